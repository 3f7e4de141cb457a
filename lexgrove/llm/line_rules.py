"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go too.

Everything here is DataFrame expressions; no Python runs on executors.

Defined results: a null text counts as an empty one; an empty text has no words, fails the base rules and
isn't kept; a text of any length is read whole; repeated rows are judged one by one; an empty table gives an
empty result; columns of the input other than id, text and n_chars are not touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import SPACE, table


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; percentages are of the line's or the document's words."""

    min_words: int = 50
    max_repeat_pct: int = 50
    #: A line fails with so many symbols for 100 words.
    symbol_pct: int = 40
    #: A line fails with so many words ending in two or more exclamation or question marks.
    shout_pct: int = 40
    #: A line fails with so many separators between its entries.
    separator_pct: int = 30
    #: A line of so many words and no sentence mark at all fails.
    unpunctuated_words: int = 40
    #: A document goes if failing lines hold more than this share of its words.
    max_lost_pct: int = 30
    #: A line of up to 30 words fails if it holds one of these, compared in lower case; English, German, French and Spanish.
    boilerplate: tuple[str, ...] = field(
        default=(
            "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "accept cookies",
            "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our", "click here to",
            "skip to content", "back to top", "share this", "powered by wordpress",
            "cookie-richtlinie", "datenschutzerklärung", "alle rechte vorbehalten", "zum inhalt springen", "nach oben", "newsletter abonnieren",
            "politique de confidentialité", "tous droits réservés", "aller au contenu", "haut de page", "accepter les cookies", "conditions générales",
            "política de privacidad", "política de cookies", "todos los derechos reservados", "ir al contenido", "volver arriba", "aceptar cookies",
        )
    )

    def boilerplate_pattern(self) -> str:
        return "|".join(self.boilerplate)


def _line() -> str:
    """SQL of a struct for the line `l`, which has a word: the line and its words."""
    return r"named_struct('l', l, 'w', cast(length(regexp_replace(l, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', '~')) as bigint))"


def _passes(rules: LineRules) -> str:
    """SQL: whether the line x.l with x.w words passes all rules."""
    return rf"""(not (
        100 * length(regexp_replace(x.l, '[^#*$%&<>]+', '')) >= {rules.symbol_pct} * x.w
        or 100 * (length(x.l) - length(replace(replace(replace(replace(x.l, '|', ''), '»', ''), '›', ''), '•', ''))) >= {rules.separator_pct} * x.w
        or 100 * size(regexp_extract_all(x.l, '[!?][!?]+', 0)) >= {rules.shout_pct} * x.w
        or (x.w >= {rules.unpunctuated_words} and not rlike(x.l, '[.!?:;…。]'))
        or (x.w <= 30 and rlike(lower(x.l), '(^| )({rules.boilerplate_pattern()})'))))"""


def judged(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """row: the columns of docs, so that none of their names meets one from here; verdict: the counts, the flags, the cleaned text."""
    steps: list[tuple[str, str]] = [
        ("_w", rf"filter(split(_t, '{SPACE.replace(chr(92), chr(92) * 2)}'), v -> v <> '')"),
        ("_c", rf"regexp_replace(_t, '{SPACE.replace(chr(92), chr(92) * 2)}', '')"),
        ("_l", rf"transform(filter(split(_t, '\\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]')), l -> {_line()})"),
        ("_n", "cast(size(_w) as bigint)"),
        # one hash for each window of three words, with its place
        ("_h", "if(_n < 3, cast(array() as array<struct<h: bigint, i: int>>), transform(slice(_w, 1, size(_w) - 2), (a, i) -> named_struct('h', xxhash64(a, _w[i + 1], _w[i + 2]), 'i', i)))"),
        ("_s", "if(size(array_distinct(_h.h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), sort_array(_h))"),
        # places of the windows that occur twice or more, in order
        ("_d", "sort_array(transform(filter(_s, (x, i) -> x.h <=> get(_s, i + 1).h or x.h <=> get(_s, i - 1).h), x -> x.i))"),
        ("_r", "if(size(_d) = 0, 0L, aggregate(transform(_d, (p, i) -> least(coalesce(get(_d, i + 1) - p, 3), 3)), 0L, (s, v) -> s + v))"),
        ("_k", f"filter(_l, x -> {_passes(rules)})"),
        ("_lost", "_n - aggregate(_k, 0L, (s, x) -> s + x.w)"),
        ("_b", f"_n < {rules.min_words} or 100 * _r > {rules.max_repeat_pct} * _n"),
    ]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    for name, sql in steps:
        out = out.withColumn(name, F.expr(sql))
    verdict: list[Column] = [
        F.col("_n").alias("n_words"),
        F.expr("cast(length(_c) as bigint)").alias("word_chars"),
        F.expr("cast(length(regexp_replace(_c, '[^#*$%&|<>]+', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l.l)) as bigint)").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"),
        F.col("_b").alias("base_failed"),
        F.expr(f"not _b and 100 * _lost <= {rules.max_lost_pct} * _n").alias("kept"),
        F.col("_lost").alias("n_lost_words"),
        F.expr("array_join(_k.l, '\\n')").alias("clean_text"),
    ]
    return out.select("row", F.struct(*verdict).alias("verdict"))


def line_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row for each document: id, counts, base_failed, kept, n_lost_words, clean_text."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return judged(source, rules=rules).select("row.doc_id", "verdict.*")


def keep_passing(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, without their failing lines, with the columns they came with. A text without failing lines
    stays as it is; n_chars follows the text where it is a column of integers."""
    # the generator keeps the optimizer from evaluating the rules again inside a pushed filter
    out = judged(docs, text, rules).withColumn("verdict", F.explode(F.array("verdict"))).filter("verdict.kept")
    cut = F.col("verdict.n_lost_words") > 0
    columns = []
    for f in docs.schema.fields:
        column = F.col(f"row.`{f.name}`")
        if f.name == text:
            column = F.when(cut, F.col("verdict.clean_text")).otherwise(column)
        elif f.name == "n_chars" and isinstance(f.dataType, (T.LongType, T.IntegerType)):
            column = F.when(cut, F.length("verdict.clean_text")).otherwise(column).cast(f.dataType)
        columns.append(column.alias(f.name))
    return out.select(*columns)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first(table(spark, sf_dir, "documents")).drop("clean_text")


def _sql(rules: LineRules = LineRules()) -> str:
    w, s = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '{w}') AS w, regexp_replace(text, '{s}', '', 'g') AS c,
  list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{w}')), lambda l: {{'l': l, 'w': len(regexp_extract_all(l, '{w}'))}}) AS ls FROM t),
b AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM a),
h AS (SELECT doc_id, g, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS i FROM b)),
d AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3), 3) AS c FROM h WHERE n > 1),
r AS (SELECT doc_id, sum(c) AS r FROM d GROUP BY doc_id),
k AS (SELECT doc_id, w, c, ls, coalesce(r, 0) AS r, list_sum(list_transform(list_filter(ls, lambda x:
    100 * (length(x.l) - length(translate(x.l, '#*$%&<>', ''))) >= {rules.symbol_pct} * x.w
    OR 100 * (length(x.l) - length(translate(x.l, '|»›•', ''))) >= {rules.separator_pct} * x.w
    OR 100 * len(regexp_extract_all(x.l, '[!?][!?]+')) >= {rules.shout_pct} * x.w
    OR (x.w >= {rules.unpunctuated_words} AND NOT regexp_matches(x.l, '[.!?:;…。]'))
    OR (x.w <= 30 AND regexp_matches(lower(x.l), '(^| )({rules.boilerplate_pattern()})'))), lambda x: x.w)) AS lost
  FROM b LEFT JOIN r USING (doc_id)),
v AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(c)::BIGINT AS word_chars, (length(c) - length(translate(c, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(list_transform(ls, lambda x: x.l))))::BIGINT AS n_dup_lines, r::BIGINT AS n_repeat_words,
  len(w) < {rules.min_words} OR 100 * r > {rules.max_repeat_pct} * len(w) AS base_failed, coalesce(lost, 0)::BIGINT AS n_lost_words FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {rules.max_lost_pct} * n_words AS kept, n_lost_words FROM v"""


#: For DuckDB; compares whole windows, so it takes no hash for equality.
ORACLE = _sql()
