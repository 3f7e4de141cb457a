"""Synthetic annotations of plain documents, derived by rules, so that sequence operators have an input.

Lines are sentences and maximal runs of non-blank characters are tokens. Parts of speech and entity types come from rules
on the token's form; they stand in for annotated corpora and say nothing about language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TYPES = ("LOC", "MISC", "ORG", "PER")
SENTENCE = ("doc_id", "sent_id")
TOKEN = r"[^\x20\x09-\x0D]+"


def sentences(docs: DataFrame, text: str = "text", *others: str) -> DataFrame:
    return docs.select("doc_id", *others, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("sent_id", "line"))


def tokens(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, sent_id, tok_id, token; ids count from 0."""
    lines = sentences(docs, "text", *others)
    return lines.select("doc_id", *others, "sent_id", F.posexplode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("tok_id", "token"))


def sentences_of(text: Column) -> Column:
    """Sentences of running text: cut at white space behind a full stop, exclamation or question mark. A substitute by rule."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01"), lambda x: x != "")


def words_of(sentence: Column) -> Column:
    """Words, marks and clitics of a sentence as tokens of their own. A substitute by rule for treebank tokenizing."""
    apart = F.regexp_replace(sentence, r"([Nn]'[Tt])([^\p{L}\p{N}]|$)", " $1 $2")
    apart = F.regexp_replace(apart, r"([\p{L}\p{N}])('(?:[sS]|[dD]|[mM]|[lL][lL]|[rR][eE]|[vV][eE]))([^\p{L}\p{N}]|$)", "$1 $2 $3")
    apart = F.regexp_replace(apart, r"([^\p{L}\p{N}\x20\x09-\x0D'_])", " $1 ")
    return F.regexp_extract_all(apart, F.lit(TOKEN), F.lit(0))


def part_of_speech(token: Column) -> Column:
    low = F.lower(token)
    return (
        F.when(token.rlike("^[0-9]"), "CD")
        .when(low.isin("the", "a", "an"), "DT")
        .when(low.isin("of", "in", "on", "at", "for", "with", "by", "from"), "IN")
        .when(low.isin("and", "or", "but"), "CC")
        .when(token.rlike(r"^\p{Lu}"), "NNP")
        .when(low.endswith("ing") | low.endswith("ed"), "VB")
        .otherwise("NN")
    )


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or SENTENCE)).orderBy("tok_id")


def with_runs(rows: DataFrame, value: str, name: str = "run_id", keys: tuple[str, ...] = SENTENCE) -> DataFrame:
    """Numbers, within each sentence, the maximal runs of equal neighbours in a column."""
    w = in_order(*keys)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("_new", new.cast("int")).withColumn(name, (F.sum("_new").over(w) - 1).cast("int")).drop("_new")


#: Names of the codes of Annotated.
TAGS = ("CC", "CD", "DT", "IN", "NN", "NNP", "VB")
NERS = ("O", *(f"I-{t}" for t in TYPES))
PROPER = TAGS.index("NNP")
#: Bytes of text that a worker annotates at once, and words whose part of speech it keeps.
SLICE_BYTES, MOST_WORDS = 2_000_000, 300_000
_DETERMINERS, _PREPOSITIONS, _CONJUNCTIONS = {"the", "a", "an"}, {"of", "in", "on", "at", "for", "with", "by", "from"}, {"and", "or", "but"}


class Tags(dict):
    """The code of a word's part of speech, as part_of_speech has it; words are bytes in UTF-8."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        text = word.decode()
        low = text.lower()
        if "0" <= text[0] <= "9":
            name = "CD"
        elif low in _DETERMINERS:
            name = "DT"
        elif low in _PREPOSITIONS:
            name = "IN"
        elif low in _CONJUNCTIONS:
            name = "CC"
        elif unicodedata.category(text[0]) == "Lu":
            name = "NNP"
        else:
            name = "VB" if low.endswith(("ing", "ed")) else "NN"
        code = self[word] = TAGS.index(name)
        return code


def run_starts(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where maximal runs of equal neighbours start; a run ends with its sentence. first: where sentences start."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first] = True
    return np.flatnonzero(new)


class Annotated:
    """The annotations of some documents, flat: words, tags, ner (codes) by token; doc, sent_id by sentence with words, whose tokens
    are those from first[i] to first[i + 1] - 1."""

    def __init__(self, texts: list[bytes | None], turns: np.ndarray, tags: Tags) -> None:
        self.n_docs, self.words = len(texts), []
        doc, number, size = [], [], []
        for d, text in enumerate(texts):
            text = text or b""
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            for i, line in enumerate(text.split(b"\n")):
                if words := line.split():  # of bytes: at the six characters that TOKEN leaves out
                    doc.append(d)
                    number.append(i)
                    size.append(len(words))
                    self.words += words
        self.doc, self.sent_id = np.array(doc, np.int64), np.array(number, np.int32)
        self.sizes = np.array(size, np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.tags = np.fromiter(map(tags.__getitem__, self.words), np.int8, len(self.words))
        starts = run_starts(self.tags, self.first[:-1])
        self.proper = starts[self.tags[starts] == PROPER]  # the entities' first tokens
        self.of_sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        code = np.array([w[0] if w[0] < 128 else ord(w.decode()[0]) for w in map(self.words.__getitem__, self.proper.tolist())], np.int64)
        kind = np.zeros(len(starts), np.int8)
        kind[self.tags[starts] == PROPER] = (code + turns[self.doc[self.of_sentence[self.proper]]]) % 4 + 1
        self.ner = np.repeat(kind, np.diff(np.r_[starts, len(self.words)]))

    def of_document(self) -> np.ndarray:
        """The document of each token."""
        return self.doc[self.of_sentence]

    def places(self) -> np.ndarray:
        """tok_id of each token."""
        return (np.arange(len(self.words)) - np.repeat(self.first[:-1], self.sizes)).astype(np.int32)

    def entities(self) -> np.ndarray:
        """The number of each token's entity in its document, from 0; -1 outside."""
        starts = np.zeros(len(self.words), np.int64)
        starts[self.proper] = 1
        whole = np.r_[0, np.cumsum(starts)]
        before = whole[self.first[np.searchsorted(self.doc, np.arange(self.n_docs))]]  # of each document
        return np.where(self.ner > 0, whole[1:] - before[self.of_document()] - 1, -1)


def named(codes: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    return pa.array(names).take(pa.array(codes))


def text_array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def mapped(docs: DataFrame, run: Callable[[pa.RecordBatch, Annotated], Iterable[pa.Array]], schema: str, *others: str) -> DataFrame:
    """A table of the columns that `run` makes of some documents and their annotations; documents are taken as they come, so there
    is no shuffle. run: gets the columns doc_id and others as Arrow has them. schema: in it, {id} is the type of doc_id."""
    schema = schema.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.name for x in T._parse_datatype_string(schema).fields]
    keep = ("doc_id", *others)

    def annotated_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = Tags()
        for whole in batches:
            texts = whole.column("_text")
            total = np.r_[0, np.cumsum(np.array(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))]
            a = 0
            while a < whole.num_rows:
                b = max(a + 1, int(np.searchsorted(total, total[a] + SLICE_BYTES, "right")) - 1)
                some = whole.slice(a, b - a)
                turns = np.array(some.column("_turn"))
                found = Annotated(some.column("_text").to_pylist(), turns, tags)
                yield pa.RecordBatch.from_arrays(list(run(some.select(keep), found)), names=names)
                a = b

    turn = F.when(F.col("source") == "src0", 1).otherwise(0)
    return docs.select(*keep, turn.alias("_turn"), F.col("text").cast("binary").alias("_text")).mapInArrow(annotated_batches, schema)


def annotated(docs: DataFrame) -> DataFrame:
    """doc_id, source, sent_id, tok_id, token, pos, ner. A whole run of proper nouns is one entity, typed by its first token.

    Runs are maximal, so no two entities of a sentence touch and none needs a B- tag. Documents are annotated whole, so there is no
    shuffle; Python, as lambdas of built-in functions took several times as long and copied a line for each of its runs."""

    def run(batch: pa.RecordBatch, x: Annotated) -> Iterable[pa.Array]:
        doc = pa.array(x.of_document())
        return batch.column("doc_id").take(doc), batch.column("source").take(doc), pa.array(x.sent_id[x.of_sentence]), pa.array(x.places()), text_array(x.words), named(x.tags, TAGS), named(x.ner, NERS)

    return mapped(docs, run, "doc_id {id}, source string, sent_id int, tok_id int, token string, pos string, ner string", "source")


def _lists(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def annotated_sentences(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, others, sent_id, t, p, n: of each sentence with tokens, its tokens, their parts of speech and entity tags as arrays."""

    def run(batch: pa.RecordBatch, x: Annotated) -> Iterable[pa.Array]:
        doc = pa.array(x.doc)
        return *(c.take(doc) for c in batch.columns), pa.array(x.sent_id), _lists(x.first, text_array(x.words)), _lists(x.first, named(x.tags, TAGS)), _lists(x.first, named(x.ner, NERS))

    more = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in others)
    return mapped(docs, run, f"doc_id {{id}}, {more}sent_id int, t array<string>, p array<string>, n array<string>", *others)


def annotated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, s: the document's sentences with tokens in order, each as sent_id, t, p, n like annotated_sentences."""

    def run(batch: pa.RecordBatch, x: Annotated) -> Iterable[pa.Array]:
        ends = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
        parts = pa.StructArray.from_arrays([pa.array(x.sent_id), _lists(x.first, text_array(x.words)), _lists(x.first, named(x.tags, TAGS)), _lists(x.first, named(x.ner, NERS))], ["sent_id", "t", "p", "n"])
        return batch.column("doc_id"), _lists(ends, parts)

    return mapped(docs, run, "doc_id {id}, s array<struct<sent_id: int, t: array<string>, p: array<string>, n: array<string>>>").filter("size(s) > 0")


def split_of(doc_id: Column) -> Column:
    return F.when(doc_id % 10 < 7, "train").when(doc_id % 10 == 7, "validation").otherwise("test")


#: The same for DuckDB, as the first common table expressions of a query: lines_, toks, ann.
SQL = r"""
WITH lines_ AS (SELECT doc_id, source, unnest(s) AS line, (unnest(range(len(s))))::INT AS sent_id FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
toks AS (SELECT doc_id, source, sent_id, unnest(w) AS token, (unnest(range(len(w))))::INT AS tok_id FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines_)),
pos_ AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9]') THEN 'CD' WHEN lower(token) IN ('the', 'a', 'an') THEN 'DT'
  WHEN lower(token) IN ('of', 'in', 'on', 'at', 'for', 'with', 'by', 'from') THEN 'IN' WHEN lower(token) IN ('and', 'or', 'but') THEN 'CC'
  WHEN regexp_matches(token, '^\p{Lu}') THEN 'NNP' WHEN lower(token) LIKE '%ing' OR lower(token) LIKE '%ed' THEN 'VB' ELSE 'NN' END AS pos FROM toks),
new_ AS (SELECT *, CASE WHEN lag(pos) OVER w IS NOT DISTINCT FROM pos THEN 0 ELSE 1 END AS new_run FROM pos_ WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id)),
run_ AS (SELECT *, sum(new_run) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS run_id FROM new_),
kind_ AS (SELECT *, CASE WHEN pos = 'NNP' THEN ['LOC', 'MISC', 'ORG', 'PER'][(unicode(first_value(token) OVER (PARTITION BY doc_id, sent_id, run_id ORDER BY tok_id)) + CASE WHEN source = 'src0' THEN 1 ELSE 0 END) % 4 + 1] END AS kind FROM run_),
ann AS (SELECT doc_id, source, sent_id, tok_id, token, pos, CASE WHEN kind IS NULL THEN 'O' ELSE 'I-' || kind END AS ner FROM kind_)"""
