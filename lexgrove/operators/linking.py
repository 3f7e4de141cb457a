"""Surface-form dictionary: link extraction, counting, merging, top-k candidates and their presentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions import surface


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, entity (the target), anchor: one row for each plain link of a page's html."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">[^<]*</a>'), F.lit(0))).alias("link"))
    return found.select("page_id", F.regexp_extract("link", 'href="/([^"]*)"', 1).alias("entity"), F.regexp_extract("link", ">([^<]*)<", 1).alias("anchor"))


def cleaned_anchor(links: DataFrame) -> DataFrame:
    """Anchors in lower case, cut at a comma or parenthesis, so that different entities meet."""
    anchor = surface.before_parenthesis(surface.before_comma(F.lower("anchor")))
    return links.withColumn("anchor", anchor).filter("anchor <> ''")


def _parts(links: DataFrame) -> DataFrame:
    """Links of one or two parts; a category's anchor loses its prefix."""
    parts = F.split("link", r"\|")
    one = F.when(F.col("link").startswith("Category:"), F.substring_index("link", "Category:", -1)).otherwise(F.col("link"))
    return links.filter(F.size(parts) <= 2).select("id", parts[0].alias("entity"), F.when(F.size(parts) == 1, one).otherwise(F.get(parts, F.lit(1))).alias("anchor"))


def wikilinks(pages: DataFrame, nested: bool = False) -> DataFrame:
    """id, entity, anchor of [[entity|anchor]] links. The plain form finds innermost links with built-in expressions;
    nested finds links around links as well, by a scan of brackets in Python."""
    if nested:

        @F.pandas_udf("array<string>")
        def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield batch.map(bracketed)

        links = pages.select("id", F.explode(scan(F.col("text"))).alias("link"))
    else:
        links = pages.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1))).alias("link"))
    return _parts(links)


def bracketed(text: str | None) -> list[str]:
    """The contents of all [[...]], inner ones too, in the order they close."""
    out, open_, i = [], [], 0
    text = text or ""
    while i < len(text) - 1:
        pair = text[i : i + 2]
        if pair == "[[":
            open_.append(i + 2)
        elif pair == "]]" and open_:
            out.append(text[open_.pop() : i])
        else:
            i += 1
            continue
        i += 2
    return out


def malformed_links(pages: DataFrame) -> DataFrame:
    """Links of more than two parts, which the dictionary leaves out."""
    links = pages.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1))).alias("link"))
    return links.filter(F.size(F.split("link", r"\|")) > 2)


def page_pairs(pages: DataFrame, nested: bool = False, compat: bool = False) -> DataFrame:
    """entity, anchor of pages (title, ns, id, redirect, text): a redirect gives its one pair, another page its title and links."""
    title, ns = F.col("title"), F.col("ns")
    redirects = pages.filter("redirect is not null").select(F.col("redirect").alias("entity"), surface.clean_redirect(title, ns, compat).alias("anchor"))
    rest = pages.filter("redirect is null")
    titles = rest.select(title.alias("entity"), surface.clean_title(title, ns, compat).alias("anchor"))
    return redirects.union(titles).union(wikilinks(rest, nested).select("entity", "anchor"))


def dictionary(pairs: DataFrame) -> DataFrame:
    """anchor, entity, n. Counting is partial in each task before the one shuffle."""
    return pairs.groupBy("anchor", "entity").agg(F.count("*").alias("n"))


def merged(*dictionaries: DataFrame) -> DataFrame:
    out = dictionaries[0].select("anchor", "entity", "n")
    for d in dictionaries[1:]:
        out = out.unionByName(d.select("anchor", "entity", "n"))
    return out.groupBy("anchor", "entity").agg(F.sum("n").alias("n"))


def top_candidates(counts: DataFrame, k: int = -1) -> DataFrame:
    """anchor, rank, entity, n: the k most frequent entities, ties by name; k = -1 gives all."""
    if k < -1:
        raise ValueError("k is -1 for all, or the number of candidates")
    w = Window.partitionBy("anchor").orderBy(F.desc("n"), "entity")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return (ranked if k == -1 else ranked.filter(F.col("rank") <= k)).select("anchor", "rank", "entity", "n")


def lookup(queries: DataFrame, counts: DataFrame, k: int = -1) -> DataFrame:
    """query, rank, entity, n; a query without candidates keeps one row of NULLs. Only the queried anchors are ranked."""
    wanted = counts.join(queries.select(F.col("query").alias("anchor")).distinct(), "anchor", "left_semi")
    return queries.join(top_candidates(wanted, k).withColumnRenamed("anchor", "query"), "query", "left")


def candidate_html(found: DataFrame) -> DataFrame:
    """query, html: a heading and the list of candidates with their counts; without candidates the list is empty."""
    item = F.concat(F.lit('<li><a href="'), surface.entity_link(F.col("entity")), F.lit('">'), F.col("entity"), F.lit("</a> ("), F.col("n").cast("string"), F.lit(")</li>"))
    rows = found.groupBy("query").agg(F.sort_array(F.collect_list(F.when(F.col("entity").isNotNull(), F.struct("rank", item.alias("item"))))).alias("items"))
    return rows.select("query", F.concat(F.lit("<h4>"), F.col("query"), F.lit("</h4>\n<ul>\n"), F.array_join(F.transform("items", lambda x: x["item"]), "\n"), F.lit("\n</ul>")).alias("html"))


def write_dictionary(counts: DataFrame, path: str) -> None:
    """A table sorted by anchor within its files, so that a lookup skips most of them."""
    counts.repartitionByRange("anchor").sortWithinPartitions("anchor").write.mode("overwrite").parquet(path)


def upsert(path: str, more: DataFrame, to: str) -> None:
    """Adds counts to a stored dictionary and writes the result to another path."""
    write_dictionary(merged(more.sparkSession.read.parquet(path), more), to)


def linking_accuracy(gold: DataFrame, predicted: str, actual: str) -> DataFrame:
    """accuracy over all mentions, the share of mentions without an entry that got a link, accuracy over linked mentions."""
    p, a, none = F.coalesce(F.col(predicted), F.lit(surface.NO_ENTRY)), F.col(actual), surface.NO_ENTRY
    rows = gold.filter(a.isNotNull())
    return rows.agg(
        F.round(F.avg((p == a).cast("int")), 6).alias("accuracy"),
        F.round(F.avg(F.when(a == none, (p != none).cast("int"))), 6).alias("linked_without_entry"),
        F.round(F.avg(F.when(a != none, (p == a).cast("int"))), 6).alias("accuracy_with_entry"),
        F.count("*").alias("n_mentions"),
    )
