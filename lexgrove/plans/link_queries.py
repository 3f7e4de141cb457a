"""Queries over links, titles and the surface-form dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import surface
from lexgrove.operators import linking
from lexgrove.plans.catalogue import query

_LINKS = r"""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">[^<]*</a>')) AS link FROM pages),
links AS (SELECT page_id, regexp_extract(link, 'href="/([^"]*)"', 1) AS entity, regexp_extract(link, '>([^<]*)<', 1) AS anchor FROM found),
cleaned AS (SELECT page_id, entity, rtrim(split_part(split_part(lower(anchor), ',', 1), '(', 1), ' ') AS anchor FROM links),
forms AS (SELECT anchor, entity, count(*) AS n FROM cleaned WHERE anchor <> '' GROUP BY ALL),
ranked AS (SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, entity) AS rank, entity, n FROM forms)
"""
#: Wikitext made from the pages' links: the path's last part as title, every third page in another namespace.
_WIKI = _LINKS + r""", wiki AS (SELECT p.page_id AS id, CASE WHEN p.page_id % 3 = 0 THEN 1 ELSE 0 END AS ns,
  CASE WHEN p.page_id % 3 = 0 THEN 'Topic:' ELSE '' END || 'Page ' || p.page_id || CASE WHEN p.page_id % 4 = 0 THEN ', Place' WHEN p.page_id % 4 = 1 THEN ' (kind)' ELSE '' END AS title,
  CASE WHEN p.page_id % 7 = 0 THEN 'Page ' || (p.page_id + 1) END AS redirect,
  (SELECT string_agg(CASE WHEN length(l.entity) % 3 = 0 THEN '[[' || l.entity || ']]' WHEN length(l.entity) % 3 = 1 THEN '[[' || l.entity || '|' || 'the ' || l.anchor || ']]' ELSE '[[Category:' || l.entity || ']]' END, ' and ') FROM links l WHERE l.page_id = p.page_id) AS text FROM pages p)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    return linking.dictionary(linking.cleaned_anchor(linking.hrefs(table(spark, sf, "pages"))))


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic wikitext of the pages' links."""
    pages, links = table(spark, sf, "pages"), linking.hrefs(table(spark, sf, "pages"))
    size = F.length("entity") % 3
    link = F.when(size == 0, F.concat(F.lit("[["), F.col("entity"), F.lit("]]"))).when(size == 1, F.concat(F.lit("[["), F.col("entity"), F.lit("|"), F.lit("the "), F.col("anchor"), F.lit("]]"))).otherwise(F.concat(F.lit("[[Category:"), F.col("entity"), F.lit("]]")))
    text = links.groupBy("page_id").agg(F.array_join(F.collect_list(link), " and ").alias("text"))
    four, i = F.col("page_id") % 4, F.col("page_id")
    title = F.concat(F.when(i % 3 == 0, "Topic:").otherwise(""), F.lit("Page "), i, F.when(four == 0, ", Place").when(four == 1, " (kind)").otherwise(""))
    redirect = F.when(i % 7 == 0, F.concat(F.lit("Page "), i + 1))
    return pages.select("page_id").join(text, "page_id", "left").select(i.alias("id"), F.when(i % 3 == 0, 1).otherwise(0).alias("ns"), title.alias("title"), redirect.alias("redirect"), "text")


@query("link_pairs", _LINKS + "SELECT page_id, entity, anchor, count(*) AS n FROM links GROUP BY ALL")
def link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """S13, L8."""
    return linking.hrefs(table(spark, sf, "pages")).groupBy("page_id", "entity", "anchor").agg(F.count("*").alias("n"))


@query("surface_form_counts", _LINKS + "SELECT anchor, entity, n FROM forms")
def surface_form_counts(spark: SparkSession, sf: str) -> DataFrame:
    """L3, L4, X6, A1."""
    return _forms(spark, sf)


@query("surface_form_merge", _LINKS + "SELECT anchor, entity, (2 * n)::BIGINT AS n FROM forms")
def surface_form_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A2, U8: merging a dictionary with itself doubles its counts."""
    return linking.merged(_forms(spark, sf), _forms(spark, sf))


@query("entity_topk", _LINKS + "SELECT anchor, rank::INT AS rank, entity, n FROM ranked WHERE rank <= 2")
def entity_topk(spark: SparkSession, sf: str) -> DataFrame:
    """O1."""
    return linking.top_candidates(_forms(spark, sf), 2)


_QUERIES = "q AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+', 0)) AS query FROM benchmark)"


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("query")).distinct()


@query("entity_lookup", _LINKS + f", {_QUERIES} SELECT query, rank::INT AS rank, entity, n FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON query = anchor")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without candidates keep a row."""
    return linking.lookup(_queries(spark, sf), _forms(spark, sf), 5)


@query("entity_top1_link", _LINKS + "SELECT anchor, 'https://en.wikipedia.org/wiki/' || replace(entity, ' ', '_') AS link FROM ranked WHERE rank = 1")
def entity_top1_link(spark: SparkSession, sf: str) -> DataFrame:
    """O2, K7."""
    return linking.top_candidates(_forms(spark, sf), 1).select("anchor", surface.entity_link(F.col("entity")).alias("link"))


@query("candidate_html", _LINKS + f""", {_QUERIES}, c AS (SELECT query, rank, '<li><a href="https://en.wikipedia.org/wiki/' || replace(entity, ' ', '_') || '">' || entity || '</a> (' || n || ')</li>' AS item FROM q LEFT JOIN ranked ON query = anchor)
SELECT query, '<h4>' || query || '</h4>' || chr(10) || '<ul>' || chr(10) || coalesce(string_agg(item, chr(10) ORDER BY rank), '') || chr(10) || '</ul>' AS html FROM c GROUP BY query""")
def candidate_html(spark: SparkSession, sf: str) -> DataFrame:
    """K6."""
    return linking.candidate_html(linking.lookup(_queries(spark, sf), _forms(spark, sf)))


@query("wikitext_links", _WIKI + r""", inner_ AS (SELECT unnest(regexp_extract_all(text, '\[\[([^\[\]]*)\]\]', 1)) AS link FROM wiki WHERE redirect IS NULL),
parts AS (SELECT CASE WHEN contains(link, '|') THEN split_part(link, '|', 1) ELSE link END AS entity, CASE WHEN contains(link, '|') THEN split_part(link, '|', 2) WHEN starts_with(link, 'Category:') THEN substr(link, 10) ELSE link END AS anchor FROM inner_),
t AS (SELECT title, rtrim(split_part(split_part(CASE WHEN ns <> 0 THEN split_part(title, ':', -1) ELSE title END, ',', 1), '(', 1), ' ') AS anchor, redirect FROM wiki)
SELECT anchor, entity, count(*) AS n FROM (SELECT entity, anchor FROM parts UNION ALL SELECT title, anchor FROM t WHERE redirect IS NULL UNION ALL SELECT redirect, anchor FROM t WHERE redirect IS NOT NULL) GROUP BY ALL""")
def wikitext_links(spark: SparkSession, sf: str) -> DataFrame:
    """L1, L6, L7, L8 over synthetic wikitext."""
    return linking.dictionary(linking.page_pairs(_wiki(spark, sf)))


@query("title_cleanup", _WIKI + "SELECT id, title, rtrim(split_part(split_part(CASE WHEN ns <> 0 THEN split_part(title, ':', -1) ELSE title END, ',', 1), '(', 1), ' ') AS anchor FROM wiki")
def title_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """L2 to L4."""
    return _wiki(spark, sf).select("id", "title", surface.clean_title(F.col("title"), F.col("ns")).alias("anchor"))


@query("json_filename", "SELECT p_partkey, replace(replace(p_name || '/' || p_brand, ' ', '_'), '/', '__') || '.json' AS file FROM part")
def json_filename(spark: SparkSession, sf: str) -> DataFrame:
    """K3."""
    return table(spark, sf, "part").select("p_partkey", surface.json_filename(F.concat_ws("/", "p_name", "p_brand")).alias("file"))


@query("url_entity", _LINKS + "SELECT DISTINCT entity AS name, split_part('http://en.wikipedia.org/wiki/' || entity, 'http://en.wikipedia.org/wiki/', -1) AS entity FROM links")
def url_entity(spark: SparkSession, sf: str) -> DataFrame:
    """P10."""
    names = linking.hrefs(table(spark, sf, "pages")).select(F.col("entity").alias("name")).distinct()
    return names.select("name", surface.url_entity(F.concat(F.lit(surface.WIKI_PREFIX), F.col("name"))).alias("entity"))


@query("linking_accuracy", _LINKS + r""", gold AS (SELECT c.anchor, CASE WHEN c.page_id % 5 = 0 THEN '--NME--' ELSE c.entity END AS actual, r.entity AS predicted FROM cleaned c LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (anchor) WHERE c.anchor <> ''),
g AS (SELECT actual, coalesce(predicted, '--NME--') AS p FROM gold)
SELECT round(avg((p = actual)::INT), 6) AS accuracy, round(avg(CASE WHEN actual = '--NME--' THEN (p <> '--NME--')::INT END), 6) AS linked_without_entry, round(avg(CASE WHEN actual <> '--NME--' THEN (p = actual)::INT END), 6) AS accuracy_with_entry, count(*) AS n_mentions FROM g""")
def linking_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The link's target is the gold entity of its cleaned anchor; every fifth page has none."""
    links = linking.cleaned_anchor(linking.hrefs(table(spark, sf, "pages")))
    gold = links.withColumn("actual", F.when(F.col("page_id") % 5 == 0, surface.NO_ENTRY).otherwise(F.col("entity"))).drop("entity")
    top = linking.top_candidates(linking.dictionary(links), 1).select("anchor", F.col("entity").alias("predicted"))
    return linking.linking_accuracy(gold.join(top, "anchor", "left"), "predicted", "actual")
