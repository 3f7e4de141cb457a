"""Queries over vectors, clusters and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators import metrics, triples, vectors
from lexgrove.plans.catalogue import query
from lexgrove.plans.link_queries import table

_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings)"


@query("cosine_argmax", f"WITH {_V}, i AS (SELECT vec_id AS indicator_id, a AS b FROM v WHERE vec_id < 5), s AS (SELECT vec_id, indicator_id, round({_COS}, 6) AS similarity FROM v, i) SELECT vec_id, indicator_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, indicator_id) AS r FROM s) WHERE r = 1")
def cosine_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Five indicator vectors."""
    rows = table(spark, sf, "embeddings")
    return vectors.most_similar(rows, rows.filter("vec_id < 5").select(F.col("vec_id").alias("indicator_id"), F.col("embedding").alias("v")))


_SS = f"""WITH {_V}, x AS (SELECT label, unnest(a) AS x, unnest(range(len(a))) AS i FROM v), t AS (SELECT sum(q - s * s / n) AS total FROM (SELECT i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY i)),
w AS (SELECT sum(q - s * s / n) AS within FROM (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY label, i))"""


@query("variance_explained", _SS + " SELECT round(total, 4) AS total, round(within, 4) AS within, round(100 * (1 - within / total), 4) AS explained FROM t, w")
def variance_explained(spark: SparkSession, sf: str) -> DataFrame:
    """A19."""
    return vectors.variance_explained(table(spark, sf, "embeddings"), "label")


_MEAN = f"WITH {_V}, x AS (SELECT label, unnest(a) AS x, unnest(range(len(a))) AS i FROM v), m AS (SELECT label AS cluster, list(m ORDER BY i) AS b FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) GROUP BY label), near AS (SELECT vec_id, label, cluster, distance2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance2, cluster) AS r FROM (SELECT vec_id, label, cluster, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance2 FROM v, m)) WHERE r = 1)"


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return vectors.nearest_centroid(rows, vectors.centroids_of(rows, "label"))


@query("nearest_centroid", _MEAN + " SELECT vec_id, cluster, round(distance2, 5) AS distance2 FROM near")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """One step of assignment to the labels' means."""
    return _nearest(spark, sf).withColumn("distance2", F.round("distance2", 5))


@query("cluster_label_mode", _MEAN + " SELECT cluster, label FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS r FROM near GROUP BY cluster, label) WHERE r = 1")
def cluster_label_mode(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    rows = _nearest(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("gold")), "vec_id")
    return metrics.most_frequent(rows, ["cluster"], "gold", "label")


@query("cluster_sample", _MEAN + " SELECT vec_id, cluster FROM (SELECT vec_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY md5(vec_id || '-42'), vec_id) AS r FROM near) WHERE r <= 10")
def cluster_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O7."""
    return vectors.cluster_sample(_nearest(spark, sf), "cluster").select("vec_id", "cluster")


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster sizes."""
    return vectors.k_means(table(spark, sf, "embeddings"), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("elbow_k")
def elbow_k(spark: SparkSession, sf: str) -> DataFrame:
    """X17, O6."""
    return vectors.elbow(table(spark, sf, "embeddings"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return triples.star_facts(table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer"))


@query("triple_pattern", "SELECT 'nation:' || c_nationkey AS nation, count(*)::VARCHAR AS count FROM customer GROUP BY c_nationkey")
def triple_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """J10, M17."""
    return triples.match(_facts(spark, sf), ("?nation", "population", "?count"))


@query("triple_two_hop", "SELECT 'customer:' || c_custkey AS customer, 'nation:' || n_nationkey AS nation, 'region:' || r_regionkey AS region, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def triple_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Three patterns joined on shared variables."""
    return triples.match(_facts(spark, sf), ("?customer", "inNation", "?nation"), ("?nation", "inRegion", "?region"), ("?region", "label", "?name"))


@query("triple_lookup_text", "SELECT format('{:,}', count(*)) AS count FROM customer WHERE c_nationkey = 3")
def triple_lookup_text(spark: SparkSession, sf: str) -> DataFrame:
    """One bound subject, the answer with thousands separators."""
    found = triples.match(_facts(spark, sf), ("nation:3", "population", "?count"))
    return found.select(F.format_number(F.col("count").cast("long"), 0).alias("count"))
