"""Distances to a few indicator vectors or centroids, clusters, and how many of them to take."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.functions import surface

#: Indicators or centroids that are sent to every task at once, about.
MOST_SMALL = 10_000


def _in_blocks(rows: DataFrame, small: DataFrame, key: str, best: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """best() over rows beside each block of the indicators, and again() over what the blocks gave where there are several.

    A block holds a bounded number of indicators, however many there are."""
    blocks = max(1, -(-small.count() // MOST_SMALL))
    if blocks == 1:
        return best(rows.crossJoin(F.broadcast(small)))  # up to MOST_SMALL rows
    place = F.pmod(F.xxhash64(key), F.lit(blocks))
    return again(reduce(DataFrame.union, [best(rows.crossJoin(F.broadcast(small.filter(place == b)))) for b in range(blocks)]))  # a block of about MOST_SMALL rows


def most_similar(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """vec_id, indicator_id, similarity: the first indicator of the largest cosine. indicators: indicator_id, v."""

    def best(both: DataFrame) -> DataFrame:
        return again(both.select("vec_id", "indicator_id", F.round(surface.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity")))

    def again(found: DataFrame) -> DataFrame:
        by = found.groupBy("vec_id").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("indicator_id")).alias("i"))).alias("x"))
        return by.select("vec_id", (-F.col("x.i")).alias("indicator_id"), F.col("x.s").alias("similarity"))

    return _in_blocks(rows.select("vec_id", "embedding"), indicators, "indicator_id", best, again)


def nearest_centroid(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, cluster, distance2. centroids: cluster, c."""

    def best(both: DataFrame) -> DataFrame:
        return again(both.select("vec_id", "cluster", F.round(surface.squared_distance(F.col("embedding"), F.col("c")), 6).alias("distance2")))

    def again(found: DataFrame) -> DataFrame:
        by = found.groupBy("vec_id").agg(F.min(F.struct(F.col("distance2").alias("d"), F.col("cluster").alias("k"))).alias("x"))
        return by.select("vec_id", F.col("x.k").alias("cluster"), F.col("x.d").alias("distance2"))

    return _in_blocks(rows.select("vec_id", "embedding"), centroids, "cluster", best, again)


def centroids_of(rows: DataFrame, label: str) -> DataFrame:
    """cluster, c: the mean vector of each label; sums by component, so partial sums are made before the shuffle."""
    parts = rows.select(F.col(label).alias("cluster"), F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("o")).select("cluster", F.transform("o", lambda x: x["m"]).alias("c"))


def variance_explained(rows: DataFrame, label: str) -> DataFrame:
    """total, within, explained: sums of squares about the mean and about the labels' means, from sums and squares only."""
    parts = rows.select(F.col(label).alias("cluster"), F.posexplode("embedding").alias("i", "x")).select("cluster", "i", F.col("x").cast("double").alias("x"))
    by = parts.groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    within = by.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"))
    total = by.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("total"))
    out = total.crossJoin(within)  # one row each
    return out.select(F.round("total", 4).alias("total"), F.round("within", 4).alias("within"), F.round(100 * (1 - F.col("within") / F.col("total")), 4).alias("explained"))


def k_means(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """vec_id, cluster."""
    data = rows.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("vec_id", F.col("prediction").alias("cluster"))


def elbow(rows: DataFrame, k_max: int = 10, step: int = 1, threshold: float = 80.0, seed: int = 42) -> DataFrame:
    """k, within, explained, chosen, passed: the first k that explains more than the threshold, else the last; passed tells
    whether a k does. One cluster needs no search: its cost is the total."""
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    total = float(variance_explained(rows.withColumn("_one", F.lit(1)), "_one").first()["total"] or 0.0)
    costs = [(k, float(KMeans(k=k, seed=seed, maxIter=20).fit(data).summary.trainingCost) if k > 1 else total) for k in range(1, k_max + 1, step)]
    data.unpersist()
    shares = [(k, c, 100 * (1 - c / total) if total else 100.0) for k, c in costs]
    first = next((k for k, _, s in shares if s > threshold), None)
    pick = shares[-1][0] if first is None else first
    return rows.sparkSession.createDataFrame([(k, c, s, k == pick, first is not None) for k, c, s in shares], "k int, within double, explained double, chosen boolean, passed boolean")


def cluster_sample(rows: DataFrame, cluster: str, most: int = 10, seed: int = 42) -> DataFrame:
    """Up to `most` rows of each cluster, the same ones each time."""
    w = Window.partitionBy(cluster).orderBy(F.md5(F.concat_ws("-", F.col("vec_id").cast("string"), F.lit(str(seed)))), "vec_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
