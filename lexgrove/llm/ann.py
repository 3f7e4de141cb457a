"""Nearest neighbours by inner product: adaptive dimension scan inside the probed lists of an inverted file.

Vectors are turned by a random rotation and read in blocks of columns. After each block a hypothesis test compares what a
candidate's distance would be, scaled up from the columns read, with the distance of the k-th best so far; candidates
that fail are left. Lists come from centres fitted on a bounded sample; every vector is in one list, and lists
and queries are dealt in parts of a bounded size, so a hot list never meets in one task.

The number of probed lists is the smallest whose recall on the sample, against a scan of all of it, reaches a target.

Defined results: vectors that are null, zero, hold null or non-finite components, have no id, or another number of
components than most, take no part; with fewer candidates than k all are returned; ties go to the smaller id; repeated
rows are candidates each, but none is its own id's neighbour, and equal rows ask once; where rows of one id have several vectors, a
query's answer is the nearest of all of them; ids are integers; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.llm.common import table

#: Vectors that fit the centres; the index itself holds every vector.
SAMPLE = 20_000
#: Queries of the sample that choose the number of probed lists.
PROBE_QUERIES = 200
#: Vectors, and queries, that one task holds of one list.
PART = 4096
#: Below this share of open pairs, a tile goes on with the open pairs alone.
FEW_OPEN = 0.02


@dataclass
class Lists:
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1) if len(x) else np.zeros(0, int)

    def probed(self, q: np.ndarray) -> np.ndarray:
        near = q @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.probes]


def fit_lists(x: np.ndarray, n: int, k: int, target: float = 0.985, seed: int = 7) -> Lists:
    """x: the sample, n: vectors in all. Lists grow with the square root of n."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    count = int(min(4096, max(1, len(x) // 8), max(1, n**0.5 / 4)))
    centres = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(8):
        at = Lists(rotation, centres, 1).assign(x)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        sizes = np.bincount(at, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    lists = Lists(rotation, centres, count)
    queries = x[rng.permutation(len(x))[:PROBE_QUERIES]]
    best = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, : k + 1]
    homes, order = lists.assign(x)[best], np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(rank, homes, 1).ravel())
    lists.probes = int(min(count, needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] + 1))
    return lists


def scan(q: np.ndarray, qr: np.ndarray, q_ids: np.ndarray, x: np.ndarray, xr: np.ndarray, ids: np.ndarray, k: int, step: int = 16, slack: float = 3.0, tile: int = 64) -> Iterator[tuple[int, int, float]]:
    """(query, vector, score) of each query's k best. qr and xr: rotated; x: original, in double precision.

    Each pair of a query and a vector is abandoned when its own test fails; a tile of queries reads columns together while many
    pairs are open.
    """
    d = x.shape[1]
    order = np.argsort(-(xr**2).sum(1), kind="stable")
    x, xr, ids = x[order], xr[order], ids[order]
    ends = [*range(min(step, d), d, step), d]
    x_norms = np.stack([(xr[:, :e] ** 2).sum(1) for e in ends])
    head = min(len(x), 4 * k)
    for a in range(0, len(q), tile):
        t, own = qr[a : a + tile], q_ids[a : a + tile]
        scores = t @ xr[:head].T
        scores[own[:, None] == ids[:head]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k] if head >= k else np.full(len(t), -np.inf)
        floor = np.where(np.isfinite(floor), floor, -1e300)
        # a pair of a query and a vector that fails the test is abandoned, for this query alone; while many pairs are open, a block of
        # columns is read for the whole tile, later for the open pairs only
        norms = np.stack([(t[:, :e] ** 2).sum(1) for e in ends])
        alive, open_ = np.arange(len(x)), own[:, None] != ids
        dense = np.zeros((len(t), len(x)))
        row = column = part = None
        for i, e in enumerate(ends):
            c = slice(ends[i - 1] if i else 0, e)
            if row is None:
                dense += t[:, c] @ xr[alive, c].T
            else:
                part = part + np.einsum("ij,ij->i", t[row, c], xr[column, c])
            if e == d:
                break
            # the distance of a vector as near as the k-th best follows from its norm and the query's
            bound = (1 + slack / np.sqrt(e)) ** 2
            if row is None:
                limit = norms[-1][:, None] + x_norms[-1][alive] - 2 * floor[:, None]
                far = norms[i][:, None] + x_norms[i][alive] - 2 * dense
                open_ &= far * (d / e) <= bound * limit + 1e-9
                if open_.mean() < FEW_OPEN:
                    row, at = np.nonzero(open_)
                    column, part = alive[at], dense[row, at]
                elif (some := open_.any(0)).mean() < 0.8:
                    alive, dense, open_ = alive[some], dense[:, some], open_[:, some]
            else:
                limit = norms[-1][row] + x_norms[-1][column] - 2 * floor[row]
                near = (norms[i][row] + x_norms[i][column] - 2 * part) * (d / e) <= bound * limit + 1e-9
                row, column, part = row[near], column[near], part[near]
        if row is None:
            row, at = np.nonzero(open_ & (dense >= (floor - 1e-9 * (1 + abs(floor) * (floor > -1e300)))[:, None]))
            column, part = alive[at], dense[row, at]
        near = part >= floor[row] - 1e-9 * (1 + abs(floor[row]) * (floor[row] > -1e300))  # a little below the k-th, as rotating rounds
        row, found = row[near], column[near]
        exact = (x[found] * q[a + row]).sum(1)
        best = np.lexsort((ids[found], -exact, row))
        first = np.searchsorted(row[best], np.arange(len(t)))
        for j, r in enumerate(row[best]):
            if j - first[r] < k:
                yield int(own[r]), int(ids[found[best[j]]]), float(exact[best[j]])


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    source = source.filter("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = source.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["count"]
    source = source.filter(F.size("v") == d)
    drawn = source.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(sample).toPandas()
    lists = fit_lists(np.array(drawn["v"].tolist(), float).reshape(len(drawn), d), n, k)
    sent = spark.sparkContext.broadcast(lists)  # at most 4096 centres and a rotation

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist(), float).reshape(len(b), d)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "list": sent.value.assign(x).astype(np.int32), "probes": list(sent.value.probed(x).astype(np.int32)) if (b["vec_id"] % every == 0).any() else [np.zeros(0, np.int32)] * len(b)})

    dealt = source.mapInPandas(deal, "vec_id long, v array<double>, list int, probes array<int>")
    asked = dealt.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.explode("probes").alias("list"))
    # parts of a list and of its queries: two counts for each of at most 4096 lists
    parts = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}
    turns = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    count = lambda of: F.create_map(*(F.lit(int(y)) for l, c in of.items() for y in (l, -(-c // PART)))) if of else F.create_map(F.lit(-1), F.lit(1))  # noqa: E731, E741
    n_parts, n_turns = F.coalesce(count(parts)[F.col("list")], F.lit(1)), F.coalesce(count(turns)[F.col("list")], F.lit(1))
    place = lambda many, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), many).cast("int")
    held = dealt.select("vec_id", "v", "list", place(n_parts, 1).alias("part"), F.explode(F.sequence(F.lit(0), n_turns - 1)).alias("turn"))
    asked = asked.select("vec_id", "v", "list", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), place(n_turns, 2).alias("turn"))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(q) or not len(x):
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        qv, xv = (np.array(y["v"].tolist(), float).reshape(len(y), d) for y in (q, x))
        turned = sent.value.rotation
        return pd.DataFrame(scan(qv, qv @ turned, q["vec_id"].to_numpy(), xv, xv @ turned, x["vec_id"].to_numpy(), k), columns=columns)

    keys = ["list", "part", "turn"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
