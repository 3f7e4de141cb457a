"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets of five-word shingles with a similarity of 3/4 or more differ in few shingles: with r the largest size of a band, in
2r/7 at most. The shingle domain is cut into n1 parts and each part into n2 sub-parts; sets that differ so little agree, in
some part, on all but one sub-part. A signature is what a set holds in n2 - 1 sub-parts of one part, so similar sets share
one. n1 is above the least that this needs, so that parts whose signatures would be empty can be left out, as long as
enough others remain; where they don't, empty ones are given too, so no link is lost.

Before that, a document goes no further if over a quarter of its shingles occur in no other document: it has no link.
Equal sets become one. Candidates are verified on whole sets: first each set with the pivot that it shares most buckets
with; then, within families, blocks of a family meet, and sets of different components are compared there. Families are
what pairs connect that share a bucket and whose sketches (48 minima of 8 bits) agree in 10 places or more; a pair of
similarity 3/4 fails that with a probability of about 4e-16, less than two of its shingles have of sharing a hash. A set of a
family is copied once for each of its blocks, so this is quadratic in the size of a family that stays open, by a factor of
about 1/200; no pairs are written.

Defined results: a document without words, or with a null or empty text, has 0 shingles and its own id as component; with
fewer than five words the whole sequence is one shingle; texts of any length are read whole; repeated rows are linked; ids are of
any atomic type, and the smallest is by its order; a null id has no links and a null component; an empty table gives an empty
result; other columns of the input are not read, or pass through one_of_each, whatever their names. Of each group one_of_each
keeps the row with the smallest id, the first one where rows share it; rows of one id without a link all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrove.llm import blocks as B
from lexgrove.llm.common import dropped, let_go, stored, table, tidy, tidy_both

SHINGLE = 5
#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
SUBPARTS = 3
SLACK = 1.25
SKETCH, AGREE = 48, 10
_SEEDS = B.mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
#: A block of a family holds about so many shingles and sets at most.
BLOCK_SHINGLES, BLOCK_SETS = 30_000, 200
#: Signatures that one task puts into buckets, about.
PART_SIGNATURES = 800_000
#: The edges of a node are dealt to so many tasks.
SALTS = 8
#: Shuffle partitions that make one file of the tables of pairs and sets.
SHRINK = 8
#: Bits of a shingle's hash that are left out where it is only asked whether it occurs elsewhere.
SHORT = np.uint64(16)
U = np.uint64


def shingles(ids: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a document's word ids."""
    if not len(ids):
        return np.zeros(0, U)
    return B.distinct(B.windows(ids, min(SHINGLE, len(ids)), seed=min(SHINGLE, len(ids))))


@lru_cache(maxsize=100_000)
def band_of(size: int) -> tuple[int, int, int]:
    """Number of the size's band, the band's largest size, and the next band's."""
    number, low = 0, 1
    while True:
        high = low * 100 // PERCENT
        if size <= high:
            return number, high, (high + 1) * 100 // PERCENT
        number, low = number + 1, high + 1


def signatures(keys: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a set, for its own size band and the next."""
    number, high, higher = band_of(len(keys))
    return np.concatenate([_signatures(keys, number, high), _signatures(keys, number + 1, higher)])


def _signatures(keys: np.ndarray, band: int, largest: int) -> np.ndarray:
    differ = largest * 2 * (100 - PERCENT) // (100 + PERCENT)
    # with fewer than n1 - differ // 2 parts spoilt by two differences or more, the others agree in two sub-parts
    n1 = max(1, int((differ // 2 + 1) * SLACK))
    place = B.mixed(keys + U(band + 1))
    part = ((place >> U(40)) * U(n1) >> U(24)).astype(np.int64)
    sub = (place & U(0xFFFFFF)).astype(np.int64) % SUBPARTS
    sums = np.zeros(n1 * SUBPARTS, U)
    np.add.at(sums, part * SUBPARTS + sub, B.mixed(keys))
    held = np.bincount(part * SUBPARTS + sub, minlength=n1 * SUBPARTS).reshape(n1, SUBPARTS)
    sums = sums.reshape(n1, SUBPARTS)
    out = np.stack([B.joined(sums[:, (i + 1) % 3] * B.M[1] + sums[:, (i + 2) % 3], np.arange(n1, dtype=U) * U(SUBPARTS) + U(i) + (U(band) << U(40))) for i in range(SUBPARTS)], 1)
    empty = np.stack([held[:, (i + 1) % 3] + held[:, (i + 2) % 3] == 0 for i in range(SUBPARTS)], 1)
    # parts that agree are n1 - differ // 2 at least; if that many parts can't all have an empty signature, none is needed
    if empty.any(1).sum() < n1 - differ // 2:
        return out[~empty]
    return out.ravel()


def sketch(keys: np.ndarray) -> bytes:
    """8 bits of each of the set's minima under SKETCH hashes."""
    least = np.full(SKETCH, U(2**64 - 1))
    for i in range(0, len(keys), 2000):
        x = keys[None, i : i + 2000] * _SEEDS[:, None]
        least = np.minimum(least, (x ^ (x >> U(32))).min(1))
    return (B.mixed(least) & U(0xFF)).astype(np.uint8).tobytes()


def similar(a: bytes, b: bytes) -> bool:
    x, y = B.unpack_sorted(a), B.unpack_sorted(b)
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def components(edges: DataFrame) -> DataFrame:
    """node, component from the columns a and b: alternating large and small stars until the stars stay as they are.

    A star may hold a third of all nodes, so its edges are dealt by salts and its centre's minimum is sent to each."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), SHRINK)
    salt, salts = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.select("a", "b", salt).join(least.select("a", "m", salts), ["a", "salt"]).drop("salt")

    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, least).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        last, edges = edges, stored(small, SHRINK)
        dropped(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def shingle_sets(bundles: DataFrame, schema: T.StructType, chars: int) -> DataFrame:
    """chunk, place (in the bundle), doc_id, n_shingles, and for documents that may have links: d1, d2 (a digest of the set),
    shared (of 10,000 shingles, those that occur in other documents) and, once in a bundle, keys (the set).

    The first two columns of the bundles are id and text."""
    parts = B.parts_for(chars)
    cut = B.sent_parts(parts)

    @tidy
    def send(key: tuple, left: pa.Table) -> pa.Table:
        # a shingle that only one document repeats counts as shared here; that keeps a document, it never loses one
        ids, sizes = B.lower_words(B.texts_of(B.opened(left["blob"][0]).column(1)))
        ends = np.cumsum(sizes)
        inside = np.repeat(ends, sizes)  # where the word's document ends
        whole = B.windows(ids, SHINGLE, seed=SHINGLE)
        whole = whole[np.arange(len(whole)) + SHINGLE <= inside[: len(whole)]]
        short = [shingles(ids[ends[i] - sizes[i] : ends[i]]) for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE))]
        keys, counts = np.unique(np.concatenate([whole, *short]) >> SHORT << SHORT, return_counts=True)
        return pa.Table.from_batches([B.block_table(B.blocks_of(key[0].as_py(), 0, keys, np.minimum(counts, 2), cut))])

    def often(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (counts >= 2).astype(U)

    out = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", schema[0].dataType), *(T.StructField(n, T.LongType()) for n in ("n_shingles", "d1", "d2", "shared")), T.StructField("keys", T.BinaryType())])
    nothing = pa.Table.from_batches([], schema=to_arrow_schema(out))

    @tidy_both
    def meet(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing
        rows = B.opened(left["blob"][0])
        ids, words = B.lower_words(B.texts_of(rows.column(1)))
        sets = [shingles(x) for x in np.split(ids, np.cumsum(words)[:-1])]
        sizes = np.array([len(x) for x in sets])
        every, at = np.unique(np.concatenate(sets) >> SHORT << SHORT, return_inverse=True)
        shared = np.r_[0, np.cumsum(B.in_order(answers)[at].astype(np.int64))]
        ends = np.cumsum(sizes)
        shared = shared[ends] - shared[ends - sizes]
        columns: dict[str, list] = {n: [] for n in ("d1", "d2", "shared", "keys")}
        seen: set[tuple[int, int]] = set()
        for keys, count, known in zip(sets, shared.tolist(), rows.column(0).is_valid().to_pylist(), strict=True):
            row = (None, None, None, None)
            if known and len(keys) and 100 * count >= PERCENT * len(keys):  # a null id has no links, so the set isn't left to its row
                d1, d2 = (int(B.mixed(keys ^ U(s)).sum(dtype=U).astype(np.int64)) for s in (1, 2))
                row = (d1, d2, 10_000 * count // len(keys), None if (d1, d2) in seen else B.pack_sorted(keys))
                seen.add((d1, d2))
            for c, v in zip(columns.values(), row, strict=True):
                c.append(v)
        n = len(sets)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), rows.column(0), pa.array(sizes.astype(np.int64)), *(pa.array(columns[c], pa.int64()) for c in ("d1", "d2", "shared")), pa.array(columns["keys"], pa.binary())], names=out.names)

    mine = bundles.select("chunk", "blob").groupBy("chunk")
    answers = B.exchanged(mine.applyInArrow(send, B.BLOCKS), parts, often).filter(F.col("chunk") >= 0)
    return mine.cogroup(answers.groupBy("chunk")).applyInArrow(meet, out)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    one = sets.select(F.col("id").alias("a"), F.col("keys").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("keys").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(alike("x", "y")).select("a", "b")


def edges_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, values[1:] != values[:-1]]), len(values)] if len(values) else np.zeros(1, int)


def least_labels(group: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """For items 0 to n - 1, the least item that they reach through shared groups; rows stand by group."""
    label = np.arange(n)
    starts, size = edges_of(group)[:-1], np.diff(edges_of(group))
    while len(item):
        low = np.repeat(np.minimum.reduceat(label[item], starts), size)
        after = label.copy()
        np.minimum.at(after, item, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def near_labels(group: np.ndarray, item: np.ndarray, size: np.ndarray, marks: np.ndarray, most: int = 200_000) -> np.ndarray:
    """For items 0 to n - 1, the least item that they reach through pairs of one group whose sizes and sketches allow a
    link; rows stand by group and item. Pairs that have the same label already aren't looked at; `most` pairs at a time."""
    n = len(size)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
        ok[ok] = (marks[x[ok]] == marks[y[ok]]).sum(1) >= AGREE
        return ok

    def settle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return least_labels(np.repeat(np.arange(len(x)), 2), np.stack([x, y], 1).ravel(), n)

    ends = edges_of(group)
    first = np.repeat(item[ends[:-1]], np.diff(ends))
    x, y = np.divmod(np.unique(first[item != first] * n + item[item != first]), n)
    ok = near(x, y)
    x, y = x[ok], y[ok]
    label = settle(x, y)
    # the rows of groups that hold several labels stand by label and meet those of later labels
    order = np.lexsort((label[item], group))
    group, item = group[order], item[order]
    ends = edges_of(group)
    several = np.repeat(label[item[ends[:-1]]] != label[item[ends[1:] - 1]], np.diff(ends))
    group, item = group[several], item[several]
    start = label[item]
    ends = edges_of(group)
    end = np.repeat(ends[1:], np.diff(ends))
    runs = np.r_[np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (start[1:] != start[:-1])]), len(group)] if len(group) else np.zeros(1, int)
    later = np.repeat(runs[1:], np.diff(runs))
    count = end - later
    total = np.cumsum(count)
    i = 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        c = count[i:j]
        left = np.repeat(item[i:j], c)
        right = item[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(later[i:j], c)]
        open_ = label[left] != label[right]
        a, b = np.divmod(np.unique(np.minimum(left, right)[open_] * n + np.maximum(left, right)[open_]), n)
        ok = near(a, b)
        if ok.any():
            x, y = np.r_[x, a[ok]], np.r_[y, b[ok]]
            label = settle(x, y)
            low = np.flatnonzero(label != np.arange(n))
            x, y = label[low], low
        i = j
    return label


def block_links(families: DataFrame) -> DataFrame:
    """Links (a, b) between components of one family, from family, id, component, n, keys.

    A family with several components is dealt to blocks by id, and each two blocks meet in a task of their own, where whole
    sets are compared; nothing but links leaves it, and no more of them than its components need.
    """
    sizes = families.groupBy("family").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), (F.min("component") < F.max("component")).alias("open"))
    sizes = sizes.filter("open").select("family", F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("rows") / BLOCK_SETS)).cast("int").alias("blocks"))
    rows = families.join(sizes, "family").withColumn("own", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "n", "keys")

    @tidy
    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        comp, size, side = rows["component"].to_numpy(), rows["n"].to_numpy(), (rows["own"] == key[1]).to_numpy()
        if (comp == comp[0]).all():
            return none
        keys = [B.unpack_sorted(k) for k in rows["keys"]]
        _, at, often = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        common = often >= 2  # the others are in no intersection
        column, row = (np.cumsum(common) - 1)[at], np.repeat(np.arange(len(keys)), size)
        # the own side's sets stand first, so that each side is a part of the table and no copy
        left = np.flatnonzero(side)
        right = left if key[1] == key[2] else np.flatnonzero(~side)
        place = np.empty(len(keys), np.int64)
        place[np.r_[left, np.flatnonzero(~side)]] = np.arange(len(keys))
        holds = np.zeros((len(keys), int(common.sum())), np.float32)
        holds[place[row[common[at]]], column[common[at]]] = 1
        both = (holds[: len(left)] @ (holds if right is left else holds[len(left) :]).T).astype(np.int64)
        x, y = np.nonzero((100 * both >= PERCENT * (size[left][:, None] + size[right][None] - both)) & (comp[left][:, None] != comp[right][None]))
        if not len(x):
            return none
        x, y = comp[left[x]], comp[right[y]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        nodes, ends = np.unique(pairs, return_inverse=True)
        ends = ends.reshape(-1, 2)
        label = least_labels(np.repeat(np.arange(len(ends)), 2), ends.ravel(), len(nodes))
        low = label != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[label[low]], "b": nodes[low]})

    # dealt by block, as what a join has dealt by family alone would keep all blocks of a family in one task
    return rows.repartition("family", "i", "j").groupBy("family", "i", "j").applyInPandas(meet, "a long, b long")


def linked_rows(met: DataFrame) -> DataFrame:
    """chunk, place, doc_id, n_shingles, least: of the row's component the smallest (doc_id, chunk, place); null without a set.

    met: the stored rows of shingle_sets. Sets have numbers of their own, so ids may be of any type."""
    linked = met.filter("d1 is not null and doc_id is not null")
    sets = linked.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "chunk", "place")).alias("least"), F.first("keys", True).alias("keys"), F.first("n_shingles").alias("n"), F.max("shared").alias("shared"))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), SHRINK)
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_SIGNATURES))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                some = batch.iloc[a : a + 500]
                keys = [B.unpack_sorted(k) for k in some["keys"]]
                signs = [signatures(k) for k in keys]
                row = np.repeat(np.arange(len(keys)), [len(x) for x in signs])
                signs = np.concatenate(signs)
                order = np.argsort(signs, kind="stable")
                signs, row = signs[order], row[order]
                marks = np.frombuffer(b"".join(map(sketch, keys)), np.uint8).reshape(-1, SKETCH)
                ids, shared, size = (some[c].to_numpy(np.int64) for c in ("id", "shared", "n"))
                edges = np.searchsorted(B.part_of(signs, parts), np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(edges)):
                    x, y = edges[p], edges[p + 1]
                    own, at = np.unique(row[x:y], return_inverse=True)
                    out.append((int(p), B.pack_sorted(signs[x:y]), B.pack(at.astype(np.uint16)), B.pack(ids[own]), B.pack(shared[own].astype(np.uint16)), B.pack(size[own]), marks[own].tobytes()))
                yield pd.DataFrame(out, columns=["part", "signs", "at", "ids", "shared", "size", "marks"])
        let_go()

    @tidy
    def bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """How often a pivot a and a member b share a bucket; with often null, a is the first set of b's family here.

        Sets rank by the share of their shingles that occur in other documents: an original before its altered copies.
        A bucket's pivot is its first set."""
        signs = np.concatenate([B.unpack_sorted(x) for x in rows["signs"]])
        ids = [B.unpack(x, np.int64) for x in rows["ids"]]
        before = np.cumsum([0, *map(len, ids)])
        who = np.concatenate([B.unpack(x, np.uint16).astype(np.int64) + o for x, o in zip(rows["at"], before, strict=False)])
        ids = np.concatenate(ids)
        shared = np.concatenate([B.unpack(x, np.uint16) for x in rows["shared"]]).astype(np.int64)
        size = np.concatenate([B.unpack(x, np.int64) for x in rows["size"]])
        marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(-1, SKETCH)
        best = np.lexsort((ids, -shared))
        rank = np.empty(len(ids), np.int64)
        rank[best] = np.arange(len(ids))
        ranked, size, marks, rank = ids[best], size[best], marks[best], rank[who]
        order = np.lexsort((rank, signs))
        signs, rank = signs[order], rank[order]
        edges = edges_of(signs)
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        signs, rank = signs[several], rank[several]
        edges = edges_of(signs)
        pivot = np.repeat(rank[edges[:-1]], np.diff(edges))
        star = rank != pivot
        pairs, often = np.unique(pivot[star] * len(ranked) + rank[star], return_counts=True)
        label = near_labels(signs, rank, size, marks)
        low = label != np.arange(len(ranked))
        many = pd.Series([*often.tolist(), *[None] * int(low.sum())], dtype="Int64")
        return pd.DataFrame({"a": np.r_[ranked[pairs // len(ranked)], ranked[label[low]]], "b": np.r_[ranked[pairs % len(ranked)], ranked[low]], "often": many})

    signed = sets.select("id", "keys", "shared", "n").mapInPandas(sign, "part int, signs binary, at binary, ids binary, shared binary, size binary, marks binary")
    members = stored(signed.groupBy("part").applyInPandas(bucket, "a long, b long, often long"), SHRINK)
    # each set meets the pivot that it shares most buckets with
    shares = members.filter("often is not null").groupBy("a", "b").agg(F.sum("often").alias("often"))
    star = shares.groupBy("b").agg(F.max(F.struct("often", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    first = stored(verified(star, sets), SHRINK)
    known = components(first)
    # sets that near pairs of buckets connect are a family; those of one that are in different components meet in blocks
    family = components(members.filter("often is null").select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("family"))
    families = sets.select("id", "n", "keys").join(family, "id").join(known.withColumnRenamed("node", "id"), "id", "left")
    families = stored(families.select("family", "id", F.coalesce("component", "id").alias("component"), "n", "keys"), SHRINK)
    dropped(members)
    more = stored(block_links(families), SHRINK)
    dropped(families)
    found = components(first.union(more)) if not more.isEmpty() else known
    groups = sets.select("d1", "d2", "least", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    groups = groups.select("d1", "d2", "least", F.coalesce("component", "id").alias("component"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    # a component may hold a third of all sets: its least row goes to each of its salts
    least = groups.groupBy("component").agg(F.min("least").alias("all")).select("component", "all", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    groups = groups.join(least, ["component", "salt"]).select("d1", "d2", F.col("all").alias("least"))
    rows = met.select("chunk", "place", "doc_id", "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("d1", "d2")))
    return rows.join(groups, ["d1", "d2"], "left").select("chunk", "place", "doc_id", "n_shingles", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that the document's links reach."""
    bundles, schema, chars = B.bundles(docs, [id_col, text_col], text_col)
    met = stored(shingle_sets(bundles, schema, chars))
    dropped(bundles)
    return linked_rows(met).select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, with the columns they came with; rows without links all stay."""
    columns = [id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col))]
    bundles, schema, chars = B.bundles(docs, columns, text_col)
    met = stored(shingle_sets(bundles, schema, chars))
    gone = linked_rows(met).filter("least is not null and (chunk <> least.chunk or place <> least.place)").select("chunk", "place")
    nothing = pa.Table.from_batches([], schema=to_arrow_schema(schema))

    @tidy_both
    def rest(key: tuple, left: pa.Table, places: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing
        rows = B.opened(left["blob"][0])
        keep = np.ones(rows.num_rows, bool)
        keep[np.array(places["place"], np.int64)] = False
        return rows.filter(pa.array(keep))

    kept = bundles.select("chunk", "blob").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(rest, schema)
    return kept.toDF(*columns).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
