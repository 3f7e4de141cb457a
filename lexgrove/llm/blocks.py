"""Corpus-wide counts of 64-bit keys, exchanged in compressed blocks between bundles of documents.

A bundle holds consecutive rows of one input partition, up to a bounded number of characters, as a compressed Arrow
table; so neither ids nor texts decide where a row goes, and a hot id, source or group of copies is spread like any rows.
Bundles are written once; what later passes read is the same rows in the same order, also after an executor is lost.

A bundle sends its distinct keys, sorted and cut by ranges, as one block for each range; a key occurs once in a block whatever
its frequency, so a hot key is no hot task. The task of a range adds up its blocks and answers each of them with one value for
each key. Blocks number bundles times ranges. Above MOST_PARTS ranges, groups of bundles are first merged over
coarse ranges, so that a bundle never sends more than MOST_PARTS blocks and each block stays large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import let_go, stored, tidy, tidy_both

#: Characters of text of a bundle, about; a longer text is a bundle of its own.
BUNDLE_CHARS = 1_500_000
#: Characters of text whose keys one task adds up, about.
PART_CHARS = 6_000_000
#: Rows of an Arrow batch while bundles are written.
BATCH_ROWS = 300
#: Ranges that a bundle's keys are cut into at most.
MOST_PARTS = 512
#: Bundles that are merged first where there are more ranges.
GROUP = 64
BLOCKS = "chunk long, kind int, part int, keys binary, counts binary"
ANSWERS = "chunk long, kind int, part int, values binary"
#: Rows of BLOCKS of this kind aren't counted: their counts come back as they are, beside the answers.
ALONG = 1000
#: The chunk of an answer that holds the totals of a range: the sum of the counts, and the keys with a count.
TOTALS = -1
M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
U = np.uint64


class Words(dict):
    """64-bit ids of words, kept for up to `most` words."""

    def __init__(self, most: int = 400_000, seed: int = 0) -> None:
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return v

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order: np.unique without its table of hashes, which takes many times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


#: Bytes whose words are hashed at once, and bytes of a word that is hashed alone.
HASH_BYTES, LONG_WORD = 1 << 18, 1024
_RANDOM = np.random.default_rng(7).integers(0, 2**64, 256 + LONG_WORD, U)
_BYTE, _PLACE = _RANDOM[:256].copy(), _RANDOM[256:]
_BYTE[65:91] = _BYTE[97:123]
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE[_GAP] = 0


def lower_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the texts' words, A-Z in lower case, and how many words each text has.

    A word's id is a multilinear hash of its bytes, mixed with its length; words are hashed by arrays and none becomes an object."""
    whole = np.frombuffer(b"\n".join(texts), np.uint8)
    edge = np.diff(np.r_[True, _GAP[whole], True].astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.diff(np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in texts)])))
    sums = np.zeros(len(first), U)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + HASH_BYTES, "right")))
        if last[j - 1] - first[i] <= HASH_BYTES:
            some, at = whole[first[i] : last[j - 1]], first[i:j] - first[i]
            place = np.arange(len(some)) - np.repeat(at, np.diff(np.r_[at, len(some)]))
            sums[i:j] = np.add.reduceat(_BYTE[some] * _PLACE[np.minimum(place, LONG_WORD - 1)], at)
        i = j
    length = last - first
    for i in np.flatnonzero(length > LONG_WORD):
        sums[i] = xxhash.xxh3_64_intdigest(whole[first[i] : last[i]].tobytes().lower())
    return joined(sums, length.astype(U)), sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * M[1]
    x = x ^ (x >> U(27))
    x = x * M[2]
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * M[0] + b)


def windows(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, seed + 1, U)
    done = 0
    spread = mixed(ids + U(n))
    with np.errstate(over="ignore"):
        factor = U(1)
        while done < n:
            out = out + spread[done : done + m] * factor
            factor = factor * M[0]
            done += 1
    return mixed(out)


def pack(values: np.ndarray) -> bytes:
    """Bytes of the same weight side by side, then compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1) if len(values) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U), dtype=U)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal width, in the order of the keys."""
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for what runs inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bundles(docs: DataFrame, columns: list[str], text_col: str, chars: int | None = None, steady: bool = False) -> tuple[DataFrame, T.StructType, int]:
    """The rows as a table (chunk, rows, chars, blob); the schema of the blobs' columns; all bytes of texts, about.

    The columns are named c0, c1, ... in their order, whatever their names. The table is stored, unless docs is steady: a
    scan of files, which gives the same rows in the same order and partitions whenever it is read again."""
    limit = chars or BUNDLE_CHARS
    place = columns.index(text_col)
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held, size
            blob = sealed(pa.Table.from_batches(held))
            out = pa.record_batch({"chunk": pa.array([n], pa.int64()), "rows": pa.array([sum(b.num_rows for b in held)], pa.int64()), "chars": pa.array([size], pa.int64()), "blob": pa.array([blob], pa.binary())})
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0)).astype(np.int64)
            a = 0
            total = np.r_[0, np.cumsum(lengths + 8)]
            while a < batch.num_rows:
                b = max(a + (not held), int(np.searchsorted(total, total[a] + limit - size, "right")) - 1)
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(total[b] - total[a])
                if b < batch.num_rows or size >= limit:
                    yield flush()
                a = b
        if held:
            yield flush()
        let_go()

    table = source.mapInArrow(run, "chunk long, rows long, chars long, blob binary")
    if steady:  # the plan runs later, with the session's own batches
        total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")) + 8)).first()[0] or 0
    else:
        with batches_of(docs.sparkSession, BATCH_ROWS):
            table = stored(table)
        total = table.agg(F.sum("chars")).first()[0] or 0
    return table, source.schema, int(total)


def sealed(table: pa.Table) -> bytes:
    """A table as compressed Arrow data."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def opened(blob: bytes | pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_py() if isinstance(blob, pa.Scalar) else blob).read_all()


def texts_of(column: pa.ChunkedArray) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts_for(chars: int) -> int:
    return max(2, -(-chars // PART_CHARS))


def block_table(rows: list[tuple]) -> pa.RecordBatch:
    """rows: of the columns of BLOCKS."""
    chunk, kind, part, keys, counts = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.record_batch({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def answer_table(rows: list[tuple]) -> pa.Table:
    chunk, kind, part, values = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "values": pa.array(values, pa.binary())})


def blocks_of(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> list[tuple]:
    """The rows of BLOCKS for sorted distinct keys."""
    out = []
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        out.append((chunk, kind, int(p), pack_sorted(keys[a:b]), pack(counts[a:b].astype(U))))
    return out


def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a range's blocks, their counts in all, each key's place among them, and where blocks end."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    counts = np.concatenate([unpack(c, U) for c in table["counts"].to_pylist()])
    ends = np.cumsum([len(k) for k in keys])
    together = np.concatenate(keys)
    order = np.argsort(together)
    keys = together[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    keys = keys[new]
    return keys, np.bincount(at, counts.astype(float), len(keys)).astype(np.int64), at, ends


Answer = Callable[[int, int, np.ndarray, np.ndarray], np.ndarray]


def exchanged(sent: DataFrame, parts: int, answer: Answer, most_parts: int | None = None, group: int = GROUP) -> DataFrame:
    """ANSWERS for the rows of BLOCKS: answer(kind, part, keys, counts) gives a uint64 for each distinct key of a range.

    A block's values stand in the order of its keys. sent must have been cut into sent_parts(parts) ranges."""
    coarse = sent_parts(parts, most_parts)

    @tidy
    def add(key: tuple, table: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        if kind == ALONG:
            return along(table)
        distinct, total, at, ends = added(table)
        values = answer(kind, part, distinct, total)[at]
        out = [(c, kind, part, pack(x)) for c, x in zip(table["chunk"].to_pylist(), np.split(values, ends[:-1]), strict=True)]
        out.append((TOTALS, kind, part, pack(np.array([total.sum(), (total > 0).sum()], U))))
        return answer_table(out)

    if coarse == parts:
        return sent.groupBy("kind", "part").applyInArrow(add, ANSWERS)
    # groups of bundles meet over coarse ranges first; what they have in common goes on once
    keyed = sent.withColumn("team", F.pmod(F.xxhash64("chunk"), F.greatest(F.lit(1), F.lit(parts // group))))

    @tidy
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        team, kind, part = (x.as_py() for x in key)
        if kind == ALONG:
            return pa.Table.from_batches([block_table([])])
        distinct, total, _, _ = added(table)
        return pa.Table.from_batches([block_table(blocks_of(team << 20 | part, kind, distinct, total, parts))])

    @tidy_both
    def split(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, kind, part = (x.as_py() for x in key)
        if kind == ALONG:
            return along(table)
        if not table.num_rows:  # totals
            return answers.select(["chunk", "kind", "part", "values"])
        _, _, at, ends = added(table)
        values = in_order(answers, U)[at]
        return answer_table([(c, kind, part, pack(x)) for c, x in zip(table["chunk"].to_pylist(), np.split(values, ends[:-1]), strict=True)])

    merged = keyed.groupBy("team", "kind", "part").applyInArrow(merge, BLOCKS).groupBy("kind", "part").applyInArrow(add, ANSWERS)
    back = merged.select("chunk", "kind", "part", "values", F.when(F.col("chunk") == TOTALS, TOTALS - F.col("part")).otherwise(F.shiftright("chunk", 20)).alias("team"), F.when(F.col("chunk") == TOTALS, F.col("part")).otherwise(F.col("chunk").bitwiseAND(F.lit(2**20 - 1))).cast("int").alias("coarse"))
    own = keyed.withColumn("coarse", F.col("part"))
    return own.groupBy("team", "kind", "coarse").cogroup(back.groupBy("team", "kind", "coarse")).applyInArrow(split, ANSWERS)


def along(table: pa.Table) -> pa.Table:
    return answer_table(list(zip(*(table[c].to_pylist() for c in ("chunk", "kind", "part", "counts")), strict=True)))


def sent_parts(parts: int, most_parts: int | None = None) -> int:
    """Into how many ranges bundles cut their keys: the parts, or fewer where groups of bundles are merged first."""
    return parts if parts <= (most_parts or MOST_PARTS) else int(parts**0.5) + 1


def in_order(answers: pa.Table, kind: type = U) -> np.ndarray:
    """The values of one bundle and kind, in the order of its keys."""
    rows = sorted(zip(answers["part"].to_pylist(), answers["values"].to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, kind), *(unpack(v, kind) for _, v in rows)])
