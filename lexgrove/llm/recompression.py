"""Substring dedup by recompression.

Rounds turn a text into ever longer symbols. In a round, each bundle of documents folds runs of equal symbols and then pairs
of a left and a right symbol, twice; the side of a symbol is a bit of its name. Spark then gathers the new symbols of
all bundles and names them: a symbol that the corpus holds twice or more gets a number, the same one everywhere, and the next
round goes on with these numbers; a symbol that occurs once gets none.

Each symbol carries the interval of words that its existence depends on. Equal windows of words therefore hold the same
symbols, with the same intervals, wherever they occur, and a window around a symbol without a name occurs nowhere else. Windows
that hold named symbols only, shared up to the highest level, are the candidates; they are verified by counting them by a
digest of 96 bits of their words (at 10^13 windows, two different ones share one with a probability of about 10^-3 in all).
Words covered by a window that starts twice or more go.

Symbols travel as hashes of 48 bits: two that collide may get a number where none is due, which costs a verification and
changes no result.

Defined results: a null or empty text has no words and keeps the empty text; texts of any length are read whole; equal
texts in different rows, repeated rows included, are repeats of each other; an empty table gives an empty result; an id of
any type, null included, passes through as it is; other columns of the input are not read, or pass through where asked for,
whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrove.llm import blocks as B
from lexgrove.llm.common import table, tidy, tidy_both

WINDOW = 35
#: Rounds of naming, and levels of runs and pairs in a round.
ROUNDS, LEVELS = 2, 2
#: Kinds of blocks: a round's symbols have the round's number; windows of words, and where they start; open windows go along.
WINDOWS, STARTS, OPEN = 100, 101, B.ALONG
#: Bits of a symbol's hash that are left out when it is sent.
SHORT = np.uint64(16)
U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.r_[U(1), np.cumprod(np.full(n - 1, U(base)))]


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... up to n of them."""
    return _powers(base, 1 << max(16, n.bit_length()))[:n]


class Texts:
    """The words of a bundle's documents, one after another."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths

    def ids(self, docs: np.ndarray, seed: int = 0) -> np.ndarray:
        """A hash of each word of the given documents; 0 for the words of others."""
        out, known = np.zeros(int(self.lengths.sum()), U), B.Words(seed=seed)
        for d in docs.tolist():
            out[self.first[d] : self.first[d] + self.lengths[d]] = known.ids(self.words[d])
        return out

    def starts(self, width: int) -> np.ndarray:
        """Where windows of so many words start."""
        counts = np.maximum(self.lengths - width + 1, 0)
        return np.repeat(self.first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    def digests(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the windows that start at the given places; by two independent hashes of each word."""
        out = []
        docs = np.unique(np.searchsorted(self.first, at, "right") - 1)
        docs = docs[self.lengths[docs] > 0]
        for seed, base in enumerate(_BASES):
            spread = B.mixed(self.ids(docs, seed) + U(width))
            with np.errstate(over="ignore"):
                sums = np.r_[U(0), np.cumsum(spread * _power(base, len(spread)), dtype=U)]
                out.append(B.mixed((sums[at + width] - sums[at]) * _power(pow(base, -1, 2**64), len(spread) + 1)[at]))
        return out[0], out[1] >> U(32)


class Symbols:
    """The symbols of a bundle's documents, in order.

    name: 0 where a symbol has none. start, end: the interval of words that the symbol depends on; one that reaches over its
    document's ends depends on what no window holds. fresh: formed in this round."""

    def __init__(self, texts: Texts) -> None:
        n = int(texts.lengths.sum())
        self.name = texts.ids(np.arange(len(texts.lengths))) | U(1)
        self.start, self.end = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        self.doc = np.repeat(np.arange(len(texts.lengths), dtype=np.int32), texts.lengths)
        self.low, self.high = (texts.first - 1).astype(np.int32), (texts.first + texts.lengths + 1).astype(np.int32)
        self.fresh = np.zeros(n, bool)

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol and the next are of one document; where the symbol before starts; where the one after ends."""
        inner = self.doc[1:] == self.doc[:-1]
        before, after = np.empty_like(self.start), np.empty_like(self.end)
        before[1:], after[:-1] = self.start[:-1], self.end[1:]
        edge = np.flatnonzero(~inner)
        head, tail = np.r_[0, edge + 1], np.r_[edge, len(before) - 1]
        before[head], after[tail] = self.low[self.doc[head]], self.high[self.doc[tail]]
        return inner, before, after

    def fold(self, level: int) -> None:
        """One level: runs of equal symbols, then pairs of a left and a right one."""
        if not len(self.name):
            return
        # a run depends on the symbols beside it, which are others; without a name, a symbol stands for itself
        name = self.name
        inner, before, after = self._beside()
        head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | ~inner | (name[1:] == 0)])
        named = name != 0
        np.copyto(self.start, before, where=named)
        np.copyto(self.end, after, where=named)
        if len(head) < len(name):
            tail = np.r_[head[1:], len(name)] - 1
            size = (tail - head + 1).astype(U)
            self.name = np.where(size > 1, B.joined(name[head], size) | U(1), name[head])
            self.fresh = self.fresh[head] | (size > 1)
            self.start, self.end, self.doc = self.start[head], self.end[tail], self.doc[head]
        # a left symbol depends on the next one, a right symbol on the one before
        name = self.name
        inner, before, after = self._beside()
        right = B.mixed(name + U(level + 1)) >> U(63) == 1
        named = name != 0
        left, right = ~right & named, right & named
        pair = np.r_[left[:-1] & right[1:] & inner, False]
        second = np.r_[False, pair[:-1]]
        np.copyto(self.end, after, where=left)
        np.copyto(self.start, before, where=right & ~second)
        at = np.flatnonzero(pair)
        name[at] = B.joined(name[at], name[at + 1]) | U(1)
        self.fresh[at] = True
        keep = ~second
        for c in ("name", "start", "end", "doc", "fresh"):
            setattr(self, c, getattr(self, c)[keep])


class Open:
    """Windows of a bundle that may occur elsewhere, by where they start, and the symbols that ask Spark for a name.

    key: the symbol's place among the distinct ones asked for; start, end: what it depends on."""

    def __init__(self, windows: np.ndarray, width: int) -> None:
        self.windows, self.width = windows, width
        self.key = self.start = self.end = np.zeros(0, np.int64)

    def holds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether an open window holds the interval."""
        count = np.r_[0, np.cumsum(self.windows)]
        first, last = np.maximum(end - self.width, 0), np.minimum(start, len(self.windows) - 1)
        held = (first <= last) & (last >= 0)
        held[held] = count[last[held] + 1] > count[first[held]]
        return held

    def close(self, numbers: np.ndarray) -> np.ndarray:
        """Closes the windows around symbols without a number; gives each asking symbol's number."""
        given = numbers[self.key]
        gone = given == 0
        first, last = np.maximum(self.end[gone] - self.width, 0), self.start[gone]
        n = len(self.windows) + 1
        shut = np.bincount(first, minlength=n)[:n] - np.bincount(last + 1, minlength=n)[:n]
        self.windows &= np.cumsum(shut)[:-1] == 0
        return given

    def dump(self) -> bytes:
        arrays = [self.key.astype(np.int32), np.diff(self.start, prepend=0).astype(np.int32), (self.end - self.start).astype(np.int32), intervals(np.flatnonzero(self.windows)), np.array([len(self.windows)])]
        parts = [B.pack(x) for x in arrays]
        return b"".join([*(len(x).to_bytes(4, "little") for x in parts), *parts])

    @staticmethod
    def load(data: bytes, width: int) -> Open:
        sizes = [int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(5)]
        ends = np.cumsum([20, *sizes])
        key, start, size, runs, n = (B.unpack(data[a:b], t) for a, b, t in zip(ends, ends[1:], (np.int32, np.int32, np.int32, U, np.int64), strict=False))
        out = Open(np.zeros(int(n[0]), bool), width)
        out.windows[from_intervals(runs)] = True
        out.key, out.start = key, np.cumsum(start, dtype=np.int64)
        out.end = out.start + size
        return out


class Parse:
    """A bundle's parse: what it asks Spark to name in each round, and the windows that may occur elsewhere."""

    def __init__(self, texts: Texts, width: int) -> None:
        self.round, self.symbols = 0, Symbols(texts)
        windows = np.zeros(int(texts.lengths.sum()) + 1, bool)
        windows[texts.starts(width)] = True
        self.open = Open(windows, width)
        self._fold()

    def _fold(self) -> None:
        s = self.symbols
        s.fresh[:] = False
        for k in range(LEVELS):
            s.fold(self.round * LEVELS + k)
        # a symbol asks for a name if an open window holds it with all that it depends on
        asked = np.flatnonzero(s.fresh)
        self._asked = asked = asked[self.open.holds(s.start[asked], s.end[asked])]
        self.keys, self.open.key, counts = np.unique(s.name[asked] >> SHORT << SHORT, return_inverse=True, return_counts=True)
        self.counts = np.minimum(counts, 2)  # how often each occurs here, twice at most
        self.open.start, self.open.end = s.start[asked].astype(np.int64), s.end[asked].astype(np.int64)

    def named(self, numbers: np.ndarray) -> None:
        """Goes on with Spark's numbers for the keys; windows around a symbol without one close."""
        given = self.open.close(numbers)
        self.round += 1
        self.symbols.name[self._asked] = np.where(given > 0, B.mixed(given + (U(self.round) << U(56))) | U(1), U(0))
        self._fold()


def parsed(blob: pa.Scalar, place: int, width: int, answers: pa.Table | None = None, rounds: int = 0) -> Parse:
    """The parse of a bundle after so many rounds, with the numbers that Spark gave in each."""
    out = Parse(Texts(B.texts_of(B.opened(blob).column(place))), width)
    for r in range(rounds):
        out.named(B.in_order(answers.filter(pa.compute.equal(answers["kind"], r))))
    return out


def number(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers for the symbols that occur twice or more: the range's, then the place in it."""
    often = counts >= 2
    return np.where(often, (U(part) << U(32)) + np.cumsum(often).astype(U), U(0))


def intervals(at: np.ndarray) -> np.ndarray:
    """Rising numbers as runs: first, length, first, length, ..."""
    head = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else np.zeros(0, int)
    return np.stack([at[head], np.diff(np.r_[head, len(at)])], 1).ravel().astype(U)


def from_intervals(runs: np.ndarray) -> np.ndarray:
    first, size = runs[::2].astype(np.int64), runs[1::2].astype(np.int64)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def window_keys(texts: Texts, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests of windows in order (64 bits, 32 bits), which of them each window has, and how often each occurs."""
    high, low = texts.digests(at, width)
    order = np.lexsort((low, high))
    new = np.r_[True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)] if len(at) else np.zeros(0, bool)
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return high[order][new], low[order][new], which, np.bincount(which, minlength=int(new.sum()))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space). With carry, the columns of docs, where a document
    that loses nothing keeps its text as it was, and n_chars follows the text."""
    columns = list(docs.columns) if carry else [id_col, text_col]
    bundles, schema, chars = B.bundles(docs, columns, text_col)
    place, parts = columns.index(text_col), B.parts_for(chars)
    cut = B.sent_parts(parts)
    mine = bundles.select("chunk", "blob").groupBy("chunk")

    def asking(chunk: int, parse: Parse) -> list[tuple]:
        """The blocks of a round; before the last one's answer, the open windows go along."""
        rows = B.blocks_of(chunk, parse.round, parse.keys, parse.counts, cut)
        return [*rows, (chunk, OPEN, chunk % cut, b"", parse.open.dump())] if parse.round == ROUNDS - 1 else rows

    @tidy
    def first(key: tuple, left: pa.Table) -> pa.Table:
        return pa.Table.from_batches([B.block_table(asking(key[0].as_py(), parsed(left["blob"][0], place, width)))])

    def later(rounds: int):
        @tidy_both
        def run(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
            rows = asking(key[0].as_py(), parsed(left["blob"][0], place, width, answers, rounds)) if left.num_rows else []
            return pa.Table.from_batches([B.block_table(rows)])

        return run

    @tidy_both
    def candidates(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            chunk = key[0].as_py()
            still = Open.load(answers.filter(pa.compute.equal(answers["kind"], OPEN))["values"][0].as_py(), width)
            still.close(B.in_order(answers.filter(pa.compute.equal(answers["kind"], ROUNDS - 1))))
            at = np.flatnonzero(still.windows)
            if len(at):
                texts = Texts(B.texts_of(B.opened(left["blob"][0]).column(place)))
                high, low, _, counts = window_keys(texts, at, width)
                edges = np.searchsorted(B.part_of(high, parts), np.arange(parts + 1))
                more = low << U(1) | (counts > 1).astype(U)
                for p in np.flatnonzero(np.diff(edges)):
                    x, y = edges[p], edges[p + 1]
                    rows.append((chunk, WINDOWS, int(p), B.pack_sorted(high[x:y]), B.pack(more[x:y])))
                rows.append((chunk, STARTS, chunk % parts, b"", B.pack(intervals(at))))
        return pa.Table.from_batches([B.block_table(rows)])

    @tidy
    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        """For each window of a bundle whether it occurs twice or more; where they start passes through."""
        kind, part, chunks = key[0].as_py(), key[1].as_py(), rows["chunk"].to_pylist()
        if kind == STARTS:
            return B.answer_table([(c, STARTS, part, x) for c, x in zip(chunks, rows["counts"].to_pylist(), strict=True)])
        highs = [B.unpack_sorted(k) for k in rows["keys"].to_pylist()]
        high, low = np.concatenate(highs), np.concatenate([B.unpack(x, U) for x in rows["counts"].to_pylist()])
        order = np.lexsort((low >> U(1), high))
        new = np.r_[True, (np.diff(high[order]) != 0) | (np.diff(low[order] >> U(1)) != 0)]
        group = np.cumsum(new) - 1
        twice = np.bincount(group, 1 + (low[order] & U(1)).astype(float)) >= 2
        often = np.empty(len(high), np.uint8)
        often[order] = twice[group]
        ends = np.cumsum([len(k) for k in highs])
        return B.answer_table([(c, WINDOWS, part, B.pack(often[e - len(k) : e])) for c, k, e in zip(chunks, highs, ends, strict=True)])

    kinds = [f.dataType for f in schema.fields]
    if carry:
        out_schema = schema
    else:
        out_schema = T.StructType([T.StructField("c0", kinds[0]), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    counted = columns.index("n_chars") if "n_chars" in columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None

    nothing = pa.Table.from_batches([], schema=to_arrow_schema(out_schema))

    @tidy_both
    def finish(key: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return nothing
        rows = B.opened(left["blob"][0])
        texts = Texts(B.texts_of(rows.column(place)))
        edges = np.zeros(int(texts.lengths.sum()) + 1, np.int64)
        starts = answers.filter(pa.compute.equal(answers["kind"], STARTS))
        if starts.num_rows:
            at = from_intervals(B.unpack(starts["values"][0].as_py(), U))
            _, _, which, _ = window_keys(texts, at, width)
            at = at[B.in_order(answers.filter(pa.compute.equal(answers["kind"], WINDOWS)), np.uint8)[which] > 0]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
        gone = np.cumsum(edges)[:-1] > 0
        removed = np.diff(np.r_[0, np.cumsum(gone)][np.r_[texts.first, len(gone)]])
        kept = []
        for words, a, n in zip(texts.words, texts.first, removed, strict=True):
            if n:
                words = [w for w, g in zip(words, gone[a : a + len(words)], strict=True) if not g]
            kept.append(b" ".join(words) if n or not carry else None)
        new = pa.array(kept, pa.binary()).cast(options=pa.compute.CastOptions.unsafe(pa.string()))  # words stay as they are, UTF-8 or not
        if not carry:
            return pa.table({"c0": rows.column(0), "n_words": pa.array(texts.lengths), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": new})
        text = rows.column(place).combine_chunks()
        new = new.cast(text.type)
        out = rows.set_column(place, rows.schema.names[place], pa.compute.coalesce(new, text))
        if counted is not None:
            size = pa.compute.utf8_length(new).cast(rows.column(counted).type)
            out = out.set_column(counted, rows.schema.names[counted], pa.compute.coalesce(size, rows.column(counted).combine_chunks()))
        return out

    asked = mine.applyInArrow(first, B.BLOCKS)
    names = None
    for r in range(ROUNDS):
        given = B.exchanged(asked, parts, number).filter(F.col("chunk") >= 0)
        names = given if names is None else names.union(given)
        if r + 1 < ROUNDS:
            asked = mine.cogroup(names.groupBy("chunk")).applyInArrow(later(r + 1), B.BLOCKS)
        else:
            asked = mine.cogroup(given.groupBy("chunk")).applyInArrow(candidates, B.BLOCKS)
    often = asked.groupBy("kind", "part").applyInArrow(verify, B.ANSWERS)
    done = mine.cogroup(often.groupBy("chunk")).applyInArrow(finish, out_schema)
    return done.toDF(*(columns if carry else ["doc_id", "n_words", "n_removed", "kept_text"]))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words gone from the text, and with the columns they came with; n_chars follows the text."""
    return without_repeats(docs, id_col, text_col, carry=True)


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
