"""Language-model scoring by deleted interpolation of trigrams, bigrams, words and a uniform share.

p3(w | u v) = a c(u v w) / c(u v) + (1 - a) p2(w | v), p2(w | v) = b c(v w) / c(v) + (1 - b) p1(w), p1(w) = d c(w) / N + (1 - d) / (V + 1).
a belongs to the bucket of the context's frequency c(u v), b to that of c(v). The weights are learned by
expectation-maximisation on counts held out in turn: for each training document, the counts of all other training documents.
Counts cover the whole corpus; what reaches the driver is a table of at most 12 * 18 * 12 * 18 * 34 cells.

Words are told apart by hashes of 64 bits, bigrams and trigrams by hashes of at least 40 bits, and 13 more than the number of
bytes of the corpus has: about one in 30,000 of them is counted together with another.

Defined results: a null text counts as an empty one, which is one end token; texts of any length are read whole;
repeated rows are counted and scored each; a null id is trained on and not held out; ids of any type pass through as they are;
with no training documents all counts are zero and the score is log10(1 / (V + 1)) a token; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrove.llm import blocks as B
from lexgrove.llm.common import dropped, id_remainder, stored, table

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB382D699DDF1B63)
WORD, PAIR, TRIPLE = 0, 1, 2
BUCKETS, RATIOS, FREQUENCIES = 12, 18, 34
FOLDS, HELD_OUT = 10, 0
#: Characters of a bundle here: the larger, the fewer keys are sent twice.
CHARS = 6_000_000
U = np.uint64


class Tokens:
    """Tokens of a bundle's documents, one after another, each document closed by END."""

    def __init__(self, rows: pa.Table, words: B.Words, short: int) -> None:
        parts = []
        for text in B.texts_of(rows.column(1)):
            parts += [words.ids(text.lower().split()), np.array([END])]
        self.ids = np.concatenate(parts)
        self.lengths = np.array([len(p) + 1 for p in parts[::2]], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.trained = ~np.array(rows.column(2).to_pylist(), bool)
        self.short = U(short)

    def keys(self, kind: int) -> np.ndarray:
        if kind == WORD:
            return self.ids
        pairs = B.joined(self.before(self.ids, START), self.ids)
        if kind == TRIPLE:
            pairs = B.joined(self.before(pairs, START), self.ids + U(1))
        return pairs >> self.short << self.short

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and each token's place in them."""
        return np.unique(self.keys(kind), return_inverse=True)

    def own(self, at: np.ndarray) -> np.ndarray:
        """For each token, how often its key occurs in its own document."""
        both = self.doc.astype(np.int64) * (int(at.max()) + 1) + at
        order = np.argsort(both)
        new = np.r_[True, np.diff(both[order]) != 0]
        group = np.cumsum(new) - 1
        out = np.empty(len(both), np.int64)
        out[order] = np.bincount(group)[group]
        return out

    def before(self, values: np.ndarray, first: int) -> np.ndarray:
        """Each token's value at the token before it; `first` where none is."""
        out = np.roll(values, 1)
        out[self.starts] = first
        return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(np.maximum(context, 0) + 1.0)).astype(np.int64))


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(part > 0, np.clip(RATIOS - 1 + np.round(np.log2(np.maximum(part, 1) / np.maximum(whole, 1))), 1, RATIOS - 1), 0).astype(np.int64)


def cells(triple: np.ndarray, pair_context: np.ndarray, pair: np.ndarray, word_context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The cell of held-out counts that a token falls in: buckets of both contexts, ratios to them, frequency of the word."""
    frequency = np.where(word > 0, np.minimum(FREQUENCIES - 1, 1 + np.round(np.log2(np.maximum(word, 1)))), 0).astype(np.int64)
    out = bucket(pair_context) * RATIOS + _ratio(triple, pair_context)
    return ((out * BUCKETS + bucket(word_context)) * RATIOS + _ratio(pair, word_context)) * FREQUENCIES + frequency


def mixture(shares: np.ndarray, f3: np.ndarray, f2: np.ndarray, f1: np.ndarray, uniform: float, b3: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, ...]:
    """The interpolated probability, and the parts of the orders in it: trigram, bigram, word, uniform."""
    a, b, d = shares[0, b3], shares[1, b2], shares[2, 0]
    p = a * f3, (1 - a) * b * f2, (1 - a) * (1 - b) * d * f1, (1 - a) * (1 - b) * (1 - d) * uniform
    return (sum(p), *p)


def learn_weights(at: np.ndarray, weight: np.ndarray, n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Rows a (by bucket of c(u v)), b (by bucket of c(v)) and d (the first place), by expectation-maximisation over the cells."""
    shares = np.full((3, BUCKETS), 0.5)
    if n == 0:
        return np.zeros((3, BUCKETS))
    frequency, rest = at % FREQUENCIES, at // FREQUENCIES
    r2, rest = rest % RATIOS, rest // RATIOS
    b2, rest = rest % BUCKETS, rest // BUCKETS
    r3, b3 = rest % RATIOS, rest // RATIOS
    f3, f2 = (np.where(r > 0, 2.0 ** (r - RATIOS + 1.0), 0) for r in (r3, r2))
    f1 = np.where(frequency > 0, 2.0 ** (frequency - 1.0), 0) / n
    shares[:2, 0] = 0  # a context that never occurred has nothing after it
    for _ in range(rounds):
        total, p3, p2, p1, p0 = mixture(shares, f3, f2, f1, 1 / (v + 1), b3, b2)
        scale = weight / total
        new = shares.copy()
        for k, (own, lower, by) in enumerate(((p3, p2 + p1 + p0, b3), (p2, p1 + p0, b2), (p1, p0, np.zeros_like(b2)))):
            yes, no = (np.bincount(by, x * scale, BUCKETS) for x in (own, lower))
            new[k] = (yes + 1e-3 * shares[k]) / (yes + no + 1e-3)
        shares = new
    shares[:2, 0] = 0
    return shares


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steady: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. steady: docs is a scan of files (see bundles)."""
    held = F.coalesce(id_remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT, F.lit(False))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held.alias("held_out"))
    bundles, kinds, chars = B.bundles(source, source.columns, "text", CHARS, steady)
    parts = B.parts_for(chars)
    cut = B.sent_parts(parts)
    short = 64 - min(64, max(40, chars.bit_length() + 13))

    def send(key: tuple, left: pa.Table) -> pa.Table:
        tokens, out = Tokens(B.opened(left["blob"][0]), B.Words(), short), []
        trained = tokens.trained[tokens.doc]
        for kind in (WORD, PAIR, TRIPLE):
            keys, at = tokens.distinct(kind)
            out += B.blocks_of(key[0].as_py(), kind, keys, np.bincount(at, trained, len(keys)), cut)
        return pa.Table.from_batches([B.block_table(out)])

    def count(kind: int, part: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(U)

    mine = bundles.select("chunk", "blob").groupBy("chunk")
    answers = B.exchanged(mine.applyInArrow(send, B.BLOCKS), parts, count)
    schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("cell", T.LongType()), T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(schema)

    def cell_rows(at: list, weight: list) -> pa.Table:
        return pa.table([pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int64()), pa.array(weight, pa.int64())], schema=arrow)

    def meet(key: tuple, left: pa.Table, got: pa.Table) -> pa.Table:
        if not left.num_rows:  # the totals: cell -1 for N, -2 for V
            sums = [B.unpack(x, U) for x in got.filter(pa.compute.equal(got["kind"], WORD))["values"].to_pylist()]
            return cell_rows([-1, -2], [int(sum(s[0] for s in sums)), int(sum(s[1] for s in sums))])
        rows = B.opened(left["blob"][0])
        tokens = Tokens(rows, B.Words(), short)
        learnt = tokens.trained[tokens.doc]
        total, own = {}, {}
        for kind in (WORD, PAIR, TRIPLE):
            keys, at = tokens.distinct(kind)
            values = B.in_order(got.filter(pa.compute.equal(got["kind"], kind))).astype(np.int64)
            total[kind] = values[at]
            own[kind] = np.where(learnt, tokens.own(at), 0)
            if kind == WORD:
                n_docs = int(values[np.searchsorted(keys, END)])
        word, pair, triple = total[WORD], total[PAIR], total[TRIPLE]
        known, base = np.add.reduceat((word > 0).astype(np.int64), tokens.starts), np.add.reduceat(np.log10(word + 0.1), tokens.starts)
        blob = B.sealed(pa.table({"doc_id": rows.column(0), "held_out": rows.column(2), "n_tokens": tokens.lengths, "n_known": known, "base": base}))
        codes = B.pack(np.r_[word, pair, triple, n_docs].astype(U))
        out = pa.table([pa.array([blob], pa.binary()), pa.array([codes], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=arrow)
        if learnt.any():
            word, pair, triple = word - own[WORD], pair - own[PAIR], triple - own[TRIPLE]
            others = n_docs - 1  # the documents that start elsewhere
            cell = cells(triple, tokens.before(pair, others), pair, tokens.before(word, others), word)[learnt]
            at, weight = np.unique(cell, return_counts=True)
            out = pa.concat_tables([out, cell_rows(at.tolist(), weight.tolist())])
        return out

    met = stored(mine.cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema))
    if not steady:
        dropped(bundles)
    gathered = met.filter("cell is not null").groupBy("cell").agg(F.sum("weight").alias("weight")).toPandas()
    totals = dict(zip(gathered["cell"], gathered["weight"], strict=True))
    n, v = int(totals.get(-1, 0)), int(totals.get(-2, 0))
    cell = gathered[gathered["cell"] >= 0].sort_values("cell")
    shares = learn_weights(cell["cell"].to_numpy(np.int64), cell["weight"].to_numpy(float), n, v)
    numbers = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    result = T.StructType([T.StructField("doc_id", kinds[0].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, t) for c, t in numbers.items())])
    log_all = float(np.log10(n + 0.1 * (v + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, codes in zip(batch.column("blob"), batch.column("codes").to_pylist(), strict=True):
                rows = B.opened(blob)
                lengths = np.array(rows["n_tokens"])
                scores = log_probabilities(B.unpack(codes, U).astype(np.int64), lengths, shares, n, v)
                base = np.array(rows["base"]) - lengths * log_all
                columns = [*(rows[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([n] * len(lengths), pa.int64()), pa.array(base), pa.array(scores)]
                yield from pa.table(columns, names=result.names).combine_chunks().to_batches()

    return met.filter("cell is null").select("blob", "codes").mapInArrow(score, result)


def log_probabilities(code: np.ndarray, lengths: np.ndarray, shares: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of each text's probability. code: the counts of the texts' words, of their bigrams and of their trigrams, in order,
    and the number of training documents; lengths: tokens of each text."""
    k, starts = len(code) // 3, np.cumsum(lengths) - lengths
    word, pair, triple = code[:k], code[k : 2 * k], code[2 * k : 3 * k]
    c3, c2 = np.roll(pair, 1), np.roll(word, 1)
    c3[starts] = c2[starts] = code[-1]
    f3, f2 = triple / np.maximum(c3, 1), pair / np.maximum(c2, 1)
    p = mixture(shares, f3, f2, word / max(n, 1), 1 / (v + 1), bucket(c3), bucket(c2))[0]
    return np.add.reduceat(np.log10(p), starts)


def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), steady=True)
