"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree to one feature's bins (later: to the cells of
one pair of features) and adds it to that feature's lookup table. A score is a sum of table entries, one gather and
one addition for each table.

Learning reads at most SAMPLE_ROWS labelled documents, the first by a hash of their id; only documents whose
crc32(doc_id) mod 4 is not 2 are learnt from. Neither labels nor language, source or id are inputs of a score.

Defined results: a null or empty text has all its counts at zero and gets the score of those; texts of any length are
read whole, and bytes that aren't UTF-8 count as they are; repeated rows are scored alike; an empty table gives an empty result; labels that are null, or that
contradict each other for a document, aren't learnt from; of texts that share an id one is; with no labels, or of one kind only, the score is the
share of good labels (0.5 without any); other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import id_remainder, table

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Texts that a worker holds outside an Arrow batch at once.
SLICE_ROWS = 200
FOLDS, HELD_OUT = 4, 2
NAMES = (
    "log_words", "word_bytes", "distinct_words", "repeated_triples", "same_as_next", "log_lines", "repeated_lines", "line_words",
    "upper_share", "digit_share", "mark_share", "symbols_a_word", "bars_a_word", "shouts_a_word", "stops_a_word", "commas_a_word", "high_bytes", "mixed_words",
)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARK, _SYMBOL, _HIGH = bytes(x for x in range(33, 127) if not chr(x).isalnum()), b"#*$%&<>@^~=+{}[]\\", bytes(range(128, 256))
_LETTER = bytes(x for x in range(128) if chr(x).isalpha()) + _HIGH
_SHOUT = re.compile(rb"[!?][!?]+")


def measures(text: bytes | None) -> list[float]:
    """The inputs of the model, from the whole text, in the order of NAMES."""
    raw = text or b""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    count = lambda kinds: size - len(raw.translate(None, kinds)) if raw else 0
    triples = max(1, len(words) - 2)
    letters = max(1, count(_LETTER))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        len(words) / max(1, len(lines)),
        count(_UPPER) / letters,
        count(_DIGIT) / size,
        count(_MARK) / size,
        count(_SYMBOL) / n,
        raw.count(b"|") / n,
        len(_SHOUT.findall(raw)) / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        count(_HIGH) / size,
        raw.count(b"_") / n,
    ]


def measured_rows(texts: pa.Array) -> np.ndarray:
    """The measures of a batch of texts, a row for each; the texts are taken out a few at a time."""
    out = np.zeros((len(texts), len(NAMES)))
    texts = texts.cast(pa.binary())  # never decoded, so bytes that aren't UTF-8 are bytes like others
    for a in range(0, len(texts), SLICE_ROWS):
        for i, text in enumerate(texts.slice(a, SLICE_ROWS).to_pylist(), a):
            out[i] = measures(text)
    return out


@dataclass
class AdditiveModel:
    """edges: of each feature's bins. tables: for each feature. pairs: (i, j, coarse bins of i, of j, table)."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    constant: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _cuts(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins with gradient g and weight h: the value of each bin's leaf."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out[: k + 1], out[k + 1 :] = _cuts(g[: k + 1], h[: k + 1], depth - 1, least, ridge), _cuts(g[k + 1 :], h[k + 1 :], depth - 1, least, ridge)
    return out


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.1, depth: int = 2, least: float = 1.0, ridge: float = 1.0) -> AdditiveModel:
    """x: rows by features; y: 0 or 1. The same model for the same rows in any order of rows."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return AdditiveModel(constant=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    prior = y.mean()
    m = AdditiveModel([_quantiles(c, bins) for c in x.T], constant=float(np.log(prior / (1 - prior))))
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T, strict=True)]
    z = np.full(len(y), m.constant)
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * _cuts(np.bincount(at[j], y - p, len(t)), np.bincount(at[j], p * (1 - p), len(t)), depth, least, ridge)
            t += step
            z += step[at[j]]
    coarse = [_quantiles(c, 6) for c in x.T]
    cell = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]
    p = 1 / (1 + np.exp(-z))

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[i] * 8 + cell[j], v, 64).reshape(8, 8)

    gains = [((sums(i, j, y - p) ** 2 / (sums(i, j, p * (1 - p)) + ridge)).sum(), i, j) for i in range(x.shape[1]) for j in range(i)]
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        m.pairs.append((i, j, coarse[i], coarse[j], np.zeros((8, 8))))
    for _ in range(pair_rounds):
        for i, j, _, _, t in m.pairs:
            p = 1 / (1 + np.exp(-z))
            g, h = sums(i, j, y - p), sums(i, j, p * (1 - p))
            rows = _cuts(g.sum(1), h.sum(1), 1, least, ridge)  # one cut of i, then one of j in each half
            step = np.zeros((8, 8))
            for v in np.unique(rows):
                half = rows == v
                step[half] = rate * _cuts(g[half].sum(0), h[half].sum(0), 1, least, ridge)
            t += step
            z += step[cell[i], cell[j]]
    return m


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on at most sample_rows labelled documents; they come to the driver as len(NAMES) numbers each."""
    kept = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    kept = kept.filter(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
    kept = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "y")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(measured_rows(texts).tolist(), pa.list_(pa.float64()))

    # kept: sample_rows rows at most; of texts that share an id, the one with the least measures is learnt from
    rows = source.join(F.broadcast(kept), "doc_id").select("doc_id", "y", measured("text").alias("x")).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))
    return fit(x[order], rows["y"].to_numpy(float)[order])


def scores(docs: DataFrame, model: AdditiveModel, text_col: str) -> DataFrame:
    """row: the columns of docs, so that none of their names meets one from here; score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables of fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(sent.value.score(measured_rows(texts)))

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), score(F.col(f"`{text_col}`")).alias("score"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: AdditiveModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id counts as not held out."""
    model = model or learn(docs, labels, id_col, text_col)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = scores(source, model, "text").select("row.doc_id", "score")
    return out.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The documents with a score of THRESHOLD or more, with the columns they came with."""
    return scores(docs, model, text_col).filter(F.col("score") >= THRESHOLD).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
