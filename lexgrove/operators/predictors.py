"""Detectors and scorers as interfaces, and predictors made of them: candidates, scores, a held-out threshold, tags."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators import metrics, scoring
from lexgrove.operators.annotations import SENTENCE, with_runs
from lexgrove.sources.workspace import stored

PHRASE = (*SENTENCE, "start")


class Detector(Protocol):
    """Finds spans: doc_id, sent_id, start, n_tokens, phrase, is_entity, kind."""

    def detect(self, rows: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """Learns from token rows and gives phrases (PHRASE, phrase, ...) a column score."""

    def fit(self, rows: DataFrame) -> Scorer: ...

    def transform(self, phrases: DataFrame, rows: DataFrame) -> DataFrame: ...


class TfIdf:
    """A phrase's mean inverse document frequency, from the documents it was fitted on."""

    def __init__(self) -> None:
        self.weights: DataFrame | None = None

    def fit(self, rows: DataFrame) -> TfIdf:
        texts = rows.groupBy("doc_id").agg(F.array_join(F.collect_list("token"), " ").alias("text"))
        self.weights = scoring.idf(texts)
        return self

    def transform(self, phrases: DataFrame, rows: DataFrame) -> DataFrame:
        if self.weights is None:
            raise ValueError("fit the scorer first")
        keyed = phrases.withColumn("phrase_id", F.struct(*PHRASE))
        return scoring.tfidf_score(keyed, self.weights).drop("phrase_id")


class TextRank:
    """A phrase's mean rank in its own document's graph; nothing is learned."""

    def fit(self, rows: DataFrame) -> TextRank:
        return self

    def transform(self, phrases: DataFrame, rows: DataFrame) -> DataFrame:
        ranks = scoring.page_rank(scoring.nodes(rows), scoring.edges(rows))
        inside = phrases.select(*PHRASE, F.explode(F.sequence("start", F.col("start") + F.col("n_tokens") - 1)).alias("tok_id"))
        scored = scoring.rank_score(inside.join(rows, [*SENTENCE, "tok_id"]), ranks, list(PHRASE))
        return phrases.join(scored.select(*PHRASE, F.col("normalised").alias("score")), list(PHRASE), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def candidates(rows: DataFrame, grammar: str = "^[CDJNP]") -> DataFrame:
    """PHRASE, n_tokens, phrase, flag (a noun phrase), proper (has a proper noun), target (has a token of an entity): all chunks."""
    marked = with_runs(rows.withColumn("_np", F.col("pos").rlike(grammar)), "_np")
    ordered = F.sort_array(F.collect_list(F.struct("tok_id", "token")))
    out = marked.groupBy(*SENTENCE, "run_id").agg(F.min("tok_id").alias("start"), F.count("*").cast("int").alias("n_tokens"), ordered.alias("o"), F.first("_np").alias("flag"), F.bool_or(F.col("pos") == "NNP").alias("proper"), F.bool_or(F.col("ner") != "O").alias("target"))
    return out.select(*PHRASE, "n_tokens", F.array_join(F.transform("o", lambda x: x["token"]), " ").alias("phrase"), "flag", "proper", "target")


def report(scored: DataFrame, predicted: str = "predicted") -> DataFrame:
    """The classification report of phrases by target and predicted."""
    name = lambda c: F.when(F.col(c), "entity").otherwise("other")
    return metrics.classification_report(scored.select(name("target").alias("gold"), name(predicted).alias("said")), "gold", "said")


def with_held_out_threshold(scorer: Scorer, train: DataFrame, test: DataFrame, steps: int = 64) -> DataFrame:
    """The test rows' candidates with score and predicted; scorer and threshold are learned on the train rows alone.

    The threshold is the sweep's with the best F1 on the train rows, ties to the least."""
    fitted = scorer.fit(train)
    return held_out(fitted.transform(candidates(train), train), fitted.transform(candidates(test), test), steps)


def held_out(train: DataFrame, test: DataFrame, steps: int = 64) -> DataFrame:
    """The scored test chunks with predicted, by the threshold of the scored train chunks."""
    best = metrics.best_threshold(metrics.threshold_curve(train, "score", "flag", "target", steps)).select("threshold")
    return test.crossJoin(F.broadcast(best)).withColumn("predicted", F.col("flag") & (F.col("score") >= F.col("threshold") - 1e-6)).drop("threshold")  # best: one row


def by_graph_rank(train: DataFrame, test: DataFrame, steps: int = 64) -> DataFrame:
    """with_held_out_threshold of TextRank for the annotations of documents: a document's graph is made and ranked where it is read."""
    score = scoring.length_normalised(F.col("raw"), F.col("n_tokens"), F.col("content")).alias("score")
    scored = lambda docs: scoring.document_chunks(docs, True).select(*PHRASE, "n_tokens", "phrase", "flag", "proper", "target", score)
    return held_out(scored(train), scored(test), steps)


def by_tfidf(docs: DataFrame, learnt: Column, tested: Column, steps: int = 64) -> DataFrame:
    """with_held_out_threshold of TfIdf for the annotations of documents, trained on the learnt ones; the candidates without their phrases.

    Scores are written once, as the threshold reads them several times."""
    scored = stored(scoring.document_tfidf(docs.filter(learnt | tested), learnt))
    return held_out(scored.filter(learnt), scored.filter(tested), steps)


def by_proper_nouns(test: DataFrame) -> DataFrame:
    """The candidates, predicted where they hold a proper noun."""
    return candidates(test).withColumn("predicted", F.col("flag") & F.col("proper"))


def by_clusters(vectors: DataFrame, clusters: DataFrame, label: str) -> DataFrame:
    """vec_id, predicted: the most frequent label of the vector's cluster. clusters: vec_id, cluster."""
    both = vectors.join(clusters, "vec_id")
    return both.join(metrics.most_frequent(both, ["cluster"], label, "predicted"), "cluster").select("vec_id", "predicted")
