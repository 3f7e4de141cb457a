"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages take null and empty texts for texts without words, read whole texts, also those with bytes that aren't UTF-8, keep
repeated rows apart until near_duplicates, give an empty result for an empty table, and all but the last return the columns they got, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import line_rules, packing, partenum, quality_model, recompression
from lexgrove.llm.common import stored, table
from lexgrove.sources.workspace import shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail; null and empty texts go."""
    return line_rules.keep_passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.7 or more; it learns from the labelled documents of sf_dir. Null texts are scored as empty ones."""
    shipped(spark)
    model = quality_model.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of repeated rows the first. Documents without a link
    stay, those with a null id and those without words too."""
    shipped(spark)
    return partenum.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated passages; a document that loses nothing stays as it is, one that loses all stays empty."""
    shipped(spark)
    return recompression.cleaned(docs)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' sequences; a null or empty text gives its end token."""
    shipped(spark)
    return packing.pack(docs, most_kept=60_000_000, lasting=False)  # its workers go on with other stages


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("harmonic_packing", harmonic_packing),
]
#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written once, so that no later one evaluates it again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
