"""Facts as (subject, predicate, object), pattern matching over them, and a rule-based extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.annotations import SENTENCE


def match(facts: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of the patterns' variables (written ?name). Patterns share variables through equi-joins, in the given order."""
    frames = []
    for pattern in patterns:
        df, names = facts, {}
        for column, term in zip(("subject", "predicate", "object"), pattern, strict=True):
            if not term.startswith("?"):
                df = df.filter(F.col(column) == term)
            elif term in names:
                df = df.filter(F.col(column) == F.col(names[term]))
            else:
                names[term] = column
        frames.append(df.select(*(F.col(c).alias(n[1:]) for n, c in names.items())))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        return a.join(b, shared)

    return reduce(joined, frames)


def star_facts(nation: DataFrame, region: DataFrame, customer: DataFrame) -> DataFrame:
    """The tables' keys as facts, the number of customers as the nations' population."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    fact = lambda s, p, o: (s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    return (
        nation.select(*fact(name("nation", "n_nationkey"), "inRegion", name("region", "n_regionkey")))
        .union(nation.select(*fact(name("nation", "n_nationkey"), "label", F.col("n_name"))))
        .union(region.select(*fact(name("region", "r_regionkey"), "label", F.col("r_name"))))
        .union(customer.select(*fact(name("customer", "c_custkey"), "inNation", name("nation", "c_nationkey"))))
        .union(customer.groupBy("c_nationkey").count().select(*fact(name("nation", "c_nationkey"), "population", F.col("count").cast("string"))))
    )


def extracted(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, sent_id, subject, predicate, object: noun phrase, verbs, noun phrase. A substitute by rule for a trained extractor.

    spans: of noun_phrase_chunks; rows: the tokens with pos."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*SENTENCE).orderBy("start")
    verbs = rows.filter(F.col("pos").startswith("VB")).groupBy(*SENTENCE).agg(F.collect_set("tok_id").alias("verbs"))
    around = spans.select(*SENTENCE, "start", "n_tokens", "phrase", "is_entity", F.lag("phrase").over(w).alias("subject"), F.lag("is_entity").over(w).alias("_s"), F.lead("phrase").over(w).alias("object"), F.lead("is_entity").over(w).alias("_o"))
    held = around.filter("not is_entity and _s and _o").join(verbs, list(SENTENCE))
    return held.filter(F.exists("verbs", lambda v: (v >= F.col("start")) & (v < F.col("start") + F.col("n_tokens")))).select(*SENTENCE, "subject", F.col("phrase").alias("predicate"), "object")
