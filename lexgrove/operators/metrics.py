"""Evaluation: reports, votes, thresholds, ratios. 0/0 counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.sources.workspace import running_total


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def classification_report(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1_score, support; then accuracy, macro avg and weighted avg. One shuffle of the pairs' counts."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("x"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    by = sides.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), (F.sum("hit") / 2).alias("hits"))
    by = by.withColumn("precision", ratio(F.col("hits"), F.col("said"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    by = by.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1_score")
    # the labels' rows and their averages in one row, so that the pairs aren't counted again for each average
    total, right = F.sum("support"), ratio(F.sum("hits"), F.sum("support"))
    line = lambda label, values: F.struct(F.lit(label).alias("label"), *(v.alias(m) for m, v in zip(measures, values, strict=True)), total.alias("support"))
    accuracy, macro = line("accuracy", [right] * 3), line("macro avg", [F.avg(m) for m in measures])
    weighted = line("weighted avg", [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in measures])
    whole = by.agg(F.collect_list(F.struct("label", *measures, "support")).alias("_by"), F.array(accuracy, macro, weighted).alias("_all"))
    out = whole.select(F.explode(F.concat("_by", "_all")).alias("_x")).select("_x.*")
    return out.select("label", *(F.round(m, 6).alias(m) for m in measures), "support")


def report_table(report: DataFrame) -> DataFrame:
    """The report for print: no accuracy row, averages in title case."""
    label = F.when(F.col("label").isin("macro avg", "weighted avg"), F.initcap("label")).otherwise(F.col("label"))
    return report.filter("label <> 'accuracy'").select(label.alias("Class"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1_score").alias("F1-Score"), F.col("support").cast("int").alias("Support"))


def latex_table(report: DataFrame) -> str:
    """A small report as LaTeX; the frame has one row for each class."""
    rows = report_table(report).orderBy("Class").collect()
    line = lambda cells: " & ".join(cells) + r" \\"
    body = [line([r[0], *(f"{x:.2f}" for x in r[1:4]), str(r[4])]) for r in rows]
    return "\n".join([r"\begin{tabular}{lrrrr}", line(["Class", "Precision", "Recall", "F1-Score", "Support"]), r"\hline", *body, r"\end{tabular}"])


def accuracy(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def most_frequent(rows: DataFrame, keys: list[str], value: str, name: str = "label") -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), value)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, F.col(value).alias(name))


def mapped(rows: DataFrame, mapping: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the mapped value and keeps the original; a value that the mapping lacks gives NULL."""
    return rows.join(mapping, column, "left").withColumnRenamed(column, f"{column}_original").withColumnRenamed(to, column)


def chunk_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 over spans that agree in all keys."""
    marks = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).union(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p"))).groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = marks.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("n_right"))
    n = n.withColumn("precision", ratio(F.col("n_right"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("n_right"), F.col("n_gold")))
    return n.select("n_gold", "n_predicted", "n_right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1_score"))


def conditional_ratios(rows: DataFrame) -> DataFrame:
    """Shares between entity tokens, noun-phrase tokens and proper nouns, in percent; one pass."""
    ner, np_, nnp = F.col("ner") != "O", F.col("pos").rlike("^[CDJNP]"), F.col("pos") == "NNP"
    cases = {"np_given_ner": (np_, ner), "ner_given_np": (ner, np_), "nnp_given_ner": (nnp, ner), "ner_given_nnp": (ner, nnp)}
    counted = rows.agg(*(F.count_if(a & b).alias(f"{k}_n") for k, (a, b) in cases.items()), *(F.count_if(b).alias(f"{k}_d") for k, (_, b) in cases.items()))
    row = lambda k: F.struct(F.lit(k).alias("measure"), F.col(f"{k}_n").alias("numerator"), F.col(f"{k}_d").alias("denominator"))
    out = counted.select(F.explode(F.array(*map(row, cases))).alias("x")).select("x.*")
    return out.withColumn("percent", F.round(100 * F.round(ratio(F.col("numerator"), F.col("denominator")), 4), 2))


def quantiles(rows: DataFrame, score: str, **shares: float) -> DataFrame:
    """One row with a column for each share: the score below which it lies, between neighbours in proportion. NULLs don't count.

    Scores are counted and summed up range by range, so no task holds all of them."""
    counts = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, ["_v"], "_n", "_before")
    total = ranked.agg(F.sum("_n").alias("_all"))
    at = ranked.crossJoin(F.broadcast(total))  # one row

    def value(place: Column) -> Column:
        return F.max(F.when(F.col("_before") <= place, F.col("_v")))

    columns = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * share
        columns += [value(F.floor(place)).alias(f"_lo_{name}"), value(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = at.agg(*columns)
    return found.select(*((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares))


def above_median(rows: DataFrame, score: str, flag: str) -> DataFrame:
    """Adds predicted: flagged, and scored above the median of all."""
    median = quantiles(rows, score, _m=0.5)
    return rows.crossJoin(F.broadcast(median)).withColumn("predicted", F.col(flag) & (F.col(score) > F.col("_m"))).drop("_m")  # _m: one row


def threshold_curve(rows: DataFrame, score: str, flag: str, target: str, steps: int = 32) -> DataFrame:
    """threshold, precision, recall, f1_score for thresholds between the quartiles.

    Each row falls in one bucket between thresholds; the curve is a running sum over at most steps + 1 buckets, so the
    rows are read twice and never multiplied.
    """
    q = quantiles(rows, score, _a=0.25, _b=0.75)
    x = rows.crossJoin(F.broadcast(q)).withColumn("_w", (F.col("_b") - F.col("_a")) / steps)  # q: one row
    at = F.when(F.col(score) < F.col("_a"), -1).when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col(score) - F.col("_a")) / F.when(F.col("_w") != 0, F.col("_w"))), F.lit(steps - 1)))
    counts = x.withColumn("_k", at.cast("int")).groupBy("_k").agg(F.count_if(F.col(flag)).alias("said"), F.count_if(F.col(flag) & F.col(target)).alias("hits"), F.count_if(F.col(target)).alias("gold"))
    grid = q.select("_a", ((F.col("_b") - F.col("_a")) / steps).alias("_w"), F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("_k")).filter("_w > 0 or _k <= 0")
    w = Window.orderBy(F.desc("_k"))  # over at most steps + 1 rows
    total = grid.join(F.broadcast(counts), "_k", "left").select("_k", (F.col("_a") + F.col("_k") * F.col("_w")).alias("threshold"), F.sum(F.coalesce("said", F.lit(0))).over(w).alias("said"), F.sum(F.coalesce("hits", F.lit(0))).over(w).alias("hits"), F.sum(F.coalesce("gold", F.lit(0))).over(Window.partitionBy()).alias("gold")).filter("_k >= 0")
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("gold"))
    return total.select(F.round("threshold", 6).alias("threshold"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1_score"))


def best_threshold(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("f1_score"), "threshold").limit(1)
