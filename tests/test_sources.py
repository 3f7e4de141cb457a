"""Readers, writers, running numbers, predictors and models on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexgrove.operators import annotations as A
from lexgrove.operators import capacity, metrics, models, predictors, render, scoring, sequences, vectors
from lexgrove.plans import source_queries
from lexgrove.sources import readers, workspace


def test_conll_ids_run_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("dropped\n-DOCSTART- -X- O O\n\nEU NNP I-NP I-ORG\n\n-DOCSTART- -X- O O\n\nPeter NNP I-NP I-PER\nran VB O O\n")
    (tmp_path / "b.txt").write_text("-DOCSTART- -X- -X- O\n\nLast NNP I-NP I-PER\n\nNext NN I-NP O\n")
    rows = readers.conll(spark, str(tmp_path)).orderBy("doc_id", "sent_id", "tok_id").collect()
    assert [(r["doc_id"], r["sent_id"], r["tok_id"], r["token"]) for r in rows] == [(0, 0, 0, "EU"), (1, 0, 0, "Peter"), (1, 0, 1, "ran"), (2, 0, 0, "Last"), (2, 1, 0, "Next")]
    counts = readers.conll_counts(spark, str(tmp_path)).first()
    assert (counts["n_docs"], counts["n_sentences"]) == (3, 4)


def test_large_files_are_split_between_marks(spark, tmp_path):
    docs = [f"-DOCSTART- -X- O O\n\nword{i} NN I-NP O\n" + "filler NN I-NP O\n" * 60 + "\n" for i in range(300)]
    (tmp_path / "x.txt").write_text("".join(docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = readers.conll(spark, str(tmp_path))
        first = {r["doc_id"]: r["token"] for r in found.filter("tok_id = 0").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == {i: f"word{i}" for i in range(300)}


def test_shards_are_read_as_written(spark, tmp_path):
    counts = spark.createDataFrame([("a", "X", 2), ("a", 'Y "q"', 1), ("b\n", "Z", 5)], "anchor string, entity string, n long")
    path = str(tmp_path / "shards")
    readers.write_shards(counts, path, rows_per_file=1)
    assert {tuple(r) for r in readers.shards(spark, path).collect()} == {tuple(r) for r in counts.collect()}
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "p.json").write_text(json.dumps({"a": {"X": 1}, "c": {"W": 2}}, indent=1))
    assert {tuple(r) for r in readers.shards(spark, str(tmp_path / "old"), whole_files=True).collect()} == {("a", "X", 1), ("c", "W", 2)}


def test_dump_round_trip(spark, tmp_path):
    rows = [("A", 0, 1, None, "[[B|b]] & <x>"), ("C d", 4, 2, "A", None)]
    pages = spark.createDataFrame(rows, "title string, ns int, id long, redirect string, text string")
    path = str(tmp_path / "dump")
    readers.write_pages(pages, path)
    got = readers.pages(spark, path).select("title", "ns", "id", "redirect", "text")
    assert {tuple(r) for r in got.collect()} == set(rows)


def test_listing_settings_digests(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    for name, text in (("pages-1.xml", "abc"), ("pages-index.txt", "x"), (".DS_Store", "y")):
        (files / name).write_text(text)
    assert [tuple(r) for r in readers.listing(spark, str(files)).collect()] == [("pages-1.xml", 3)]
    assert {r["file"]: r["sha1"] for r in readers.digests(spark, str(files)).collect()}["pages-1.xml"] == "a9993e364706816aba3e25717850c26c9cd0d89d"
    config = tmp_path / "c.yaml"
    config.write_text("page_extractor_workers: -1\nsaver_workers: 1\nname: 'x'  # comment\nrate: 0.5\nflag: true\n")
    got = readers.settings(spark, str(config))
    assert got == {"page_extractor_workers": spark.sparkContext.defaultParallelism, "saver_workers": 1, "name": "x", "rate": 0.5, "flag": True}


def test_running_totals(spark):
    rng = random.Random(1)
    values = [(i // 3, i % 3, rng.randrange(5)) for i in range(400)]
    rng.shuffle(values)
    rows = spark.createDataFrame(values, "a int, b int, v long").repartition(5)
    got = {(r["a"], r["b"]): (r["t"], r["n"]) for r in workspace.numbered(workspace.running_total(rows, ["a", "b"], "v", "t"), ["a", "b"], "n").collect()}
    total = 0
    for n, (a, b, v) in enumerate(sorted(values)):
        assert got[a, b] == (total, n)
        total += v


def test_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())


def test_sentences_and_words(spark):
    row = spark.sql("select 'One here. Two there!  \"Three\" now' as t").select(A.sentences_of(F.col("t")).alias("s"), A.words_of(F.lit("He didn't say (much), we're done.")).alias("w")).first()
    assert row["s"] == ["One here.", "Two there!", '"Three" now']
    assert row["w"] == ["He", "did", "n't", "say", "(", "much", ")", ",", "we", "'re", "done", "."]


def test_annotation_against_a_loop(spark):
    docs = spark.createDataFrame([(1, "src0", "The Big Cat saw 3 dogs\n\nand Ann Lee"), (2, "src1", None), (3, "src1", " Zed ")], "doc_id long, source string, text string")
    got = {(r["doc_id"], r["sent_id"], r["tok_id"]): (r["token"], r["pos"], r["ner"]) for r in A.annotated(docs).collect()}
    kinds = ("LOC", "MISC", "ORG", "PER")
    big, ann, zed = (f"I-{kinds[(ord(c) + turn) % 4]}" for c, turn in (("B", 1), ("A", 1), ("Z", 0)))
    assert got == {
        (1, 0, 0): ("The", "DT", "O"), (1, 0, 1): ("Big", "NNP", big), (1, 0, 2): ("Cat", "NNP", big), (1, 0, 3): ("saw", "NN", "O"), (1, 0, 4): ("3", "CD", "O"), (1, 0, 5): ("dogs", "NN", "O"),
        (1, 2, 0): ("and", "CC", "O"), (1, 2, 1): ("Ann", "NNP", ann), (1, 2, 2): ("Lee", "NNP", ann), (3, 0, 0): ("Zed", "NNP", zed),
    }


def test_zip(spark):
    left = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, None)], "doc_id long, sent_id int, tok_id int, token string")
    right = left.withColumn("tag", F.lit("T"))
    assert sequences.zipped(left, right).count() == 2 and sequences.zip_mismatches(left, right).count() == 0
    changed = right.filter("tok_id < 2").replace("b", "c", ["token"])
    assert {r["tok_id"] for r in sequences.zip_mismatches(left, changed).collect()} == {1}


def corpus(spark, n=40):
    texts = [f"the Dog{i % 5} saw a cat and Ann Lee{i % 3} was running by the house{i % 7}" for i in range(n)]
    return A.annotated(spark.createDataFrame([(i, "src1", t) for i, t in enumerate(texts)], "doc_id long, source string, text string"))


def test_models_are_saved_and_stop_early(spark, tmp_path):
    rows = sequences.neighbour_features(corpus(spark), "ner")
    train, validation = rows.filter("doc_id % 4 > 0"), rows.filter("doc_id % 4 = 0")
    model, losses = models.train_until(train, validation, ["pos", "prevpos"], "ner", epochs=(1, 2, 4, 8, 8, 8, 8), patience=2)
    assert models.loss_of(model, validation) == pytest.approx(min(x for _, x in losses)) and len(losses) < 7
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    keys = ["doc_id", "sent_id", "tok_id", "predicted"]
    assert sorted(map(tuple, models.max_entropy_tags(model, validation).select(*keys).collect())) == sorted(map(tuple, models.max_entropy_tags(again, validation).select(*keys).collect()))


def test_predictors_end_to_end(spark):
    rows = corpus(spark)
    train, test = rows.filter("doc_id < 30"), rows.filter("doc_id >= 30")
    for scorer in (predictors.TfIdf(), predictors.TextRank()):
        found = predictors.with_held_out_threshold(scorer, train, test)
        assert all(r["predicted"] <= r["flag"] for r in found.collect())
        assert {r["label"] for r in predictors.report(found).collect()} >= {"accuracy", "macro avg"}
    assert all(r["predicted"] == r["target"] for r in predictors.by_proper_nouns(test).collect() if r["flag"])
    with pytest.raises(ValueError, match="fit"):
        predictors.TfIdf().transform(predictors.candidates(test), test)


def test_capacity(spark):
    docs = spark.createDataFrame([("x" * 100,)] * 50, "text string")
    assert tuple(capacity.sizes(docs, "text", 1000, 2).first()) == (100, 10_000, 10, 100.0)
    plan = capacity.measured(docs, lambda d: d.select(F.length("text")), 1_000_000, 100, 10_000, 100.0)
    assert (plan.rows, plan.rows_a_partition, plan.partitions) == (50, 100, 10_000) and plan.projected_seconds > 0


def test_labels_and_batches(spark):
    row = spark.range(1).select(models.labels_of(F.array(F.lit(1), F.lit(0), F.lit(9)), ["A", "B"]).alias("x")).first()
    assert row["x"] == ["B", "A", "O"]
    got = models.batches(spark.range(50).withColumnRenamed("id", "k"), ["k"], 8).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == [2] + [8] * 6


def test_early_stopping_query(spark, tmp_path):
    docs = [(i, "src1", f"the Dog{i} saw a cat by Ann{i % 3}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    losses = [r["loss"] for r in source_queries.early_stopping(spark, str(tmp_path)).orderBy("iterations").collect()]
    assert losses and min(losses) <= losses[0]
    report = source_queries.textrank_predictor(spark, str(tmp_path)).collect()
    assert {r["label"] for r in report} >= {"entity", "other", "accuracy"}


def test_every_query_has_sql_or_a_test():
    without = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert {q for q in without if not q.startswith("op") and q != "pipeline"} == {"bigram_chunker", "maxent_chunker", "kmeans_clusters", "elbow_k", "early_stopping", "textrank_predictor"}


def test_quantiles_and_ranks(spark):
    rng = random.Random(4)
    values = [rng.choice([0.5, 1.25, 2.0, 7.0, 7.5]) for _ in range(41)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "s double").repartition(3)
    got = metrics.quantiles(rows, "s", a=0.25, b=0.5, c=0.9).first()
    ordered = sorted(values)

    def wanted(share):
        place = (len(ordered) - 1) * share
        low, part = int(place), place - int(place)
        return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * part

    assert [got[c] for c in "abc"] == pytest.approx([wanted(x) for x in (0.25, 0.5, 0.9)])
    whole = rows.filter("s is not null")
    one, all_ = scoring.percentile_rank(whole.withColumn("k", F.lit(1)), "s", ["k"]), scoring.percentile_rank(whole, "s")
    assert sorted((r["s"], r["percentile"]) for r in one.collect()) == sorted((r["s"], r["percentile"]) for r in all_.collect())


def test_indicators_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    vectors_ = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    rows = spark.createDataFrame(vectors_, "vec_id long, embedding array<double>")
    indicators = rows.filter("vec_id < 25").select(F.col("vec_id").alias("indicator_id"), F.col("embedding").alias("v"))
    centroids = rows.filter("vec_id < 25").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("c"))
    whole = sorted(vectors.most_similar(rows, indicators).collect()), sorted(vectors.nearest_centroid(rows, centroids).collect())
    monkeypatch.setattr(vectors, "MOST_SMALL", 4)
    assert (sorted(vectors.most_similar(rows, indicators).collect()), sorted(vectors.nearest_centroid(rows, centroids).collect())) == whole


def test_k_means_finds_separate_clusters(spark):
    rows = spark.createDataFrame([(i, [10.0 * (i % 3) + 0.01 * i, -10.0 * (i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["cluster"] for r in vectors.k_means(rows, 3).collect()}
    assert len(set(found.values())) == 3 and all(found[i] == found[i % 3] for i in found)


def test_latex_table(spark):
    rows = spark.createDataFrame([("A", "A"), ("B", "A")], "g string, p string")
    assert metrics.latex_table(metrics.classification_report(rows, "g", "p")).splitlines() == [
        r"\begin{tabular}{lrrrr}",
        r"Class & Precision & Recall & F1-Score & Support \\",
        r"\hline",
        r"A & 0.50 & 1.00 & 0.67 & 1 \\",
        r"B & 0.00 & 0.00 & 0.00 & 1 \\",
        r"Macro Avg & 0.25 & 0.50 & 0.33 & 2 \\",
        r"Weighted Avg & 0.25 & 0.50 & 0.33 & 2 \\",
        r"\end{tabular}",
    ]


def test_linked_html_by_broadcast_and_by_join(spark, monkeypatch):
    spans = spark.createDataFrame([(0, 0, "Ann", True, None), (0, 1, "saw", False, None), (0, 2, "Bo", True, "PER")], "doc_id long, start int, phrase string, is_entity boolean, kind string")
    top = spark.createDataFrame([("Ann", "Ann A")], "anchor string, entity string")
    small = render.linked_html(spans, top, ["doc_id"]).first()["html"]
    monkeypatch.setattr(render, "MOST_ANCHORS", 0)
    assert render.linked_html(spans, top, ["doc_id"]).first()["html"] == small
    assert small == '<a href="https://en.wikipedia.org/wiki/Ann_A">Ann</a> saw <u class="entity">Bo</u> <span class="type">(PER)</span>'


def test_training_goes_on_until_the_loss_stays(spark, monkeypatch):
    """No list of epochs ends it, and equal rows are one with a weight."""
    falling = iter([0.5, 0.4, 0.3, 0.2, 0.15, 0.12, 0.11, 0.105, 0.105, 0.105])
    monkeypatch.setattr(models, "max_entropy", lambda *a, iterations, **b: iterations)
    monkeypatch.setattr(models, "loss_of", lambda *a: next(falling))
    best, losses = models.train_until(None, None, ["pos"], "ner")
    assert [n for n, _ in losses] == [2**i for i in range(10)] and best == 128
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"))
    got = models.grouped(rows, ["k"]).groupBy("k").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(0, 500.0, 256), (1, 500.0, 256)}
