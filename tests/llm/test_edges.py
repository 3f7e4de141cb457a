"""Nulls, ids of 64 bits beside them, repeated ids and rows, empty tables and clashing names, for every operator with ids."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexgrove.llm import ann, blocks, html_wrappers, interpolated_lm, line_rules, packing, partenum, quality_model, recompression, segmentations, url_filter

BIG = 2**60 + 1
RNG = random.Random(5)
WORDS = [f"v{i}" for i in range(90)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ONE, TWO = text(70), text(80)
#: a null id beside ids of 61 bits, one id on different texts, the same row three times
ROWS = [(BIG, ONE), (None, TWO), (BIG + 2, None), (BIG + 4, ""), (7, text(60)), (7, text(65)), (8, ONE), (9, TWO), (9, TWO), (9, TWO), (None, None)]
#: names that operators use inside, as columns of the input
CLASH = "c0 string, chunk string, place int, row string, verdict string, score string, kept boolean, rank string, n_chars long"


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "w", "v", True, "u", len(r[1] or "")) for r in rows], f"doc_id {kind}, text string, {CLASH}")


def by_id(operator, docs):
    return [r["doc_id"] for r in operator(docs).collect()]


OPERATORS = {
    "op4": interpolated_lm.score_corpus,
    "op5": partenum.near_duplicates,
    "op6": lambda d: segmentations.sample_segmentations(d, k=1),
    "op10": recompression.without_repeats,
    "op2": line_rules.line_first,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_keep_their_digits(spark, name):
    assert Counter(by_id(OPERATORS[name], frame(spark, ROWS))) == Counter(r[0] for r in ROWS)
    texts = [(None if r[0] is None else f"id-{r[0]}", r[1]) for r in ROWS]
    assert Counter(by_id(OPERATORS[name], frame(spark, texts, "string"))) == Counter(r[0] for r in texts)


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_one_id_and_no_rows(spark, name):
    for i in (None, 3):
        assert by_id(OPERATORS[name], frame(spark, [(i, r[1]) for r in ROWS])) == [i] * len(ROWS)
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_packing_ids(spark):
    packed = packing.pack(frame(spark, ROWS)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in ROWS}
    assert sum(r["length"] for r in packed if r["start"] == 0 or True) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


def test_near_duplicates_by_id(spark):
    got = {(r["doc_id"], r["component_id"]) for r in partenum.near_duplicates(frame(spark, ROWS)).collect()}
    assert got == {(BIG, 8), (8, 8), (None, None), (BIG + 2, BIG + 2), (BIG + 4, BIG + 4), (7, 7), (9, 9)}
    kept = partenum.one_of_each(frame(spark, ROWS))
    assert kept.columns == frame(spark, ROWS).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([*ROWS[1:8], ROWS[10]])


def test_null_ids_take_no_links_from_their_copies(spark):
    """Rows with a null id stand before copies of theirs; the copies keep their sets, and so their links, and get no others."""
    one, two = [text(5).split() * 2 + [f"{k}{i}" for i in range(300)] for k in "ab"]
    near = [*one[:100], "changed", *one[101:]]
    rows = [(None, " ".join(one)), (None, " ".join(two)), (5, " ".join(one)), (6, " ".join(near)), (7, " ".join(two))]
    docs = frame(spark, rows).coalesce(1)
    found = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()}
    assert found == {None: None, 5: 5, 6: 5, 7: 7}
    assert sorted(r["doc_id"] or 0 for r in partenum.one_of_each(docs).collect()) == [0, 0, 5, 7]


def test_cleaned_keeps_all_columns(spark):
    docs = frame(spark, ROWS)
    rows = recompression.cleaned(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    assert all(tuple(r)[2:10] == ("x", "y", 1, "z", "w", "v", True, "u") and r["n_chars"] == len(r["text"] or "") for r in rows)


def test_two_steps_of_merging(spark, monkeypatch):
    docs = frame(spark, ROWS)
    wanted = [sorted(map(repr, f(docs).collect())) for f in (recompression.without_repeats, partenum.near_duplicates, interpolated_lm.score_corpus)]
    for name, value in (("BUNDLE_CHARS", 400), ("PART_CHARS", 100), ("MOST_PARTS", 4), ("GROUP", 2)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(interpolated_lm, "CHARS", 300)
    assert blocks.sent_parts(blocks.parts_for(4000)) < blocks.parts_for(4000)
    got = [f(docs).collect() for f in (recompression.without_repeats, partenum.near_duplicates)]
    assert [sorted(map(repr, g)) for g in got] == wanted[:2]
    scores = sorted((r["base_score"], r["score"]) for r in interpolated_lm.score_corpus(docs).collect())
    single = sorted((r["base_score"], r["score"]) for r in _scored_once(spark, docs, monkeypatch))
    assert len(scores) == len(single) and all(abs(a - c) < 1e-9 and abs(b - d) < 1e-6 for (a, b), (c, d) in zip(scores, single, strict=True))


def _scored_once(spark, docs, monkeypatch):
    monkeypatch.undo()
    return interpolated_lm.score_corpus(docs).collect()


def test_neighbours_of_repeated_rows(spark):
    near = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.2]]
    rows = [(20, near[0], "a")] * 3 + [(1, near[1], "a"), (2, near[2], "b"), (2, near[2], "b"), (None, near[0], "c"), (BIG, near[2], "d")]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect()]
    assert sorted(got) == [(20, 1, 1), (20, 2, 2), (20, 3, 2), (20, 4, BIG)]


def test_pages(spark):
    page = "<body><article><p>Body text {}</p></article></body>"
    rows = [(BIG, "http://a.org/x", page.format(1), "x"), (None, None, page.format(2), "y"), (None, "http://a.org/x", None, "z"), (BIG, "http://a.org/x", page.format(1), "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_wrappers.extract_main_text(docs).collect())
    assert got == Counter({(BIG, "Body text 1", 11): 2, (None, "Body text 2", 11): 1, (None, "", 0): 1})
    assert html_wrappers.extract_main_text(docs.limit(0)).count() == 0
    by_join = html_wrappers.BROADCAST_CHARS
    try:  # the other way to bring wrappers to pages
        html_wrappers.BROADCAST_CHARS = -1
        assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_wrappers.extract_main_text(docs).collect()) == got
    finally:
        html_wrappers.BROADCAST_CHARS = by_join
    assert [r["page_id"] for r in url_filter.judge_urls(docs.withColumnRenamed("text", "host")).collect()] == [BIG, None, None, BIG]


def test_rules_remove_lines_and_keep_columns(spark):
    clean = "This is a sentence with some words in it. " * 3 + "Every one differs: " + ", ".join(f"item{i}" for i in range(60)) + "."
    docs = frame(spark, [(1, clean), (2, "Home | About | News | Shop | Login\n" + clean), (3, None), (1, clean)])
    docs = docs.withColumnRenamed("c0", "_n").withColumnRenamed("chunk", "_t")
    got = line_rules.keep_passing(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == Counter({(1, clean, len(clean)): 2, (2, clean, len(clean)): 1})


def test_quality_labels(spark):
    good, bad = [f"A fine sentence number {i} with many words, and a second part." for i in range(12)], ["$$ | || ## " * (i + 2) for i in range(12)]
    docs = frame(spark, [*((i, t) for i, t in enumerate(good + bad)), (0, good[0]), (None, good[1])])
    rows = [(i, int(i < 12), 0) for i in range(24)] + [(5, 0, 0), (6, None, 0), (None, 1, 0), (1, 1, 0), (1, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = quality_model.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs, labels).collect()}
    assert min(scores[i] for i in range(12)) > max(scores[i] for i in range(12, 24))
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, None}
    for given, share in (([], 0.5), ([(i, 1, 0) for i in range(12)], 1.0)):
        one_sided = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
        assert all(abs(r["score"] - share) < 0.01 for r in quality_model.score_quality(docs, one_sided).collect())


def test_pipeline(spark, tmp_path):
    """Five stages on a small corpus, each against what it must have done."""
    clean = [". ".join(text(12) for _ in range(12)) + "." for _ in range(30)]
    passage = " ".join(text(60).split())
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " " + passage), (102, clean[2] + " " + passage), (103, "Home | About | Shop\n" + clean[3]), (104, "short"), (105, None), (106, ""), (None, clean[4] + " only here")]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(30)] + [(104, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, seen = str(tmp_path), {}
    out = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()}
    assert not {104, 105, 106} & set(seen["quality_rules"]) and set(range(30)) <= set(seen["quality_rules"]) and seen["quality_rules"][103] == clean[3]
    assert 100 not in seen["near_duplicates"] and 0 in seen["near_duplicates"] and 103 not in seen["near_duplicates"]
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(seen["substring_dedup"])
    assert not any(passage in (t or "") for t in seen["substring_dedup"].values())
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline_takes_bytes_that_are_not_utf8(spark, tmp_path):
    """They stop no stage, and no word with or without them is lost on the way."""
    passage = text(60)
    rows = [(i, ". ".join(text(12) for _ in range(12)) + "." + (" " + passage) * (i > 17)) for i in range(20)]
    docs = frame(spark, rows).withColumn("text", F.expr("cast(case when doc_id % 2 = 0 then concat(X'FF41C3', X'20', cast(text as binary)) else cast(text as binary) end as string)"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.filter("not is_valid_utf8(text)").count() == 10

    def held(stage):
        return {r["doc_id"]: bytes(r["raw"]) for r in stage(spark, docs, sf).select("doc_id", F.col("text").cast("binary").alias("raw")).collect()}

    given = held(lambda s, d, _: d)
    assert held(corpus_pipeline.quality_classifier) == held(corpus_pipeline.near_duplicates) == given
    cleaned = held(corpus_pipeline.substring_dedup)
    assert cleaned[18] == b" ".join(given[18].removesuffix(passage.encode()).split()) and all(cleaned[i] == given[i] for i in range(18))
    assert {r["doc_id"] for r in corpus_pipeline.harmonic_packing(spark, docs, sf).collect()} == {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(range(20))
