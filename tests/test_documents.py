"""Steps that stay inside a document: no shuffle of its tokens, and the same results as the operators over token rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import annotations as A
from lexgrove.operators import gazetteer, metrics, predictors, scoring, sequences
from lexgrove.plans import source_queries, text_queries
from lexgrove.sources import readers


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(7)
    words = "the The of and Ann Lee Österreich running jumped cats dogs 3rd 42 house ünder Bob an IN bed".split()
    texts = ["\n".join(rng.choice([" ", "\t ", "\u000b"]).join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [None, "", " \n\n ", "one", "A B C\x1cd e\n\nthe", "the the\na cat", "𝐀b Ǆx éd İng"]
    path = str(tmp_path_factory.mktemp("docs"))
    rows = spark.createDataFrame([(i, f"src{i % 3}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    rows.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_annotations_by_document(spark, sf):
    docs = docs_of(spark, sf)
    rows = A.annotated(docs)
    assert exchanges(rows) == 0
    tokens = A.tokens(docs).withColumn("pos", A.part_of_speech(F.col("token")))
    assert rows_of(rows.select("doc_id", "sent_id", "tok_id", "token", "pos")) == rows_of(tokens)
    first = {}
    wanted = []
    for d, source, s, t, token, pos in rows_of(rows.select("doc_id", "source", "sent_id", "tok_id", "token", "pos")):
        first = {"key": (d, s), "token": token, "pos": pos} if first.get("key") != (d, s) or first["pos"] != pos else first
        wanted.append((d, s, t, "I-" + A.TYPES[(ord(first["token"][0]) + (source == "src0")) % 4] if pos == "NNP" else "O"))
    assert rows_of(rows.select("doc_id", "sent_id", "tok_id", "ner")) == wanted


def test_graphs_by_document(spark, sf):
    rows = A.annotated(docs_of(spark, sf))
    assert rows_of(text_queries.cooccurrence_edges(spark, sf)) == rows_of(scoring.edges(rows))
    ranks = scoring.page_rank(scoring.nodes(rows), scoring.edges(rows)).withColumn("rank", F.round("rank", 6))
    assert rows_of(text_queries.textrank_pagerank(spark, sf)) == rows_of(ranks)
    for query in (text_queries.cooccurrence_edges, text_queries.textrank_pagerank, text_queries.textrank_phrase_score):
        assert exchanges(query(spark, sf)) == 0


def test_chunks_by_document(spark, sf):
    docs = docs_of(spark, sf)
    names = ["doc_id", "sent_id", "start", "n_tokens", "phrase", "flag", "proper", "target"]
    rows = A.annotated(docs)
    assert rows_of(scoring.document_chunks(docs).select(*names)) == rows_of(predictors.candidates(rows).select(*names))
    score = scoring.length_normalised(F.col("raw"), F.col("n_tokens"), F.col("content"))
    got = scoring.document_chunks(docs, True).select(*names[:3], F.round(score, 6).alias("score"))
    wanted = predictors.TextRank().transform(predictors.candidates(rows), rows).select(*names[:3], F.round("score", 6).alias("score"))
    assert rows_of(got) == rows_of(wanted) and exchanges(got) == 0


def test_sentences_by_document(spark, sf):
    rows = A.annotated(docs_of(spark, sf))
    assert rows_of(text_queries.sentence_sequences(spark, sf)) == rows_of(sequences.sentence_sequences(rows))
    assert rows_of(text_queries.tags_since_dt(spark, sf)) == rows_of(sequences.tags_since_determiner(rows))
    assert exchanges(text_queries.sentence_sequences(spark, sf)) == exchanges(text_queries.tags_since_dt(spark, sf)) == 0
    zipped = source_queries.zip_join(spark, sf)
    tags = rows.select("doc_id", "sent_id", "tok_id", "token", F.when(F.col("pos").rlike("^[CDJNP]"), "I-NP").otherwise("O").alias("chunk"))
    assert rows_of(zipped) == rows_of(sequences.zipped(rows.select("doc_id", "sent_id", "tok_id", "token", "ner"), tags))
    assert "tok_id" not in "".join(x for x in zipped._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_zipped_arrays_drop_what_one_table_lacks(spark):
    left = spark.createDataFrame([(0, 0, ["a", None, "c"]), (0, 1, ["x"])], "doc_id long, sent_id int, token array<string>")
    right = spark.createDataFrame([(0, 0, ["A", "B"]), (1, 1, ["X"])], "doc_id long, sent_id int, tag array<string>")
    assert rows_of(sequences.zipped_arrays(left, right)) == [(0, 0, 0, "a", "A")]


def test_entities_over_documents(spark, sf):
    docs = docs_of(spark, sf)
    names = ["doc_id", "sent_id", "tok_id", "entity_id"]
    key = lambda r: tuple((x is None, x) for x in r)
    wanted = sorted(map(tuple, sequences.with_entity_ids(A.annotated(docs)).select(*names).collect()), key=key)
    got = sequences.document_entities(docs).select(*names)
    assert sorted(map(tuple, got.collect()), key=key) == wanted
    assert "sent_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    some = sequences.document_entities(docs, F.col("doc_id") % 10 > 7).select(*names)
    assert sorted(map(tuple, some.collect()), key=key) == [r for r in wanted if r[0] % 10 > 7]


def test_records_are_numbered_where_they_are_read(spark, tmp_path):
    for f in range(3):
        text = "".join(f"-DOCSTART- -X- O O\n\nw{f} NN O O\nv NN O O\n\nd{i} NN O O\n\n" for i in range(400))
        (tmp_path / f"part-{f}.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = readers.conll(spark, str(tmp_path)).filter("sent_id = 1 and tok_id = 0")
        assert sorted((r["doc_id"], r["token"]) for r in found.collect()) == [(f * 400 + i, f"d{i}") for f in range(3) for i in range(400)]
        assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sentences_of_annotated_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("-DOCSTART- (1 X)\na\n\n\nb\nc\n\nd\n-DOCSTART- (2 Y)\n\ne\n")
    found = readers.aida(spark, str(tmp_path))
    assert rows_of(found.select("Document_ID", "Document_Name", "Sentence_Number", "Token")) == [("1", "X", 0, "a"), ("1", "X", 2, "b"), ("1", "X", 2, "c"), ("1", "X", 3, "d"), ("2", "Y", 1, "e")]
    assert exchanges(found) == 0


def test_tags_by_document(spark, sf):
    docs = docs_of(spark, sf)
    rows, test = A.annotated(docs), F.col("doc_id") % 10 > 7
    dictionary = gazetteer.maximal(gazetteer.unambiguous(gazetteer.phrases(sequences.with_local_entities(rows.filter("doc_id % 10 < 7")))))
    assert rows_of(text_queries.gazetteer_longest(spark, sf)) == rows_of(dictionary)
    tagged = gazetteer.tagged(sequences.with_entity_ids(rows).filter(test), dictionary).withColumn("gold", F.when(F.col("ner") == "O", "O").otherwise(F.expr("substr(ner, 3)")))
    names = ["doc_id", "sent_id", "tok_id", "predicted"]
    assert rows_of(text_queries.gazetteer_tag(spark, sf)) == rows_of(tagged.select(*names))
    assert {r["predicted"] for r in tagged.collect()} > {"O"}
    filled = sequences.filled_ids(tagged)
    assert rows_of(text_queries.filled_ids(spark, sf)) == rows_of(filled.select(*names[:3], "entity_id"))
    voted = metrics.most_frequent(filled, ["doc_id", "entity_id", "gold"], "predicted")
    assert rows_of(text_queries.entity_level_report(spark, sf)) == rows_of(metrics.classification_report(voted, "gold", "label"))
    votes = metrics.most_frequent(tagged.filter("entity_id is not null"), ["entity_id"], "predicted")
    assert rows_of(text_queries.majority_vote(spark, sf)) == rows_of(votes)
    for query in (text_queries.gazetteer_tag, text_queries.filled_ids, text_queries.classification_report, text_queries.gazetteer_longest):
        assert "tok_id" not in "".join(x for x in query(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_report_counts_pairs_once(spark):
    rows = spark.range(10).select(F.lit("A").alias("g"), F.lit("B").alias("p"))
    assert metrics.classification_report(rows, "g", "p")._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
