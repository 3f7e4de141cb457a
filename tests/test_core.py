"""Goldens and invariants of the reference-style operators."""

import bz2
import json
import random

from pyspark.sql import functions as F

from lexgrove.functions import surface
from lexgrove.operators import annotations as A
from lexgrove.operators import gazetteer, linking, metrics, models, scoring, sequences, triples
from lexgrove.sources import readers

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10" xml:lang="en">
<page><title>AccessibleComputing</title><ns>0</ns><id>10</id><redirect title="Computer accessibility"/><revision><id>20</id><contributor><id>30</id></contributor><text>x</text></revision></page>
<page><title>Mercury (element)</title><ns>0</ns><id>11</id><revision><id>21</id><text>[[Political movement|movement]] [[Computer accessibility]] [[Category:Anti-capitalism]] [[File:a.jpg|thumb|cap]] [[Image:x|a [[Q]] b]]</text></revision></page>
</mediawiki>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, surface.after_colon(lit("Category:People"), lit(14))) == "People"
    assert one(spark, surface.after_colon(lit("Dune: The Butlerian Jihad"), lit(0))) == "Dune: The Butlerian Jihad"
    assert one(spark, surface.before_comma(lit("Windsor, Berkshire"))) == "Windsor"
    assert one(spark, surface.before_parenthesis(lit("Mercury (element)"))) == "Mercury"
    assert one(spark, surface.before_parenthesis(lit("Mercury (element)"), compat=True)) == "Mercury "
    assert one(spark, surface.split_camel_case(lit("AfghanistanHistory"))) == "Afghanistan History"
    assert one(spark, surface.strip_namespace(lit("{http://x/}mediawiki"))) == "mediawiki"
    assert [one(spark, surface.normal_tag(lit(t))) for t in ("I-LOC", "B-LOC", "O")] == ["LOC", "LOC", "O"]
    assert one(spark, surface.repaired_quote(lit("``"))) == '"'
    assert one(spark, surface.elapsed(lit(3723.5))) == "1:02:03.50"
    assert one(spark, surface.only_punctuation(lit("?!-")))
    assert one(spark, surface.entity_link(lit(None).cast("string"))) is None
    assert one(spark, surface.first_maximum(F.array(lit(1), lit(3), lit(3)))) == 1


def test_dump_and_links(spark, tmp_path):
    path = tmp_path / "pages.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    pages = readers.pages(spark, str(path))
    assert [r["id"] for r in pages.orderBy("id").collect()] == [10, 11]
    assert [r["id"] for r in readers.pages(spark, str(path), compat=True).orderBy("page_id").collect()] == [30, 21]
    got = {(r["anchor"], r["entity"]): r["n"] for r in linking.dictionary(linking.page_pairs(pages)).collect()}
    assert got == {("Accessible Computing", "Computer accessibility"): 1, ("Mercury", "Mercury (element)"): 1, ("movement", "Political movement"): 1, ("Computer accessibility", "Computer accessibility"): 1, ("Anti-capitalism", "Category:Anti-capitalism"): 1, ("Q", "Q"): 1}
    nested = {(r["anchor"], r["entity"]) for r in linking.wikilinks(pages, nested=True).collect()}
    assert ("a [[Q]] b", "Image:x") in nested
    assert linking.malformed_links(pages).count() == 1


def test_dictionary_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([("a", "X", 2), ("a", "Y", 2), ("b", "Z", 1)], "anchor string, entity string, n long")
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    linking.write_dictionary(counts, first)
    linking.upsert(first, counts, second)
    assert {tuple(r) for r in spark.read.parquet(second).collect()} == {("a", "X", 4), ("a", "Y", 4), ("b", "Z", 2)}
    queries = spark.createDataFrame([("a",), ("none",)], "query string")
    found = linking.lookup(queries, counts, 1)
    assert {tuple(r) for r in found.collect()} == {("a", 1, "X", 2), ("none", None, None, None)}
    html = {r["query"]: r["html"] for r in linking.candidate_html(found).collect()}
    assert html["none"] == "<h4>none</h4>\n<ul>\n\n</ul>" and "X</a> (2)" in html["a"]


def test_readers(spark, tmp_path):
    conll = tmp_path / "conll.txt"
    conll.write_text("-DOCSTART- -X- O O\n\nEU NNP I-NP I-ORG\nrejects VBZ I-VP O\n\nPeter NNP I-NP I-PER\n\n-DOCSTART- -X- O O\n\nBlackburn NNP I-NP I-PER\n")
    rows = readers.conll(spark, str(conll)).orderBy("doc_id", "sent_id", "tok_id").collect()
    assert [(r["doc_id"], r["sent_id"], r["tok_id"], r["token"], r["ner"]) for r in rows] == [(0, 0, 0, "EU", "I-ORG"), (0, 0, 1, "rejects", "O"), (0, 1, 0, "Peter", "I-PER"), (1, 0, 0, "Blackburn", "I-PER")]
    counts = readers.conll_counts(spark, str(conll)).first()
    assert (counts["n_docs"], counts["n_sentences"], counts["n_with_empty"]) == (2, 3, 4)
    aida = tmp_path / "aida.tsv"
    aida.write_text("-DOCSTART- (1testa EU)\nEU\tB\tEU\t--NME--\nrejects\n\nPeter\tB\tPeter\tPeter_X\thttp://u\t7\t/m/1\n")
    rows = readers.aida(spark, str(aida)).collect()
    assert [(r["Document_ID"], r["Document_Name"], r["Sentence_Number"], r["Token"], r["BI_Tag"], r["Wikipedia_URL"]) for r in rows] == [("1testa", "EU", 0, "EU", "B", "--NME--"), ("1testa", "EU", 0, "rejects", None, None), ("1testa", "EU", 1, "Peter", "B", "http://u")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"x": {"E": 2}}))
    (tmp_path / "s" / "b.json").write_text(json.dumps({"x": {"E": 3, "F": 1}}))
    assert {tuple(r) for r in readers.shards(spark, str(tmp_path / "s")).collect()} == {("x", "E", 5), ("x", "F", 1)}
    listing = spark.createDataFrame([("../", None), ("20200101/", True), ("20200201/", False)], "date string, ready boolean")
    assert readers.latest_dump(listing).first()["date"] == 20200101


def token_rows(spark, sentence, column):
    return spark.createDataFrame([(0, 0, i, f"t{i}", v) for i, v in enumerate(sentence)], f"doc_id long, sent_id int, tok_id int, token string, {column} string")


def test_entity_islands(spark):
    rows = token_rows(spark, "O I-PER I-PER B-PER I-LOC O I-LOC".split(), "ner")
    assert [r["entity_id"] for r in sequences.with_entity_ids(rows).orderBy("tok_id").collect()] == [None, 0, 0, 1, 2, None, 3]


def test_entity_islands_random(spark):
    rng = random.Random(3)
    data, wanted, n = [], [], -1
    for doc in range(5):
        for sent in range(4):
            before = "O"
            for tok in range(rng.randrange(1, 9)):
                tag = rng.choice(["O", "I-A", "B-A", "I-B"])
                n += tag != "O" and (tag[0] == "B" or before == "O" or before[2:] != tag[2:])
                wanted.append(n if tag != "O" else None)
                data.append((doc, sent, tok, tag))
                before = tag
    rows = spark.createDataFrame(data, "doc_id long, sent_id int, tok_id int, ner string")
    assert [r["entity_id"] for r in sequences.with_entity_ids(rows).orderBy("doc_id", "sent_id", "tok_id").collect()] == wanted


def test_noun_phrases(spark):
    words = "the little yellow dog barked at the cat .".split()
    tags = "DT JJ JJ NN VBD IN DT NN .".split()
    rows = spark.createDataFrame([(0, 0, i, w, t) for i, (w, t) in enumerate(zip(words, tags, strict=True))], "doc_id long, sent_id int, tok_id int, token string, pos string")
    got = [(r["phrase"], r["is_entity"]) for r in sequences.noun_phrase_chunks(rows).orderBy("start").collect()]
    assert got == [("the little yellow dog", True), ("barked at", False), ("the cat", True), (".", False)]
    facts = triples.extracted(sequences.noun_phrase_chunks(rows), rows).collect()
    assert [(r["subject"], r["predicate"], r["object"]) for r in facts] == [("the little yellow dog", "barked at", "the cat")]


def test_greedy_tagging_against_a_loop(spark):
    rng = random.Random(5)
    phrases = {("a", "b"): "X", ("b", "c", "a"): "Y", ("c",): "Z"}
    dictionary = spark.createDataFrame([(" ".join(p), len(p), k) for p, k in phrases.items()], "phrase string, n_tokens int, kind string")
    data, wanted = [], {}
    for sent in range(20):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        data += [(0, sent, i, w) for i, w in enumerate(words)]
        i = 0
        while i < len(words):
            hit = next(((n, phrases[tuple(words[i : i + n])]) for n in range(1, 9) if tuple(words[i : i + n]) in phrases and i + n <= len(words)), (1, "O"))
            for j in range(hit[0]):
                wanted[sent, i + j] = hit[1]
            i += hit[0]
    rows = spark.createDataFrame(data, "doc_id long, sent_id int, tok_id int, token string")
    assert {(r["sent_id"], r["tok_id"]): r["predicted"] for r in gazetteer.tagged(rows, dictionary).collect()} == wanted


def test_containment(spark):
    d = spark.createDataFrame([("US", 1, "A"), ("US Navy", 2, "B"), ("AUSTRALIA", 1, "C")], "phrase string, n_tokens int, kind string")
    assert {r["phrase"] for r in gazetteer.maximal(d).collect()} == {"US Navy", "AUSTRALIA"}
    assert {r["phrase"] for r in gazetteer.maximal_by_characters(d).collect()} == {"US Navy", "AUSTRALIA"}


def test_bigram_decoding_against_a_loop(spark):
    rows = spark.createDataFrame([(0, 0, i, "w", p, t) for i, (p, t) in enumerate([("N", "B"), ("N", "I"), ("V", "O"), ("N", "B")])], "doc_id long, sent_id int, tok_id int, token string, pos string, ner string")
    table = {(r["before"], r["pos"]): r["tag"] for r in models.bigram_table(rows, "ner").collect()}
    before, wanted = "<S>", []
    for p in ("N", "N", "V", "N"):
        tag = table.get((before, p))
        wanted.append(tag)
        before = tag or "<NONE>"
    assert models.bigram_decoded(rows, models.bigram_table(rows, "ner")).first()["tags"] == wanted


def test_rank_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "s", "dogs chasing cats running dogs"), (2, "s", "alone")], "doc_id long, source string, text string")
    rows = A.annotated(docs)
    ranks = scoring.page_rank(scoring.nodes(rows), scoring.edges(rows), 4)
    assert all(abs(r["s"] - 1) < 1e-9 for r in ranks.groupBy("doc_id").agg(F.sum("rank").alias("s")).collect())


def test_percentile_rank(spark):
    rows = spark.createDataFrame([(0, x) for x in (1.0, 2.0, 2.0, 4.0)], "k int, s double")
    assert [r["percentile"] for r in scoring.percentile_rank(rows, "s", ["k"]).orderBy("s").collect()] == [0.25, 0.625, 0.625, 1.0]


def test_report(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")], "g string, p string")
    got = {r["label"]: tuple(r)[1:] for r in metrics.classification_report(rows, "g", "p").collect()}
    assert got["A"] == (1.0, 0.5, round(2 / 3, 6), 2) and got["C"] == (0.0, 0.0, 0.0, 1) and got["accuracy"][0] == 0.5
    assert "Macro Avg" in metrics.latex_table(metrics.classification_report(rows, "g", "p"))


def test_threshold_with_equal_scores(spark):
    rows = spark.createDataFrame([(1.0, True, True), (1.0, True, False)], "s double, f boolean, t boolean")
    assert [tuple(r) for r in metrics.threshold_curve(rows, "s", "f", "t", 4).collect()] == [(1.0, 0.5, 1.0, round(2 / 3, 6))]


def test_entry_imports():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= 50 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
