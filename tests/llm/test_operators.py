"""Small tests of the corpus operators against brute force, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexgrove.llm import ann, html_wrappers, interpolated_lm, line_rules, packing, partenum, quality_model, recompression, segmentations, url_filter

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]


def words(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = words(120)
PASSAGE = words(55)
TEXTS = [BASE, BASE, BASE.replace("w7 ", "x ", 1), words(80) + " " + PASSAGE, PASSAGE + "\n" + words(90), None, "", "  \n ", "one two", "one two", "a " * 200, words(3000), "É ÉTÉ\u00a0x\u2003y " * 30, words(40)]
DOCS = [(i, t, 1, True) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2, False), (None, words(60), 3, False)]
SCHEMA = "doc_id long, text string, n_words int, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_line_rules(docs, empty):
    got = {r["doc_id"]: r for r in line_rules.line_first(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = split(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert line_rules.line_first(empty).count() == 0
    kept = line_rules.keep_passing(docs)
    assert kept.columns == docs.columns


def test_line_rules_judge_lines(spark):
    clean = "This is a sentence with some words in it. " * 3 + "Every one differs: " + ", ".join(f"item{i}" for i in range(60)) + "."
    rows = [(1, clean), (2, "Home | About | News | Shop | Login\n" * 1 + clean), (3, " | ".join(f"link{i}" for i in range(80)))]
    got = {r["doc_id"]: r for r in line_rules.line_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[2]["kept"] and got[2]["clean_text"] == clean and not got[3]["kept"]


def test_quality_model(spark, docs, empty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.85
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    rows = quality_model.score_quality(docs, labels).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert quality_model.score_quality(empty, labels.limit(0)).count() == 0


def test_wrappers(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Top</header><nav><ul><li><a href='/a'>a</a></li></ul></nav><div class='ad'>buy</div><article><h1>Head &amp; {n}</h1><p>One\n {n} <b>two</b><p>Three</article><div class='comments'>me too</div><footer>foot</footer>"
    plain = "<html><body><div id='menu'><a href='/'>home</a></div><div class='content'><p>A long text number {n} that goes on.</p><p>And more of it {n}.</p></div><div class='sidebar'>side</div></body></html>"
    rows = [(i, "http://h.org/x", page.replace("{n}", str(i)), 0) for i in range(4)] + [(10 + i, "http://g.org/x", plain.replace("{n}", str(i)), 0) for i in range(4)] + [(20, None, None, 0), (21, "http://h.org/y", "", 0)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[2] == ("Head & 2\nOne 2 two\nThree", 24)
    assert got[12][0] == "A long text number 2 that goes on.\nAnd more of it 2."
    assert got[20] == ("", 0) and got[21] == ("", 0)


def extracted(pages):
    """Main texts of the pages of one host."""
    merged = None
    for p in pages:
        merged = html_wrappers.page_wrapper(p) if merged is None else html_wrappers.align(merged, html_wrappers.page_wrapper(p))
    return [html_wrappers.extract(p, html_wrappers.main_slots(merged)) for p in pages]


def test_main_text_keeps_siblings_and_outer_elements():
    body = " ".join(["words"] * 40)
    layouts = {
        "<html><body><div class=post><h1>Title {n}</h1><p>lead {n}</p><div class=body><p>{b} {n}</p><p>more {n}</p></div></div></body></html>": ["Title {n}", "lead {n}", "{b} {n}", "more {n}"],
        "<html><body><div class=one><p>{b} {b} {n}</p></div><div class=two><p>{b} {n}</p></div></body></html>": ["{b} {b} {n}", "{b} {n}"],
        "<html><body><div class=post><h2><a href=/x>Linked {n}</a></h2><div class=body><p>{b} {n}</p></div></div></body></html>": ["Linked {n}", "{b} {n}"],
        "<html><body><main><h1>Title {n}</h1><p>lead {n}</p><article><p>{b} {n}</p></article></main></body></html>": ["Title {n}", "lead {n}", "{b} {n}"],
        "<html><body><div class=x><p>{b} {n}</p></div><div class='" + "grid-column " * 10 + "sidebar'><p>side {n}</p></div></body></html>": ["{b} {n}"],
    }
    for page, lines in layouts.items():
        for pages in (1, 4):
            fill = lambda s, n: s.replace("{n}", f"number {'abcd'[n]}").replace("{b}", body)  # noqa: E731, B023
            assert extracted([fill(page, n) for n in range(pages)]) == ["\n".join(fill(x, n) for x in lines) for n in range(pages)]


def test_wrappers_decide_without_names():
    """Layouts whose article has no telling name: what is the same on all pages of a host and lists of links go, what varies stays."""
    body = " ".join(["words"] * 30)
    layouts = {
        # a constant block above, a list of links that varies below
        "<body><div class=top>Our site, since 1999</div><div class=mid><h1>Head {n}</h1><p>{b} {n}</p><p>End {n}</p></div><div class=low><ul><li><a href=/{n}1>Next {n} one</a></li><li><a href=/{n}2>Next {n} two</a></li></ul></div></body>": ["Head {n}", "{b} {n}", "End {n}"],
        # nested boxes, a constant line between
        "<body><div class=z><div class=k><span>Welcome all</span></div><div class=m><div><p>{b} {n}</p><p>{b} more {n}</p></div></div></div><section>Imprint here</section></body>": ["{b} {n}", "{b} more {n}"],
        # a table layout with an optional note on some pages
        "<body><table><tr><td class=l>Left column of fixed text</td><td class=r><p>{b} {n}</p>{o}<p>Last {n}</p></td></tr></table></body>": ["{b} {n}", "{o}", "Last {n}"],
    }
    changed = total = 0
    for page, lines in layouts.items():
        fill = lambda s, n: s.replace("{n}", f"number {'abcdef'[n]}").replace("{b}", body).replace("{o}", f"<p>Some note {'abcdef'[n]}</p>" if n % 2 else "")
        pages = [fill(page, n) for n in range(6)]
        wanted = ["\n".join(x for x in (fill(line, n).replace("<p>", "").replace("</p>", "") for line in lines) if x) for n in range(6)]
        assert extracted(pages) == wanted
        changed += sum(html_wrappers.extract(p, None) != w for p, w in zip(pages, wanted, strict=True))
        total += len(pages)
    assert changed / total > 0.9  # the page's own wrapper, which can't know what varies, gives another text


def test_deep_and_wide_pages():
    deep = "<div>" * 3000 + "<p>all the way down</p>" + "</div>" * 3000
    wide = "".join(f"<p id=x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>part {i}</p>" for i in range(700))
    assert extracted([deep] * 3) == ["all the way down"] * 3
    node = html_wrappers.page_wrapper(deep)
    assert html_wrappers.Node.load(node.dump()).dump() == node.dump()
    assert extracted([wide, wide[::1]]) == ["\n".join(f"part {i}" for i in range(700))] * 2


def test_common_orders():
    rng = random.Random(8)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        got = list(html_wrappers.matches(x, y))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_interpolated_lm(docs, empty):
    rows = interpolated_lm.score_corpus(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in DOCS if not held(i) for w in [*(x.lower() for x in split(t)), None])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(DOCS)
    for r in rows:
        t = next(t for i, t, *_ in DOCS if i == r["doc_id"])
        tokens = [*(x.lower() for x in split(t)), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n, held(r["doc_id"]))
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6 * len(tokens)
        assert r["score"] < 0
    assert interpolated_lm.score_corpus(empty).count() == 0


def test_weights_prefer_what_predicts():
    many, few = np.array([50] * 9 + [0]), np.array([1] * 10)
    at = interpolated_lm.cells(many, np.array([100] * 10), few, np.array([400] * 10), few)
    shares = interpolated_lm.learn_weights(at, np.ones(10), 10_000, 100)
    assert shares[0, interpolated_lm.bucket(np.array([100]))[0]] > 0.8 and ((0 <= shares) & (shares <= 1)).all()


def test_scores_against_brute_force(docs, monkeypatch):
    """The score of each text, from counts by a loop and the weights that were learned; the weights from exact held-out counts."""
    learned = []
    learn = interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda *a: learned.append(learn(*a)) or learned[-1])
    rows = {r["doc_id"]: r["score"] for r in interpolated_lm.score_corpus(docs).collect()}
    tokens = [(i, [*(x.lower() for x in split(t)), None]) for i, t, *_ in DOCS]
    counts = [Counter(), Counter(), Counter()]

    def grams(t):
        return t, list(zip([0, *t], t, strict=False)), list(zip([0, 0, *t], [0, *t], t, strict=False))

    for i, t in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for c, g in zip(counts, grams(t), strict=True):
                c.update(g)
    n, v, start = sum(counts[0].values()), len(counts[0]), sum(counts[0][w] for w in [None])
    for i, t in tokens:
        word, pair, triple = ([c[x] for x in g] for c, g in zip(counts, grams(t), strict=True))
        total = 0.0
        for k in range(len(t)):
            c3, c2 = (pair[k - 1], word[k - 1]) if k else (start, start)
            a, b, d = learned[0][0, interpolated_lm.bucket(np.array([c3]))[0]], learned[0][1, interpolated_lm.bucket(np.array([c2]))[0]], learned[0][2, 0]
            p1 = d * word[k] / n + (1 - d) / (v + 1)
            total += math.log10(a * triple[k] / max(c3, 1) + (1 - a) * (b * pair[k] / max(c2, 1) + (1 - b) * p1))
        if i != 3:
            assert abs(rows[i] - total) < 1e-9 * len(t)


def test_partenum(docs, empty, spark):
    more = [(100 + i, BASE.replace(f"w{i} ", "y ", 1), 0, True) for i in range(25)]
    rows = {i: t for i, t, *_ in DOCS + more if i is not None}
    got = {r["doc_id"]: r for r in partenum.near_duplicates(docs.union(spark.createDataFrame(more, SCHEMA))).collect()}
    sets = {}
    for i, t in rows.items():
        w = [x.lower() for x in split(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in rows} == {i: (len(sets[i]), root[i]) for i in rows}
    assert got[None]["component_id"] is None
    assert partenum.near_duplicates(empty).count() == 0
    kept = partenum.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None).count(3) == 1


def test_partenum_signatures_never_miss():
    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 100, 333, 1000]:
        a = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
        for cut in {0, len(a) // 8, len(a) // 4}:
            b = np.unique(a[cut:])
            extra = (len(b) * 100 // 75) - len(a)
            b = np.unique(np.r_[b, rng.integers(1, 2**63, max(0, extra), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[50:60] = x[49]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [1.0], 1)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()
    hits = 0
    for q in range(0, 700, 20):
        s = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len(mine) == 20 and all(m[2] == s[m[1]] for m in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits / (35 * 20) >= 0.9 and {r["query_id"] for r in got} == set(range(0, 700, 20))
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    few = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = lambda t: exact.encode(t, add_special_tokens=False).ids
    odd = [" a b ", "a  b", "\n x\n y \n", " ", "  ", "x \u00a0 y\u2003 z", "don't  won't I'll", "<|endoftext|> x<|endoftext|>", "  a\n\n b\t", "naïve – “q” 日本語 🙂", "it's 12345 don't", "a" * 3000]
    encode = packing.Encoder()
    for t in [*odd, *(t or "" for t in TEXTS)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == ids_of(t)
    rows = packing.pack(docs).collect()
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in DOCS}
    fill = Counter()
    seen = Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        fill[r["sequence_id"]] += r["length"]
        seen[r["doc_id"]] += r["length"]
    assert seen == Counter({i: len(x) * (2 if i == 3 else 1) for i, x in ids.items()})
    for s, n in fill.items():
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert n <= 2048
    assert packing.pack(empty).count() == 0
    for n in range(1, 2048):
        k = packing.class_of(n)
        assert k * n <= 2048 < (k + 1) * n


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://example.com/en/1", "http://www.example.com/en/1?q", "http://X.NET/es/2#a", "http://x.net/de/1", "http://notcom/x", None, "no scheme", "http://com", "ftp://a.com", "http://b.org/a://c"]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None, None]
    assert (got[2]["verdict"], got[3]["verdict"], got[3]["host"], got[3]["path"]) == ("allow", "block", "x.net", "/es/2")
    assert (got[6]["host"], got[6]["path"], got[7]["verdict"]) == ("", "", "allow")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, host string, score int")).count() == 0


def test_url_model_on_names_it_has_not_seen():
    rows = url_filter.labelled_urls()
    site = lambda host: max(host.split("."), key=lambda x: (x not in ("www", "m", "blog", "example", "com", "net", "org", "info", "co", "uk"), len(x)))
    unseen = [zlib.crc32(site(h).encode()) % 5 == 0 for h, _, _ in rows]
    w = url_filter.fit([r for r, out in zip(rows, unseen, strict=True) if not out])
    held = [r for r, out in zip(rows, unseen, strict=True) if out]
    p = url_filter.probabilities(w, [h for h, _, _ in held], [x for _, x, _ in held])
    y = np.array([r[2] for r in held])
    assert len(held) > 500 and (p[y == 1] >= 0.5).mean() > 0.8 and (p[y == 0] < 0.5).mean() > 0.93
    assert url_filter.probabilities(url_filter.fit(rows), [""], [""])[0] < 0.5 and len(url_filter.probabilities(w, [], [])) == 0


def test_recompression(docs, empty):
    counts = Counter()
    for _, t, *_ in DOCS:
        w = split(t)
        counts.update(tuple(w[s : s + 35]) for s in range(len(w) - 34))
    wanted = Counter()
    for i, t, *_ in DOCS:
        w = split(t)
        gone = {s + k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        wanted[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in recompression.without_repeats(docs).collect())
    assert got == wanted
    assert recompression.without_repeats(empty).count() == 0
    kept = recompression.cleaned(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[13] == TEXTS[13]


def test_equal_windows_hold_equal_symbols():
    """Symbols that depend on a window alone are the same wherever it stands, so it closes nowhere or everywhere."""
    rng = random.Random(2)
    window = [rng.choice("abc") for _ in range(12)] + ["a"] * 6 + [f"x{rng.randrange(9)}" for _ in range(17)]
    inner = set()
    for _ in range(30):
        before = [rng.choice("abc") for _ in range(rng.randrange(50))]
        text = " ".join([*before, *window, *(rng.choice("abc") for _ in range(rng.randrange(50)))])
        s = recompression.Symbols(recompression.Texts([text.encode()]))
        for level in range(recompression.LEVELS):
            s.fold(level)
        held = (s.start >= len(before)) & (s.end <= len(before) + 35)
        inner.add(tuple(zip(s.name[held].tolist(), (s.start[held] - len(before)).tolist(), strict=True)))
    assert len(inner) == 1 and len(next(iter(inner))) > 2


def small_vocabulary():
    return segmentations.Vocabulary(["▁a", "ab", "b", "a", "ba", "c", "▁"], list(range(256, 512)), 512)


def all_segmentations(vocabulary, text):
    if not text:
        return [((), 1.0)]
    heads = [n for n in range(1, len(text) + 1) if text[:n] in vocabulary.ids]
    return [((vocabulary.ids[text[:n]], *tail), vocabulary.weights[text[:n]] * w) for n in heads for tail, w in all_segmentations(vocabulary, text[n:])]


def test_segmentations_follow_the_law():
    """First and second samples against the enumerated law of sampling without replacement; inclusion scores."""
    v, text, n = small_vocabulary(), "aba bab", 6000
    listed = all_segmentations(v, v.marked(text))
    law = {p: w / sum(w for _, w in listed) for p, w in listed}
    second = {p: sum(law[a] * law[p] / (1 - law[a]) for a in law if a != p) for p in law}
    firsts, seconds, sums = Counter(), Counter(), []
    for got in segmentations.Sampler(v, 3, 5).sample(list(range(n)), [text] * n):
        ids = [tuple(s[0].tolist()) for s in got]
        assert len(set(ids)) == 3 and [s[2] for s in got] == sorted((s[2] for s in got), reverse=True)
        assert all(abs(math.exp(s[1]) - law[i]) < 1e-9 for i, s in zip(ids, got, strict=True)) and v.decode(got[2][0]) == text
        firsts[ids[0]] += 1
        seconds[ids[1]] += 1
        sums.append(sum(math.exp(s[1] - s[3]) for s in got))
    for counts, want in ((firsts, law), (seconds, second)):
        assert sum((counts[p] - n * q) ** 2 / (n * q) for p, q in want.items()) < 40  # 14 degrees of freedom
    assert abs(np.mean(sums) - 1) < 0.03  # weights by inclusion estimate the total probability without bias
    few = next(segmentations.Sampler(v, 9).sample([1], ["ab"]))
    assert len(few) == len(all_segmentations(v, "▁ab")) and all(s[3] == 0 for s in few)


def test_segmentations_round_trip(spark, docs, empty):
    odd = ["", " ", "▁ ▁a", "日本 x\x00\n\n  é", "x" * 5000, "\U0001f600" * 300, "a\tb,c;;d  e "]
    frame = spark.createDataFrame([(100 + i, t, 0, True) for i, t in enumerate(odd)], SCHEMA)
    for source in (docs, frame):
        texts = {r["doc_id"]: {x["text"] or "" for x in source.collect() if x["doc_id"] == r["doc_id"]} for r in source.collect()}
        rows = segmentations.sample_segmentations(source).withColumn("decoded", segmentations.decode_pieces("ids")).collect()
        assert all(r["decoded"] in texts[r["doc_id"]] and r["log_inclusion"] <= 0 for r in rows)
        assert {r["doc_id"] for r in rows} == set(texts)
    again = segmentations.sample_segmentations(docs.repartition(3)).collect()
    first = segmentations.sample_segmentations(docs.coalesce(1)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, first))
    assert segmentations.sample_segmentations(empty).count() == 0
