"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

The model learns from a small labelled table of URLs, a parameter; the default table is built by rule from lists of words
that name unwanted sites and words that don't. Its weights are a vector of fixed size. N-grams of a batch of URLs are hashed at once.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and gets the model's
verdict of two empty strings, which is allow; urls of any length are read whole; repeated rows are judged
alike; an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import table

#: (host, path, verdict), as the contract of op9 fixes them.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Words of sites that a corpus leaves out: gambling, medicine by mail, adult content, loans, copies, advertising, search spam, pirated goods.
UNWANTED = (
    "casino poker bet bets betting slots roulette jackpot lottery bingo pills pharmacy viagra cialis tramadol steroids adult porn xxx sex sexy nude escort "
    "cams milf erotic payday loans credit replica fake rolex ads adserver advert banner track tracker tracking pixel click clicks affiliate popunder spam seo "
    "backlinks linkfarm doorway warez torrent crack keygen serial nulled pirated cheap discount win winner prize free bonus coupon dating hookup singles"
).split()
#: Words of other sites.
WANTED = (
    "library museum garden river school history weather recipe science therapy street travel radio farm bird chess hospital theatre ontario housing whistle "
    "city news daily journal review archive atlas book books paper press story letters poetry music opera cinema film photo design studio craft wood stone "
    "metal water ocean island mountain forest valley park trail road rail bridge harbor market bakery kitchen coffee tea wine cheese bread apple cherry "
    "health clinic doctor nurse care family child parent teacher student college university research institute physics chemistry biology math data code "
    "software open source linux cloud network energy solar wind power engine motor car bike train plane ship space star moon planet earth climate nature "
    "animal horse dog cat fish tree flower seed soil farmers community council county state nation law court police army peace church temple sport football "
    "tennis hockey swim run yoga dance art gallery fashion shoes house home room window door light lamp clock watch phone mobile camera guide map tour hotel "
    "inn beach summer winter spring autumn north south east west old new green blue red white black golden silver little big first last world global local"
).split()
#: Letters of which names without a meaning are made, so that rare n-grams don't tell.
SYLLABLES = "ba co di fu ga he in jo ka le mo na or pe ri sa th ti un vo wa ea st en an er re ou nd on".split()
BITS = 15
SIZES = (3, 4, 5)


def named_sites() -> list[tuple[str, int]]:
    """(name, 1 if unwanted): single words, pairs of words, and names without a meaning, chosen by hashes of their places."""
    pick = lambda words, *key: words[zlib.crc32(repr(key).encode()) % len(words)]
    out = [(w, 1) for w in UNWANTED] + [(w, 0) for w in WANTED]
    for i, word in enumerate(UNWANTED):
        for j in range(6):
            other = pick(UNWANTED if j % 2 else WANTED, "u", i, j)
            out.append(((word, other) if j % 3 else (other, word), 1))
    for i, word in enumerate(WANTED):
        for j in range(3):
            other = pick(WANTED, "w", i, j)
            out.append(((word, other) if j % 2 else (other, word), 0))
    for i in range(900):
        out.append(("".join(pick(SYLLABLES, "s", i, k) for k in range(2 + i % 4)), 0))
    joint = ("-", "", "")
    return [(x if isinstance(x, str) else joint[i % 3].join(x), y) for i, (x, y) in enumerate(out)]


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): the small table that the model learns from; what has no host is wanted."""
    places = list(product(("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "com", "net", "org", "info", "co.uk")))
    paths = ("/en/12", "/de/345.html", "/fr/67/", "/es/890", "", "/", "/a/b.html")
    out = [("", "", 0)] * 20
    for i, (name, y) in enumerate(named_sites()):
        for j in range(2):
            prefix, top = places[(7 * i + 13 * j) % len(places)]
            out.append((f"{prefix}{name}.{top}", paths[(i + 3 * j) % len(paths)], y))
    return out


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the n-grams of all URLs their URL's place, their slot and their value, 1 / sqrt of their number on their side of the URL.

    Hosts and paths have slots of their own, and their ends are marked."""
    owners, slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for side, texts in enumerate((hosts, paths)):
        marked = [f"^{t}$" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(marked)), [len(t) for t in marked])
        own = []
        for n in SIZES:
            m = max(0, len(code) - n + 1)
            key = np.full(m, n * 2 + side, np.uint64)
            for k in range(n):
                key = (key + code[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            whole = owner[:m] == owner[len(owner) - m :]
            own.append(owner[:m][whole])
            slots.append((key[whole] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
        own = np.concatenate(own)
        owners.append(own)
        values.append(1 / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(texts))))[own])
    return np.concatenate(owners), np.concatenate(slots), np.concatenate(values)


def fit(rows: Iterable[tuple[str, str, int]], rounds: int = 1000, rate: float = 12.0, penalty: float = 3e-5) -> np.ndarray:
    """Weights, the last one the constant; full-batch gradient descent with both classes of equal weight, the same at each run."""
    hosts, paths, y = zip(*rows, strict=True)
    owner, slot, value = grams(list(hosts), list(paths))
    y, weights = np.array(y, float), np.zeros(2**BITS + 1)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-(np.bincount(owner, weights[slot] * value, len(y)) + weights[-1]))) - y)
        step = np.r_[np.bincount(slot, error[owner] * value, 2**BITS), error.sum()]
        weights -= rate * (step + penalty * np.r_[weights[:-1], 0.0])
    return weights


def probabilities(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    owner, slot, value = grams(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(owner, weights[slot] * value, len(hosts)) + weights[-1])))


def host_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the longer host, then by name) and its verdict; null if none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = (F.when(fits, F.lit(h + p)), F.when(fits, F.lit(v))) if rule is None else (rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v)))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and score: the model's probability that the url is unwanted."""
    weights = fit(labelled if labelled is not None else labelled_urls())
    sent = pages.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 doubles at any input

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = sent.value
        for host, path in batches:
            yield pd.Series(probabilities(w, host.tolist(), path.tolist()), dtype="float64")

    host, path = host_path(F.col("url"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    out = out.withColumn("score", score("host", "path")).withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
