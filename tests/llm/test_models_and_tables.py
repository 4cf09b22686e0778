"""Operators with trained models by held-out quality, table operators against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarium.llm import mixing, neighbours, quality, revisits

GIVEN = "/root/testdata/sf0.1/embeddings.parquet"
DOCS = "doc_id long, text string, source string, copy string, score string"


def test_copies_follow_the_rates(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else None, "c", "s") for i in range(600)] + [(None, "t", "one", "c", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    weights = spark.createDataFrame([("big", 1.0), (None, 1.0), ("one", 0.2), ("absent", 5.0)], "source string, weight double")
    got = mixing.replicate(docs, weights).collect()
    rates = {r.source: r.rate for r in mixing.rates(docs, weights).collect()}
    for source in ("big", None):
        n = sum(r[2] == source for r in rows)
        assert abs(sum(r.source == source for r in got) - rates[source] * n) < 5 * math.sqrt(rates[source] * n)

    def poisson(rate, doc):
        pieces = max(1, math.ceil(rate / 16))
        total = 0
        for j in range(1, pieces + 1):
            u = int(hashlib.md5(f"17:{doc}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            k, mass = 0, math.exp(-rate / pieces)
            below = mass
            while below <= u:
                k += 1
                mass *= rate / pieces / k
                below += mass
            total += k
        return total

    counts = Counter(r.doc_id for r in got)
    assert all(counts[r[0]] == poisson(rates[r[2]], "" if r[0] is None else r[0]) for r in rows)
    split = mixing.replicate(docs, weights, few=0)  # more sources than are broadcast
    assert Counter(r.doc_id for r in split.collect()) == counts
    assert mixing.replicate(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000, "big", "c", "s")], DOCS)
    assert all(len(r.text) == 3_000_000 for r in mixing.replicate(long).collect())


def test_revisits_against_a_scan(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        url = rng.choice(["http://www.A.org/x/?b=2&a=1&utm_x=3#f", "https://a.org/x?a=1&b=2", "http://b.org", None, "nonsense"])
        at = rng.randint(0, 60)
        headers = {"ETag": rng.choice(['"1"', 'W/"1"', '"2"']), "X-Own": "r"} if rng.random() < 0.7 else ({"Last-Modified": rng.choice(["d1", "d2"])} if rng.random() < 0.7 else None)
        rows.append((i, url, at, rng.choice(["response", "revisit", "request"]), headers, "extra"))
    records = spark.createDataFrame(rows, "record_id long, url string, s long, type string, headers map<string,string>, outcome string").withColumn("at", F.timestamp_seconds("s"))
    key = {None: None, "nonsense": None, "http://b.org": "b.org"}
    of = lambda u: key.get(u, "a.org/x?a=1&b=2")
    want = {}
    for i, url, at, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [(r[2], r[0]) for r in rows if r[3] == "response" and of(r[1]) and of(r[1]) == of(url) and r[2] < at]
        found = max(earlier, default=None)
        new, old = headers or {}, (rows[found[1]][4] or {}) if found else {}
        if not found:
            want[i] = ("missing", None)
        elif "ETag" in new and "ETag" in old:
            want[i] = ("resolved", found[1]) if new["ETag"].replace("W/", "") == old["ETag"].replace("W/", "") else ("mismatch", None)
        elif "Last-Modified" in new and "Last-Modified" in old:
            want[i] = ("resolved", found[1]) if new["Last-Modified"] == old["Last-Modified"] else ("mismatch", None)
        else:
            want[i] = ("unverified", None)
    for stretches, most in ((1, 100_000), (7, 3), (512, 2)):  # few records in a stretch: busy ones are cut finer
        got = revisits.resolve_revisits(records, stretches, most).collect()
        assert {r.record_id: (r.outcome, r.response_id) for r in got} == want
    assert any(r.headers and ("x-own", "r") in [tuple(h) for h in r.headers] for r in got)
    assert revisits.resolve_revisits(records.limit(0)).count() == 0


def test_canonical_urls(spark):
    urls = {
        "http://a.org/x#f?b=1": "a.org/x", "https://user:pw@WWW.a.org:443/x/?b=2&a=1&utm_source=z#q": "a.org/x?a=1&b=2", "http://a.org": "a.org", "HTTP://a.org:80/?ref=x": "a.org",
        "ftp://a.org": None, "nonsense": None, "": None, "http://a.org/u@v": "a.org/u@v", " http://a.org/p?q ": "a.org/p?q",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == urls


@pytest.mark.skipif(not Path(GIVEN).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("piece", [4096, 64])
def test_recall_on_the_given_vectors(spark, piece, monkeypatch):
    """Queries are routed to a part of several partitions; recall is measured against brute force."""
    monkeypatch.setattr(neighbours, "PIECE", piece)
    table = spark.read.parquet(GIVEN)
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float64)
    got = neighbours.search(table, F.col("vec_id") % 100 == 0, 10).collect()
    router = neighbours.Router(x, len(x), 10)
    assert router.parts >= 8 and router.probes < router.parts
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    recall = hits / (10 * len(range(0, len(x), 100)))
    print("recall", recall, "partitions", router.probes, "of", router.parts)
    assert recall >= 0.9


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((24, 16)) * 3
    x = np.vstack([centres[i % 24] + rng.standard_normal(16) for i in range(3000)])
    x[100:400] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(len(x))]
    rows += [(5000, None, 0.0), (5100, [0.0] * 16, 0.0), (5200, [float("nan")] * 16, 0.0), (5300, [1.0], 0.0), (None, [1.0] * 16, 0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = neighbours.search(table, F.col("vec_id") % 50 == 0, 10).collect()
    found, hits, total = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 50))
    for q, answers in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits, total = hits + len({v for _, v, _ in answers} & set(best)), total + 10
        assert [a[0] for a in sorted(answers)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for _, v, s in answers)
    assert hits / total >= 0.9
    few = neighbours.search(table.where("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank)] == sorted(range(1, 4), key=lambda i: ((x[i] - x[0]) ** 2).sum())
    assert neighbours.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def plain_statistics(t):
    """The statistics of a text in plain Python."""
    t = t or ""
    n, words, lines = len(t), re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").split(" "), t.split("\n")
    symbols = "".join("\n" if unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\f\r" else c for c in t)
    runs = [r for r in symbols.split("\n") if r]
    w = len(words) if n else 0
    per = lambda a, b: a / b if b > 0 else 0.0
    return {
        "log_chars": math.log1p(n), "word_chars": per(n, w), "distinct_words": per(len(set(words)), w), "upper": per(sum(unicodedata.category(c) == "Lu" for c in t), n), "digits": per(sum(c in "0123456789" for c in t), n),
        "symbols": per(sum(map(len, runs)), n), "doubled_symbols": per(sum(len(m.group()) // 2 for r in runs for m in re.finditer(r"(.)\1+", r)), w), "bars": per(t.count("|"), w), "stops": per(t.count("."), w),
        "line_words": per(w, len(lines)), "distinct_lines": per(len(set(lines)), len(lines)) if n else 0.0, "bad_characters": per(sum(c == "\ufffd" or 0 < ord(c) < 9 or 13 < ord(c) < 28 for c in t), n),
    }


def test_compiled_rules_against_plain_python(spark):
    rng = random.Random(8)
    texts = ["", None, " ", "ABC. déf | x!! y", "a\x01b\x02\n\n|||", "Éé 12 34…", "x" * 100_000, *("".join(rng.choice("aB é1|.!,\n\x03") for _ in range(rng.randint(0, 120))) for _ in range(150))]
    rules = [((("bars", True, 0.05), ("upper", False, 0.2)), 1.5), ((("distinct_lines", True, 0.5),), -0.75), ((("log_chars", False, 3.0), ("symbols", True, 0.1), ("doubled_symbols", True, 0.0)), 2.0)]
    docs = spark.createDataFrame([(i, t, "s", "c", "x") for i, t in enumerate(texts)], DOCS)
    numbers = {r.doc_id: r.s.asDict() for r in quality.with_statistics(docs, "text", "s").select("doc_id", "s").collect()}
    for r in quality.RuleModel(rules, 0.25).score(docs).collect():
        plain = plain_statistics(texts[r.doc_id])
        assert all(abs(plain[k] - numbers[r.doc_id][k]) < 1e-9 for k in quality.STATISTICS), (texts[r.doc_id], plain, numbers[r.doc_id])
        margin = 0.25 + sum(w for rule, w in rules if all(plain[k] > at if above else plain[k] <= at for k, above, at in rule))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-12


def test_quality_is_learnt(spark):
    rng = random.Random(9)
    words = ["sed", "ut", "omnis", "iste", "natus", "error", "sit"]
    good = lambda: " ".join(rng.choice(words) for _ in range(40)) + "."
    bad = lambda: " | ".join(rng.choice(words).upper() + "!!" for _ in range(40))
    rows = [(i, good() if i % 2 else bad(), "s", "c", "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, "s", "c", "x"), (901, "", "s", "c", "x")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if r.held_out and i < 400]
    assert len(held) > 40 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
