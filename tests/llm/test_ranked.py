"""Ranked search against all sums, and what its lists are read by."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scholarium.llm import ranked

DOCS = "doc_id long, text string, row long, term string, score string"
ITEMS = "item_id long, text string, rank int, shard int"


def terms(text):
    return [] if text is None else re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


def expected(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            scored += [(-score, doc)] * (score > 0)
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)]
    docs = [(i, rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 120])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)]  # ties
    docs += [(None, "w1 w2"), (n + 40, None), (n + 41, ""), (n + 42, "ÉTÉ été W1 x' _y_"), (n + 43, docs[3][1]), (n + 43, docs[4][1]), (n + 44, "w1 " * 60_000 + "long")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 40])))) for i in range(25)]
    items += [(100, docs[7][1]), (101, None), (102, "nowhere else"), (None, "w1"), (103, "ÉTÉ long w1"), (104, "w2"), (104, "w3 w2"), (105, "...")]
    return docs, items


@pytest.mark.parametrize(("shard", "most"), [(16, 7), (100_000, 2000)])
def test_search_against_all_sums(spark, shard, most):
    docs, items = corpus(3, 300)
    rows = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in docs], DOCS)
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    got = sorted(map(tuple, ranked.search(rows, queries, 10, shard, most).collect()))
    assert got == expected(docs, items, 10) and len(got) > 200


def test_search_of_empty_tables(spark):
    rows, queries = spark.createDataFrame([(1, "a", 5, "x", "y")], DOCS), spark.createDataFrame([(1, "a", 1, 2)], ITEMS)
    assert ranked.search(rows.limit(0), queries).count() == 0
    assert ranked.search(rows, queries.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.search(rows, queries).collect()] == expected([(1, "a")], [(1, "a")], 10)


@pytest.mark.parametrize("seed", range(6))
def test_lists_are_read_as_far_as_needed(seed):
    """Random lists with many ties, against sums; where one document is far ahead, most entries stay unread."""
    rng = np.random.default_rng(seed)
    docs, n = 3000, 12
    term = np.repeat(np.arange(n), rng.integers(0, docs, n))
    doc = np.concatenate([rng.permutation(docs)[:c] for c in np.bincount(term, minlength=n)])
    score = rng.integers(1, [4, 1000][seed % 2], len(doc))
    lists, ids = ranked.Lists(term, doc, score, n), rng.permutation(docs)
    for wanted in (np.arange(n), np.array([0]), np.array([], np.int64), np.array([3, 7])):
        sums = np.bincount(doc[np.isin(term, wanted)], score[np.isin(term, wanted)], docs).astype(np.int64)
        order = np.lexsort((ids, -sums))[:10]
        order = order[sums[order] > 0]
        first, got = lists.best(wanted, 10, ids)
        assert first.tolist() == order.tolist() and got.tolist() == sums[order].tolist()
    term, doc = np.repeat(np.arange(n), docs), np.tile(np.arange(docs), n)
    score = np.where(doc < 10, 1_000_000 - doc, rng.integers(1, 1000, n * docs))
    lists = ranked.Lists(term, doc, score, n)
    first, _ = lists.best(np.arange(n), 10, np.arange(docs))
    assert first.tolist() == list(range(10)) and lists.read <= n * ranked.FIRST
