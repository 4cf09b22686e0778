"""The suffix tree against counts of plain Python, its distributions, and held-out text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scholarium.llm import suffix_tree

DOCS = "doc_id long, text string, block long, kind string, score string"


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def expected(rows, least, divergence):
    """Scores by dictionaries, from the definition of the tree; and the tree's distribution after a context."""
    rows = [(i, tokens(t)) for i, t in rows if i is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    total, different = sum(count.values()), len(count)
    grams = [Counter(tuple(t[i : i + n]) for t in train for i in range(len(t) - n + 1)) for n in (2, 3)]
    root = lambda w: (count[w] + 1) / (total + different + 1)
    kept: dict = {}

    def p(context, w):
        """By the longest kept suffix of context."""
        if not context:
            return root(w)
        if context not in kept:
            return p(context[1:], w)
        c, again, nexts = kept[context]
        return (nexts.get(w, 0) + (c - again + suffix_tree.PSEUDO) * p(context[1:], w)) / (c + suffix_tree.PSEUDO)

    for n, counts in ((1, {(w,): c for w, c in count.items() if w is not None}), (2, grams[0])):
        after: dict = {}
        for gram, c in grams[n - 1].items():
            if c >= 2:
                after.setdefault(gram[:-1], {})[gram[-1]] = c
        for context, c in counts.items():
            nexts = after.get(context, {})
            if c < least or not nexts:
                continue
            again, covered = sum(nexts.values()), sum(p(context[1:], w) for w in nexts)
            gain = sum(k * math.log(k / c / p(context[1:], w)) for w, k in nexts.items())
            if c > again:
                gain += (c - again) * math.log((c - again) / c / (1 - covered))
            if gain >= divergence * len(nexts):
                kept[context] = (c, again, nexts)
    out = []
    for i, t in rows:
        known = sum(count[w] > 0 for w in t)
        score = sum(math.log10(p(tuple(t[max(0, j - 2) : j]), w)) for j, w in enumerate(t))
        out.append((i, held(i), len(t), known, total, sum(math.log10(root(w)) for w in t), score))
    return sorted(out), p, kept, count


def corpus(seed, n):
    rng = random.Random(seed)
    follow = {w: [f"v{rng.randrange(40)}" for _ in range(3)] for w in (f"v{i}" for i in range(40))}
    rows = []
    for i in range(n):
        w, text = f"v{rng.randrange(40)}", []
        for _ in range(rng.choice([0, 1, 2, 8, 60])):
            w = rng.choice(follow[w]) if rng.random() < 0.8 else f"V{rng.randrange(60)}"
            text.append(w)
            w = w.lower() if w.lower() in follow else "v1"
        rows.append((i, " ".join(text)))
    rows += [(n + j, rows[4][1]) for j in range(25)]
    rows += [(None, "v1 v2 v3"), (n + 50, None), (n + 51, ""), (n + 52, "\n\t "), (n + 53, "É é v1"), (n + 1, "v1 v1 v1"), (n + 54, "v1 v2 " * 20_000), (n + 55, "x" * 1000 + " y")]
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 30), (2, 3000)])
def test_scores_against_plain_counts(spark, monkeypatch, seed, size):
    monkeypatch.setattr(suffix_tree, "BLOCK", size)
    rows = corpus(seed, 240)
    want, p, kept, count = expected(rows, 6, 2.0)
    docs = spark.createDataFrame([(i, t, 1, "k", "s") for i, t in rows], DOCS).repartition(3)
    got = sorted(map(tuple, suffix_tree.score_texts(docs, 6, 2.0).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6)
    assert {len(c) for c in kept} == {1, 2}
    fresh = [g for g in got if g[1] and g[2] > 20]
    assert sum(g[6] for g in fresh) > 0.9 * sum(g[5] for g in fresh)  # both below 0


def test_every_state_has_a_distribution():
    _, p, kept, count = expected(corpus(3, 200), 6, 2.0)
    for context in list(kept)[::5]:
        assert abs(sum(p(context, w) for w in count) + p(context, "never seen") - 1) < 1e-9


def test_few_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_tree.score_texts(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(held, "a b", 1, "k", "s")], DOCS)
    assert [tuple(r) for r in suffix_tree.score_texts(only).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_packed_arrays():
    arrays = np.arange(5, dtype=np.uint64), np.zeros(0, np.float32), np.array([3], np.uint16)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, suffix_tree.unpack(suffix_tree.pack(*arrays), np.uint64, np.float32, np.uint16), strict=True))
