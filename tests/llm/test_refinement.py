"""Bucket-pointer refinement: identifiers against the strings themselves, hot buckets, long texts, repeated rows."""

import random

import numpy as np
import pytest

from scholarium.llm import hashing, substrings
from scholarium.llm.substrings import identifiers, remove_repeats


@pytest.mark.parametrize("length,rounds", [(8, 0), (16, 1), (24, 2), (50, 3), (100, 4)])
def test_identifiers_are_those_of_the_strings(length, rounds):
    rng = random.Random(length)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 130))) for _ in range(6)]
    slices = [(rng.choice(pieces) + rng.choice(pieces) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))))[rng.randint(0, 9) :].encode() for _ in range(60)]
    text, size = np.frombuffer(b"".join(slices), np.uint8), np.array([len(x) for x in slices])
    places, bucket, done = identifiers(text, size, length)
    assert done == rounds
    joined, ends = b"".join(slices), np.repeat(np.cumsum(size), size)
    strings = {p: joined[p : p + length] for p in range(len(joined)) if p + length <= ends[p]}
    counts = {}
    for x in strings.values():
        counts[x] = counts.get(x, 0) + 1
    assert sorted(places.tolist()) == sorted(p for p, x in strings.items() if counts[x] > 1)
    names = {}
    for p, b in zip(places.tolist(), bucket.tolist(), strict=True):
        assert names.setdefault(b, strings[p]) == strings[p]
    assert len(names) == len(set(names.values()))


def test_lone_suffixes_are_settled_early():
    text = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" * 1, np.uint8)
    assert identifiers(text, np.array([36]), 16)[2] == 0


def brute(rows):
    first, want = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = set()
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone.update(range(p, p + 50))
        want[i] = bytes(c for p, c in enumerate(t) if p not in gone)
    return want


@pytest.mark.parametrize("spread", [16, 1])
def test_a_passage_of_many_documents(spark, monkeypatch, spread):
    """It begins and ends in different blocks in each: gathered in its bucket, or dealt window by window."""
    monkeypatch.setattr(substrings, "SPREAD", spread)
    monkeypatch.setattr(substrings, "REFINED", 300)
    monkeypatch.setattr(hashing, "RUN_BYTES", 700)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, rows = noise(160), []
    ids = list(range(80))
    rng.shuffle(ids)
    for i in ids:
        cut = rng.randint(0, 60)
        rows.append((i, noise(rng.randint(0, 90)) + passage[cut : rng.randint(cut + 50, 160)] + noise(rng.randint(0, 40)) + (passage if i % 5 == 0 else "")))
    rows += [(100, None), (101, ""), (102, noise(5000) + passage), (103, "x" * 4000), (104, "x" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs).collect()} == brute(rows)


def test_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(120)
    rows = [(1, passage), (2, noise(30) + passage), (2, "short"), (2, noise(30) + passage)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_removed for r in got if r.doc_id == 2) == [0, 120, 120]
