"""The burst trie against every prefix of every conversation."""

import hashlib
import random
import re
import zlib

import pytest

from scholarium.llm import trie

TURNS = "conv_id long, turn long, role string, text string, head string, depth int, key string"


def expected(rows):
    given: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            order = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest()[: trie.WIDTH]
            given.setdefault(conv, []).append(((turn is not None, turn or 0, order), said))
    listed = {c: [said for _, said in sorted(turns)] for c, turns in given.items()}
    whole = {}
    for c in listed:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(listed.get(c - c % 20, [])[:h] + listed[c][h:])
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(re.findall(trie.WORD, q[-1][1])) for q in under if q)
        ended = ",".join(map(str, sorted(c for c in convs if whole[c] == p)))
        children = sum(len(q) == len(p) + 1 for q in under)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else -1, len(convs), children, len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, container):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS)
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.prefix_trie(table, container).collect())


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        start = rng.randrange(3)
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, "user" if turn % 2 else "system", f"say {start if turn < 4 else rng.randrange(2)}"))
    for c in range(1000, 1030):  # copies
        rows += [(c, turn, "user", f"copy {turn}") for turn in range(6)]
    for c in range(2001, 2012):  # each the beginning of the next
        rows += [(c, turn, "user", f"comb {turn}") for turn in range(c - 2000)]
    rows += [(None, 1, "user", "no id"), (5000, None, None, None), (5000, 2, "", "two words"), (5000, 2, "", "two words"), (5001, 1, "a", ""), (5001, 1, "b", "tie"), (5001, 1, "b", "same"), (5003, 1, "u", "w " * 30_000)]
    rows += [(c, 1, "user", f"only {c}") for c in range(6000, 6040)]  # shorter than what is taken from them
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("container", "seed"), [(1, 1), (4, 2), (100_000, 3)])
def test_trie_against_all_prefixes(spark, container, seed):
    rows = conversations(seed, 60)
    got = found(spark, rows, container)
    assert got == expected(rows) and len(got) > 120


def test_trie_of_few_rows(spark):
    assert found(spark, [(None, 1, "user", "x")], 1) == []
    assert found(spark, [(7, 1, "user", "x")], 1) == expected([(7, 1, "user", "x")])
    assert any(r[1] == 0 and r[3] == 1 for r in found(spark, [(7, 1, "user", "x")], 1))
