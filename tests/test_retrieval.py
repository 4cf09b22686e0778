"""Vectors, sparse rows, the inverted index and related works against all pairs."""

import itertools
import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholarium.operators import graph, index, matching, papers, sparse, vectors
from scholarium.sources import store


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def all_nearest(asked, rows, n):
    return sorted((pos, rank, i) for pos, q in asked for rank, (_, i) in enumerate(sorted((-cosine(q, v), i) for i, v in rows)[:n], 1))


def clusters(seed, count, size, width):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(count)]
    return [[x + rng.gauss(0, 0.05) for x in c] for c in centres for _ in range(size)]


def table(spark, rows, key):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{key} long, vec array<double>")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pivots_leave_out_most_pairs_of_clustered_vectors(spark):
    rows = list(enumerate(clusters(3, 20, 30, 8)))
    asked = rows[::20]
    left, right = table(spark, asked, "pos"), table(spark, rows, "id")
    got = sorted((r.pos, r.rank, r.id) for r in matching.nearest(left, right, 3).collect())
    assert got == all_nearest(asked, rows, 3)
    assert vectors.compared(left, right, 3).count() < len(asked) * len(rows) / 3


@pytest.mark.parametrize(("n", "most"), [(1, 20_000), (5, 7), (400, 20_000)])
def test_nearest_equals_all_pairs_whatever_the_vectors(spark, n, most):
    """Random ones, copies, opposite ones, zeros, nulls, shorter ones and ties, in pieces of cells too."""
    rng = random.Random(n)
    vecs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(150)] + clusters(5, 3, 20, 6)
    vecs += [vecs[3]] * 40 + [[-x for x in vecs[4]], [0.0] * 6, [0.0] * 6, vecs[5][:3], [2 * x for x in vecs[6]]]
    rows = list(enumerate(vecs))
    asked = rows[::17] + [(1000, [0.0] * 6), (1001, vecs[7][:2])]
    got = sorted((r.pos, r.rank, r.id) for r in matching.nearest(table(spark, asked, "pos"), table(spark, rows, "id"), n, most).collect())
    want = all_nearest(asked, rows, n)
    assert len(got) == len(want)
    sims = {(p, i): round(cosine(dict(asked)[p], v), 9) for p, _ in asked for i, v in rows}
    assert [(p, r, sims[p, i]) for p, r, i in got] == [(p, r, sims[p, i]) for p, r, i in want]


def test_vectors_without_direction(spark):
    right = table(spark, [(1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "id")
    got = matching.nearest(table(spark, [(0, [1.0, 0.0]), (9, None)], "pos"), right, 3).orderBy("pos", "rank").collect()
    assert [(r.pos, r.id, r.sim) for r in got] == [(0, 4, 1.0), (0, 1, 0.0), (0, 2, 0.0), (9, 1, 0.0), (9, 2, 0.0), (9, 3, 0.0)]
    assert matching.nearest(table(spark, [(0, [1.0])], "pos"), right.limit(0), 3).count() == 0


def words(text):
    return [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if t]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 20, 60])))) for i in range(n)]
    return rows + [(n + i, rows[i][1]) for i in range(10)] + [(n + 20, None), (n + 21, ""), (n + 22, "T1, t1; T1!")]


def test_tfidf_is_its_definition(spark):
    rows = texts(1, 40)
    df = sparse.tfidf(spark.createDataFrame(rows, "doc_id int, text string"), "text", 64)
    got = {r.doc_id: dict(zip(r.indices, r.values, strict=True)) for r in df.collect()}
    dims = {r.t: r.d for r in spark.createDataFrame([(t,) for t in sorted({t for _, x in rows for t in words(x)})], "t string").select("t", sparse.dimension(F.col("t"), 64).alias("d")).collect()}
    counts = {i: Counter(dims[t] for t in words(x)) for i, x in rows}
    df_ = Counter(d for c in counts.values() for d in c)
    for i, c in counts.items():
        raw = {d: tf * math.log((len(rows) + 1) / (df_[d] + 1)) for d, tf in c.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        assert list(got[i]) == sorted(raw) and all(abs(got[i][d] - (v / length if length else 0)) < 1e-12 for d, v in raw.items())


@pytest.mark.parametrize("threshold", [0.3, 0.92, 1.0])
def test_cosine_pairs_equal_all_pairs(spark, threshold):
    df = sparse.tfidf(spark.createDataFrame(texts(2, 60), "doc_id int, text string"), "text", 256).select(F.col("doc_id").alias("id"), "indices", "values")
    rows = {r.id: dict(zip(r.indices, r.values, strict=True)) for r in df.collect()}
    want = {(p, i) for p in rows if p % 3 == 0 for i in rows if sum(v * rows[i].get(d, 0) for d, v in rows[p].items()) >= threshold - 1e-9}
    asked = df.where("id % 3 = 0").withColumnRenamed("id", "pos")
    got = sparse.cosine_pairs(asked, df, threshold)
    assert {(r.pos, r.id) for r in got.collect()} == want and len(want) >= 20
    with pytest.raises(ValueError):
        sparse.cosine_pairs(asked, df, 0.0)


def test_first_columns_leave_out_a_column_of_all_rows(spark):
    """One column that all rows have makes no pairs, however many rows there are."""
    rows = spark.range(300).select("id", F.array(F.lit(0), (F.col("id") + 1).cast("int")).alias("indices"), F.array(F.lit(0.6), F.lit(0.8)).alias("values"))
    entries = sparse._entries(rows, "id", "a")
    ranks = entries.groupBy("index").agg(F.count("*").alias("rank"))
    first = sparse._leading(entries, "a", ranks, lambda w: F.sqrt(F.sum(F.col("v") * F.col("v")).over(w)), 0.9).where("leads")
    assert {r["index"] for r in first.collect()} == set(range(1, 301))
    assert sparse.cosine_pairs(rows.withColumnRenamed("id", "pos"), rows, 0.9).count() == 300


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.05), (100, 0.3)])
def test_related_works_equal_the_product(spark, k, threshold):
    """With a hub that a third of all edges go to."""
    rng = random.Random(k)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(240)] + [(i, 999) for i in range(120)] + [(5, 6), (5, 6), (None, 1), (7, 7)]
    pairs = {e for e in edges if None not in e}
    columns: dict = {}
    for citing, cited in pairs:
        columns.setdefault(("+", cited), set()).add(citing)
        columns.setdefault(("-", citing), set()).add(cited)
    scores: Counter = Counter()
    for of in columns.values():
        for a in of:
            for b in of - {a}:
                scores[a, b] += 1 / len(of)
    want = []
    for a in {a for a, _ in scores}:
        best = sorted((-round(s, 9), b) for (x, b), s in scores.items() if x == a and s >= threshold - 1e-9)
        want += [(a, rank, b) for rank, (_, b) in enumerate(best[:k], 1)]
    got = sparse.related(spark.createDataFrame(edges, "citing long, cited long"), k, threshold)
    assert sorted((r.id, r["rank"], r.other) for r in got.collect()) == sorted(want) and want


@pytest.mark.parametrize("block", [3, 16, 10_000])
def test_index_gives_the_best_texts_of_each_question(spark, tmp_path, block):
    docs = texts(4, 150)
    questions = [(i, t) for i, t in texts(9, 12)] + [(90, "nowhere"), (91, None), (None, "t1"), (92, docs[3][1]), (93, "t1 t2 T3")]
    index.build_index(spark.createDataFrame([*docs, (None, "t1")], "doc_id long, text string"), str(tmp_path / "i"), block)
    rows = [(i, words(t)) for i, t in docs]
    mean, df = sum(len(w) for _, w in rows) / len(rows), Counter(t for _, w in rows for t in set(w))
    want = []
    for q, text in questions:
        scores = []
        for i, w in rows:
            tf = Counter(w)
            s = sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(words(text)) if t in tf)
            scores += [(-round(s, 9), i)] if s > 0 else []
        want += [(q, rank, i) for rank, (_, i) in enumerate(sorted(scores)[:5], 1) if q is not None]
    found = index.search_many(spark, str(tmp_path / "i"), spark.createDataFrame(questions, "qid long, text string"), 5)
    assert sorted((r.qid, r["rank"], r.doc_id) for r in found.collect()) == sorted(want)
    assert "doc_id" in plan(found) and "text" not in re.sub("[^ ]*/[^ ]*", "", plan(found).split("ReadSchema", 1)[1])


@pytest.mark.parametrize("least", [1, 200])
def test_questions_are_answered_in_rounds_of_blocks(spark, tmp_path, monkeypatch, least):
    """Rounds of one block or a few give the same answers, and no table of candidates stays."""
    docs, questions = texts(4, 150), spark.createDataFrame(texts(9, 12), "qid long, text string")
    index.build_index(spark.createDataFrame([*docs, (3, "t1 t2"), (3, "t1")], "doc_id long, text string"), str(tmp_path / "i"), 10)
    want = sorted(map(tuple, index.search_many(spark, str(tmp_path / "i"), questions, 5).collect()))
    monkeypatch.setattr(index, "ROUND", least)
    monkeypatch.setattr(store, "scratch", lambda spark: str(tmp_path / f"table-{uuid.uuid4().hex}"))
    found = index.search_many(spark, str(tmp_path / "i"), questions, 5)
    left = [spark.read.parquet(str(path)).columns for path in tmp_path.glob("table-*")]
    assert ["qid", "rank", "doc_id", "score"] in left and not [c for c in left if "part" in c]
    assert sorted(map(tuple, found.collect())) == want and len(left) > 2


def test_lists_are_made_where_a_block_is(spark, tmp_path):
    """Texts with letters that change in lower case, and repeated words; a list is in the order of doc_id."""
    docs = [(5, "B b a"), (-2, "a \u212aelvin \u0130x"), (9, None), (7, "...")]
    index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / "postings")).collect()
    got = {r.term: [tuple(e) for e in r.entries] for r in rows}
    assert got == {"a": [(-2, 1, 4), (5, 1, 3)], "b": [(5, 2, 3)], "i": [(-2, 1, 4)], "kelvin": [(-2, 1, 4)], "x": [(-2, 1, 4)]}
    assert all(r.n == len(r.entries) and r.best > 0 for r in rows)


def test_index_reads_no_list_below_the_floor(spark, tmp_path, monkeypatch):
    """Blocks whose bound is below a question's floor, and candidates of the least terms, are left out."""
    read = []
    scored = index._scored
    monkeypatch.setattr(index, "_scored", lambda asked, *rest: read.append(asked) or scored(asked, *rest))
    docs = [(i, "common " * 3 + ("rare " * 5 if i < 20 else "filler")) for i in range(400)]
    index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), 10)
    found = index.search_many(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "common rare")], "qid long, text string"), 2)
    assert found.count() == 2
    first, leading, adding = (r.select("block", "term").distinct().count() for r in read)
    blocks = spark.read.parquet(str(tmp_path / "i" / "postings")).select("block").distinct().count()
    assert first <= 4 and leading + adding < blocks


def test_numbering_of_all_rows(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("id"), (F.col("id") % 13).alias("score"))
    got = papers.numbered(rows, F.desc("score"), F.col("id"))
    want = sorted(((r.score, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.score, r.id) for r in got.orderBy("n").collect()] == [(n, s, i) for n, (s, i) in enumerate(want, 1)]
    assert "Window" not in plan(got) and "SinglePartition" not in plan(got)
    assert papers.numbered(rows.limit(0), F.col("id")).count() == 0


def test_a_kept_library_is_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    spark.sql("create database if not exists kept location '%s'" % (tmp_path / "kept.db"))
    library = spark.createDataFrame([("10.1/A", "Known work"), ("", ""), ("10.1/a", "Known  work!")], "doi string, title string")
    asked = spark.createDataFrame([(0, " 10.1/a ", "x"), (1, "", "known-WORK"), (2, "", ""), (3, "10.9/none", None)], "pos int, doi string, title string")
    matching.keep_library(library, "kept.library", 4)
    found = matching.match_kept(asked, "kept.library")
    assert [r.status for r in found.orderBy("pos").collect()] == ["have", "have", "new", "new"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching.match_kept(asked, "kept.library")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [part.split("FileScan")[0] for part in plan.split("SortMergeJoin")[1:]]
    assert len(scans) == 2 and plan.count("Exchange") == 2  # the papers', once for each key
    spark.sql("drop database kept cascade")


def test_snowball_looks_at_seeds_first(spark):
    works = spark.range(100).select("id", F.concat(F.lit("10.1/"), "id").alias("doi"), F.lit("t").alias("title"), F.lit(1).alias("citations"))
    edges = spark.range(1000).select((F.col("id") % 100).alias("citing"), (F.col("id") % 100 % 7).alias("cited"), F.lit(0).alias("ord"))
    seeds = spark.createDataFrame([(0, "10.1/3"), (1, "10.1/none")], "seed_pos long, doi string")
    known = graph._known(seeds, works)
    found = graph.forward(known.where("seed is not null"), edges, works)
    assert found.count() == 14
    below = plan(found).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    aggregate = below.index("Aggregate [seed_pos")
    assert below.index("Join Inner", aggregate) < below.index("Range (0, 1000", aggregate)


def test_scores_do_not_depend_on_the_order_of_sums(spark):
    """Copies have the same terms, whose sum in another order may be on another side of the half of the last place."""
    parts = [0.1, 0.7, 0.0000000005, 0.3]
    assert len({round(sum(order), 9) for order in itertools.permutations(parts)}) == 2
    rows = [(0, i, x) for i, order in enumerate(itertools.permutations(parts)) for x in order]
    got = index._whole(spark.createDataFrame(rows, "qid int, doc_id int, part double").coalesce(1)).collect()
    assert len(got) == 24 and len({r.score for r in got}) == 1


def related_by_hand(edges, k, threshold):
    columns: dict = {}
    for citing, cited in set(edges):
        columns.setdefault(("+", cited), set()).add(citing)
        columns.setdefault(("-", citing), set()).add(cited)
    scores: dict = {}
    for of in columns.values():
        for a, b in itertools.permutations(of, 2):
            scores.setdefault(a, Counter())[b] += 1 / len(of)
    best = {a: sorted((-round(s, 9), b) for b, s in others.items() if s >= threshold - 1e-9)[:k] for a, others in scores.items()}
    return sorted((a, rank, b) for a, found in best.items() for rank, (_, b) in enumerate(found, 1))


def test_related_works_in_rounds_and_parts(spark, monkeypatch):
    """Columns of several parts, works of several rounds and large columns that lead in one work only, of numbers and names."""
    for name, value in (("SMALL", 3), ("CHUNK", 4), ("ROUND", 100), ("PAIRS", 50)):
        monkeypatch.setattr(sparse, name, value)
    rng = random.Random(8)
    edges = [(rng.randrange(50), rng.randrange(40)) for _ in range(300)] + [(i, 99) for i in range(50)] + [(i, 98) for i in range(0, 50, 3)]
    for kind, rows in (("long", edges), ("string", [(f"w{a:02}", f"w{b:02}") for a, b in edges])):
        got = sparse.related(spark.createDataFrame(rows, f"citing {kind}, cited {kind}"), 15, 0.2)
        want = related_by_hand(rows, 15, 0.2)
        assert sorted((r.id, r["rank"], r.other) for r in got.collect()) == want and len(want) > 300


def test_related_works_write_no_pair_below_the_threshold(spark, monkeypatch):
    """43,000 pairs share a column of 30 works each, which relates none of them: no table of these pairs is written."""
    written = []

    def kept(f):
        def run(*args):
            df = f(*args)
            written.append(df.count())
            return df

        return run

    monkeypatch.setattr(sparse, "settled", kept(sparse.settled))
    monkeypatch.setattr(sparse, "_product", kept(getattr(sparse, "_product", None)), raising=False)
    rng = random.Random(1)
    edges = [(citing, 10_000 + i) for i in range(100) for citing in rng.sample(range(3000), 30)]
    got = sparse.related(spark.createDataFrame(edges, "citing long, cited long"))
    assert sorted((r.id, r["rank"], r.other) for r in got.collect()) == related_by_hand(edges, 20, 0.05)
    assert max(written) <= 2 * len(edges) + 1


def test_related_works_write_only_the_best_of_a_work(spark, monkeypatch):
    """7,140 pairs reach the threshold, five of each work are asked for: no table has more rows than entries."""
    written, write = [], sparse.settled
    monkeypatch.setattr(sparse, "settled", lambda df: written.append((out := write(df)).count()) or out)
    product = sparse._product
    monkeypatch.setattr(sparse, "_product", lambda *args: written.append((out := product(*args)).count()) or out)
    edges = [(i, 1000 + (i * 7 + j) % 40) for i in range(120) for j in range(6)] + [(i, 2000) for i in range(120)]
    got = sparse.related(spark.createDataFrame(edges, "citing long, cited long"), 5, 1e-6)
    assert sorted((r.id, r["rank"], r.other) for r in got.collect()) == related_by_hand(edges, 5, 1e-6)
    assert max(written) <= 2 * len(edges)


def test_related_works_are_summed_in_pieces(spark, monkeypatch):
    """A partition whose pairs are summed again and again, with what large columns add, of numbers and names."""
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(30)) for _ in range(200)] + [(i, 98) for i in range(0, 40, 3)]
    for name, value in (("SMALL", 9), ("MET", 50)):
        monkeypatch.setattr(sparse, name, value)
    for kind, rows in (("long", edges), ("string", [(f"w{a:02}", f"é{b:02}") for a, b in edges])):
        sent = spark.createDataFrame(rows, f"citing {kind}, cited {kind}")
        assert sorted((r.id, r["rank"], r.other) for r in sparse.related(sent, 7, 0.15).collect()) == related_by_hand(rows, 7, 0.15)


def test_pages_of_derived_relations_compute_them_once(spark):
    """Related works are a finished table: counting their pairs and cutting pages read it, and do not derive them again."""
    edges = spark.range(400).select((F.col("id") % 40).alias("citing"), (F.col("id") * 7 % 31).alias("cited"))
    found = sparse.related(edges)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pages = graph.relations(edges, "RELATED_WORKS", 2, 3, found)
    lists = {i: sorted(r.other for r in rows) for i, rows in itertools.groupby(sorted(found.collect(), key=lambda r: r.id), key=lambda r: r.id)}
    assert sorted((r.id, r.other, r.total) for r in pages.collect()) == sorted((i, other, len(x)) for i, x in lists.items() for other in x[3:6])
