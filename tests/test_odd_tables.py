"""Queries against their SQL on small tables with what the given ones do not have."""

import os

import pytest

import __spark_entry__

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines without a flag, lines of orders that are missing, and lines that occur twice."""
    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(GIVEN):
        os.symlink(f"{GIVEN}/{name}", folder / name)
    (folder / "lineitem.parquet").unlink()
    lines = spark.read.parquet(f"{GIVEN}/lineitem.parquet")
    changed = lines.selectExpr("l_orderkey + 1000000 AS l_orderkey", "l_linenumber", "l_quantity", "CASE WHEN l_quantity > 25 THEN l_returnflag END AS l_returnflag")
    lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").unionByName(changed).unionByName(changed).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["figure_boxes", "figure_captions", "figure_rectangles"])
def test_figures_equal_their_sql(spark, odd, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}/lineitem.parquet/*.parquet'")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{odd}/orders.parquet'")
    found = __spark_entry__.queries()[name](spark, odd)
    columns = ", ".join(found.columns)
    wanted = db.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_scores_of_questions_are_rounded_as_whole_numbers(spark):
    """Halves of doubles are rounded up or down as an engine likes: 2.0000005 * 1e6 is 2000000.4999999998."""
    from scholarium.operators import index

    assert "round(" not in __spark_entry__.oracle_sql()["search_questions"]
    parts = spark.createDataFrame([(1, 1, 3.0), (1, 1, 0.0123456785), (1, 2, 1.0000000005)], "qid int, doc_id int, part double")
    assert {r.doc_id: r.score for r in index._whole(parts).collect()} == {1: 3.012345679, 2: 1.000000001}


def test_nearest_vectors_compare_no_pairs_row_by_row(spark):
    """2,000 candidates against 40,000 vectors of one direction more or less: every pair is met, in matrix products."""
    from pyspark.sql import functions as F

    from scholarium.operators import matching

    rows = spark.range(40_000).select("id", F.array(*[F.rand(i) + 1 for i in range(16)]).alias("vec"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "pos")
    found = matching.nearest(asked, rows, 1)
    assert found.where("pos = id and sim > 0.999999").count() == 2_000
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_pages_of_relations_have_partitions_in_proportion(spark, monkeypatch):
    """Repeated pairs, and one work that all others cite."""
    from scholarium.operators import graph

    monkeypatch.setattr(graph, "PAIRS", 50)
    edges = spark.range(600).selectExpr("id % 300 AS citing", "CAST(7 AS BIGINT) AS cited").unionByName(spark.range(600).selectExpr("id % 300 AS citing", "id % 40 + 100 AS cited"))
    found = graph.relations(edges, "CITATIONS", 2, 10)
    rows = sorted(tuple(r) for r in found.where("id = 7").select("other", "total", "pages").collect())
    assert rows == [(i, 300, 30) for i in range(10, 20)]
    assert "hashpartitioning(id" in found._jdf.queryExecution().toString() and ", 24)" in found._jdf.queryExecution().toString()


def test_a_text_of_many_terms_is_weighed_in_linear_time(spark):
    """60,000 different terms: the length is not taken once a term."""
    import time

    from pyspark.sql import functions as F

    from scholarium.operators import sparse

    rows = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(60_000))), (1, "w1 w2")], "doc_id int, text string")
    began = time.time()
    got = sparse.tfidf(rows, "text", 1 << 20).where("doc_id = 0").select(F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x).alias("l")).first()
    assert got.n > 55_000 and abs(got.l - 1) < 1e-9 and time.time() - began < 60


def test_cosines_write_no_table_of_pairs(spark, monkeypatch):
    """Rows whose columns are all shared: nothing is written between the steps."""
    from pyspark.sql import functions as F

    from scholarium.operators import sparse

    monkeypatch.setattr(sparse, "settled", None)
    rows = spark.range(200).select("id", F.array(F.lit(0), F.lit(1)).alias("indices"), F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("values"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "pos")
    near = sorted((r.pos, r.id) for r in sparse.cosine_pairs(asked, rows, 0.9999).collect())
    assert near == [(0, 0), (0, 1), (100, 99), (100, 100), (100, 101)]


def test_cosines_in_rounds_copy_no_more_vectors_than_there_are_rows(spark, monkeypatch):
    """3 blocks and 10 pieces meet in rounds, each pair once; what a round shuffles is the vectors of its blocks and pieces."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql import functions as F

    from scholarium.operators import sparse

    rows = spark.range(200).select("id", F.array(F.lit(0), F.lit(1)).alias("indices"), F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("values"))
    asked = rows.where("id % 4 = 0").withColumnRenamed("id", "pos")
    want = sorted((r.pos, r.id, r.sim) for r in sparse.cosine_pairs(asked, rows, 0.9999).collect())
    rounds, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: rounds.append(self) or write(self, *a, **b))
    for name, n in (("ASKED", 20), ("PIECE", 20), ("COPIES", 1)):
        monkeypatch.setattr(sparse, name, n)
    got = sorted((r.pos, r.id, r.sim) for r in sparse.cosine_pairs(asked, rows, 0.9999).collect())
    assert got == want and len(got) == len({g[:2] for g in got}) > 50
    assert len(rounds) == -(-(50 * 10 + 200 * 3) // 200)


def test_texts_before_references_equal_their_sql(spark, tmp_path):
    """No text, blank ones, ones that begin with a heading, characters of two UTF-16 units, and white space that is not ASCII's."""
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " \n ", "References", "\r\n# References\nx", "a \U0001f600\U0001f600 b\n## Bibliography \nx", "　word \nliterature cited", "words\x0b", "x  ", "some words\n参考文献\nx", "words here\nreferenceſ\nx"]
    rows = [(i * 4 + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(["en", "de", "fr", "es"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = dict(db.execute(f"SELECT doc_id, text FROM ({__spark_entry__.oracle_sql()['strip_refs']})").fetchall())
    assert {r.doc_id: r.text for r in __spark_entry__.queries()["strip_refs"](spark, str(tmp_path)).collect()} == wanted


def test_references_are_cut_behind_characters_of_two_units(spark):
    from pyspark.sql import functions as F

    from scholarium.operators import documents

    text = "\U0001f600" * 20 + " words\n# References\nx"
    assert spark.range(1).select(documents.strip_references(F.lit(text)).alias("x")).first().x == "\U0001f600" * 20 + " words"
