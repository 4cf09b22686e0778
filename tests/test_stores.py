"""Stores that change, and document operators in proportion to the text."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarium.operators import documents
from scholarium.plans import stored
from scholarium.sources import store, tables

REVIEW = "key string, verdict string, rated_at string"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def failing(df):
    return df.withColumn("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("no"))).otherwise(F.col("id")))


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path)
    before = files(path)
    with pytest.raises(Exception, match="no"):
        tables.write_table(failing(spark.range(9)), path)
    assert files(path) == before and spark.read.parquet(path).count() == 3 and len(list(tmp_path.iterdir())) == 1
    tables.write_table(spark.read.parquet(path).where("id > 0"), path)  # of itself
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "reviews")
    rows = [(f"k{i}", "good", f"2024-01-{1 + i % 28:02}") for i in range(200)]
    store.create_reviews(spark.createDataFrame(rows, REVIEW), path, 16)
    before = files(path)
    changes = [("k1", "bad", "2024-05-01", False), ("k2", "bad", "2023-05-01", False), ("k3", "good", "2024-05-01", True), ("new", "bad", "2024-05-01", False), ("new", "good", "2024-04-01", False)]
    change = spark.createDataFrame(changes, f"{REVIEW}, deleted boolean")
    store.upsert_reviews(change, path, 16)
    got = {r.key: r.verdict for r in store.read_reviews(spark, path).collect()}
    assert len(got) == 200 and (got["k1"], got["k2"], got["new"]) == ("bad", "good", "bad") and "k3" not in got
    touched = {r.bucket for r in store._bucketed(change, 16).collect()}
    after = files(path)
    same = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert same and all(after[f] == before[f] for f in same) and not any(f in after for f in set(before) - same)
    store.upsert_reviews(spark.createDataFrame([("k3", "good", "2024-04-30", False)], f"{REVIEW}, deleted boolean"), path, 16)
    assert store.read_reviews(spark, path).where("key = 'k3'").count() == 0  # rated before it was deleted
    now = files(path)
    bad = change.withColumn("verdict", F.when(F.col("key") == "new", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("verdict")))
    with pytest.raises(Exception, match="no"):
        store.upsert_reviews(bad, path, 16)
    assert files(path) == now
    store.upsert_reviews(change.limit(0), path, 16)
    assert files(path) == now


def test_classes_and_condensed_texts_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "Plain words\n\n## References\n\n3 g of salt"), (2, None), (3, "\n\n"), (4, "TGA: measured on an analyzer\n\n12 g of x"), (5, "references\n\n" + "word\n\n" * 3000)], "doc_id int, text string")
    for df in (documents.classify(rows), documents.condense(rows), documents.document_stats(rows), documents.chunk_rows(rows)):
        assert "Exchange" not in df._jdf.queryExecution().toString()
    got = [(r.doc_id, r.pos, r.kind) for r in documents.classify(rows.where("doc_id < 5")).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "keep"), (1, 1, "drop"), (1, 2, "drop"), (4, 0, "brief"), (4, 1, "core")]
    assert {r.kind for r in documents.classify(rows.where("doc_id = 5")).collect()} == {"drop"}
    texts = {r.doc_id: r.text for r in documents.condense(rows).collect()}
    assert texts[1] == "Plain words" and texts[4] == "12 g of x" + documents.CONDENSED + "TGA" and texts[5] == "" and set(texts) == {1, 4, 5}
    again = {r.doc_id: r.text for r in documents.filtered_text(documents.classify(rows)).collect()}
    assert again == texts
    stats = {r.doc_id: (r.total, r.n_drop, r.chars_core, r.n_brief) for r in documents.document_stats(rows).collect()}
    assert stats[2] == (0, None, 0, None) and stats[4] == (39, None, 9, 1) and stats[5][1] == 3001


def test_many_chunks_of_one_document_take_linear_time(spark):
    """50,000 chunks from paragraphs, and as many from one long paragraph."""
    text = "\n\n".join(f"{i:06d} " + "x" * 490 for i in range(50_000))
    one = "é" * (800 * 50_000)
    rows = spark.createDataFrame([(0, "a\n\nb")], "doc_id int, text string")
    documents.chunk_rows(rows).count()
    for body, most in ((text, 800), (one, 800)):
        began = time.time()
        got = spark.createDataFrame([(1, body)], "doc_id int, text string").select(F.size(documents.chunks(F.col("text"), most)).alias("n")).first()
        assert got.n == 50_000 and time.time() - began < 20


def test_files_of_keys_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """A file a key, without a step of the driver for each; rows of one key share its file."""
    monkeypatch.setattr(stored.store, "files", lambda *_: pytest.fail("the driver handles files"))
    rows = spark.range(2000).select(F.concat(F.lit("K"), "id").alias("key"), F.concat(F.lit("é"), "id").alias("value"))
    rows = rows.unionByName(spark.createDataFrame([("K7", "more"), ("none", None), (None, "lost")], "key string, value string"))
    before = [spark.conf.get(name, None) for name in tables._LISTING]
    stored._named(rows, f"file://{tmp_path}/files", "file.PDF")
    got = {r.att_key: r.size for r in tables.attachments(spark, f"file://{tmp_path}/files").collect()}
    assert got == {f"K{i}": len(f"é{i}\n".encode()) + 5 * (i == 7) for i in range(2000)} | {"none": 1}
    assert sorted((tmp_path / "files/K7/file.PDF").read_text().split("\n")) == ["", "more", "é7"]
    assert [spark.conf.get(name, None) for name in tables._LISTING] == before
    assert all(p.name == "file.PDF" for p in (tmp_path / "files").rglob("*") if p.is_file())


def listing_tasks(spark, read):
    """Tasks of the jobs that list files while read() runs."""
    spark.sparkContext.setJobGroup(f"list-{read.__name__}", "list")
    read()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(f"list-{read.__name__}") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(tracker.getStageInfo(s).numTasks for s in stages)


def test_layouts_of_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    stored._named(spark.range(300).select(F.col("id").cast("string").alias("key"), F.lit('{"pdf_info": [{"page_idx": 1, "page_size": [6.0, 8.0], "para_blocks": [{"type": "text"}]}]}').alias("value")), f"file://{tmp_path}/f", "layout.json")
    (tmp_path / "f/7/other.json").write_text('{"pdf_info": [{"page_idx": 2, "para_blocks": [{"type": "no"}]}]}')

    def layouts():
        layouts.found = tables.layout_blocks(spark, str(tmp_path / "f"), "layout.json")

    assert 0 < listing_tasks(spark, layouts) <= 16
    assert {r.page_idx for r in layouts.found.collect()} == {1} and layouts.found.select("doc").distinct().count() == 300


def test_parsed_documents_of_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    stored._named(spark.range(300).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("text "), "id").alias("value")), f"file://{tmp_path}/f", "full.md")

    def parsed():
        parsed.found = tables.parsed_documents(spark, str(tmp_path / "f"))

    assert 0 < listing_tasks(spark, parsed) <= 16
    assert {(r.doc_id, r.text) for r in parsed.found.collect()} == {(str(i), f"text {i}\n") for i in range(300)}
