"""Queries that write a table's rows in a source's own form and read them back, and of stores that change."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.operators import matching, papers
from scholarium.plans.catalog import _RANK, _read, query
from scholarium.plans.catalog import rank_score as _rank_score
from scholarium.sources import store, tables

_REVIEWS = "SELECT doc_id::VARCHAR AS key, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS verdict, 'toxic ' || toxic AS note, '2024-01-0' || (1 + doc_id % 9) AS rated_at FROM labels"


def _reviews(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("verdict"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("note"), F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 9).cast("string")).alias("rated_at"))


@query(_REVIEWS)
def review_store_json(spark, sf_dir):
    """Stores as JSON objects by key, one file a hash of the keys, and one file that is corrupt."""
    path = store.scratch(spark)
    entry = F.concat(F.lit('"'), "key", F.lit('":'), F.to_json(F.struct("verdict", "note", "rated_at")))
    rows = _reviews(spark, sf_dir).groupBy(F.pmod(F.xxhash64("key"), F.lit(8)).alias("part")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    rows.select("part", "value").repartition("part").write.partitionBy("part").text(path)
    spark.range(1).select(F.lit('{"broken": ').alias("value")).write.mode("append").text(f"{path}/part=99")
    return tables.reviews(spark, path).select("key", "verdict", "note", "rated_at")


@query(f"""
WITH r AS ({_REVIEWS}), n AS (SELECT * FROM r WHERE key::BIGINT % 3 <> 0)
SELECT key, CASE WHEN key::BIGINT % 6 = 1 THEN 'good' ELSE verdict END AS verdict, CASE WHEN key::BIGINT % 6 = 1 THEN '2025-01-01' ELSE rated_at END AS rated_at FROM n WHERE key::BIGINT % 12 <> 5
UNION ALL SELECT 'new ' || key, verdict, rated_at FROM r WHERE key::BIGINT % 50 = 0
""")
def review_upserts(spark, sf_dir):
    """A store that is made, changed and added to: later ratings win, earlier ones do not, deletions stay."""
    path, rows, key = store.scratch(spark), _reviews(spark, sf_dir).drop("note"), F.col("key").cast("long")
    alive = F.lit(False)
    store.create_reviews(rows, path)
    store.upsert_reviews(rows.where(key % 3 == 0).withColumns({"rated_at": F.lit("2024-06-01"), "deleted": F.lit(True)}), path)
    changed = rows.where(key % 6 == 1).withColumns({"verdict": F.lit("good"), "rated_at": F.lit("2025-01-01"), "deleted": alive})
    early = rows.where((key % 3 == 0) | (key % 6 == 1)).withColumns({"verdict": F.lit("early"), "rated_at": F.lit("2023-01-01"), "deleted": alive})
    gone = rows.where(key % 12 == 5).withColumns({"deleted": F.lit(True), "rated_at": F.lit("2025-01-02")})
    fresh = rows.where(key % 50 == 0).withColumns({"key": F.concat(F.lit("new "), "key"), "deleted": alive})
    store.upsert_reviews(changed.unionByName(early).unionByName(gone).unionByName(fresh), path)
    return store.read_reviews(spark, path).select("key", "verdict", "rated_at")


@query(f"SELECT row_number() OVER (ORDER BY score DESC, pos) AS n, pos, score FROM ({_RANK})")
def result_files(spark, sf_dir):
    """Ranked, numbered results as JSON lines, read back."""
    path = store.scratch(spark)
    tables.write_results(papers.numbered(_rank_score(spark, sf_dir), F.desc("score"), F.col("pos")), path)
    return spark.read.schema("n long, pos long, score double").json(path)


def _named(rows, path: str, name: str) -> None:
    """A file `name` of text for each row (key, value), in a folder with the key's name; rows of one key share its file, a line
    each. Each task writes the files of its keys itself, through Arrow's file systems (file, s3, gs, hdfs, viewfs), so that
    nothing is done a key at a time by the driver. A file gets its name when it is complete: a task that is tried again, or twice
    at once, leaves it whole."""

    def write(batches):
        at, root = fs.FileSystem.from_uri(path)
        last, out, part = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                at.move(part, f"{root}/{last}/{name}")

        for batch in batches:
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or key != last:
                    close()
                    at.create_dir(f"{root}/{key}")
                    last, part = key, f"{root}/{key}/.{name}-{uuid.uuid4().hex}"
                    out = at.open_output_stream(part)
                out.write(f"{value or ''}\n".encode())
        close()
        yield from ()

    key, value = rows.columns
    dealt = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    dealt.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


@query("SELECT 'K' || s_suppkey AS att_key, strlen(s_name) + 1 AS size FROM supplier WHERE s_suppkey % 4 <> 1")
def attachment_listing(spark, sf_dir):
    """Files in a folder for each key, some of them no PDF, with their sizes; contents are not read."""
    path, key = store.scratch(spark), F.col("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("K"), key.cast("string")).alias("att_key"), F.col("s_name").alias("value"), (key % 4 == 1).alias("other"))
    _named(rows.where("not other").drop("other"), path, "file.PDF")
    _named(rows.where("other").drop("other"), path, "file.txt")
    return tables.attachments(spark, path).select("att_key", "size")


@query("SELECT 'D' || conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id")
def parsed_texts(spark, sf_dir):
    """Conversations as parsed documents, `full.md` in a folder for each."""
    path = store.scratch(spark)
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    _named(_read(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("D"), F.col("conv_id").cast("string")).alias("doc_id")).agg(F.array_join(turns, "\n").alias("value")), path, "full.md")
    return tables.parsed_documents(spark, path)


@query("SELECT 'L' || conv_id AS doc, turn::INT AS page_idx, 600.0::DOUBLE AS page_w, 800.0::DOUBLE AS page_h, (n)::INT AS ord, CASE WHEN n = 0 THEN 'text' ELSE 'image' END AS type, CASE WHEN n = 0 THEN text ELSE 'Figure ' || turn END AS text FROM conversations, range(0, 2) AS r(n)")
def layout_files(spark, sf_dir):
    """Layout JSON, a file for each conversation: a page for each turn, with its text and an image."""
    path = store.scratch(spark)
    block = lambda kind, text, top: F.struct(F.lit(kind).alias("type"), F.array(F.lit(10.0), F.lit(top), F.lit(300.0), F.lit(top + 200)).alias("bbox"), F.array(F.struct(F.array(F.struct(text.alias("content"))).alias("spans"))).alias("lines"))
    page = F.struct(F.col("turn").cast("int").alias("page_idx"), F.array(F.lit(600.0), F.lit(800.0)).alias("page_size"), F.array(block("text", F.col("text"), 20.0), block("image", F.concat(F.lit("Figure "), F.col("turn").cast("string")), 300.0)).alias("para_blocks"))
    rows = _read(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("L"), F.col("conv_id").cast("string")).alias("doc")).agg(F.to_json(F.struct(F.collect_list(page).alias("pdf_info"))).alias("value"))
    _named(rows, path, "layout.json")
    found = tables.layout_blocks(spark, path, "layout.json").withColumn("doc", F.element_at(F.split("doc", "/"), -2))
    content = F.col("block.lines")[0]["spans"][0]["content"]
    return found.select("doc", "page_idx", "page_w", "page_h", "ord", "block.type", content.alias("text"))


@query(r"SELECT doc_id, lang || '  and ' || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents")
def image_marks(spark, sf_dir):
    """Texts with marks of images, which go."""
    marked = F.concat("lang", F.lit(" ![](images/a-1.jpg) and "), F.replace("text", F.lit("\n"), F.lit("\n![](images/b/c.png)\n")))
    return _read(spark, sf_dir, "documents").select("doc_id", tx.drop_image_marks(marked).alias("text"))


@query("""
WITH d AS (SELECT doc_id AS pos, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t, source FROM documents),
lib AS (SELECT t FROM d WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4'))
SELECT pos, CASE WHEN t <> '' AND t IN (SELECT t FROM lib) THEN 'have' ELSE 'new' END AS status FROM d
""")
def library_match_kept(spark, sf_dir):
    """Documents matched by title with a library whose keys are kept in buckets."""
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.lit("").alias("doi"), "source")
    name = f"library_{uuid.uuid4().hex}"
    matching.keep_library(rows.where(F.col("source").isin("src0", "src1", "src2", "src3", "src4")), name, 16)
    return matching.match_kept(rows, name).select("pos", "status")
