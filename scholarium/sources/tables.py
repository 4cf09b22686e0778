"""Reading inputs as tables, and writing results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.functions import text as tx
from scholarium.sources import schemas
from scholarium.sources.store import replace_table

#: A side is broadcast only if a count shows that it has no more rows, and no more bytes of text and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _bytes(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 16
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if one pass over it shows that it is small."""
    size = df.agg(F.count("*").alias("n"), F.sum(sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))).alias("b")).first()
    return F.broadcast(df) if size["n"] <= most and (size["b"] or 0) <= most_bytes else df


def works(spark: SparkSession, path: str) -> DataFrame:
    """Work JSON (one object a line), with the schema given: no inference pass."""
    return spark.read.schema(schemas.WORK).json(path)


def work_papers(raw: DataFrame) -> DataFrame:
    """Works as paper rows; missing fields get the defaults of a paper."""
    doi, at = tx.doi_display(F.col("doi")), F.col("primary_location")
    return raw.select(
        tx.strip(tx.text_or_empty(F.col("title"))).alias("title"), doi.alias("doi"), F.col("publication_year").alias("year"), tx.text_or_empty(at["source"]["display_name"]).alias("venue"), F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
        tx.restore_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce(at["is_oa"], F.lit(False)).alias("is_oa"), tx.text_or_empty(at["landing_page_url"]).alias("oa_url"), tx.id_tail(F.col("id")).alias("openalex_id"), tx.unique_id(doi).alias("unique_id"),
    )


def discovered_papers(raw: DataFrame) -> DataFrame:
    """Works as discovery rows: first author, short abstract, open access from the work itself."""
    first = F.try_element_at(F.col("authorships"), F.lit(1))["author"]["display_name"]
    venue = F.col("primary_location")["source"]["display_name"]
    return raw.select(
        tx.text_or_empty(F.col("title")).alias("title"), tx.doi_display(F.col("doi")).alias("doi"), F.col("publication_year").alias("year"), tx.text_or_empty(first).alias("first_author"), tx.text_or_empty(venue).alias("venue"),
        tx.restore_abstract(F.col("abstract_inverted_index"), 400).alias("abstract"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by"), F.coalesce(F.col("open_access")["is_oa"], F.lit(False)).alias("is_oa"),
    )


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Search-hit JSON (one object a line), with the schema given."""
    return spark.read.schema(schemas.HIT).json(path)


def evidence_json(spark: SparkSession, path: str) -> DataFrame:
    """Evidence-hit JSON (one object a line), with the schema given."""
    return spark.read.schema(schemas.EVIDENCE).json(path)


def hit_papers(raw: DataFrame) -> DataFrame:
    """Search hits as paper rows."""
    doi = tx.text_or_empty(F.col("doi"))
    return raw.select(
        tx.clean_title(F.col("title")).alias("title"), doi.alias("doi"), tx.year(F.col("publication_published_year")).alias("year"), tx.text_or_empty(F.col("publication_venue_name_unified")).alias("venue"), tx.citations(F.col("citation_count")).alias("citations"),
        F.substring(tx.text_or_empty(F.col("abstract")), 1, 600).alias("abstract"), tx.truth(F.col("is_oa")).alias("is_oa"), tx.text_or_empty(F.col("oa_url")).alias("oa_url"), tx.text_or_empty(F.col("unique_id")).alias("unique_id"), "doc_id", tx.first_names(F.col("author")).alias("authors"), "fwci",
    )


def evidence(raw: DataFrame) -> DataFrame:
    """Evidence hits as chunk rows."""
    return raw.select(
        tx.clean_title(F.col("title")).alias("title"), tx.clean_chunk(F.col("chunk")).alias("chunk"), F.bround("score", 3).alias("score"), F.col("page_no").alias("page"), tx.year(F.col("publication_published_year")).alias("year"),
        tx.text_or_empty(F.col("publication_venue_name_unified")).alias("venue"), tx.citations(F.col("citation_count")).alias("citations"), "doc_id", "offset",
    )


def saved_search(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.SAVED_SEARCH).json(path, multiLine=True)
    return raw.select("query", "time", F.explode("items").alias("i")).select("query", "time", "i.*")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a store: one JSON object by key. A corrupt store is an empty one."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.REVIEWS).alias("m"))
    return raw.select(F.explode("m").alias("key", "r")).select("key", "r.*")


#: Spark's settings for listing folders: the most tasks, and whether the places of a file's blocks are not asked for.
_LISTING = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.sources.ignoreDataLocality")


@contextmanager
def _many_folders(spark: SparkSession) -> Iterator[None]:
    """While files are listed: four tasks a core, not one for each of the first 10,000 folders, and no places of blocks."""
    before = [spark.conf.get(name, None) for name in _LISTING]
    for name, value in zip(_LISTING, (str(4 * spark.sparkContext.defaultParallelism), "true"), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(_LISTING, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files below path with their size; contents are not read."""
    with _many_folders(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    return files.where(F.lower("path").endswith(".pdf")).withColumn("att_key", F.element_at(F.split("path", "/"), -2))


def layout_blocks(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """Layout JSON as a row for each block of each page, in reading order. Of a folder, all files of that name below it are
    read; tasks list it, where a glob would be resolved by the driver."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    with _many_folders(spark):
        raw = files.schema(schemas.LAYOUT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("doc"), F.explode("pdf_info").alias("p"))
    return raw.select("doc", "p.page_idx", F.get("p.page_size", F.lit(0)).alias("page_w"), F.get("p.page_size", F.lit(1)).alias("page_h"), F.posexplode("p.para_blocks").alias("ord", "block"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Report pages with their size and time."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed texts, `full.md` in a directory for each document."""
    with _many_folders(spark):
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "full.md").text(path, wholetext=True)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("doc_id"), F.col("value").alias("text"))


def read_window(windows: DataFrame, documents: DataFrame, length: int = 4000) -> DataFrame:
    """(doc_id, offset, content): `length` characters of each document from the offset, or all of it where that is null."""
    joined = windows.select("doc_id", "offset").join(documents.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "offset", F.when(F.col("offset").isNull(), F.col("text")).otherwise(F.substring("text", F.col("offset").cast("int") + 1, F.lit(length))).alias("content"))


def write_table(df: DataFrame, path: str) -> None:
    """Replaces the table at path; a failing job leaves the old one."""
    replace_table(df, path)


def write_results(df: DataFrame, path: str) -> None:
    """Ranked, numbered results (n) as JSON lines in order: within each file, and from file to file by name."""
    df.orderBy("n").write.mode("overwrite").json(path)
