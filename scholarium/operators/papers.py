"""Paper tables: supplements, duplicates, ranking, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions import scores
from scholarium.functions import text as tx
from scholarium.sources.store import settled


def is_supplementary(doi: Column, venue: Column, citations: Column) -> Column:
    """A DOI ending in .sNNN, or an uncited record of a data archive."""
    archive = F.lower(F.coalesce(venue, F.lit(""))).isin("figshare", "zenodo")
    return F.lower(F.coalesce(doi, F.lit(""))).rlike(r"\.s[0-9]{3,}$") | (archive & (F.coalesce(citations, F.lit(0)) == 0))


def without_supplements(papers: DataFrame, keep: bool = False) -> DataFrame:
    return papers if keep else papers.where(~is_supplementary(F.col("doi"), F.col("venue"), F.col("citations")))


def in_years(papers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows with first <= year <= last; a bound of 0 or None is none. Pushed into the scan."""
    if first:
        papers = papers.where(F.col("year") >= first)
    return papers.where(F.col("year") <= last) if last else papers


def dedupe_best(papers: DataFrame) -> DataFrame:
    """Of the records of one title the best, at the place (`pos`, each row's own) of the first; of equals the earlier.
    Records whose title has no letters or digits are never merged.

    What is grouped is narrow (a key, a quality, a place) and reduced before the shuffle, so a title that many records
    share is no hot key; whole rows only meet the places of those that stay.
    """
    kept = best_of_titles(papers, -F.col("pos"))
    return kept.select(*[(-F.col("_place")).alias("pos") if c == "pos" else F.col(c) for c in papers.columns])


def best_of_titles(papers: DataFrame, place: Column) -> DataFrame:
    """The best record of each title, with `_place`, the greatest place of the title's records. A record with a greater
    place comes earlier; of equals it wins. pos tells records apart."""
    key = tx.dedupe_key(F.col("title"))
    best = F.struct(scores.quality(F.col("venue"), F.col("citations"), F.col("doi")).alias("q"), place.alias("p"))
    keyed = papers.select(F.when(key != "", F.sha2(key, 256)).otherwise(F.concat(F.lit("#"), F.col("pos"))).alias("_key"), place.alias("_place"), "pos", best.alias("_best"))
    chosen = keyed.groupBy("_key").agg(F.max("_place").alias("_place"), F.max_by("pos", "_best").alias("pos")).drop("_key")
    return papers.join(chosen, "pos")


def first_wins(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each non-empty key."""
    ranked = rows.withColumn("_key", key).where("_key <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return ranked.where("_n = 1").drop("_key", "_n")


def ranked(papers: DataFrame, year_now: int) -> DataFrame:
    """papers with `score`; sort by it descending, then by pos."""
    return papers.withColumn("score", scores.rank_score(F.col("relevance"), F.col("citations"), F.col("year"), F.col("status"), year_now))


def top(papers: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows (1 to 200), numbered in `n`: the limit comes first, so only they meet in one task."""
    cut = papers.orderBy(*order).limit(max(1, min(200, n)))
    return cut.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """All rows with their place `n` in the order, from 1: sorted ranges are written, counted, and numbered from what lies
    before them. No task sees more than its range. Rows that are equal in the order are numbered in any way."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settled(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, seen = [], 0
    for r in placed.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        before.append((r["_range"], seen))
        seen += r["count"]
    offsets = spark.createDataFrame(before, "_range int, _before long")
    return placed.join(F.broadcast(offsets), "_range").withColumn("n", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def page(rows: DataFrame, number: int, size: int, partition: list[str], *order: Column) -> DataFrame:
    """Page `number` (from 1) of each partition's list, with its `total` and `pages`; size is held to 1..200."""
    size = max(1, min(200, size))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    totals = rows.groupBy(*partition).agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return numbered.where(F.col("_n").between((number - 1) * size + 1, number * size)).drop("_n").join(totals, partition)


def search_totals(found: DataFrame, returned: DataFrame) -> DataFrame:
    """One row: total, and how many were filtered or cut."""
    return found.agg(F.count("*").alias("total")).join(F.broadcast(returned.agg(F.count("*").alias("returned")))).withColumn("filtered", F.col("total") - F.col("returned"))
