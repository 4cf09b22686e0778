"""Reviews (key, verdict, reasons, note, title, snapshot, rated_at): what is pending, the latest, counts and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions import text as tx

VERDICTS = ("good", "bad")
METRICS = ("chars", "figures", "numbers", "sections")
# The reasons that a bad review may name, and what a reader sees of them.
REASONS = {
    "missing_data": "缺关键数据（没有具体数值/条件）",
    "too_vague": "太笼统，没有信息量",
    "figure_bad": "图不对、缺图、或图文不搭",
    "mechanism_wrong": "机理讲错了",
    "structure_bad": "结构混乱、重复啰嗦",
    "truncated": "明显被截断，没写完",
}


def check_verdict(verdict: str) -> str:
    if verdict not in VERDICTS:
        raise ValueError(f"verdict {verdict!r} is not good or bad")
    return verdict


def split_by_verdict(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others for quarantine."""
    ok = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    return reviews.where(ok), reviews.where(~ok)


def shortened(reviews: DataFrame) -> DataFrame:
    return reviews.withColumns({"note": F.substring(F.coalesce("note", F.lit("")), 1, 500), "title": F.substring(F.coalesce("title", F.lit("")), 1, 120)})


def report_snapshots(reports: DataFrame) -> DataFrame:
    """reports (path, html, size, modified) with `snapshot`: the metrics of each page, its size in kB and its time."""
    size = F.bround(F.col("size") / 1024).cast("int")
    metrics = [c.cast("int").alias(k) for k, c in tx.report_metrics(F.col("html")).items()]
    return reports.select("path", F.struct(*metrics, size.alias("size_kb"), F.date_format("modified", "yyyy-MM-dd HH:mm").alias("mtime")).alias("snapshot"))


def pending(read: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of read (key) without a review."""
    return read.join(reviews.select("key").distinct(), "key", "left_anti")


def latest(reviews: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The last review of each key by (rated_at, pos); keys of `deleted` go."""
    row = F.struct(*[F.col(c) for c in reviews.columns])
    kept = reviews.groupBy("key").agg(F.max_by(row, F.struct("rated_at", "pos")).alias("r")).select("r.*")
    return kept if deleted is None else kept.join(deleted.select("key").distinct(), "key", "left_anti")


def review_stats(reviews: DataFrame) -> DataFrame:
    """One row: all reviews, good and bad ones with a snapshot, each metric's mean by verdict (null counts as 0), and
    whether there are three of each."""
    has = F.col("snapshot").isNotNull()
    counts = [F.count_if(has & (F.col("verdict") == v)).alias(v) for v in VERDICTS]
    means = [F.bround(F.avg(F.when(has & (F.col("verdict") == v), F.coalesce(F.col("snapshot")[m], F.lit(0)).cast("double"))), 1).alias(f"{m}_{v}") for m in METRICS for v in VERDICTS]
    return reviews.agg(F.count("*").alias("total"), *counts, *means).withColumn("ready", (F.col("good") >= 3) & (F.col("bad") >= 3))


def reason_label(reason: Column) -> Column:
    return F.coalesce(*[F.when(reason == code, label) for code, label in REASONS.items()], reason)


def reason_counts(reviews: DataFrame) -> DataFrame:
    """(reason, label, n, first_pos), the most frequent first, ties by first appearance (pos, place in the list); a reason
    that is none of REASONS is its own label."""
    exploded = reviews.select("pos", F.posexplode("reasons").alias("place", "reason"))
    grouped = exploded.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("pos", "place")).alias("_at"))
    return grouped.orderBy(F.desc("n"), "_at").select("reason", reason_label(F.col("reason")).alias("label"), "n", F.col("_at.pos").alias("first_pos"))
