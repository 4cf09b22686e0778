"""Tables on disk that change: safe replacement, a review store with upserts, and tables between two steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of a review store: an upsert rewrites those of its keys.
BUCKETS = 64


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir); only a local session may be without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/table-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to a scratch table and read back: what follows sees the same rows each time, in the same partitions' order."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting to remove a query's shuffle files as soon as the query has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files on the disks when it has ended."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def drop(df: DataFrame) -> None:
    """Removes the scratch table that df reads as it is (of settled); nothing may read it later."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, name = files(df.sparkSession, path)
        fs.delete(name(path), True)


def files(spark: SparkSession, path: str):
    """The file system of path, and what makes its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table at path, which df may itself read. The new files are complete beside it before the old ones are
    moved away, so a failing job leaves the old table; readers that start between the two renames find none."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}-new-{mark}", f"{path.rstrip('/')}-old-{mark}"
    fs, name = files(spark, path)
    try:
        df.write.parquet(fresh)
    except Exception:
        fs.delete(name(fresh), True)
        raise
    before = fs.exists(name(path))
    if before and not fs.rename(name(path), name(old)):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(name(fresh), name(path)):
        if before:
            fs.rename(name(old), name(path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(name(old), True)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _last(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each key the row that was rated last; of equal times the one that is written now, then the deletion."""
    whole, order = F.struct(*columns, "deleted"), F.struct("rated_at", "_now", "deleted")
    return rows.groupBy("key", "bucket").agg(F.max_by(whole, order).alias("r")).select("key", "bucket", "r.*")


def create_reviews(reviews: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new store of reviews (key, rated_at ...) at path, in place of one that is there."""
    columns = [c for c in reviews.columns if c != "key"]
    rows = _last(_bucketed(reviews, buckets).withColumns({"deleted": F.lit(False), "_now": F.lit(0)}), columns)
    spark, fresh = reviews.sparkSession, f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(fresh)
    fs, name = files(spark, path)
    fs.delete(name(path), True)
    if not fs.rename(name(fresh), name(path)):
        raise OSError(f"{path} could not be replaced")


def upsert_reviews(changes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes changes, of the store's columns and `deleted`, into the store at path; the last rating of a key wins.

    Only buckets that hold a key of the changes are read and, by a dynamic overwrite when the job has ended well, replaced. A
    deletion stays as a tombstone, so that an older rating that comes later is not taken for a new one.
    """
    spark = changes.sparkSession
    dealt = settled(_bucketed(changes, buckets))
    touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    store = spark.read.parquet(path)
    columns = [c for c in store.columns if c not in ("key", "bucket", "deleted")]
    kept = store.where(F.col("bucket").isin(touched)).withColumn("_now", F.lit(0))
    rows = _last(kept.unionByName(dealt.select("key", *columns, "deleted", "bucket").withColumn("_now", F.lit(1))), columns)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The reviews of a store that are not deleted."""
    return spark.read.parquet(path).where(~F.col("deleted")).drop("deleted", "bucket")
