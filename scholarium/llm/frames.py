"""Small helpers that the corpus operators share: reading, scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count has shown that it has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session, which is one process on one
    machine, may do without and gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Spark's setting to remove a query's shuffle files as soon as the query has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What queries inside have shuffled goes from the disks when they have ended."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def materialise(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors. An operator's
    result reads such tables when its rows are asked for, so they stay; `settled` removes them, or `drop` before. With `tidy`
    what the write has shuffled goes from the disks when it has ended."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidied(spark) if tidy else nullcontext():
        df.write.parquet(path)
    if _written.get() is not None:
        _written.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables of `materialise`; nothing may read them later."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(table.sparkSession, path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table, after which all tables that it wrote on the way are removed."""
    token = _written.set([])
    try:
        df = make()
        paths = list(_written.get() or [])
    finally:
        _written.reset(token)
    out = materialise(df, tidy=True)
    for path in paths:
        _remove(df.sparkSession, path)
    return out


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def partitions(df: DataFrame, bytes_in: int, per: int = 32 << 20) -> int:
    """So many partitions that each gets about `per` of `bytes_in` bytes, and never fewer than the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_in // per))
