"""Tables of model answers: search lines and digitised charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions import text as tx
from scholarium.sources import schemas


def clean_lines(answers: DataFrame, n: int) -> DataFrame:
    """(id, pos, line): cleaned lines of each answer (id, text) of four characters or more without Chinese, the first of
    each spelling (in any case), n at most."""
    lines = answers.select("id", F.posexplode(F.split(tx.text_or_empty(F.col("text")), "\n")).alias("pos", "raw"))
    kept = lines.select("id", "pos", tx.query_line(F.col("raw")).alias("line")).where((F.length("line") >= 4) & ~tx.looks_chinese(F.col("line")))
    firsts = kept.groupBy("id", F.lower("line").alias("_k")).agg(F.min(F.struct("pos", "line")).alias("f")).select("id", "f.pos", "f.line")
    return firsts.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("_n") <= n).drop("_n")


def query_set(base: DataFrame, answers: DataFrame, n: int = 5) -> DataFrame:
    """(id, rank, query): the base query (id, query) first, then lines that differ from it, n in all."""
    first = base.select("id", F.lit(-1).alias("pos"), "query")
    if n > 1:
        extra = clean_lines(answers, n - 1).join(base.select("id", F.lower("query").alias("_b")), "id").where(F.lower("line") != F.col("_b")).select("id", "pos", F.col("line").alias("query"))
        first = first.unionByName(extra)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("rank") <= n).select("id", "rank", "query")


def chart_points(responses: DataFrame) -> DataFrame:
    """(id, chart_type, series, n, x, y, error) of answers (id, raw): a row a point; what is no JSON is one row with an error."""
    parsed = responses.select("id", tx.json_text(F.col("raw")).alias("j")).select("id", F.when(F.col("j").isNull(), "not JSON").alias("error"), F.from_json("j", schemas.CHART).alias("c"))
    series = parsed.select("id", "error", "c.chart_type", F.explode_outer("c.series").alias("s"))
    points = series.select("id", "error", "chart_type", F.col("s.name").alias("series"), F.posexplode_outer("s.points").alias("n", "p"))
    return points.where("error is not null or p is not null").select("id", "chart_type", "series", "n", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "error")
