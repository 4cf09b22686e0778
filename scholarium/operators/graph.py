"""Citation graphs: edges (citing, cited, ord), works (id, doi, title, citations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.operators.papers import first_wins
from scholarium.functions import text as tx
from scholarium.sources.tables import broadcast_if_small

RELATIONS = ("CITATIONS", "REFERENCES", "RELATED_WORKS")
MOST_FORWARD = 50
#: Pairs of a partition (about), and parts that one work's list is dealt into.
PAIRS, LIST_PARTS = 500_000, 4


def _known(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """seeds (seed_pos, doi) with the id of their work, null if there is none. Works that no seed names leave first."""
    keyed = seeds.withColumn("_doi", tx.doi_key(F.col("doi")))
    asked = broadcast_if_small(keyed.select("_doi").where("_doi <> ''").distinct())
    found = works.select(tx.doi_key(F.col("doi")).alias("_doi"), F.col("id").alias("seed")).join(asked, "_doi", "left_semi").groupBy("_doi").agg(F.min("seed").alias("seed"))
    return keyed.join(found, "_doi", "left").drop("_doi")


def backward(seeds: DataFrame, edges: DataFrame, works: DataFrame, limit: int = 40) -> DataFrame:
    """(seed_pos, seed, ord, id, doi, title, citations): the first `limit` references of each seed (seed_pos, seed)."""
    cited = edges.where(F.col("ord") < limit).join(broadcast_if_small(seeds.select("seed_pos", "seed")), F.col("citing") == F.col("seed"))
    return cited.select("seed_pos", "seed", "ord", F.col("cited").alias("id")).join(works.select("id", "doi", "title", "citations"), "id")


def forward(seeds: DataFrame, edges: DataFrame, works: DataFrame, limit: int = 40) -> DataFrame:
    """As backward, for the most cited works that cite each seed, 50 at most. Only edges to seeds are made distinct."""
    citing = edges.select("citing", "cited").join(broadcast_if_small(seeds.select("seed_pos", "seed")), F.col("cited") == F.col("seed"))
    named = citing.select("seed_pos", "seed", F.col("citing").alias("id")).distinct().join(works.select("id", "doi", "title", "citations"), "id")
    by = Window.partitionBy("seed_pos", "seed").orderBy(F.desc("citations"), "id")
    return named.withColumn("ord", F.row_number().over(by) - 1).where(F.col("ord") < min(MOST_FORWARD, limit)).select("seed_pos", "seed", "ord", "id", "doi", "title", "citations")


def expand(seeds: DataFrame, edges: DataFrame, works: DataFrame, direction: str = "both", limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """One round of the snowball from seeds (seed_pos, doi): its items, each at the first seed and direction that finds it,
    and for each seed how many new ones it found."""
    if direction not in ("backward", "forward", "both"):
        raise ValueError(f"direction {direction!r} is not backward, forward or both")
    known = _known(seeds, works)
    found = known.where("seed is not null")
    parts = [f(found, edges, works, limit).withColumn("from", F.lit(name)) for name, f in (("backward", backward), ("forward", forward)) if direction in (name, "both")]
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    key = F.when(F.coalesce("doi", F.lit("")) != "", F.lower("doi")).otherwise(F.coalesce(F.col("id").cast("string"), F.lit("")))
    items = first_wins(union, key, [F.col("seed_pos"), F.col("from"), F.col("ord")])
    counts = items.groupBy("seed_pos").agg(F.count_if(F.col("from") == "backward").alias("n_backward"), F.count_if(F.col("from") == "forward").alias("n_forward"))
    titles = works.select(F.col("id").alias("seed"), F.substring("title", 1, 56).alias("note"))
    stats = known.join(counts, "seed_pos", "left").join(titles, "seed", "left").select("seed_pos", "doi", F.coalesce("n_backward", F.lit(0)).alias("n_backward"), F.coalesce("n_forward", F.lit(0)).alias("n_forward"), F.when(F.col("seed").isNull(), "not found").otherwise(F.col("note")).alias("note"))
    return items, stats


def relations(edges: DataFrame, relation: str, number: int, size: int, related: DataFrame | None = None) -> DataFrame:
    """Page `number` of each work's list for a relation: (id, other, total, pages). RELATED_WORKS needs a table (id, other)."""
    if relation not in RELATIONS:
        raise ValueError(f"relation {relation!r} is not one of {', '.join(RELATIONS)}")
    if relation == "RELATED_WORKS":
        if related is None:
            raise ValueError("RELATED_WORKS needs a table of related works")
        pairs = related.select("id", "other")
    else:
        pairs = edges.select(F.col("cited").alias("id"), F.col("citing").alias("other")) if relation == "CITATIONS" else edges.select(F.col("citing").alias("id"), F.col("cited").alias("other"))
    # Partitions in proportion to the pairs, so that a task's memory does not grow with the table. A list is cut in each of its
    # parts first, so that a work with very many others is not one task.
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("other"), F.lit(LIST_PARTS)))
    dealt = dealt.repartition(parts, "id", "_part").dropDuplicates(["id", "_part", "other"])
    totals = dealt.groupBy("id", "_part").agg(F.count("*").alias("total")).repartition(parts, "id").groupBy("id").agg(F.sum("total").alias("total"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("other"))
    size = max(1, min(200, size))
    first = dealt.withColumn("_n", place("id", "_part")).where(F.col("_n") <= number * size).select("id", "other")
    numbered = first.repartition(parts, "id").withColumn("_n", place("id")).where(F.col("_n").between((number - 1) * size + 1, number * size))
    return numbered.drop("_n").join(totals, "id").select("id", "other", "total", F.ceil(F.col("total") / size).alias("pages"))
