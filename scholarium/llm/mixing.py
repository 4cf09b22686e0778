"""Mixing sources to target weights by Poisson replication.

A source with target share w and n of N documents is wanted N*w/n times over. Each document is taken as often as a
Poisson variable with that mean says, whose value is the inverse distribution function of a uniform number hashed from
the seed and doc_id: no state, no draw order, and a lost task repeats itself exactly. A mean above `PIECE` is split into
equal parts with one uniform number each (sums of Poisson variables are Poisson), so tables of the distribution stay
short for every mean.

The tables, one a source, are broadcast if a count shows that they are few; else they are written first, so that the join
has a plain shuffle on either side and Spark can split a source that has a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise, small

PIECE = 16.0
#: P(X > TERMS) is under 1e-45 for a mean of PIECE, far below the 2**-52 steps of the uniform numbers.
TERMS = 100


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, n, rate): the mean number of times that each document of the source is wanted.

    weights: (source, weight), relative; a source without one has weight 1, a negative one counts as 0.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy("source").agg(F.max("weight").cast("double").alias("weight")).withColumnRenamed("source", "of")
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("weight", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(1.0))))
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))  # one row
    return sizes.join(F.broadcast(total)).select("source", "n", F.coalesce(F.col("all_n") * F.col("weight") / F.expr("nullif(all_weight, 0)") / F.col("n"), F.lit(0.0)).alias("rate"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, few: int = 10_000) -> DataFrame:
    """docs with each row as often as its source's rate asks, with `copy` (from 1) and `shuffle_key`, shuffled globally.

    The order is that of shuffle_key, an MD5 of seed, doc_id and copy: rows go to partitions by it and are sorted by it
    there, so every partition is a uniform sample of the mixture. A null source is a source of its own; a null doc_id is
    hashed as an empty one; rows that repeat a doc_id get the same count and key. Empty tables stay empty. Columns of
    docs named copy or shuffle_key are replaced. Texts are not looked at, however long. Tables of at most `few` sources are
    broadcast.
    """
    docs = docs.drop("copy", "shuffle_key")
    per_source = rates(docs, weights)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE))
    mean = F.col("rate") / pieces
    log_factorial = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    mass = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.when(mean > 0, F.exp(k * F.log(mean) - mean - log_factorial(k))).otherwise(F.when(k == 0, 1.0).otherwise(0.0)))
    table = per_source.withColumn("_mass", mass).select(
        F.col("source").alias("_source"), pieces.cast("int").alias("_pieces"), F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.aggregate(F.slice("_mass", 1, k + 1), F.lit(0.0), lambda a, x: a + x)).alias("_below")
    )
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # one number a piece, each computed once, outside the search of the table
    numbers = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda j: uniform(F.lit(str(seed)), doc, j.cast("string")))
    count = F.aggregate("_numbers", F.lit(0), lambda a, u: a + F.size(F.filter("_below", lambda b: b <= u)))
    table = materialise(table)
    drawn = docs.join(small(table, limit=few), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_numbers", F.explode(F.array(numbers)))
    counted = drawn.withColumn("_count", F.explode(F.array(count))).where("_count > 0").drop("_source", "_pieces", "_below", "_numbers")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count")
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), doc, F.col("copy").cast("string"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
