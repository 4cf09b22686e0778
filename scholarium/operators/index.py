"""An inverted index of texts on disk, and the best texts (BM25) for a table of questions in one job.

Texts are dealt into blocks of about BLOCK by a hash of their id. A posting list is one row for a term and a block: its
texts in order with their counts, and the best that the term adds to a score there. So a term that a third of all texts
have is many rows of bounded size, and what a block can give a question is known without its lists. A block's texts meet in
one task, so that texts are shuffled and lists are not.

A question's best two blocks are scored first; its k-th best score there is a floor. Blocks whose bounds stay below the floor are not
read. In the others terms are taken by their bounds (MaxScore; Turtle and Flood 1995): the least ones that together stay below the floor
make no candidates, they only add to those that the other terms' lists have. Blocks go in rounds, each of which leaves the k best
of every question: what is on the disks at once is in proportion to the index, however many questions there are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.operators.search import K1, B, terms
from scholarium.sources.store import drop, settled, tidy
from scholarium.sources.tables import broadcast_if_small

#: Texts in a block (about); blocks that are scored for a question's floor.
BLOCK, FIRST = 4096, 2
#: Entries of lists that a round scores, once a question; or a quarter of the index's, if that is more.
ROUND = 10_000_000
#: What terms add is counted in whole steps of one over UNITS, so that sums do not depend on their order; then scores are
#: rounded to so many places, by whole numbers of STEP steps, and equal ones are in order of doc_id.
UNITS, PLACES, STEP = 1e12, 9, 1000
_WORD = re.compile("[a-z0-9]+")


def _part(tf: Column | np.ndarray, length: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What tf occurrences add, before the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


def _lists(mean: float, schema: T.StructType):
    """The posting lists of the texts (doc_id, low, block) of a block, in order of terms."""

    def lists(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids, places, which, tf, size, n = rows.column("doc_id").combine_chunks(), {}, [], [], [], []
        for text in rows.column("low"):
            counts = Counter(_WORD.findall(text.as_py()))
            which += [places.setdefault(term, len(places)) for term in counts]
            tf += counts.values()
            size.append(counts.total())
            n.append(len(counts))
        names = sorted(places)
        rank = np.zeros(len(names), np.int64)
        rank[[places[term] for term in names]] = np.arange(len(names))
        which, tf, doc = rank[np.array(which, np.int64)], np.array(tf, np.int32), np.repeat(np.arange(len(n)), n)
        order = np.argsort(which, kind="stable")
        which, tf, doc = which[order], tf[order], doc[order]
        long, first = np.array(size, np.int32)[doc], np.searchsorted(which, np.arange(len(names) + 1))
        best = np.maximum.reduceat(_part(tf, long, mean), first[:-1]) if len(names) else np.zeros(0)
        entries = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(long)], names=["doc_id", "tf", "len"])
        block = pa.array(np.full(len(names), rows.column("block")[0].as_py(), np.int32))
        return pa.table([pa.array(names, pa.string()), block, pa.array(np.diff(first)), pa.array(best), pa.ListArray.from_arrays(pa.array(first, pa.int32()), entries)], names=schema.names)

    return lists


def build_index(documents: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes the index of documents (doc_id, text) to path: `postings`, a block's in order of terms, and one row of `totals`."""
    some = documents.where("doc_id is not null")
    totals = some.select(F.size(terms(F.col("text"))).alias("len")).agg(F.count("*").alias("n_rows"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"))
    totals.write.parquet(f"{path}/totals")
    n_rows, mean = documents.sparkSession.read.parquet(f"{path}/totals").first()
    dealt = some.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n_rows // block)))).cast("int").alias("block"))
    entry = T.StructType([some.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())])
    kinds = {"term": T.StringType(), "block": T.IntegerType(), "n": T.LongType(), "best": T.DoubleType(), "entries": T.ArrayType(entry)}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    with tidy(documents.sparkSession):
        dealt.groupBy("block").applyInArrow(_lists(mean, schema), schema).write.parquet(f"{path}/postings")


def _scored(asked: DataFrame, postings: DataFrame, mean: float) -> DataFrame:
    """(qid, doc_id, part) of asked (qid, term, block, idf) from their lists."""
    met = postings.select("term", "block", "entries").join(broadcast_if_small(asked), ["term", "block"])
    return met.select("qid", "idf", F.explode("entries").alias("e")).select("qid", "e.doc_id", (F.col("idf") * _part(F.col("e.tf"), F.col("e.len"), mean)).alias("part"))


def _whole(parts: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of (qid, doc_id, part)."""
    whole = parts.groupBy("qid", "doc_id").agg(F.sum(F.floor(F.col("part") * UNITS + 0.5).cast("long")).alias("steps"))
    return whole.select("qid", "doc_id", (F.expr(f"(steps + {STEP // 2}) div {STEP}") / 10.0**PLACES).alias("score"))


def search_many(spark: SparkSession, path: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score): the k best texts of the index for each question (qid, text), scores above 0 in places of
    PLACES, equal ones by doc_id. Texts are not read again, lists only of terms that are asked for."""
    with tidy(spark):
        return _search(spark, path, questions, k)


def _search(spark: SparkSession, path: str, questions: DataFrame, k: int) -> DataFrame:
    n_rows, mean = spark.read.parquet(f"{path}/totals").first()
    postings = spark.read.parquet(f"{path}/postings")
    wanted = questions.where("qid is not null").select("qid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    bounds = postings.select("term", "block", "n", "best").join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
    bounds = settled(bounds)
    idf = F.log(1 + (n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = bounds.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf.alias("idf"))
    asked = settled(wanted.join(weights, "term").join(bounds.select("term", "block", "n", "best"), "term").select("qid", "term", "block", "n", "idf", (F.col("idf") * F.col("best")).alias("bound")))

    reach = settled(asked.groupBy("qid", "block").agg(F.sum("bound").alias("reach")))
    top = reach.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("reach"), "block"))).where(F.col("_n") <= FIRST).select("qid", "block")
    best = lambda rows, n: rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= n)
    first = settled(best(_whole(_scored(asked.join(top, ["qid", "block"]).drop("bound"), postings, mean)), k).drop("rank"))
    floor = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))

    # Blocks that may still have one of the k best, and their terms by their bounds, the least first.
    open_ = reach.join(top, ["qid", "block"], "left_anti").join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 10.0 ** (1 - PLACES))
    open_ = open_.where(F.col("reach") >= F.col("floor")).select("qid", "block", "floor")
    below = Window.partitionBy("qid", "block").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    left = settled(asked.join(open_, ["qid", "block"]).withColumn("leads", F.sum("bound").over(below) >= F.col("floor")))
    n_blocks, all_ = postings.agg(F.max("block") + 1, F.sum("n")).first()
    rounds = max(1, min(n_blocks or 1, -(-(left.agg(F.sum("n")).first()[0] or 0) // max(ROUND, (all_ or 0) // 4))))
    found = first
    for r in range(rounds):
        here = F.col("block").between(r * (n_blocks or 1) // rounds, (r + 1) * (n_blocks or 1) // rounds - 1)
        lists, asks = postings.where(here), left.where(here)
        leading = settled(_scored(asks.where("leads").select("qid", "term", "block", "idf"), lists, mean))
        adding = _scored(asks.where("not leads").select("qid", "term", "block", "idf"), lists, mean).join(leading.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
        found = found.unionByName(settled(best(_whole(leading.unionByName(adding)).where("score > 0"), k).drop("rank")))
        drop(leading)
    return settled(best(found.where("score > 0"), k).select("qid", "rank", "doc_id", "score"))
