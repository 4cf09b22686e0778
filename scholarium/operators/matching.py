"""Candidates against a library: exact keys, nearest vectors, a topic, and near-certain duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions import scores
from scholarium.functions import text as tx
from scholarium.operators.vectors import nearest
from scholarium.sources.tables import broadcast_if_small

DUPLICATE, STRONG = 0.92, 0.75


def _hashed(key: Column) -> Column:
    """128 bits of a key, in hexadecimal digits; an empty key has none."""
    return F.when(key != "", F.substring(F.sha2(key, 256), 1, 32))


def library_keys(library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct DOI keys and distinct title keys, empty ones apart, hashed: a title may be as long as it likes."""
    dois = library.select(_hashed(tx.doi_key(F.col("doi"))).alias("_doi")).where("_doi is not null").distinct()
    titles = library.select(_hashed(tx.title_key(F.col("title"))).alias("_title")).where("_title is not null").distinct()
    return dois, titles


def _marked(papers: DataFrame, dois: DataFrame, titles: DataFrame) -> DataFrame:
    keyed = papers.withColumns({"_doi_key": _hashed(tx.doi_key(F.col("doi"))), "_title_key": _hashed(tx.title_key(F.col("title")))})
    keyed = keyed.join(dois.withColumn("_d", F.lit(True)), F.col("_doi_key") == F.col("_doi"), "left")
    keyed = keyed.join(titles.withColumn("_t", F.lit(True)), F.col("_title_key") == F.col("_title"), "left")
    return keyed.withColumn("status", F.when(F.col("_d") | F.col("_t"), "have").otherwise("new")).drop("_doi_key", "_title_key", "_doi", "_title", "_d", "_t")


def exact_match(papers: DataFrame, library: DataFrame) -> DataFrame:
    """papers with `status`: 'have' if the library has the DOI or the title, else 'new'. Keys are distinct, so no row multiplies."""
    dois, titles = library_keys(library)
    return _marked(papers, broadcast_if_small(dois), broadcast_if_small(titles))


def keep_library(library: DataFrame, name: str, buckets: int = 64) -> None:
    """Keeps the keys of a library as bucketed tables NAME_dois and NAME_titles, each file sorted, so that whatever is
    matched with them later shuffles its own rows only."""
    for keys, kind in zip(library_keys(library), ("doi", "title"), strict=True):
        keys.repartition(buckets, f"_{kind}").write.mode("overwrite").bucketBy(buckets, f"_{kind}").sortBy(f"_{kind}").saveAsTable(f"{name}_{kind}s")


def match_kept(papers: DataFrame, name: str) -> DataFrame:
    """As exact_match, with a library that keep_library has kept. The library is neither shuffled nor counted."""
    spark = papers.sparkSession
    return _marked(papers, spark.table(f"{name}_dois"), spark.table(f"{name}_titles"))


def in_library(discovered: DataFrame, library: DataFrame) -> DataFrame:
    """Discovery rows (title, doi ...) with `in_library`: whether the library has the title, or the DOI in any case, whose
    white space counts."""
    titles = library_keys(library)[1].withColumn("_t", F.lit(True))
    dois = library.select(_hashed(F.lower(tx.text_or_empty(F.col("doi")))).alias("_doi")).where("_doi is not null").distinct().withColumn("_d", F.lit(True))
    keyed = discovered.withColumns({"_title_key": _hashed(tx.title_key(F.col("title"))), "_doi_key": _hashed(F.lower(tx.text_or_empty(F.col("doi"))))})
    keyed = keyed.join(broadcast_if_small(titles), F.col("_title_key") == F.col("_title"), "left").join(broadcast_if_small(dois), F.col("_doi_key") == F.col("_doi"), "left")
    return keyed.withColumn("in_library", F.coalesce(F.col("_t") | F.col("_d"), F.col("_t"), F.col("_d"), F.lit(False))).drop("_title_key", "_doi_key", "_title", "_doi", "_t", "_d")


def with_topic(candidates: DataFrame, topic: DataFrame) -> DataFrame:
    """candidates with topic_sim, the cosine with the one vector of topic."""
    return candidates.join(F.broadcast(topic.select(F.col("vec").alias("_topic")).limit(1))).withColumn("topic_sim", scores.cosine(F.col("vec"), F.col("_topic"))).drop("_topic")


def likely(status: Column, sim: Column, title: Column, nearest_title: Column, threshold: float = DUPLICATE) -> Column:
    """Still new, very near, and the titles contain each other or share most four-letter pieces."""
    a, b = tx.title_key(title), tx.title_key(nearest_title)
    return (status == "new") & (sim >= threshold) & (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (tx.overlap(a, b) > 0.8))


def match_many(papers: DataFrame, library: DataFrame, collection: DataFrame | None = None, topic: DataFrame | None = None, threshold: float = DUPLICATE) -> DataFrame:
    """papers (pos, title, doi, vec) with status, lib_sim, topic_sim, relevance and nearest; without a collection only the
    exact layer is filled in."""
    exact = exact_match(papers, library)
    if collection is None:
        return exact.withColumns({"lib_sim": F.lit(None).cast("double"), "topic_sim": F.lit(None).cast("double"), "relevance": F.lit(None).cast("double"), "nearest": F.lit(None).cast("struct<title:string,sim:double>")})
    near = nearest(papers, collection, 1).join(collection.select("id", F.col("title").alias("_near")), "id").select("pos", "sim", "_near")
    both = exact.join(near, "pos", "left")
    both = with_topic(both, topic) if topic is not None else both.withColumn("topic_sim", F.lit(None).cast("double"))
    lib = scores.library_similarity(F.col("sim"))
    status = F.when(likely(F.col("status"), F.col("sim"), F.col("title"), F.col("_near"), threshold), "likely").otherwise(F.col("status"))
    done = both.withColumns({"status": status, "lib_sim": lib, "relevance": scores.relevance(lib, F.col("topic_sim")), "nearest": F.when(F.col("sim").isNotNull(), F.struct(F.substring("_near", 1, 70).alias("title"), lib.alias("sim")))})
    return done.withColumn("topic_sim", F.bround("topic_sim", 3)).drop("sim", "_near")


def pick_seeds(chunks: DataFrame, topic: DataFrame, n: int = 4) -> DataFrame:
    """(doi, title, sim): of the max(20, 6n) chunks (id, doi, title, vec) nearest to the topic, the best n different DOIs."""
    sim = with_topic(chunks, topic).withColumn("_doi", tx.doi_key(F.col("doi")))
    close = sim.orderBy(F.desc("topic_sim"), "id").limit(max(20, 6 * n)).where("_doi <> ''")
    best = close.groupBy("_doi").agg(F.max_by(F.struct("title", "topic_sim", "id"), F.struct(F.col("topic_sim"), -F.col("id"))).alias("b"))
    return best.orderBy(F.desc("b.topic_sim"), "b.id").limit(n).select(F.col("_doi").alias("doi"), F.substring("b.title", 1, 70).alias("title"), F.bround("b.topic_sim", 3).alias("sim"))
