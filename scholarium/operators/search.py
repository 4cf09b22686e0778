"""Lexical search (BM25) over papers or chunks, with the document frequencies of the whole table; and TF-IDF vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.operators.papers import best_of_titles, in_years, without_supplements

K1, B = 1.2, 0.75
SORTS = ("relevance", "citations")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def bm25(rows: DataFrame, query: str, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, score) of rows that share a term with the query, with columns named in `also`. Nothing of a row is shuffled:
    the totals are one row, which is broadcast."""
    wanted = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    listed = rows.select(key, *also, terms(F.col(text)).alias("t"))
    totals = listed.agg(F.count("*").alias("n_rows"), F.avg(F.size("t")).alias("mean"), *[F.count_if(F.array_contains("t", w)).alias(f"df{i}") for i, w in enumerate(wanted)])
    scored = listed.select(key, *also, F.size("t").alias("len"), *[_times("t", w).alias(f"tf{i}") for i, w in enumerate(wanted)]).join(F.broadcast(totals))
    part = lambda i: F.log(1 + (F.col("n_rows") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    score = sum((part(i) for i in range(1, len(wanted))), part(0)) if wanted else F.lit(0.0)
    return scored.select(key, *also, score.alias("score")).where("score > 0")


def _times(column: str, word: str) -> Column:
    return F.size(F.filter(column, lambda t: t == word))


def search_papers(papers: DataFrame, query: str, limit: int = 25, prefer: str = "relevance", first: int | None = None, last: int | None = None, keep_supplements: bool = False) -> DataFrame:
    """Papers (pos, title, abstract, doi, venue, citations, year ...) of the years first..last that share a term with the
    query, by relevance, by citations, or with influence ('impact') or freshness ('fresh') boosted. Supplements go, of one
    title's records the best stays at the place of the first, then `limit` (held to 1..200) cuts. The boosts are this
    library's own: log of citations, and a year's decay."""
    papers = in_years(papers, first, last)
    scored = papers.join(bm25(papers.withColumn("_t", F.concat_ws(" ", "title", "abstract")), query, "_t", "pos"), "pos")
    if prefer == "impact":
        scored = scored.withColumn("score", F.col("score") * (1 + F.log1p(F.coalesce("citations", F.lit(0)).cast("double")) / 10))
    elif prefer == "fresh":
        newest = papers.agg(F.max("year").alias("_newest"))
        scored = scored.join(F.broadcast(newest)).withColumn("score", F.col("score") * F.exp(-(F.col("_newest") - F.coalesce("year", F.col("_newest") - 30)) / 15.0)).drop("_newest")
    elif prefer not in SORTS:
        raise ValueError(f"prefer {prefer!r} is not relevance, citations, impact or fresh")
    place = F.struct(*(["citations", "score"] if prefer == "citations" else ["score"]), (-F.col("pos")).alias("p"))
    best = best_of_titles(without_supplements(scored, keep_supplements), place)
    return best.orderBy(F.desc("_place")).limit(max(1, min(200, limit))).drop("_place")


def ask_evidence(chunks: DataFrame, question: str, top_k: int = 10, year_from: int | None = None) -> DataFrame:
    """(doc_id, n, chunk, score): the best chunks for a question, top_k held to 1..100. With year_from, only of documents
    of that year or later; chunks then has a column year."""
    found = bm25(in_years(chunks, year_from), question, "chunk", "doc_id", ("n", "chunk"))
    return found.orderBy(F.desc("score"), "doc_id", "n").limit(max(1, min(100, top_k))).select("doc_id", "n", "score", "chunk")


def vectorise(rows: DataFrame, text: str, size: int = 4096) -> DataFrame:
    """rows with `vec`, the TF-IDF vector of the text in `size` hashed dimensions, of length 1."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern="[^a-z0-9]+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n")]
    done = Pipeline(stages=stages).fit(rows).transform(rows)
    return done.withColumn("vec", vector_to_array("_n", "float32")).drop("_w", "_tf", "_idf", "_n")
