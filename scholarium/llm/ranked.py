"""Ranked lexical search: the exact best documents of each query, by the NRA algorithm (Fagin, Lotem and Naor 2001) over
impact-sorted lists.

Documents are read once, behind a bit map of the queries' terms, and leave (document, term, occurrences) for terms that a
query has. Impacts are integers from the totals of the whole table. The index is dealt by document into shards of about
SHARD documents; a shard has one list for each term, greatest impact first, so a term that a third of all documents hold
is a list of at most SHARD entries in each. In a shard each query reads its lists from the top, all of them on in turn.
A document that was met has a lower bound, the impacts read, and an upper one, with the next impact of each list in which
it was not met. Documents go when the upper bound is below the k-th lower one, lists are no longer read when no document
waits for them, and reading ends when the bounds of the k best are equal. Of a shard's k best for each query, the k best
of all shards are the result: no list, and no query's documents, are ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm import hashing as H
from scholarium.llm.decontaminate import FILTER_BYTES, fingerprint_filter
from scholarium.llm.frames import materialise, partitions, small

#: Documents of a shard (about, as they are dealt by a hash); queries that a task answers at a time.
SHARD, QUERIES = 8_192, 2_000
#: Entries that each list is read by in the first round; twice as many in each further one.
FIRST = 32
#: An impact is w * (SCALE * tf div (1000 * tf + 8 * m)), m growing from 100 - SLOPE with the length of the document.
SCALE, SLOPE = 1_000_000_000, 90
#: Bytes of the terms: digits, a-z in either case before the lowering, and all of non-ASCII characters.
TERM = H.ALNUM
_ENTRIES = "doc_id long, row long, n long, terms array<struct<term:string,tf:long>>"


def _term_counts(data: np.ndarray, at: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a run of documents: the terms of each with repeats; and of known terms the document, term and occurrences."""
    h, first, end, doc = H.words(data, at, TERM)
    counts = np.bincount(doc, minlength=len(at) - 1)
    if known is not None:
        some = np.flatnonzero(known.has(h))
        h, first, end, doc = h[some], first[some], end[some], doc[some]
    number = H.exact_words(data, at, h, first, end).astype(np.int64)
    _, index, number = np.unique(number, return_index=True, return_inverse=True)
    texts = pa.array([H.LOWER[data[at[0] + a : at[0] + b]].tobytes().decode("utf-8", "replace") for a, b in zip(first[index].tolist(), end[index].tolist(), strict=True)], pa.string())
    pairs, tf = np.unique(doc * max(1, len(index)) + number, return_counts=True)
    of, term = np.divmod(pairs, max(1, len(index)))
    return counts, of, texts.take(pa.array(term)), tf.astype(np.int64)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (item_id, term, fingerprint, n) of the queries; n is 1, the words of a term."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            for a, b in H.runs(at):
                _, of, words, _ = _term_counts(data, at[a : b + 1], None)
                text, ends = H.utf8(words)
                prints = H.hashes(text[ends[0] :], ends[:-1] - ends[0], np.diff(ends)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + of)), words, pa.array(prints), pa.array(np.ones(len(of), np.int32))], names=["item_id", "term", "fingerprint", "n"])

    kind = queries.schema["item_id"].dataType.simpleString()
    return queries.select("item_id", F.col("text").cast("string")).where("item_id is not null and text is not null").mapInArrow(terms, f"item_id {kind}, term string, fingerprint long, n int").distinct()


def entries(docs: DataFrame, known) -> DataFrame:
    """Per document (doc_id, row, n, terms): its terms with repeats, and those that a query may have with their
    occurrences. `row` tells rows of one doc_id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # FILTER_BYTES at most
    kind = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            for a, b in H.runs(at):
                counts, of, words, tf = _term_counts(data, at[a : b + 1], shared.value)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(tf)], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts.astype(np.int64)), lists], names=["doc_id", "row", "n", "terms"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(read, _ENTRIES)


def weight(n: Column, df: Column) -> Column:
    """A term's weight among n documents of which df hold it."""
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1))).cast("long")


def impact(tf: Column, n: Column, w: Column, documents: int, words: int) -> Column:
    """What tf occurrences add to the score of a document of n terms, in whole numbers."""
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(100 - SLOPE).cast("long") + div(n * F.lit(SLOPE * documents).cast("long"), F.lit(max(1, words)).cast("long"))
    return w * div(tf * F.lit(SCALE).cast("long"), 1000 * tf + 8 * m)


class Lists:
    """A shard's impact-sorted lists: documents and impacts of list t are those from at[t] to at[t + 1]."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, terms: int):
        order = np.lexsort((doc, -score, term))
        self.doc, self.score = doc[order], score[order]
        self.at = np.searchsorted(term[order], np.arange(terms + 1))
        self.read = 0

    def best(self, wanted: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k documents with the highest sums over the lists `wanted`, above 0, ties to the smaller of `ids`; their sums."""
        wanted = wanted[self.at[wanted + 1] > self.at[wanted]]
        size, place, top = len(ids), self.at[wanted].copy(), self.at[wanted + 1]
        lower, seen, met = np.zeros(size, np.int64), np.zeros((len(wanted), size), bool), np.zeros(size, bool)
        live: np.ndarray | None = None  # documents that may still be among the k, once no others can
        open_, step = np.ones(len(wanted), bool), FIRST
        while open_.any():
            for t in np.flatnonzero(open_).tolist():
                end = min(int(top[t]), int(place[t]) + step)
                docs, scores = self.doc[place[t] : end], self.score[place[t] : end]
                self.read += len(docs)
                lower[docs] += scores  # a document is once in a list
                seen[t, docs] = met[docs] = True
                place[t] = end
            step *= 2
            nexts = np.where(place < top, self.score[np.minimum(place, len(self.score) - 1)], 0)
            some = np.flatnonzero(met) if live is None else live
            upper = lower[some] + nexts.sum() - nexts @ seen[:, some]
            kth = np.partition(lower[some], len(some) - k)[len(some) - k] if len(some) >= k else 0
            if live is not None or (len(some) >= k and nexts.sum() < kth) or not nexts.any():  # what was not met yet stays below
                live = some[upper >= kth]
            # A list is open while it goes on and a document that counts was not met in it.
            open_ = place < top
            if live is not None:
                open_ &= ~seen[:, live].all(1) & (nexts > 0)
        live = np.flatnonzero(met) if live is None else live
        live = live[lower[live] > 0]
        first = live[np.lexsort((ids[live], -lower[live]))][:k]
        return first, lower[first]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, most: int = QUERIES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query (item_id, text) the k documents (doc_id, text) of highest score above
    0, ties to the smaller doc_id.

    Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case; a score sums the impacts of the
    query's terms, once each. Rows without an id are left out, null texts have no terms; queries that repeat an item_id are
    one with the terms of all. Documents that repeat a doc_id count, and are ranked, each for itself (equal ones in any
    order). Texts of any length are read in pieces. An empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = materialise(query_terms(queries))
    n_terms = wanted.count()
    found = materialise(entries(docs, fingerprint_filter(wanted, n_terms, filter_bytes)[1]), tidy=True)
    n_docs, n_words = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    terms = small(materialise(wanted.select("term").distinct()), n_terms)
    occurring = found.select("doc_id", "row", "n", F.explode("terms").alias("t")).select("doc_id", "row", "n", "t.term", "t.tf").join(terms, "term", "left_semi")
    weights = occurring.groupBy("term").agg(F.count("*").alias("df")).select("term", weight(F.lit(n_docs).cast("long"), F.col("df")).alias("w"))
    weights = materialise(weights, tidy=True)
    scored = occurring.join(small(weights, n_terms), "term").select("doc_id", "row", "term", impact(F.col("tf"), F.col("n"), F.col("w"), n_docs, n_words).alias("impact"))
    shards = max(1, -(-found.count() // shard))
    index = scored.where("impact > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    blocks = max(1, -(-wanted.select("item_id").distinct().count() // most))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    best = reduce(DataFrame.unionByName, [_best_of_shards(wanted.where(block == i), index, k, shards) for i in range(blocks)])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _best_of_shards(wanted: DataFrame, index: DataFrame, k: int, shards: int) -> DataFrame:
    """The k best of each shard for a block of queries, whose terms every task gets."""
    spark = index.sparkSession
    rows = wanted.select("item_id", "term").toPandas()  # about QUERIES queries
    names, of = np.unique(rows["term"].to_numpy(str), return_inverse=True)
    items, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    order = np.argsort(item, kind="stable")
    shared = spark.sparkContext.broadcast((items, np.split(of[order], np.searchsorted(item[order], np.arange(1, len(items)))), len(names)))
    number = spark.createDataFrame([(t, i) for i, t in enumerate(names.tolist())], "term string, number int")
    lists = index.join(small(number, len(names)), "term").select("shard", "doc_id", "row", "number", "impact")

    def resolve(table: pa.Table) -> pa.Table:
        items, terms_of, n = shared.value
        row, doc = np.unique(table.column("row").to_numpy(), return_inverse=True)
        ids = np.zeros(len(row), np.int64)
        ids[doc] = table.column("doc_id").to_numpy()
        held = Lists(table.column("number").to_numpy(), doc, table.column("impact").to_numpy(), n)
        out = [held.best(terms, k, ids) for terms in terms_of]
        firsts = np.concatenate([first for first, _ in out])
        return pa.table({"item_id": pa.array(np.repeat(items, [len(first) for first, _ in out])), "doc_id": ids[firsts], "row": row[firsts], "score": np.concatenate([s for _, s in out])})

    kind = wanted.schema["item_id"].dataType.simpleString()
    return lists.repartition(partitions(lists, shards * (8 << 20)), "shard").groupBy("shard").applyInArrow(resolve, f"item_id {kind}, doc_id long, row long, score long")
