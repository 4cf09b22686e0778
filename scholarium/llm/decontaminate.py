"""Benchmark decontamination by winnowing.

Every span of `span` words holds `span - k + 1` word k-grams. Its smallest k-gram hash is its fingerprint; a document
that has the span has the same minimum there, so no shared span is missed. Shorter items are one span of their own
length, with a shorter k. Fingerprints of documents are kept if the benchmark has them too, are joined with it, and each
hit is extended to its whole span, compared as text.

Documents are read once, and never shuffled: the executors get a bit map of the benchmark's fingerprints, FILTER_BYTES at
most, and only what passes it leaves a document. The map lets a few too many pass, which the comparison as text removes. A
passage that a third of the documents share costs each of them its own hits only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm import hashing as H
from scholarium.llm.frames import materialise, small

SPAN = 10
#: Bytes of the bit map of the benchmark's fingerprints at most, and bits for each while it is smaller.
FILTER_BYTES, BITS = 64 << 20, 32
_SPANS = "item_id string, n int, fingerprint long, span string"
_HITS = "doc_id long, n_words long, hits array<struct<start:int,n:int,fingerprint:long,span:string>>"


def _k(n: int, span: int) -> int:
    return max(1, (n + 1) // 2) if n < span else (span + 1) // 2


def _text(data: np.ndarray, first: np.ndarray, end: np.ndarray, i: int, n: int) -> str:
    return b" ".join(H.LOWER[data[first[j] : end[j]]].tobytes() for j in range(i, i + n)).decode("utf-8", "replace")


def _minima(h: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each span of n words, and which spans lie in one document."""
    least = H.sliding_min(H.grams(h, k), n - k + 1)
    return least, doc[: len(least)] == doc[n - 1 : n - 1 + len(least)]


class _Filter:
    """A bit map of fingerprints, two bits each."""

    def __init__(self, n: int, most: int):
        self.bits = np.zeros(max(8, min(most, -(-n * BITS // 8))), np.uint8)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for factor in (50, 51):
            yield (H.mix(h * H.FACTORS[factor]) % H.U(len(self.bits) * 8)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in self._places(h):
            found &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found


def fingerprint_filter(spans: DataFrame, n: int, most: int = FILTER_BYTES) -> tuple[list[int], _Filter]:
    """The lengths of spans in use, and the filter of their fingerprints. They come to the driver packed, a partition at a
    time, and only their bits stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([np.unique(batch.column(1).to_numpy()).tolist()], pa.list_(pa.int32()))], names=["packed", "lengths"])

    lengths: set[int] = set()
    out = _Filter(n, most)
    for row in spans.select("fingerprint", "n").mapInArrow(pack, "packed binary, lengths array<int>").toLocalIterator():
        out.add(np.frombuffer(row.packed, np.uint64))
        lengths.update(row.lengths)
    return sorted(lengths), out


def benchmark_spans(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """Every distinct span of each item: item_id, n (its words), fingerprint, span (its words, one space between)."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for a, b in H.runs(at):
                h, first, end, doc = H.words(data, at[a : b + 1], H.ALNUM)
                counts = np.bincount(doc, minlength=b - a)
                for n in np.unique(np.minimum(counts[counts > 0], span)).tolist():
                    least, same = _minima(h, doc, n, _k(n, span))
                    same &= np.minimum(counts, span)[doc[: len(least)]] == n
                    for i in np.flatnonzero(same).tolist():
                        rows.append((ids[a + doc[i]], n, int(least[i].view(np.int64)), _text(data[at[a] :], first, end, i, n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["item_id", "n", "fingerprint", "span"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    return items.mapInArrow(spans, _SPANS).distinct()


def document_hits(docs: DataFrame, lengths: list[int], wanted: _Filter, span: int = SPAN) -> DataFrame:
    """Per document its words, and its spans of these lengths whose fingerprint may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # FILTER_BYTES at most

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b in H.runs(at):
                h, first, end, doc = H.words(data, at[a : b + 1], H.ALNUM)
                counts[a:b] = np.bincount(doc, minlength=b - a)
                firsts = np.searchsorted(doc, np.arange(b - a))
                for n in lengths:
                    least, same = _minima(h, doc, n, _k(n, span))
                    inside = np.flatnonzero(same)
                    for i in inside[known.has(least[inside])].tolist():
                        start = i - int(firsts[doc[i]])
                        found[a + doc[i]].append({"start": start, "n": n, "fingerprint": int(least[i].view(np.int64)), "span": _text(data[at[a] :], first, end, i, n)})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("fingerprint", pa.int64()), ("span", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(found, kind)], names=["doc_id", "n_words", "hits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(hits, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, most: int = FILTER_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of a benchmark span), items (sorted item ids).

    A null or empty text has no words and is clean; so is an empty benchmark. Rows without doc_id are left out; rows that
    repeat a doc_id are one document with the hits of all. Long texts are read in pieces. Other columns are ignored. Items
    without words match nothing.
    """
    spans = materialise(benchmark_spans(benchmark, span))
    n = spans.count()
    hits = materialise(document_hits(docs, *fingerprint_filter(spans, n, most), span))
    found = hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
    key = ["fingerprint", "n", "span"]
    matches = found.join(small(materialise(spans.select(*key).distinct()), n), key).select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matches.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    items = found.select("doc_id", *key).distinct().join(small(spans, n), key).select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    per_doc = hits.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    return per_doc.join(covered, "doc_id", "left").join(items, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
