"""Exact removal of repeated byte strings, by bucket-pointer refinement spread over the cluster.

Suffixes are put into buckets of their first bytes, and buckets that hold one document only are done. The others are refined
by sorting on the identifiers of the buckets that the same suffixes have at a later offset, which gives new identifiers; with
these the step doubles, until LENGTH bytes are told apart. Identifiers are integers, and equal only for equal bytes.

1. Of each LENGTH-byte window only the suffix with the smallest Q-gram fingerprint (its leftmost minimum) is taken; equal
   windows choose equal suffixes, so one suffix in about LENGTH/4 is enough. Four bytes of each travel once, to find the
   Q-gram buckets of several documents; a bit map of these, of bounded size, goes to the executors. It may name a bucket too
   many, which costs time only.
2. A run of windows that chose one suffix is a block. Blocks in such buckets meet, with their bytes, in the task of their
   bucket. A block that an earlier document has too is removed whole. Where a bucket holds different blocks, all suffixes of
   these blocks are refined, and the windows that an earlier document has are removed.
3. A bucket of very many different blocks (a passage that a third of all documents share begins there) is not gathered: its
   windows are dealt one by one, by their own bytes.

What a batch can tell by itself does not travel to one place: at most one message a batch does of equal blocks or windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.llm import hashing as H
from scholarium.llm.frames import materialise, partitions
from scholarium.llm.shared_keys import distinct_pairs

LENGTH = 50
Q = 24
#: Bytes of the bit map at most.
MAP_BYTES = 64 << 20
_LOW = 20
#: Different blocks of a bucket in one batch above which its windows are dealt one by one.
SPREAD = 16
#: Bytes of blocks that are refined at a time (a bucket is not divided).
REFINED = 1 << 19
#: Bytes of documents that a task looks at together.
TOGETHER = 4 << 20
_NOTES = "bucket int, single binary, several binary"
_WINDOWS = "bucket int, hash binary, text binary, doc_id binary, first binary, own_doc_id binary, own_first binary"
_MESSAGES = "bucket int, key binary, doc_id binary, at binary, lone binary, text binary, noted binary, own_doc_id binary, own_at binary"


class _Run:
    """The Q-gram buckets of some documents (or of a piece of one, `base` bytes after its start), and the blocks of windows
    that chose the same suffix."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, q: int, base: int = 0):
        self.at, self.base, self.data = at - at[0], base, data[at[0] : at[-1]]
        self.buckets = H.byte_grams(self.data, q)
        # the leftmost minimum: bucket above, place below, so that one comparison finds both
        place = np.arange(len(self.buckets), dtype=np.uint64) & H.U((1 << _LOW) - 1)
        least = H.sliding_min((self.buckets & ~H.U((1 << _LOW) - 1)) | place, length - q + 1)
        starts = np.arange(len(least))
        chosen = starts + (((least & H.U((1 << _LOW) - 1)).astype(np.int64) - starts) & ((1 << _LOW) - 1))
        doc = np.searchsorted(self.at, starts, "right") - 1
        fits = starts + length <= self.at[doc + 1]
        first = fits.copy()
        first[1:] &= (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(first)
        last = fits.copy()
        last[:-1] &= ~fits[1:] | first[1:]
        self.count = np.flatnonzero(last) - self.first + 1
        self.doc, self.key = doc[self.first], self.buckets[chosen[self.first]]

    def places(self, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Places in the documents of places in the run."""
        return first - self.at[doc] + self.base


def _runs(data: np.ndarray, at: np.ndarray, length: int, q: int) -> Iterator[tuple[int, _Run]]:
    """Runs of documents with the number of their first. A long document comes in pieces, so that what a task holds at a
    time does not grow with it; a block that a cut divides is two blocks, told apart window by window where it matters."""
    for a, b in H.runs(at):
        if at[b] - at[a] <= 2 * H.RUN_BYTES:
            yield a, _Run(data, at[a : b + 1], length, q)
            continue
        for low in range(int(at[a]), int(at[b]), H.RUN_BYTES):
            yield a, _Run(data, np.array([low, min(low + H.RUN_BYTES + length - 1, int(at[b]))]), length, q, low - int(at[a]))


def _gather(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after another."""
    return text[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _packed(parts: dict[str, tuple], buckets: int) -> pa.RecordBatch:
    """A row for each bucket in use; parts: by column, the bucket of each value and the values, or a text with the first
    byte and size of each value's slice."""
    out = {}
    for name, (where, *values) in parts.items():
        order = np.argsort(where, kind="stable")
        rows = np.split(order, np.cumsum(np.bincount(where, minlength=buckets))[:-1])
        out[name] = [(values[0][r] if len(values) == 1 else _gather(values[0], values[1][r], values[2][r])).tobytes() for r in rows]
    used = [i for i in range(buckets) if any(x[i] for x in out.values())]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([x[i] for i in used], pa.binary()) for x in out.values())], names=["bucket", *out])


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


class _Map:
    """A bit map in slices, one for each bucket of keys."""

    def __init__(self, slices: list[tuple[int, bytes]], buckets: int):
        parts = dict(slices)
        self.sizes = np.array([len(parts.get(i) or b"\0") * 8 for i in range(buckets)], np.uint64)
        bits = [np.frombuffer(parts.get(i) or b"\0", np.uint8) for i in range(buckets)]
        self.starts = np.cumsum([0] + [len(x) * 8 for x in bits[:-1]])
        self.bits, self.buckets = np.concatenate(bits), buckets

    @staticmethod
    def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
        return ((keys >> H.U(32)) % H.U(buckets)).astype(np.int64)

    @staticmethod
    def places(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = H.mix(low.astype(np.uint64) + H.FACTORS[59])
        return h >> H.U(32), h & H.U(0xFFFFFFFF)

    @staticmethod
    def slice(low: np.ndarray, most: int) -> bytes:
        bits = np.zeros(min(most, 2 * len(low) + 8), np.uint8)
        for p in _Map.places(low):
            p %= H.U(len(bits) * 8)
            np.bitwise_or.at(bits, (p >> H.U(3)).astype(np.int64), (1 << (p & H.U(7)).astype(np.uint8)).astype(np.uint8))
        return bits.tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        bucket = self.bucket(keys, self.buckets)
        size, start, found = self.sizes[bucket], self.starts[bucket], np.ones(len(keys), bool)
        for part in self.places(keys & H.U(0xFFFFFFFF)):
            p = start + (part % size).astype(np.int64)
            found &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return found


def _refine(key: np.ndarray, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket, block and document; in it, which blocks an earlier document has, and how many different blocks
    the bucket of each has."""
    order = np.lexsort((doc, block, key))
    key, block, doc = key[order], block[order], doc[order]
    other_key = np.ones(len(key), bool)
    other_key[1:] = key[1:] != key[:-1]
    other = other_key.copy()
    other[1:] |= block[1:] != block[:-1]
    if not len(key):
        return order, other, np.zeros(0, np.int64)
    earliest = doc[np.flatnonzero(other)][np.cumsum(other) - 1]
    number = np.cumsum(other_key) - 1
    return order, doc > earliest, np.bincount(number, weights=other)[number].astype(np.int64)


def identifiers(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of slices of so many bytes, one after another in text: the places from which a string of `length` bytes (eight at
    least) lies in its slice and occurs at another such place too, its identifier, and the number of refinements.

    Places begin in the buckets of their next eight bytes. Each round sorts them by (identifier, identifier `step` later),
    which tells twice the bytes apart, and numbers the buckets anew; only places whose bucket, and later bucket, hold
    others too are kept.
    """
    end = np.repeat(np.cumsum(size), size)
    known, rounds = 8, 0
    bucket = np.unique(H.eights(np.concatenate([text, np.zeros(8, np.uint8)]))[: len(text)], return_inverse=True)[1]
    places = np.flatnonzero(end - np.arange(len(text)) >= known)
    while True:
        places = places[np.bincount(bucket[places], minlength=1)[bucket[places]] > 1] if len(places) else places
        if known == length or not len(places):
            return places, bucket[places], rounds
        step = min(known, length - known)
        kept = np.zeros(len(text), bool)
        kept[places] = True
        places = places[end[places] - places >= known + step]
        places = places[kept[places + step]]
        pairs = bucket[places] * (int(bucket.max(initial=0)) + 1) + bucket[places + step]
        bucket = np.zeros(len(text), np.int64)
        bucket[places] = np.unique(pairs, return_inverse=True)[1]
        known, rounds = known + step, rounds + 1


def _windows_gone(text: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of the runs of windows in these blocks that an earlier document has."""
    places, bucket, _ = identifiers(text, size, length)
    row = np.repeat(np.arange(len(size)), size)[places]
    order = np.lexsort((doc[row], bucket))
    first = np.ones(len(order), bool)
    first[1:] = bucket[order][1:] != bucket[order][:-1]
    earliest = np.zeros(len(places), np.int64)
    if len(order):
        earliest[order] = doc[row[order[first]]][np.cumsum(first) - 1]
    gone = doc[row] > earliest
    places, row = places[gone], row[gone]
    begins = np.ones(len(places), bool)
    begins[1:] = (places[1:] != places[:-1] + 1) | (row[1:] != row[:-1])
    runs = np.diff(np.append(np.flatnonzero(begins), len(places)))
    places, row = places[begins], row[begins]
    return doc[row], (at[row] // 256 + places - (np.cumsum(size) - size)[row]) * 256 + runs


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of (doc_id, text ...) in parts of about TOGETHER bytes of text; a longer document is a part of its own."""
    for batch in batches:
        ends, low = np.cumsum(np.diff(H.utf8(batch.column(1))[1])), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, "right")))
            yield batch.slice(low, high - low)
            low = high


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and for each value the number of its list."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def removed_spans(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(doc_id, first, end): byte spans of each document that cover all strings of `length` bytes which also start in a
    document with a smaller doc_id. Spans may overlap. docs: doc_id (not null), text."""

    def suffixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, (data, at) = batch.column(0).to_numpy(), H.utf8(batch.column(1))
        found = [(run.key, ids[a + run.doc]) for a, run in _runs(data, at, length, q)]
        return (np.concatenate([x[i] for x in found]) if found else np.zeros(0, (np.uint64, np.int64)[i]) for i in (0, 1))

    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            keys, _, twin = distinct_pairs(*suffixes(batch))
            single, several = keys[~twin], np.unique(keys[twin])
            yield _packed({"single": (_Map.bucket(single, buckets), single.astype(np.uint32)), "several": (_Map.bucket(several, buckets), several.astype(np.uint32))}, buckets)

    def gather(table: pa.Table) -> pa.Table:
        single = np.sort(_joined(table, "single", np.uint32))
        low = np.union1d(single[1:][single[1:] == single[:-1]], _joined(table, "several", np.uint32))
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "bits": pa.array([_Map.slice(low, max(8, MAP_BYTES // buckets))], pa.binary())})

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in _parts(batches):
            ids, (data, at) = batch.column(0).to_numpy(), H.utf8(batch.column(1))
            found = [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.uint8))]
            for a, run in _runs(data, at, length, q):
                keep = wanted.has(run.key)
                first, size, doc = run.first[keep], run.count[keep] + length - 1, run.doc[keep]
                found.append((run.key[keep], H.hashes(run.data, first, size), ids[a + doc], run.places(first, doc) * 256 + run.count[keep], _gather(run.data, first, size)))
            key, block, doc, place, text = (np.concatenate(x) for x in zip(*found, strict=True))
            size = place % 256 + length - 1
            start = np.cumsum(size) - size
            order, whole, blocks = _refine(key, H.exact_slices(text, block, start, size), doc)
            own, rest, spread = order[whole], order[~whole], blocks[~whole] > SPREAD
            noted = np.unique(key[rest][spread])
            own, by = own[np.lexsort((place[own], doc[own]))], np.lexsort((place[rest], doc[rest]))
            rest, spread = rest[by], spread[by]
            where = _Map.bucket(np.where(spread, H.mix(key[rest] + block[rest]), key[rest]), buckets)
            own_where = np.arange(len(own)) * buckets // max(1, len(own))
            yield _packed({"key": (where, key[rest]), "doc_id": (where, doc[rest]), "at": (where, place[rest]), "lone": (where, ~spread), "text": (where, text, start[rest], size[rest]), "noted": (_Map.bucket(noted, buckets), noted), "own_doc_id": (own_where, doc[own]), "own_at": (own_where, place[own])}, buckets)

    def judge(table: pa.Table) -> pa.Table:
        lone, noted = _joined(table, "lone", np.bool_), _joined(table, "noted", np.uint64)
        key, doc, at, text = (_joined(table, n, t) for n, t in (("key", np.uint64), ("doc_id", np.int64), ("at", np.int64), ("text", np.uint8)))
        size = at % 256 + length - 1
        start = np.cumsum(size) - size
        contested = np.unique(np.concatenate([noted, key[~lone]]))
        order, whole, blocks = _refine(key, H.exact_slices(text, H.hashes(text, start, size), start, size), doc)
        spread = np.isin(key[order], contested)
        gone, open_, mixed = order[whole], order[~whole & spread], order[~whole & ~spread & (blocks > 1)]
        found = [(_joined(table, "own_doc_id", np.int64), _joined(table, "own_at", np.int64)), (doc[gone], at[gone])]
        ends = np.flatnonzero(np.append(key[mixed][1:] != key[mixed][:-1], True)) + 1 if len(mixed) else np.zeros(0, np.int64)
        low, total = 0, np.cumsum(size[mixed])
        while low < len(mixed):  # whole buckets of about REFINED bytes together
            high = int(ends[min(len(ends) - 1, np.searchsorted(total[ends - 1], (total[low - 1] if low else 0) + REFINED))])
            rows = mixed[low:high]
            found.append(_windows_gone(_gather(text, start[rows], size[rows]), size[rows], doc[rows], at[rows], length))
            low = high
        sure = sum(len(f[0]) for f in found)
        found.append((doc[open_], at[open_]))
        return pa.table({"doc_id": np.concatenate([f[0] for f in found]), "at": np.concatenate([f[1] for f in found]), "whole": np.arange(sure + len(open_)) < sure})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, (data, at) = batch.column(0).to_numpy(), H.utf8(batch.column(1))
            firsts, owners = _lists(batch.column(2))
            counts, _ = _lists(batch.column(3))
            lows = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, length), np.uint8))]
            for a, run in _runs(data, at, length, q):
                some = np.arange(lows[a], lows[a + len(run.at) - 1])
                some = some[(firsts[some] >= run.base) & (firsts[some] - run.base + counts[some] - 1 + length <= np.diff(run.at)[owners[some] - a])]
                if not len(some):
                    continue
                count, doc = counts[some], owners[some] - a
                start = np.repeat(firsts[some] - run.base + run.at[doc], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc = np.repeat(doc, count)
                found.append((H.hashes(run.data, start, np.full(len(start), length)), ids[a + doc], run.places(start, doc), np.lib.stride_tricks.sliding_window_view(run.data, length)[start]))
            hash_, doc, first, text = (np.concatenate(x) for x in zip(*found, strict=True))
            order, gone, _ = _refine(hash_, _exact(hash_, text), doc)
            own, rest = order[gone], order[~gone]
            own, rest = own[np.lexsort((first[own], doc[own]))], rest[np.lexsort((first[rest], doc[rest]))]
            where, own_where = _Map.bucket(hash_[rest], buckets), np.arange(len(own)) * buckets // max(1, len(own))
            yield _packed({"hash": (where, hash_[rest]), "text": (where, text[rest]), "doc_id": (where, doc[rest]), "first": (where, first[rest].astype(np.int32)), "own_doc_id": (own_where, doc[own]), "own_first": (own_where, first[own].astype(np.int32))}, buckets)

    def _exact(hash_: np.ndarray, text: np.ndarray) -> np.ndarray:
        return H.exact_slices(text.ravel(), hash_, np.arange(len(hash_)) * length, np.full(len(hash_), length))

    def repeats(table: pa.Table) -> pa.Table:
        hash_, doc, first, text = (_joined(table, n, t) for n, t in (("hash", np.uint64), ("doc_id", np.int64), ("first", np.int32), ("text", np.uint8)))
        order, gone, _ = _refine(hash_, _exact(hash_, text.reshape(-1, length)), doc)
        doc, first = doc[order[gone]], first[order[gone]]
        return pa.table({"doc_id": np.concatenate([doc, _joined(table, "own_doc_id", np.int64)]), "first": np.concatenate([first, _joined(table, "own_first", np.int32)]).astype(np.int64)})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions(docs, size, 12 << 20)
    slices = docs.mapInArrow(notes, _NOTES).groupBy("bucket").applyInArrow(gather, "bucket int, bits binary").collect()  # MAP_BYTES at most
    shared = docs.sparkSession.sparkContext.broadcast(_Map([(r.bucket, bytes(r.bits)) for r in slices], buckets))
    judged = materialise(docs.mapInArrow(messages, _MESSAGES).groupBy("bucket").applyInArrow(judge, "doc_id long, at long, whole boolean"))
    whole = judged.where("whole").select("doc_id", F.shiftright("at", 8).alias("first"), (F.shiftright("at", 8) + F.col("at") % 256 + (length - 1)).alias("end"))
    open_ = judged.where("not whole").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("at")), lambda at: F.struct(F.shiftright(at, 8).alias("first"), (at % 256).alias("windows"))).alias("open"))
    window = docs.join(open_, "doc_id").select("doc_id", "text", F.col("open.first").alias("firsts"), F.col("open.windows").alias("counts")).mapInArrow(windows, _WINDOWS)
    single = window.groupBy("bucket").applyInArrow(repeats, "doc_id long, first long").select("doc_id", "first", (F.col("first") + length).alias("end"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Per document: doc_id, n_bytes, kept (bytes), n_removed, n_spans (maximal removed runs).

    A null text is empty; texts under `length` bytes lose nothing; nothing matches across documents, and strings that
    repeat within one document only stay. Rows without doc_id are left out. Rows that repeat a doc_id are one document to
    the others: none is earlier than the other, and a span found in one is cut out of each that is long enough. Long texts
    are read in pieces. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    spans = removed_spans(docs, length, q).groupBy("doc_id").agg(F.collect_set(F.col("first") * 1024 + F.col("end") - F.col("first")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = H.utf8(batch.column(1))
            spans, owners = _lists(batch.column(2))
            firsts, ends = spans >> 10, (spans >> 10) + (spans & 1023)
            lows = np.searchsorted(owners, np.arange(batch.num_rows + 1))
            kept, removed, n_spans = [], [], []
            for i in range(batch.num_rows):
                text, some = data[at[i] : at[i + 1]], slice(lows[i], lows[i + 1])
                edges = np.zeros(len(text) + 1, np.int32)
                inside = ends[some] <= len(text)  # another row of the doc_id may be longer
                np.add.at(edges, firsts[some][inside], 1)
                np.add.at(edges, ends[some][inside], -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())], names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])

    joined = docs.join(spans, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")
