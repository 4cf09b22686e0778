"""Which fingerprints occur in two documents or more, found with one shuffle of packed arrays.

A task first looks at its own documents: a key that several of them share is known to be shared, so only one note of it
travels, however many documents have it; the rest of its occurrences are passed on as they are. What occurs once in a
batch travels to the bucket of its key, where the batches' notes meet. So a key that a third of all documents share
costs one note a batch there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PACKED = "bucket int, keys binary, docs binary, known binary, own_keys binary, own_docs binary"


def distinct_pairs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key, and which of them have a key of several documents."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    if len(keys):
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[fresh], docs[fresh]
    twin = np.zeros(len(keys), bool)
    if len(keys) > 1:
        same = keys[1:] == keys[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    return keys, docs, twin


def shared_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(doc_id, key) for every key that at least two different doc_id have.

    rows: what keys_of takes in Arrow batches; it returns the keys (uint64) and each key's doc_id (int64).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, twin = distinct_pairs(*keys_of(batch))
            own_keys, own_docs = keys[twin], docs[twin]
            keys, docs, known = keys[~twin], docs[~twin], np.unique(own_keys)
            place = lambda k: ((k >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            spread = (np.arange(len(own_keys)) // 4096 + int(keys[0] % np.uint64(buckets) if len(keys) else 0)) % buckets
            out = {}
            for name, where, values in (("keys", place(keys), keys), ("docs", place(keys), docs), ("known", place(known), known), ("own_keys", spread, own_keys), ("own_docs", spread, own_docs)):
                order = np.lexsort((docs, where)) if name in ("keys", "docs") else np.argsort(where, kind="stable")
                ends = np.cumsum(np.bincount(where, minlength=buckets))
                out[name] = [x.tobytes() for x in np.split(values[order], ends[:-1])]
            used = [i for i in range(buckets) if any(out[n][i] for n in out)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array([out[n][i] for i in used], pa.binary()) for n in out], names=["bucket", *out])

    def meet(table: pa.Table) -> pa.Table:
        part = {n: np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64 if "docs" in n else np.uint64) for n in table.column_names if n != "bucket"}
        keys, docs, twin = distinct_pairs(part["keys"], part["docs"])
        twin |= np.isin(keys, part["known"])
        return pa.table({"doc_id": np.concatenate([docs[twin], part["own_docs"]]), "key": np.concatenate([keys[twin], part["own_keys"]]).view(np.int64)})

    return rows.mapInArrow(pack, _PACKED).groupBy("bucket").applyInArrow(meet, "doc_id long, key long")
