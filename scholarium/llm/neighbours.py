"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: its exact neighbour graph is cut into partitions of equal size with few edges between them, and
a small softmax classifier learns to tell a vector's partition. Index: the classifier names the partition of every
vector. Search: a query goes to its most probable partitions, whose vectors are all compared with it exactly. How many
is found on the sample, as the least number that reaches the wished recall for queries that were kept out of the fit.

There are about n / PER_PARTITION partitions, as far as the sample can show their shape. Equal vectors are one row of the
index, with their least ids. Vectors and queries of a partition are both cut into pieces, every piece of the one meets
every piece of the other, and no task holds more than about PIECE of either at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.llm.frames import materialise

#: Vectors for the fit at most, and bytes of them, as they come to the driver packed; vectors that a partition should have;
#: sampled vectors that show a partition's shape.
SAMPLE, SAMPLE_BYTES, PER_PARTITION, SHAPE = 16_384, 32 << 20, 128, 32
#: Vectors, and queries, that meet in one task at most (about, as they are dealt by a hash).
PIECE = 4096
WISHED = 0.95


def neighbour_graph(x: np.ndarray, k: int, rows: np.ndarray | None = None, block: int = 256) -> np.ndarray:
    """The k nearest others of each row, or of some rows, exactly; a block of rows at a time, which bounds the memory."""
    square, rows = (x * x).sum(1), np.arange(len(x)) if rows is None else rows
    out = np.empty((len(rows), k), np.int64)
    for low in range(0, len(rows), block):
        some = rows[low : low + block]
        d = square[None, :] - 2 * x[some] @ x.T
        d[np.arange(len(d)), some] = np.inf
        out[low : low + block] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Partition of each row, by halving again and again: along the direction that the graph's smoothed coordinates vary
    most in, then by swaps of the pairs that gain most edges within the halves."""
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(seed)
    ends = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for level in range(int(np.log2(parts))):
        halves = np.zeros_like(part)
        for p in range(1 << level):
            rows = np.flatnonzero(part == p)
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            inside = (place[ends[0]] >= 0) & (place[ends[1]] >= 0)
            a, b = place[ends[0][inside]], place[ends[1][inside]]
            smooth = lambda v: np.bincount(a, v[b], len(rows)) + np.bincount(b, v[a], len(rows))  # noqa: E731, B023
            degree = np.maximum(1, smooth(np.ones(len(rows))))
            v = rng.standard_normal(len(rows))
            for _ in range(60):
                v = v - v.mean()
                v = 0.5 * v + 0.5 * smooth(v) / degree
                v /= np.abs(v).max() + 1e-30
            side = np.zeros(len(rows), bool)
            side[np.argsort(v, kind="stable")[len(rows) // 2 :]] = True
            for _ in range(20):
                other = smooth(side.astype(float)), smooth((~side).astype(float))
                gain = np.where(side, other[1] - other[0], other[0] - other[1])
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                n = min(len(left), len(right), max(1, len(rows) // 50))
                good = gain[left[:n]] + gain[right[:n]] > 0
                if not good.any():
                    break
                side[left[:n][good]], side[right[:n][good]] = True, False
            halves[rows] = p * 2 + side
        part = halves
    return part


def fit_classifier(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 300, batch: int = 2048) -> np.ndarray:
    """Weights (and a last row of biases) of a softmax classifier, by Adam over batches of the shuffled rows."""
    rng = np.random.default_rng(3)
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros((z.shape[1], parts), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(z), batch) if len(z) > batch else np.arange(len(z))
        s = z[rows] @ w
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(len(rows)), part[rows]] -= 1
        g = z[rows].T @ s / len(rows) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * 0.99**t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w.astype(np.float64)


class Router:
    """The classifier, the scale of its inputs, and how many partitions a query should see."""

    def __init__(self, sample: np.ndarray, n: int, k: int, wished: float = WISHED):
        parts = 1 << max(0, min(int(np.log2(max(1, n / PER_PARTITION))), int(np.log2(max(1, len(sample) / SHAPE)))))
        self.mean = sample.mean(0, dtype=np.float64) if len(sample) else 0.0
        self.scale = 1.0 / max(1e-30, float(np.abs(sample - self.mean).std())) if len(sample) else 1.0
        self.parts, self.probes, self.weights = parts, parts, None
        if parts == 1:
            return
        x = ((sample - self.mean) * self.scale).astype(np.float32)
        held = np.arange(len(x)) % 8 == 0
        part = balanced_cut(x[~held], neighbour_graph(x[~held], 10), parts)
        self.weights = fit_classifier(x[~held], part, parts)
        queries = np.flatnonzero(held)
        own = np.concatenate([self.order(sample[i : i + 1024])[:, 0] for i in range(0, len(sample), 1024)])
        where = self.order(sample[queries]).astype(np.int32)
        rank = np.empty_like(where)
        np.put_along_axis(rank, where, np.arange(parts, dtype=np.int32)[None, :].repeat(len(queries), 0), 1)
        needed = np.take_along_axis(rank, own[neighbour_graph(x, k, queries)], 1)
        recall = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
        self.probes = int(np.searchsorted(recall, wished) + 1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions by probability, the most probable first."""
        z = (np.asarray(x, np.float64) - self.mean) * self.scale
        return np.argsort(-(z @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def _sampled(points: DataFrame, most: int, width: int) -> np.ndarray:
    """The vectors of `most` points with the least hashes, as single-precision numbers."""

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(batch.column(0)).astype(np.float32).tobytes()], pa.binary())], names=["packed"])

    chosen = points.select("point").orderBy(F.xxhash64("point"), "point").limit(most)  # numbers only
    rows = points.join(F.broadcast(chosen), "point", "left_semi").orderBy("point").select("v").mapInArrow(packed, "packed binary")
    parts = [np.frombuffer(r["packed"], np.float32) for r in rows.toLocalIterator()]
    return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width), np.float32)


def search(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE, wished: float = WISHED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which `queries` holds, by Euclidean
    distance of the original vectors in double precision, ties to the smaller vec_id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id or
    of another length than the most frequent one. Rows that repeat a vec_id are one if equal, else each counts. With k or
    fewer candidates all are given. Other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = materialise(rows.where(F.size("v") == (common["size"] if common else 0)))
    least = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.select("v", "vec_id").withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)  # no more of equal vectors can be among k
    points = materialise(ids.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("point", F.element_at("ids", 1)))
    n = points.count()
    width = common["size"] if common else 1
    router = rows.sparkSession.sparkContext.broadcast(Router(_sampled(points, min(sample, SAMPLE_BYTES // (4 * width)), width), n, k, wished))

    def index(batches):
        for batch in batches:
            part = router.value.order(_matrix(batch.column(1)))[:, 0] if router.value.parts > 1 else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["ids", "v", "part"])

    def route(batches):
        for batch in batches:
            parts = router.value.order(_matrix(batch.column(1)))[:, : router.value.probes] if router.value.parts > 1 else np.zeros((batch.num_rows, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["point", "v", "parts"])

    indexed = materialise(points.select("ids", "v").mapInArrow(index, "ids array<long>, v array<double>, part int"))
    pieces = indexed.groupBy("part").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # a row a partition
    piece = lambda c: F.pmod(F.xxhash64(c), F.col("pieces")).cast("int")
    held = indexed.join(F.broadcast(pieces), "part").select("part", piece("ids").alias("piece"), "ids", "v")
    asked = rows.where("asks").select("v").distinct().join(points.select("v", "point"), "v").select("point", "v").mapInArrow(route, "point long, v array<double>, parts array<int>")
    asked = materialise(asked)
    lots = asked.select(F.explode("parts").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("lots"))  # a row a partition
    met = pieces.join(lots, "part")
    asked = asked.select("point", "v", F.explode("parts").alias("part")).join(F.broadcast(met), "part").withColumn("lot", F.pmod(F.xxhash64("point"), F.col("lots")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    asked = asked.select("part", "piece", "lot", "point", "v")
    held = held.join(F.broadcast(lots), "part").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select("part", "piece", "lot", "ids", "v")

    def nearest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"point": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x, q = _matrix(right.column("v").combine_chunks()), _matrix(left.column("v").combine_chunks())
            ids = right.column("ids").combine_chunks()
            counts, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            owner = np.repeat(np.arange(len(x)), counts)
            points = left.column("point").to_numpy()
            for i in range(len(q)):
                d = x - q[i]
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                close = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                of = np.flatnonzero(np.isin(owner, close))
                of = of[np.lexsort((flat[of], d[owner[of]]))][: k + 1]
                out["point"].append(np.full(len(of), points[i]))
                out["vec_id"].append(flat[of])
                out["score"].append(d[owner[of]])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in out.items()})

    found = asked.groupBy("part", "piece", "lot").cogroup(held.groupBy("part", "piece", "lot")).applyInArrow(nearest, "point long, vec_id long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct().join(points.select("v", "point"), "v").select("query_id", "point").join(lists, "point")
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "c")).select("query_id", (F.col("rank") + 1).alias("rank"), "c.vec_id", "c.score")
