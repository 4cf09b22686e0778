"""Routing over clustered vectors: fewer than half of the partitions are asked, and most neighbours found."""

import numpy as np
from pyspark.sql import functions as F

from scholarium.llm import neighbours


def clustered(seed, clusters, size, width):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width)) * 3
    return np.vstack([centres[i % clusters] + rng.standard_normal(width) for i in range(clusters * size)])


def test_routing_leaves_out_partitions(spark):
    x = clustered(8, 32, 128, 16)
    router = neighbours.Router(x.astype(np.float32), len(x), 10)
    assert router.parts == 32 and router.probes < router.parts / 2
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 40 == 0, 10).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, ids in found.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(ids) & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 103 and hits >= 0.9 * 10 * len(found)


def test_of_equally_frequent_lengths_the_shorter_counts(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(table, F.col("vec_id") > 0, 10).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 4 * 16 * 300)
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(clustered(2, 4, 200, 16))], "point long, v array<double>")
    got = neighbours._sampled(points, min(neighbours.SAMPLE, neighbours.SAMPLE_BYTES // (4 * 16)), 16)
    assert got.shape == (300, 16) and got.dtype == np.float32
