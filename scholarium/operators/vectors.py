"""Nearest vectors by cosine: an exact join that leaves out what pivots show to be too far away.

Vectors are compared by direction, so distances are those of unit vectors, a metric. Some rows are pivots, about the square
root of their number; every row belongs to the cell of its nearest pivot. How far rows are from their pivots, counted in
steps of a distance, gives each candidate a distance within which its n nearest must lie: rows of a cell are no farther
than the pivot is, and than they are from the pivot. By the same triangle inequality a candidate goes only to cells, and
there only meets rows, that may be within that distance.

Pivots are bounded (PIVOTS, PIVOT_BYTES) and with their counts travel as one row. Cells are packed into groups of about
`most` rows, a cell with more is cut into several. A task has the rows of one group and up to ASKED candidates that go there: cell by
cell a matrix product finds what may be among a candidate's n nearest, and only these are scored, term by term as
`scores.dot` adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.functions import scores

#: Pivots at most, and bytes of them; steps that distances from a pivot (0 to 2) are counted in.
PIVOTS, PIVOT_BYTES, STEPS = 1024, 16 << 20, 64
#: Distances are compared with so much to spare, for what is lost in rounding.
SPARE = 1e-6
#: Candidates that a task has at most (about), and numbers of a matrix product.
ASKED, PRODUCT = 32_768, 1 << 21


def _directed(rows: DataFrame, key: str) -> DataFrame:
    """(key, vec, norm, unit): unit is null for a vector without a direction (null, zero, or a part of it null or not finite)."""
    normed = rows.select(F.col(key), "vec", scores.norm(F.col("vec")).alias("norm"))
    usable = (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    return normed.withColumn("unit", F.when(usable, F.transform("vec", lambda x: x.cast("double") / F.col("norm"))))


def _one(rows: DataFrame, key: str) -> Column:
    """0 for every row, which Spark does not know: the key of a hash join with one row."""
    return F.pmod(F.xxhash64(key), F.lit(1))


class Cells:
    """The pivots of a collection (id, vec), and how its rows lie around them."""

    def __init__(self, collection: DataFrame, n: int, most: int):
        self.rows = _directed(collection, "id").where("unit is not null")
        spark = collection.sparkSession
        size = self.rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("unit")), F.lit(1)).alias("width")).first()
        wanted = max(1, min(PIVOTS, math.isqrt(max(0, size["n"] - 1)) + 1, PIVOT_BYTES // (8 * max(1, size["width"]))))
        chosen = self.rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("unit").collect()  # PIVOTS at most
        self.pivots = _matrix([r["unit"] for r in chosen], size["width"])
        placed = self.place(self.rows)
        steps = placed.groupBy("cell", F.floor(F.col("away") * (STEPS / 2)).alias("step")).agg(F.count("*").alias("c"), F.min("away").alias("lo"), F.max("away").alias("hi"))
        shape: dict[int, list] = {}
        for r in sorted(steps.collect(), key=lambda r: (r["cell"], r["step"])):  # PIVOTS * STEPS at most
            shape.setdefault(r["cell"], []).append(r)
        cells, group, held, most = [], 0, 0, max(1, most)
        for cell, parts in sorted(shape.items()):
            near, seen = [], 0
            for r in parts:
                near.append((r["hi"], r["c"]))
                seen += r["c"]
                if seen >= n:
                    break
            total = sum(r["c"] for r in parts)
            if held and held + total > most:
                group, held = group + 1, 0
            pieces = -(-total // most)
            cells.append((cell, chosen[cell]["unit"], parts[0]["lo"], max(r["hi"] for r in parts), list(range(group, group + pieces)), near))
            group, held = (group + pieces, 0) if pieces > 1 else (group, held + total)
        self.groups = spark.createDataFrame([(c[0], c[4]) for c in cells], "cell int, groups array<int>")
        self.names = np.array([c[0] for c in cells], np.int32)
        self.shape = (_matrix([c[1] for c in cells], size["width"]), np.array([c[2] for c in cells]), np.array([c[3] for c in cells]), [c[4] for c in cells], [c[5] for c in cells])

    def place(self, rows: DataFrame) -> DataFrame:
        """rows with the cell of the nearest pivot and how far `away` it is."""
        pivots = self.pivots

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                units = batch.column("unit")
                for a in range(0, len(batch), max(1, PRODUCT // max(1, len(pivots)))):
                    u = _matrix(units[a : a + max(1, PRODUCT // max(1, len(pivots)))], pivots.shape[1])
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (u @ pivots.T)))
                    cell[a : a + len(u)] = d.argmin(axis=1)
                    away[a : a + len(u)] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), batch.column("norm"), pa.array(cell), pa.array(away)], names=["id", "vec", "norm", "cell", "away"])

        kind = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), "norm", "unit")
        fields = [kind.schema["id"], kind.schema["vec"], kind.schema["norm"]]
        return kind.mapInArrow(placed, T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))

    def members(self) -> DataFrame:
        """(id, vec, norm, cell, group, away) of every row that has a direction."""
        piece = F.get("groups", F.pmod(F.xxhash64("id"), F.size("groups")).cast("int"))
        return self.place(self.rows).join(F.broadcast(self.groups), "cell").withColumn("group", piece).drop("groups")

    def visits(self, asked: DataFrame, n: int) -> DataFrame:
        """(pos, vec, norm, group, cells): the groups that each candidate (pos, vec, norm, unit) goes to, and the cells there."""
        pivots, lo, hi, groups, near = self.shape
        step_cell = np.repeat(np.arange(len(near)), [len(x) for x in near])
        step_away, step_count = (np.array([x[k] for c in near for x in c]) for k in (0, 1))
        in_group = {g: np.array([c for c, of in enumerate(groups) if g in of]) for g in sorted({g for of in groups for g in of})}
        names, chunk = self.names, max(1, PRODUCT // max(1, len(step_cell)))

        def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch) if len(near) else 0, chunk):
                    some = batch.slice(at, chunk)
                    away = np.sqrt(np.maximum(0.0, 2 - 2 * (_matrix(some.column("unit"), pivots.shape[1]) @ pivots.T)))
                    reach = away[:, step_cell] + step_away
                    order = np.argsort(reach, axis=1)
                    enough = np.cumsum(step_count[order], axis=1) >= n
                    last = np.take_along_axis(reach, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0]
                    within = np.where(enough.any(axis=1), last, 4.0) + SPARE  # all, if there are fewer than n
                    least = np.maximum(np.maximum(away - hi, lo - away), (away - away.min(axis=1)[:, None]) / 2)
                    open_ = least <= within[:, None]
                    for g, cells in in_group.items():
                        mask = open_[:, cells]
                        who = np.flatnonzero(mask.any(axis=1))
                        ends = np.concatenate([[0], np.cumsum(mask[who].sum(axis=1))]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[cells[np.nonzero(mask[who])[1]]]))
                        kept = [some.column(c).take(pa.array(who)) for c in ("pos", "vec", "norm")]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(who), g, np.int32)), lists], names=["pos", "vec", "norm", "group", "cells"])

        kind = asked.select("pos", F.col("vec").cast("array<double>").alias("vec"), "norm", "unit")
        fields = [kind.schema["pos"], kind.schema["vec"], kind.schema["norm"]]
        return kind.mapInArrow(gone, T.StructType([*fields, T.StructField("group", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors (lists, or an Arrow array of them) as rows of `width` numbers; of a shorter one the rest is 0, of a longer one it goes."""
    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        flat = np.asarray(vectors.flatten().cast(pa.float64()))
        sizes = np.diff(np.asarray(vectors.offsets))
        if len(vectors) and (sizes == width).all():
            return flat.reshape(len(vectors), width)
        ends = np.cumsum(sizes)
        vectors = [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _best(n: int):
    """Of one group's rows (id, vec, norm, cell) the n best for each of its candidates (pos, vec, norm, cells), as (pos, id, sim)."""

    def of_group(rows: pa.Table, asked: pa.Table) -> pa.Table:
        longest = lambda t: max((len(v) for v in t.column("vec").combine_chunks()), default=0)
        width = max(1, longest(rows), longest(asked)) if len(rows) and len(asked) else 1
        if not len(rows) or not len(asked):
            return pa.table({"pos": asked.column("pos")[:0], "id": rows.column("id")[:0], "sim": pa.array([], pa.float64())})
        rows = rows.sort_by("cell")
        b, nb, cell = _matrix(rows.column("vec"), width), np.asarray(rows.column("norm")), np.asarray(rows.column("cell"))
        a, na = _matrix(asked.column("vec"), width), np.asarray(asked.column("norm"))
        cells, begins, counts = np.unique(cell, return_index=True, return_counts=True)
        goes = np.zeros((len(a), len(cells)), bool)
        listed = asked.column("cells").combine_chunks()
        who = np.repeat(np.arange(len(a)), np.diff(np.asarray(listed.offsets)))
        what = np.asarray(listed.flatten())
        at = np.minimum(np.searchsorted(cells, what), len(cells) - 1)
        held = cells[at] == what
        goes[who[held], at[held]] = True
        ua, ub = a / na[:, None], b / nb[:, None]
        out = []
        for lo in range(0, len(a), max(1, PRODUCT // len(b))):
            some = np.arange(lo, min(len(a), lo + max(1, PRODUCT // len(b))))
            near = np.full((len(some), len(b)), -np.inf)
            for k in range(len(cells)):
                go = np.flatnonzero(goes[some, k])
                if len(go):
                    near[go, begins[k] : begins[k] + counts[k]] = ua[some[go]] @ ub[begins[k] : begins[k] + counts[k]].T
            floor = np.partition(near, len(b) - n, axis=1)[:, len(b) - n] if len(b) > n else np.full(len(some), -np.inf)
            i, j = np.nonzero((near >= (floor - SPARE)[:, None]) & (near > -np.inf))
            sim = np.empty(len(i))
            for c in range(0, len(i), max(1, PRODUCT // width)):
                part = slice(c, c + max(1, PRODUCT // width))
                x, y = some[i[part]], j[part]
                sim[part] = np.add.accumulate(a[x] * b[y], axis=1)[:, -1] / (na[x] * nb[y])  # in the order of scores.dot
            out.append((some[i], j, sim))
        x, y, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        place = np.empty(len(b), np.int64)
        place[np.asarray(pc.sort_indices(rows.column("id")))] = np.arange(len(b))
        order = np.lexsort((place[y], -sim, x))
        x, y, sim = x[order], y[order], sim[order]
        first = np.searchsorted(x, x)
        kept = np.arange(len(x)) - first < n
        return pa.table({"pos": asked.column("pos").take(pa.array(x[kept])), "id": rows.column("id").take(pa.array(y[kept])), "sim": sim[kept]})

    return of_group


def compared(candidates: DataFrame, collection: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """(pos, id): the pairs among which each candidate's n nearest are looked for, of candidates and rows that have a direction."""
    cells = Cells(collection, n, most)
    visits = cells.visits(_directed(candidates, "pos").where("unit is not null"), n)
    return visits.select("pos", "group", F.explode("cells").alias("cell")).join(cells.members().select("id", "cell", "group"), ["cell", "group"]).select("pos", "id")


def _scored(candidates: DataFrame, collection: DataFrame, n: int, most: int) -> DataFrame:
    """(pos, id, sim): for each candidate the n best of each group that it goes to."""
    cells, asked = Cells(collection, n, most), _directed(candidates, "pos").where("unit is not null")
    blocks = max(1, -(-asked.count() // ASKED))
    visits = cells.visits(asked, n).withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int"))
    rows = cells.members().select("id", "vec", "norm", "cell", "group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kind = T.StructType([visits.schema["pos"], rows.schema["id"], T.StructField("sim", T.DoubleType())])
    return rows.groupBy("group", "block").cogroup(visits.groupBy("group", "block")).applyInArrow(_best(n), kind)


def nearest(candidates: DataFrame, collection: DataFrame, n: int, most: int = 20_000) -> DataFrame:
    """(pos, id, sim, rank): the n nearest rows of collection (id, vec) for each candidate (pos, vec), by cosine, ties to the
    smaller id; exactly as if all pairs were compared.

    A vector without a direction has a cosine of 0 with every other. Groups have about `most` rows.
    Rows are cut to n a candidate before they are shuffled.
    """
    scored = _scored(candidates, collection, n, most)
    rows, asked = _directed(collection, "id"), _directed(candidates, "pos")
    first = lambda some: F.broadcast(some.select("id").orderBy("id").limit(n).withColumn("one", _one(some, "id")))
    flat = [(asked.where("unit is not null"), first(rows.where("unit is null"))), (asked.where("unit is null"), first(rows))]
    for some, others in flat:
        scored = scored.unionByName(some.join(others, _one(some, "pos") == F.col("one")).select("pos", "id", F.lit(0.0).alias("sim")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= n)
