"""Near pairs, found in the workers: both sides are dealt to grid cells, and each cell's rows are compared in numpy.

The left rows of a cell are cut into blocks of bounded size, and each block meets the right rows around
it, which come in a stream. So a worker holds one block and one batch whatever a cell holds, blocks of one
crowded cell go to different tasks, and no pair is a row of Spark's before it has been tested. A block's rows are ordered in space
and looked at in groups; what a group's circle or box rules out (or in) isn't compared row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from skyloom.functions.coords import unit
from skyloom.operators.polygons import SLACK, Polygons, boundaries_meet, dots, overlapping

#: Left rows of a cell that one task compares at a time, and of those that are looked at as one.
BLOCK, GROUP = 4096, 64
#: Rows of a batch that goes back to Spark, at least, and pairs that are tested at a time.
BATCH, CHUNK = 32_768, 65_536
#: Cells of at least this side cover the sphere in a bounded number (77,000), which may be broadcast.
WIDE = 1 / 64


# --- dealing rows to blocks --------------------------------------------------------------------------

def meet(left: DataFrame, right: DataFrame, keys: list[str], kernel, schema: StructType, few_cells: bool) -> DataFrame:
    """Run ``kernel`` over the blocks. Both sides have the cell's ``keys``, and else no column in common."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    sizes = F.broadcast(sizes) if few_cells else sizes
    own = [c for c in left.columns if c not in keys]
    a = left.join(sizes, keys).select(*keys, F.pmod(F.xxhash64(*own), F.col("__blocks")).cast("int").alias("__block"), F.lit(0).alias("__side"), *own)
    b = right.join(sizes, keys).select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block")).withColumn("__side", F.lit(1))
    dealt = a.unionByName(b, allowMissingColumns=True).repartition(_parts(left), *keys, "__block").sortWithinPartitions(*keys, "__block", "__side")
    return dealt.mapInArrow(lambda batches: _packed(kernel(keys), batches), schema)


def _parts(df: DataFrame) -> int:
    """Partitions by number, which adaptive execution leaves alone: few bytes here are much work."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def _packed(kernel: Kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small results together, so that Spark doesn't get a batch a group."""
    held, n = [], 0
    for found in kernel.run(batches):
        held.append(found)
        n += found.num_rows
        if n >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=CHUNK)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=CHUNK)


class Kernel:
    """What is done with a block: ``begin`` with its left rows, ``step`` with each part of the right ones, then ``end``."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, open_ = None, [], False
        for batch in batches:
            names = [*self.keys, "__block", "__side"]
            at = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            ends = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(ends, ends[1:], strict=False):
                if low == high:
                    continue
                if (now := tuple(at[:-1, low])) != key:
                    if open_:
                        yield from self.end()
                    key, held, open_ = now, [], False
                part = batch.slice(low, high - low)
                if at[-1, low] == 0:
                    held.append(part)
                else:
                    if not open_:
                        self.cell, open_ = key[:-1], True
                        self.begin(pa.Table.from_batches(held).combine_chunks())
                    yield from self.step(part)
        if open_:
            yield from self.end()

    def begin(self, rows: pa.Table) -> None:
        raise NotImplementedError

    def step(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _numbers(rows, names: list[str]) -> np.ndarray:
    out = []
    for c in names:
        column = rows.column(rows.schema.get_field_index(c))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append(column.to_numpy(zero_copy_only=False).astype(float))
    return np.stack(out)


def _column(rows, name: str) -> pa.Array:
    column = rows.column(rows.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _tiles(*axes: np.ndarray) -> np.ndarray:
    """An order in which GROUP rows that follow each other lie close together: strips along the widest axis, cut along the next."""
    wide = sorted(axes, key=lambda x: -float(np.ptp(x)))[:2]
    strip = GROUP * max(1, round(math.sqrt(len(axes[0]) / GROUP)))
    rank = np.empty(len(axes[0]), np.int64)
    rank[np.argsort(wide[0], kind="stable")] = np.arange(len(rank))
    return np.lexsort((wide[1], rank // strip))


# --- positions on the sphere ---------------------------------------------------------------------------

_STEPS = np.array(list(product((-1, 0, 1), repeat=3))).T


def _around(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str], side: float) -> Iterator[pa.RecordBatch]:
    """Each row once for its own cube cell and each around it that comes within ``side`` of it and meets the sphere.
    In numpy, as the expression would be too long a method for the JVM to compile."""
    for batch in batches:
        v = _numbers(batch, names)
        cell = np.floor(v / side)[:, None, :] + _STEPS[:, :, None]
        low, high = cell * side, (cell + 1) * side
        out, inner, outer = np.maximum(np.maximum(low - v[:, None, :], v[:, None, :] - high), 0.0), np.maximum(np.maximum(low, -high), 0.0), np.maximum(np.abs(low), np.abs(high))
        kept = ((out * out).sum(axis=0) <= side * side * (1 + 1e-9)) & ((inner * inner).sum(axis=0) <= 1 + 1e-9) & ((outer * outer).sum(axis=0) >= 1 - 1e-9)
        step, row = np.nonzero(kept)
        rows = batch.take(pa.array(row))
        found = [pa.array(c.astype(np.int64)) for c in cell[:, step, row]]
        yield pa.RecordBatch.from_arrays([*rows.columns, *found], names=[*batch.schema.names, *keys])


def sphere(left: DataFrame, right: DataFrame, radius: float, kernel, schema: StructType) -> DataFrame:
    """``kernel`` over pairs of rows within ``radius`` degrees. Both need ra and dec, and no other name in common; the
    right side's are ``ra_2`` and ``dec_2``. The kernel's unit vectors are __x.. and __x_2.."""
    side = 2 * math.sin(math.radians(min(radius, 180.0)) / 2) * (1 + 1e-9)
    keys = ["__cx", "__cy", "__cz"]

    def dealt(df: DataFrame, suffix: str, around: bool) -> DataFrame:
        v = [f"__{c}{suffix}" for c in "xyz"]
        placed = df.withColumns(dict(zip(v, unit(F.col(f"ra{suffix}"), F.col(f"dec{suffix}")), strict=True)))
        placed = placed.filter(F.col(v[0]) * F.col(v[0]) + F.col(v[1]) * F.col(v[1]) + F.col(v[2]) * F.col(v[2]) < 2)  # neither null nor NaN
        if not around:
            return placed.withColumns({k: F.floor(F.col(x) / side) for k, x in zip(keys, v, strict=True)})
        schema = StructType([*placed.schema.fields, *[StructField(k, LongType()) for k in keys]])
        return placed.repartition(_parts(df)).mapInArrow(lambda batches: _around(batches, v, keys, side), schema)  # a small file is one task's otherwise

    return meet(dealt(left, "", False), dealt(right, "_2", True), keys, kernel, schema, side >= WIDE)


class SphereKernel(Kernel):
    """``polygons``: "left", "right" or "both" sides have their packed corners in __p and __p_2."""

    polygons = ""

    def __init__(self, keys: list[str], radius: float):
        super().__init__(keys)
        self.radius = radius

    def begin(self, rows: pa.Table) -> None:
        v = _numbers(rows, ["__x", "__y", "__z"])
        order = _tiles(*v)
        self.rows, self.v = rows.take(pa.array(order)), np.ascontiguousarray(v[:, order])
        self.groups = []
        for low in range(0, len(order), GROUP):
            p = self.v[:, low : low + GROUP]
            c = p.sum(axis=1)
            c = c / size if (size := math.sqrt(float(c @ c))) > 1e-9 else p[:, 0]
            chord = math.sqrt(float(((p - c[:, None]) ** 2).sum(axis=0).max()))
            self.groups.append((low, p, c, 2 * math.asin(min(1.0, chord / 2)) + SLACK))
        self.shapes = Polygons.of(_column(self.rows, "__p")) if self.polygons == "both" else None

    def right(self, part: pa.RecordBatch) -> tuple[np.ndarray, Polygons | None]:
        return _numbers(part, ["__x_2", "__y_2", "__z_2"]), Polygons.of(_column(part, "__p_2")) if self.polygons else None

    def reach(self, angle: float) -> float:
        """The dot product at the end of an angle in radians; below -1 beyond a half turn."""
        return math.cos(angle) - 1e-15 if angle < math.pi else -2.0


def degrees_between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(dots(p, q), -1.0, 1.0)))


class Pairs(SphereKernel):
    """Rows of both sides with their distance. ``rising``: only pairs whose left cntr is the lesser.
    ``steps``: polygons must overlap (0) or have one of so many points of each side in the other."""

    def __init__(self, keys: list[str], radius: float, out: list[str], rising: bool, steps: int | None):
        super().__init__(keys, radius)
        self.out, self.rising, self.steps = out, rising, steps
        self.polygons = "" if steps is None else "both"

    def begin(self, rows: pa.Table) -> None:
        super().begin(rows)
        self.ids = _column(self.rows, "cntr").to_numpy(zero_copy_only=False) if self.rising else None
        self.circles = self.shapes.circles(self.v) if self.shapes else None

    def step(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, shapes = self.right(part)
        ids = _column(part, "cntr_2").to_numpy(zero_copy_only=False) if self.rising else None
        circles = shapes.circles(w) if shapes else None
        limit = math.radians(self.radius) + SLACK
        for low, p, c, wide in self.groups:
            near = np.flatnonzero(c @ w >= self.reach(limit + wide))
            each = max(1, CHUNK // p.shape[1])
            for start in range(0, len(near), each):
                some = near[start : start + each]
                hit = p.T @ w[:, some] >= self.reach(limit)
                if self.rising:
                    hit &= self.ids[low : low + p.shape[1], None] < ids[None, some]
                a, b = np.nonzero(hit)
                a, b = a + low, some[b]
                dist = degrees_between(self.v[:, a], w[:, b])
                kept = dist <= self.radius
                if shapes is not None:
                    kept = self._overlap(a, b, dist, kept, shapes, circles)
                a, b, dist = a[kept], b[kept], dist[kept]
                if len(a):
                    yield self._batch(a, b, dist, part)

    def _overlap(self, a, b, dist, kept, shapes, circles) -> np.ndarray:
        angle = np.radians(dist)
        (in_a, far_a), (in_b, far_b) = (x[a] for x in self.circles), (x[b] for x in circles)
        kept &= angle <= far_a + far_b + SLACK
        open_ = kept & ~(angle < in_a + in_b - SLACK) if self.steps == 0 else kept
        k = np.flatnonzero(open_)
        if self.steps == 0:
            kept[k] = overlapping(self.shapes[a[k]], shapes[b[k]], angle[k] / 2 + np.maximum(far_a[k], far_b[k]) < math.pi / 2)
        else:
            kept[k] = boundaries_meet(self.shapes, a[k], shapes, b[k], self.steps)
        return kept

    def _batch(self, a, b, dist, part) -> pa.RecordBatch:
        a, b = pa.array(a), pa.array(b)
        columns = [pa.array(dist) if c == "dist" else _column(part, c).take(b) if c in self.right_names else _column(self.rows, c).take(a) for c in self.out]
        return pa.RecordBatch.from_arrays(columns, names=self.out)


class Best(SphereKernel):
    """For each left row the right one of the best score: the least distance, or with polygons the greatest
    margin (degrees from the nearest edge) of those that hold it. Ties take the least cntr_2."""

    def begin(self, rows: pa.Table) -> None:
        super().begin(rows)
        self.score, self.found = np.full(len(self.rows), -np.inf), None
        self.bound = [-np.inf] * len(self.groups)  # what every row of the group reaches at least, in radians

    def step(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = _column(part, "cntr_2").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        part, ids = part.take(pa.array(order)), ids[order]
        w, shapes = self.right(part)
        if self.found is None:
            self.found = np.empty(len(self.score), ids.dtype)
        limit = math.radians(self.radius)
        for g, (low, p, c, wide) in enumerate(self.groups):
            d = c @ w
            near = np.flatnonzero(d >= self.reach(limit + wide + SLACK))
            if not len(near):
                continue
            if shapes is None:
                s = -np.arccos(np.clip(d[near], -1, 1))
                sure = s
            else:
                s = np.arcsin(np.clip(-shapes[near].height(c), -1, 1))
                sure = np.where(d[near] >= math.cos(max(0.0, limit - wide)), s, -np.inf)
            self.bound[g] = max(self.bound[g], float(sure.max()) - wide - SLACK)
            least = max(self.bound[g], 0.0) if shapes is not None else self.bound[g]
            near = near[s + wide + SLACK >= least]
            each = max(1, CHUNK // p.shape[1])
            for start in range(0, len(near), each):
                self._take(low, p, near[start : start + each], w, shapes, ids)
        return iter(())

    def _take(self, low, p, some, w, shapes, ids) -> None:
        q = p[:, :, None]
        dist = degrees_between(q, w[:, None, some])
        if shapes is None:
            score, good = -dist, dist <= self.radius
        else:
            one = shapes[some]
            one.n = one.n[:, :, None, :]
            score = np.degrees(np.arcsin(np.clip(-one.height(q), -1, 1)))
            good = (dist <= self.radius) & (score >= 0)
        score = np.where(good, score, -np.inf)
        k = score.argmax(axis=1)  # the first of equals has the least id
        value, name = score[np.arange(len(k)), k], ids[some[k]]
        own = slice(low, low + len(k))
        better = value > self.score[own]
        even = np.flatnonzero((value == self.score[own]) & (value > -np.inf))
        better[even] = name[even] < self.found[own][even]
        self.score[own] = np.where(better, value, self.score[own])
        self.found[own] = np.where(better, name, self.found[own])

    def end(self) -> Iterator[pa.RecordBatch]:
        k = np.flatnonzero(self.score > -np.inf)
        if len(k):
            score = self.score[k] + 0.0 if self.polygons else 0.0 - self.score[k]
            yield pa.RecordBatch.from_arrays([_column(self.rows, "cntr").take(pa.array(k)), pa.array(self.found[k]).cast(self.id_type), pa.array(score)], names=["cntr", "found", "score"])


class BestPolygon(Best):
    polygons = "right"


class Counts(SphereKernel):
    """For each left row the number of right ones near it, or with polygons of those that hold it."""

    def begin(self, rows: pa.Table) -> None:
        super().begin(rows)
        self.n = np.zeros(len(self.rows), np.int64)

    def step(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, shapes = self.right(part)
        limit = math.radians(self.radius)
        for low, p, c, wide in self.groups:
            d = c @ w
            near = np.flatnonzero(d >= self.reach(limit + wide + SLACK))
            sure = (d[near] >= math.cos(limit - wide - SLACK)) if limit > wide + SLACK else np.zeros(len(near), bool)
            if shapes is not None:
                top, edge = shapes[near].height(c), math.sin(min(math.pi / 2, wide + SLACK))
                sure &= top < -edge
                near, sure = near[~(top > edge)], sure[~(top > edge)]
            own = slice(low, low + p.shape[1])
            self.n[own] += int(sure.sum())
            near = near[~sure]
            each = max(1, CHUNK // p.shape[1])
            for start in range(0, len(near), each):
                some = near[start : start + each]
                q = p[:, :, None]
                hit = degrees_between(q, w[:, None, some]) <= self.radius
                if shapes is not None:
                    one = shapes[some]
                    one.n, one.total = one.n[:, :, None, :], one.total[:, None, :]
                    hit &= one.holds(q)
                self.n[own] += hit.sum(axis=1)
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        k = np.flatnonzero(self.n)
        if len(k):
            yield pa.RecordBatch.from_arrays([_column(self.rows, "cntr").take(pa.array(k)), pa.array(self.n[k])], names=["cntr", "n"])


class CountPolygons(Counts):
    polygons = "right"


def packed(corners: Column) -> Column:
    """Corners as one list x, y, z, x, y, z..."""
    return F.flatten(F.transform(corners, lambda p: F.array(p["x"], p["y"], p["z"])))


def _suffixed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_2") for c in df.columns])


def pairs(left: DataFrame, right: DataFrame, radius: float, out: list[str] | None = None, rising: bool = False, steps: int | None = None) -> DataFrame:
    """Pairs within ``radius`` degrees: the columns ``out`` of those of ``left``, of ``right`` with the suffix ``_2``,
    and ``dist``. With ``steps`` both have ``corners``."""
    right = _suffixed(right)
    names = [*left.columns, *right.columns, "dist"]
    out = out or names
    fields = {f.name: f for f in (*left.schema.fields, *right.schema.fields)} | {"dist": StructField("dist", DoubleType())}
    schema = StructType([StructField(c, fields[c].dataType) for c in out])
    right_names = set(right.columns)
    if steps is not None:
        left = left.select(*[c for c in left.columns if c != "corners"], packed(F.col("corners")).alias("__p"))
        right = right.select(*[c for c in right.columns if c != "corners_2"], packed(F.col("corners_2")).alias("__p_2"))
    if rising:
        left, right = left.filter("cntr IS NOT NULL"), right.filter("cntr_2 IS NOT NULL")

    def kernel(keys):
        k = Pairs(keys, radius, out, rising, steps)
        k.right_names = right_names
        return k

    return sphere(left, right, radius, kernel, schema)


def best(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(cntr, found, score): the nearest of ``others`` within ``radius``, or where those have ``corners`` the one that
    holds the point farthest from its edge. A cntr that comes more than once has the best of its rows."""
    shaped = "corners" in others.columns
    right = _suffixed(others.select("cntr", "ra", "dec", *(["corners"] if shaped else [])).filter("cntr IS NOT NULL"))
    id_type = right.schema["cntr_2"].dataType
    schema = StructType([StructField("cntr", points.schema["cntr"].dataType), StructField("found", id_type), StructField("score", DoubleType())])
    if shaped:
        right = right.select("cntr_2", "ra_2", "dec_2", packed(F.col("corners_2")).alias("__p_2"))
    arrow = to_arrow_type(id_type)

    def kernel(keys):
        k = (BestPolygon if shaped else Best)(keys, radius)
        k.id_type = arrow
        return k

    found = sphere(points.select("cntr", "ra", "dec"), right, radius, kernel, schema)
    order = F.struct((-F.col("score") if shaped else F.col("score")).alias("s"), "found", "score")
    return found.groupBy("cntr").agg(F.min(order).alias("b")).select("cntr", F.col("b.found").alias("found"), F.col("b.score").alias("score"))


def counts(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(cntr, n): the number of ``others`` within ``radius``, or where those have ``corners`` of those that hold the
    point. Points without any are left out."""
    shaped = "corners" in others.columns
    right = _suffixed(others.select("ra", "dec", *(["corners"] if shaped else [])))
    if shaped:
        right = right.select("ra_2", "dec_2", packed(F.col("corners_2")).alias("__p_2"))
    schema = StructType([StructField("cntr", points.schema["cntr"].dataType), StructField("n", LongType())])
    found = sphere(points.select("cntr", "ra", "dec"), right, radius, lambda keys: (CountPolygons if shaped else Counts)(keys, radius), schema)
    return found.groupBy("cntr").agg(F.sum("n").alias("n"))


# --- rectangles in a plane -----------------------------------------------------------------------------

class Rectangles(Kernel):
    """Pairs (query, id) of rectangles that meet, or where the box lies within the query. The cell that holds the
    greater of their least corners reports a pair."""

    def __init__(self, keys: list[str], side: float, contained: bool):
        super().__init__(keys)
        self.side, self.contained = side, contained

    def begin(self, rows: pa.Table) -> None:
        box = _numbers(rows, ["qx0", "qx1", "qy0", "qy1"])
        order = _tiles(np.nan_to_num(box[0]), np.nan_to_num(box[2]))
        self.rows, self.box = _column(rows, "query").take(pa.array(order)), np.ascontiguousarray(box[:, order])

    def step(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x0, x1, y0, y1 = box = _numbers(part, ["x0", "x1", "y0", "y1"])
        ids = _column(part, "id")
        for low in range(0, self.box.shape[1], GROUP):
            q = self.box[:, low : low + GROUP]
            (a0, a1, b0, b1), (c0, c1, d0, d1) = np.fmin.reduce(q, axis=1), np.fmax.reduce(q, axis=1)
            if self.contained:
                near = np.flatnonzero((x0 >= a0) & (x1 <= c1) & (y0 >= b0) & (y1 <= d1))
            else:
                near = np.flatnonzero((x0 <= c1) & (x1 >= a0) & (y0 <= d1) & (y1 >= b0))
            each = max(1, CHUNK // q.shape[1])
            for start in range(0, len(near), each):
                some = near[start : start + each]
                r = box[:, some]
                (p0, p1, s0, s1), (u0, u1, v0, v1) = q[:, :, None], r[:, None, :]
                hit = (u0 >= p0) & (u1 <= p1) & (v0 >= s0) & (v1 <= s1) if self.contained else (u0 <= p1) & (p0 <= u1) & (v0 <= s1) & (s0 <= v1)
                a, b = np.nonzero(hit)
                first = (np.floor(np.maximum(r[0, b], q[0, a]) / self.side) == self.cell[0]) & (np.floor(np.maximum(r[2, b], q[2, a]) / self.side) == self.cell[1])
                a, b = a[first] + low, some[b[first]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([self.rows.take(pa.array(a)), ids.take(pa.array(b))], names=["query", "id"])


def rectangles(boxes: DataFrame, queries: DataFrame, side: float, contained: bool) -> DataFrame:
    """See :func:`skyloom.operators.resample.rectangle_search`."""
    keys = ["__cx", "__cy"]

    def cells(df: DataFrame, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
        axis = lambda a, b: F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))
        return df.withColumn("__cx", F.explode(axis(x0, x1))).withColumn("__cy", F.explode(axis(y0, y1)))

    sides = ("x0", "x1", "y0", "y1")
    d = lambda c: F.col(c).cast("double")
    q = cells(queries.select(F.col("id").alias("query"), *[d(c).alias("q" + c) for c in sides]), *["q" + c for c in sides])
    b = cells(boxes.select("id", *[d(c).alias(c) for c in sides]), *sides)
    schema = StructType([StructField("query", queries.schema["id"].dataType), StructField("id", boxes.schema["id"].dataType)])
    return meet(q, b, keys, lambda keys: Rectangles(keys, side, contained), schema, False)
