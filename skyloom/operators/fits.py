"""Plane fits, their selection, and the background model that makes neighbouring images agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 20
CLIP = 2.0


def solve3(m: list[list[Column]], r: list[Column]) -> list[Column]:
    """Cramer's rule; null where the matrix is singular."""
    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = det(m)
    parts = [det([[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return [p / F.nullif(whole, F.lit(0.0)) for p in parts]


def plane_round(pix: DataFrame, key: str = "image_id") -> DataFrame:
    """One unclipped least-squares plane by group, from nine sums (a partial aggregate)."""
    x, y, z = F.col("i").cast("double"), F.col("j").cast("double"), F.col("v")
    sums = pix.filter("v IS NOT NULL").groupBy(key).agg(
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x).alias("x"), F.sum(y).alias("y"),
        F.sum(x * z).alias("xz"), F.sum(y * z).alias("yz"), F.sum(z).alias("z"), F.count("*").cast("double").alias("n"),
    )
    c = F.col
    a, b, d = solve3([[c("xx"), c("xy"), c("x")], [c("xy"), c("yy"), c("y")], [c("x"), c("y"), c("n")]], [c("xz"), c("yz"), c("z")])
    return sums.select(key, a.alias("a"), b.alias("b"), d.alias("c"), c("n").cast("long").alias("npixel"))


def clipped_plane(pix: DataFrame, key: str = "image_id", rounds: int = ROUNDS, level_only: bool = False) -> DataFrame:
    """The plane after ``rounds`` fits, each on the pixels within ``CLIP`` rms of the fit before.
    Every round is a partial aggregate of nine sums and a join of one row a group, so no group is
    ever gathered in a task; with more than a few rounds on wide inputs cache ``pix`` first."""
    x, y, z = F.col("i").cast("double"), F.col("j").cast("double"), F.col("v")
    good = pix.filter("v IS NOT NULL").select(key, "i", "j", "v")
    fit = None
    for k in range(rounds):
        use = good if fit is None else good.join(fit, key).filter(F.abs(z - (F.col("a") * x + F.col("b") * y + F.col("c"))) <= CLIP * F.col("rms")).select(key, "i", "j", "v")
        if level_only:
            new = use.groupBy(key).agg(F.avg("v").alias("c")).select(key, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "c")
        else:
            new = plane_round(use, key).drop("npixel")
        left = z - (F.col("a") * x + F.col("b") * y + F.col("c"))
        near = good.join(new, key)
        if fit is not None:
            near = near.join(fit.select(key, F.col("rms").alias("before")), key).filter(F.abs(left) <= CLIP * F.col("before"))
        rms = near.groupBy(key).agg(F.sqrt(F.avg(left * left)).alias("rms"), F.count("*").alias("npixel"))
        fit = new.join(rms, key)
    return fit


def clipped_plane_grouped(pix: DataFrame, key: str = "image_id", rounds: int = ROUNDS) -> DataFrame:
    """As :func:`clipped_plane`, one row for every group: one without a plane (fewer than three pixels, or all in a line)
    has NaN and no pixels, one that loses it by clipping stays at its last fit. By :func:`skyloom.operators.background.clipped_planes`, so no group is held by a task."""
    from skyloom.operators.background import clipped_planes

    found = clipped_planes(pix, [key], rounds, keep=True)
    rows = pix.select(key).distinct().join(found.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return rows.select(key, *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("a", "b", "c", "rms")], F.coalesce("npixel", F.lit(0)).cast("long").alias("npixel"))


def usable_fits(fits: DataFrame, share: float = 0.002) -> DataFrame:
    """Fits whose rms is at most two standard deviations above the mean and whose pixel count is at
    least ``share`` of the mean count."""
    usual = fits.agg(F.avg("rms").alias("m"), F.stddev_pop("rms").alias("s"), F.avg("npixel").alias("area"))
    return fits.crossJoin(F.broadcast(usual)).filter("rms <= m + 2 * s").filter(F.col("npixel") >= share * F.col("area")).drop("m", "s", "area")


def both_ways(fits: DataFrame) -> DataFrame:
    """Each fit once as seen from either image, with the signs turned."""
    turned = fits.select(F.col("minus").alias("plus"), F.col("plus").alias("minus"), *[(-F.col(c)).alias(c) for c in "abc"])
    return fits.select("plus", "minus", "a", "b", "c").unionByName(turned)


def level_corrections(fits: DataFrame, rounds: int) -> DataFrame:
    """(id, c) after ``rounds`` damped Jacobi rounds of the level-only model, as joins: every image
    moves by half the mean of its edges' offsets, then the edges follow. For few rounds; the
    driver-side :func:`solve_corrections` runs thousands on edge lists that fit in memory."""
    edges = both_ways(fits).select("plus", "minus", "c")
    total = edges.select(F.col("plus").alias("id")).distinct().withColumn("c", F.lit(0.0))
    for _ in range(rounds):
        move = edges.groupBy(F.col("plus").alias("id")).agg((F.avg("c") / 2).alias("move"))
        total = total.join(move, "id").select("id", (F.col("c") + F.col("move")).alias("c"))
        a, b = move.select(F.col("id").alias("plus"), F.col("move").alias("p")), move.select(F.col("id").alias("minus"), F.col("move").alias("m"))
        edges = edges.join(a, "plus").join(b, "minus").select("plus", "minus", (F.col("c") - (F.col("p") - F.col("m"))).alias("c"))
    return total


def solve_corrections(fits: pd.DataFrame, rounds: int = 10_000, level_rounds: int = 2_500) -> pd.DataFrame:
    """(id, a, b, c) from an edge table (plus, minus, a, b, c, npixel sums xx..n by edge): level only
    for the first rounds, then full planes. An edge list is as small as images are to pixels;
    callers bound it. Singular images keep their plane."""
    ids = np.unique(np.concatenate([fits["plus"], fits["minus"]]))
    p, q = np.searchsorted(ids, np.concatenate([fits["plus"], fits["minus"]])), np.searchsorted(ids, np.concatenate([fits["minus"], fits["plus"]]))
    sign = np.repeat([1.0, -1.0], len(fits))[:, None]
    d = np.tile(fits[["a", "b", "c"]].to_numpy(float), (2, 1)) * sign
    names = [["xx", "xy", "x"], ["xy", "yy", "y"], ["x", "y", "n"]]
    m = np.tile(np.stack([np.stack([fits[c].to_numpy(float) for c in r], -1) for r in names], -2), (2, 1, 1))
    total, n = np.zeros((len(ids), 3)), len(ids)
    normal = np.zeros((n, 3, 3))
    np.add.at(normal, p, m)
    regular = np.abs(np.linalg.det(normal)) > 1e-12
    level_rounds = level_rounds if rounds >= 5_000 else min(level_rounds, rounds // 2)
    for k in range(rounds):
        right = np.zeros((n, 3))
        np.add.at(right, p, np.einsum("eij,ej->ei", m, d))
        move = np.zeros((n, 3))
        if k < level_rounds:
            move[:, 2] = right[:, 2] / normal[:, 2, 2] / 2
        else:
            move[regular] = np.linalg.solve(normal[regular], right[regular][:, :, None])[:, :, 0] / 2
        total += move
        d -= move[p] - move[q]
        if k >= level_rounds and np.abs(move).max() < 1e-12:
            break
    return pd.DataFrame({"id": ids, "a": total[:, 0], "b": total[:, 1], "c": total[:, 2]})


def apply_corrections(images: DataFrame, corrections: DataFrame) -> DataFrame:
    """Left join; images without a correction get a zero plane and are marked."""
    found = images.join(corrections.withColumnRenamed("id", "image_id"), "image_id", "left")
    return found.select(*images.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "abc"], F.col("c").isNull().alias("no_correction"))
