"""The background model: clipped fits of differences, their selection, relaxation, and the mosaic as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import fits
from skyloom.operators.pixels import coadd, difference, subtract_plane
from skyloom.storage import cut, written

#: Edges whose model is solved on the driver (20 numbers each); a larger graph is relaxed in Spark.
MOST_EDGES = 1_000_000
#: Groups whose fits (five numbers each) are sent to every task; the pixels don't move then.
MOST_SENT = 200_000


def clipped_planes(pix: DataFrame, keys: list[str], rounds: int = fits.ROUNDS, level_only: bool = False, keep: bool = False) -> DataFrame:
    """(keys, a, b, c, rms, npixel) after ``rounds`` fits, each on the pixels within 2 rms of the fit before.
    The pixels are written once, in columns; a round is one partial aggregate of ten sums, as the rms of a plane follows
    from them, and its result, one row a group, is written, so the plan stays the same size. The first round counts the
    groups: up to MOST_SENT, later rounds shuffle their sums only. A group whose pixels
    left have no plane is left out, or with ``keep`` stays at its fit before."""
    x, y, z = F.col("i").cast("double"), F.col("j").cast("double"), F.col("v")
    good = written(pix.filter("v IS NOT NULL").select(*keys, "i", "j", "v"))
    terms = {"xx": x * x, "xy": x * y, "yy": y * y, "x": x, "y": y, "xz": x * z, "yz": y * z, "z": z, "zz": z * z}
    c, fit, few = F.col, None, False
    for _ in range(rounds):
        if fit is None:
            use = good
        else:
            near = F.abs(z - (c("fa") * x + c("fb") * y + c("fc"))) <= fits.CLIP * c("limit")
            known = fit.select(*keys, c("a").alias("fa"), c("b").alias("fb"), c("c").alias("fc"), c("rms").alias("limit"))
            use = good.join(F.broadcast(known) if few else known, keys).filter(near)
        sums = use.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in terms.items()], F.count("*").cast("double").alias("n"))
        if level_only:
            a, b, d = F.lit(0.0), F.lit(0.0), c("z") / c("n")
        else:
            a, b, d = fits.solve3([[c("xx"), c("xy"), c("x")], [c("xy"), c("yy"), c("y")], [c("x"), c("y"), c("n")]], [c("xz"), c("yz"), c("z")])
        solved = sums.withColumns({"a": a, "b": b, "c": d}).filter("c IS NOT NULL")
        left = c("zz") - 2 * (c("a") * c("xz") + c("b") * c("yz") + c("c") * c("z")) + c("a") ** 2 * c("xx") + c("b") ** 2 * c("yy") + c("c") ** 2 * c("n")
        left = left + 2 * (c("a") * c("b") * c("xy") + c("a") * c("c") * c("x") + c("b") * c("c") * c("y"))
        new = solved.select(*keys, "a", "b", "c", F.sqrt(F.greatest(F.lit(0.0), left / c("n")) + 1e-18).alias("rms"), c("n").cast("long").alias("npixel"))
        if keep and fit is not None:
            names = ["a", "b", "c", "rms", "npixel"]
            new = fit.join(new.select(*keys, *[c(n).alias(f"new_{n}") for n in names]), keys, "left").select(*keys, *[F.coalesce(f"new_{n}", n).alias(n) for n in names])
        fit = cut(new)
        few = few or fit.count() <= MOST_SENT  # no round has more groups than the one before
    return fit


def usable_edges(edges: DataFrame, images: DataFrame, share: float = 0.002, size: float = 0.25) -> DataFrame:
    """Fits that the model may use: rms at most two standard deviations above the mean, pixels at least ``share`` of
    the mean image area, and an overlap box of at least ``size`` of either image along one axis.
    ``edges``: plus, minus, rms, npixel, box_x, box_y; ``images``: image_id, nx, ny."""
    usual = edges.agg(F.avg("rms").alias("m"), F.stddev_pop("rms").alias("s")).crossJoin(images.agg(F.avg(F.col("nx") * F.col("ny")).alias("area")))  # one row
    side = lambda name: images.select(F.col("image_id").alias(name), F.col("nx").alias(f"{name}_x"), F.col("ny").alias(f"{name}_y"))
    sized = edges.join(side("plus"), "plus").join(side("minus"), "minus")
    wide = (F.col("box_x") >= size * F.least("plus_x", "minus_x")) | (F.col("box_y") >= size * F.least("plus_y", "minus_y"))
    return sized.crossJoin(F.broadcast(usual)).filter(wide & (F.col("rms") <= F.col("m") + 2 * F.col("s")) & (F.col("npixel") >= share * F.col("area"))).select(*edges.columns)


def level_relaxation(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, c) after ``rounds`` damped rounds of the level-only model for graphs of any size: an image moves by
    half the mean of its edges' offsets, then the edges follow. Every round's edges are written, so the plan
    stays the same size."""
    both = cut(fits.both_ways(edges).select("plus", "minus", "c"))
    total = cut(both.select(F.col("plus").alias("id")).distinct().withColumn("c", F.lit(0.0)))
    for _ in range(rounds):
        move = cut(both.groupBy(F.col("plus").alias("id")).agg((F.avg("c") / 2).alias("move")))
        total = cut(total.join(move, "id").select("id", (F.col("c") + F.col("move")).alias("c")))
        a, b = move.select(F.col("id").alias("plus"), F.col("move").alias("p")), move.select(F.col("id").alias("minus"), F.col("move").alias("m"))
        both = cut(both.join(a, "plus").join(b, "minus").select("plus", "minus", (F.col("c") - (F.col("p") - F.col("m"))).alias("c")))
    return total


def model(differences: DataFrame, rounds: int = 10_000, level_rounds: int = 2_500) -> DataFrame:
    """(id, a, b, c) of every image from the difference pixels (plus, minus, i, j, v): clipped plane fits, then
    relaxation of the edge graph. The graph is counted first: it is solved on the driver where it has at most
    MOST_EDGES edges, and with levels only, in Spark, beyond."""
    keys = ["plus", "minus"]
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    terms = {"xx": i * i, "xy": i * j, "yy": j * j, "x": i, "y": j, "n": F.lit(1.0)}
    sums = differences.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in terms.items()])
    edges = cut(sums.join(clipped_planes(differences, keys).drop("rms", "npixel"), keys))
    if edges.count() > MOST_EDGES:
        return level_relaxation(edges, 100).select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "c")
    schema = "id int, a double, b double, c double"
    found = edges.toPandas()
    return edges.sparkSession.createDataFrame(fits.solve_corrections(found, rounds, level_rounds), schema) if len(found) else edges.sparkSession.createDataFrame([], schema)


def overlapping_pairs(pix: DataFrame) -> DataFrame:
    """(plus, minus) of images on one grid whose pixel boxes meet. One row an image takes part."""
    box = pix.filter("v IS NOT NULL").groupBy("image_id").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    from skyloom.operators.resample import rectangle_search

    sides = cut(box.select(F.col("image_id").alias("id"), *[F.col(a).cast("double").alias(b) for a, b in (("i0", "x0"), ("i1", "x1"), ("j0", "y0"), ("j1", "y1"))]))
    step = sides.agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0")))).first()[0]
    found = rectangle_search(sides, sides, max(1.0, step or 1.0))
    return found.filter("query < id").select(F.col("query").alias("plus"), F.col("id").alias("minus"))


def mosaic(pix: DataFrame, background: bool = True, mode: str = "mean", rounds: int = 10_000) -> DataFrame:
    """The mosaic (i, j, v, area) of images on one output grid (image_id, i, j, v, area): differences of
    overlapping images, plane fits, the background model, its corrections, and the co-add. Without
    ``background`` only the co-add."""
    if not background:
        return coadd(pix, mode)
    pix = cut(pix)
    corrections = model(difference(pix, overlapping_pairs(pix)), rounds)
    moved = fits.apply_corrections(pix, corrections)
    return coadd(subtract_plane(moved, F.col("a"), F.col("b"), F.col("c")), mode)


def flatten(pix: DataFrame) -> DataFrame:
    """Every image less its own clipped plane."""
    planes = clipped_planes(pix, ["image_id"]).select("image_id", "a", "b", "c")
    planes = F.broadcast(planes) if planes.count() <= MOST_SENT else planes
    return subtract_plane(pix.join(planes, "image_id"), F.col("a"), F.col("b"), F.col("c")).drop("a", "b", "c")
