"""Area-weighted resampling and other operators that spread one pixel or source over several cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import near
from skyloom.operators.pixels import shrink
from skyloom.storage import cut

MOST_ROUNDS = 1_000


def planar_overlap(pix: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """Project square pixels by x' = scale x + dx: each input pixel meets the output cells its image
    covers, weighted by the common area. Output: (image_id, i, j, v, area)."""
    def reach(c: str, d: float) -> Column:
        low, high = F.col(c) * scale + d, (F.col(c) + 1) * scale + d
        part = lambda k: F.least(high, (k + 1).cast("double")) - F.greatest(low, k.cast("double"))
        return F.filter(F.transform(F.sequence(F.floor(low), F.floor(high)), lambda k: F.struct(k.cast("int").alias("k"), part(k).alias("w"))), lambda s: s["w"] > 1e-12)

    wide = pix.filter("v IS NOT NULL").select("image_id", "v", "j", F.explode(reach("i", dx)).alias("x")).select("image_id", "v", "x", F.explode(reach("j", dy)).alias("y"))
    weight = F.col("x.w") * F.col("y.w")
    return wide.groupBy("image_id", F.col("x.k").alias("i"), F.col("y.k").alias("j")).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"), F.sum(weight).alias("area"))


def nearest_pixel(pix: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """Quick-look projection: each pixel's centre goes to the output pixel it falls in."""
    at = lambda c, d: F.floor((F.col(c) + 0.5) * scale + d).cast("int")
    return pix.filter("v IS NOT NULL").groupBy("image_id", at("i", dx).alias("i"), at("j", dy).alias("j")).agg(F.avg("v").alias("v"))


def cube_shrink(cube: DataFrame, factor: int, planes: int) -> DataFrame:
    """Block average by ``factor`` in i and ``planes`` in k."""
    return cube.filter("v IS NOT NULL").groupBy(F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("k") / planes).cast("int").alias("k")).agg(F.avg("v").alias("v"))


def pyramid(pix: DataFrame, levels: int) -> DataFrame:
    """(level, image_id, i, j, v): each level is the one below shrunk by two."""
    out, current = None, pix.select("image_id", "i", "j", "v")
    for level in range(1, levels + 1):
        current = cut(shrink(current, 2))  # each level is read once for itself and once for the next
        one = current.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def aperture_sums(sources: DataFrame, pix: DataFrame, radius: float, key: str | None = None) -> DataFrame:
    """Per source (cntr, x, y), and per image where ``key`` names a column of ``pix``, the sum and
    number of the pixels within ``radius``. The values of one pixel are summed first, and sources at one place
    are looked at once, so the work follows the places and not the rows on them. Places meet
    in grid cells of that size; a source's goes to the 9 cells around its own."""
    side = math.ceil(radius)
    around = F.sequence(F.lit(-1), F.lit(1))
    s = sources.select("x", "y").distinct().select("x", "y", F.explode(around).alias("a")).select("x", "y", "a", F.explode(around).alias("b"))
    s = s.select("x", "y", (F.floor(F.col("x") / side) + F.col("a")).alias("cx"), (F.floor(F.col("y") / side) + F.col("b")).alias("cy"))
    keys = [key] if key else []
    p = pix.filter("v IS NOT NULL").groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    p = p.select(*keys, "i", "j", "v", "n", F.floor(F.col("i") / side).alias("cx"), F.floor(F.col("j") / side).alias("cy"))
    inside = (F.col("i") - F.col("x")) ** 2 + (F.col("j") - F.col("y")) ** 2 <= radius**2
    places = s.join(p, ["cx", "cy"]).filter(inside).groupBy(*keys, "x", "y").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sources.select("cntr", "x", "y").join(places, ["x", "y"]).groupBy(*keys, "cntr").agg(F.sum("v").alias("flux"), F.sum("n").alias("n"))


def rectangle_search(boxes: DataFrame, queries: DataFrame, side: float, contained: bool = False) -> DataFrame:
    """Pairs (query, id) of rectangles (x0, x1, y0, y1) that overlap, or where the box lies within the
    query. Rectangles go to the grid cells they touch; the least common cell reports a pair."""
    return near.rectangles(boxes, queries, side, contained)


def peak_in_core(profile: DataFrame) -> DataFrame:
    """Per image the largest value among the nearest quarter of its pixels (image_id, r, v)."""
    by = Window.partitionBy("image_id").orderBy("r", "i", "j")
    ranked = profile.select("image_id", "v", F.row_number().over(by).alias("k"), F.count("*").over(Window.partitionBy("image_id")).alias("n"))
    return ranked.filter(F.col("k") <= F.floor(F.col("n") / 4)).groupBy("image_id").agg(F.max("v").alias("peak"))


def gap_rotation(a: Column, b: Column, back: bool = False) -> tuple[Column, Column]:
    """Plane coefficients turned by 90 degrees between the spaces of two faces."""
    return (-b, a) if back else (b, -a)


def flux_calibration(matches: DataFrame, rounds: int = 5, base: float = 2.512) -> DataFrame:
    """Intercept of the slope-one line between log flux and magnitude / base, with 2 sigma clipping.
    ``matches``: (image_id, flux > 0, mag)."""
    d = F.log10("flux") + F.col("mag") / base
    good = matches.filter("flux > 0").select("image_id", d.alias("d"))
    fit = None
    for _ in range(rounds):
        use = good if fit is None else good.join(fit, "image_id").filter(F.abs(F.col("d") - F.col("m")) <= 2 * F.col("s")).select("image_id", "d")
        fit = use.groupBy("image_id").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"), F.count("*").alias("n"))
    return fit


def converged_calibration(matches: DataFrame, base: float = 2.512, tolerance: float = 1e-8) -> DataFrame:
    """As :func:`flux_calibration`, clipped until the intercept's relative change is below
    ``tolerance`` (each image by itself). An image whose matches are all clipped keeps its last fit;
    one that has seen MOST_ROUNDS rounds goes round in a cycle and raises."""
    good = matches.filter("flux > 0").select("image_id", (F.log10("flux") + F.col("mag") / base).alias("d"))
    state = good.select("image_id").distinct().select("image_id", F.lit(0.0).alias("m"), F.lit(math.inf).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("done"))
    for _ in range(MOST_ROUNDS):
        open_ = good.join(state.filter("NOT done").select("image_id", "m", "s"), "image_id")
        new = open_.filter(F.abs(F.col("d") - F.col("m")) <= 2 * F.col("s")).groupBy("image_id").agg(F.avg("d").alias("m1"), F.count("*").alias("n1"))
        left = F.col("d") - F.col("m1")
        spread = open_.join(new, "image_id").filter(F.abs(left) <= 2 * F.col("s")).groupBy("image_id").agg(F.sqrt(F.avg(left * left)).alias("s1"))
        change = F.abs(F.col("m1") - F.col("m"))
        still = (change < tolerance * F.abs("m")) | (change == 0) & ~F.col("s").isin(math.inf)
        state = cut(state.join(new, "image_id", "left").join(spread, "image_id", "left").select(
            "image_id", F.coalesce("m1", "m").alias("m"), F.coalesce("s1", "s").alias("s"), F.coalesce("n1", "n").alias("n"), (F.col("done") | F.coalesce(still, F.lit(True)) | F.col("s1").isNull()).alias("done")
        ))
        if state.filter("NOT done").isEmpty():
            return state.select("image_id", "m", "s", "n")
    raise ValueError(f"no convergence in {MOST_ROUNDS} rounds")


def synthetic_sky(sources: DataFrame, width: int, reference: float, floor: float = 3.0) -> DataFrame:
    """Sources (x, y, mag) as flat squares of 2 width + 1 pixels; fluxes below ``floor`` count as it."""
    flux = F.greatest(F.lit(floor), F.pow(F.lit(10.0), 0.4 * (F.lit(reference) - F.col("mag"))))
    reach = F.sequence(F.lit(-width), F.lit(width))
    spread = sources.select("x", "y", flux.alias("flux"), F.explode(reach).alias("dx")).select("x", "y", "flux", "dx", F.explode(reach).alias("dy"))
    return spread.groupBy((F.col("x") + F.col("dx")).alias("i"), (F.col("y") + F.col("dy")).alias("j")).agg((F.sum("flux") / (2 * width + 1) ** 2).alias("v"))
