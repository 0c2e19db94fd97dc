"""Aperture photometry of images in the long form (image_id, i, j, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.storage import cut

#: Rounds after which a background that still moves is given up.
MOST_ROUNDS = 1_000


def brightest(pix: DataFrame) -> DataFrame:
    """(image_id, x, y): each image's brightest pixel; ties take the lowest row, then column."""
    good = pix.filter("v IS NOT NULL")
    return good.groupBy("image_id").agg(F.max_by(F.struct("i", "j"), F.struct("v", -F.col("j"), -F.col("i"))).alias("p")).select("image_id", F.col("p.i").alias("x"), F.col("p.j").alias("y"))


def clipped_background(values: DataFrame, clip: float = 3.0) -> DataFrame:
    """(image_id, background, sigma, n): the mean of each image's values within ``clip`` sigma of the mean
    before, repeated until no value leaves or enters. One partial aggregate a round, over a
    written input; images that have settled leave the loop."""
    good = cut(values.filter("v IS NOT NULL").select("image_id", "v"))
    fit = good.groupBy("image_id").agg(F.avg("v").alias("background"), F.stddev_pop("v").alias("sigma"), F.count("*").alias("n"))
    state = cut(fit.withColumn("done", F.lit(False)))
    for _ in range(MOST_ROUNDS):
        moving = state.filter("NOT done")
        if moving.isEmpty():
            return state.drop("done")
        near = good.join(moving.select("image_id", F.col("background").alias("m"), F.col("sigma").alias("s")), "image_id").filter(F.abs(F.col("v") - F.col("m")) <= clip * F.col("s"))
        new = near.groupBy("image_id").agg(F.avg("v").alias("b1"), F.stddev_pop("v").alias("s1"), F.count("*").alias("n1"))
        still = F.col("done") | F.coalesce((F.col("n1") == F.col("n")) & (F.abs(F.col("b1") - F.col("background")) <= 1e-12 * (1 + F.abs("background"))), F.lit(True))
        state = cut(state.join(new, "image_id", "left").select("image_id", F.coalesce("b1", "background").alias("background"), F.coalesce("s1", "sigma").alias("sigma"), F.coalesce("n1", "n").alias("n"), still.alias("done")))
    raise ValueError(f"the background still moves after {MOST_ROUNDS} rounds")


def aperture(pix: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Pixels within ``radius`` of their image's centre (image_id, x, y), with their distance ``r``."""
    r = F.sqrt((F.col("i") - F.col("x")) ** 2 + (F.col("j") - F.col("y")) ** 2)
    return pix.filter("v IS NOT NULL").join(centres, "image_id").select("image_id", "i", "j", r.alias("r"), "v").filter(F.col("r") <= radius)


def growth_curve(inside: DataFrame, background: DataFrame) -> DataFrame:
    """The pixels of an aperture by rising distance, with the running sum of what is above the background.
    An aperture is bounded by its radius, so an image's pixels fit in one window."""
    by = Window.partitionBy("image_id").orderBy("r", "i", "j", "v").rowsBetween(Window.unboundedPreceding, 0)
    return inside.join(background.select("image_id", "background"), "image_id").withColumn("flux", F.sum(F.col("v") - F.col("background")).over(by))


def profile_width(inside: DataFrame) -> DataFrame:
    """(image_id, peak, level, width): the peak of the inner quarter (by distance), and the first distance at which
    the value is below background plus (peak - least) / e, with the least value as the background."""
    rank = Window.partitionBy("image_id").orderBy("r", "i", "j", "v")
    every = Window.partitionBy("image_id")
    ranked = inside.select("*", F.row_number().over(rank).alias("k"), F.count("*").over(every).alias("n"), F.min("v").over(every).alias("low"))
    peaked = ranked.withColumn("peak", F.max(F.when(F.col("k") <= F.floor(F.col("n") / 4), F.col("v"))).over(every))
    level = F.col("low") + (F.col("peak") - F.col("low")) / math.e
    return peaked.groupBy("image_id").agg(F.first("peak").alias("peak"), F.first(level).alias("level"), F.min_by("r", F.when(F.col("v") < level, F.col("k"))).alias("width"))


def aperture_photometry(pix: DataFrame, radius: float) -> DataFrame:
    """(image_id, x, y, background, sigma, n, peak, width, flux) around each image's brightest pixel."""
    centres = cut(brightest(pix))
    inside = cut(aperture(pix, centres, radius))
    background = clipped_background(inside)
    flux = inside.join(background, "image_id").groupBy("image_id").agg(F.sum(F.col("v") - F.col("background")).alias("flux"))
    return centres.join(background, "image_id").join(profile_width(inside), "image_id").join(flux, "image_id").drop("level")
