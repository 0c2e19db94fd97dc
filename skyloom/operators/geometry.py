"""Regions and overlaps on the sphere. Near pairs are found by cells of a cube grid on unit vectors (:mod:`skyloom.operators.near`),
so there is no special case at the poles or at longitude 0, and no pair is tested twice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.coords import cross, dot, unit
from skyloom.operators import near


def in_cone(lon: Column, lat: Column, lon0: float, lat0: float, radius: float) -> Column:
    """Strictly within ``radius`` degrees."""
    v, c = unit(lon, lat), unit(F.lit(lon0), F.lit(lat0))
    return dot(v, c) > math.cos(math.radians(radius))


def in_polygon(lon: Column, lat: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside a convex spherical polygon whose corners run clockwise as seen from outside; points
    within 1e-15 of an edge are inside."""
    v = unit(lon, lat)
    inside = F.lit(True)
    for (a0, d0), (a1, d1) in zip(corners, corners[1:] + corners[:1], strict=True):
        n = cross(unit(F.lit(a0), F.lit(d0)), unit(F.lit(a1), F.lit(d1)))
        inside = inside & (dot(v, n) <= 1e-15)
    return inside


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (left, right) within ``radius`` degrees. Both need cntr, ra and dec; the right side's
    columns get the suffix ``_2``. Each right row goes to the cells around its own, each left
    row to one, so a pair meets exactly once."""
    return near.pairs(left, right, radius)


def overlaps(images: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs of images (cntr, ra, dec and a radius of at most ``radius`` each) whose circles meet."""
    images = images.select("cntr", "ra", "dec")
    pairs = near.pairs(images, images, 2 * radius, ["cntr", "cntr_2", "dist"], rising=True)
    return pairs.select(F.col("cntr").alias("plus"), F.col("cntr_2").alias("minus"), "dist")


def nearest(points: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """For each point the nearest source within ``radius``; ties take the least cntr."""
    return near.best(points, sources.select("cntr", "ra", "dec"), radius).select("cntr", F.col("found").alias("source"), F.col("score").alias("dist"))


def best_image(images: DataFrame, lon: float, lat: float, half: float) -> DataFrame:
    """The image (square of half-size ``half`` degrees in tangent offsets) in which a point is
    farthest from the edge; ties take the first."""
    d = F.radians(F.col("dec"))
    x = (F.pmod(F.lit(lon) - F.col("ra") + 180, F.lit(360.0)) - 180) * F.cos(d)
    margin = F.lit(half) - F.greatest(F.abs(x), F.abs(F.lit(lat) - F.col("dec")))
    return images.select("cntr", margin.alias("margin")).filter("margin > 0").orderBy(F.desc("margin"), "cntr").limit(1)


def covering(images: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Number of images whose circle covers each point."""
    return near.counts(points, images.select("cntr", "ra", "dec"), radius)


def pixel_scale_order(images: DataFrame) -> DataFrame:
    """The least pixel scale of the images and the first pyramid order with finer cells."""
    least = F.min(F.least(F.abs("cdelt1"), F.abs("cdelt2")))
    order = F.greatest(F.lit(0), F.ceil(F.log2(F.lit(90.0 / math.sqrt(2)) / F.col("scale"))))
    return images.agg(least.alias("scale")).select("scale", order.cast("int").alias("order"))


def fragments(images: DataFrame) -> DataFrame:
    """Pairs of plates that hold a piece of one file. Files in one plate only don't reach the join."""
    shared = images.groupBy("fname").agg(F.countDistinct("plate").alias("n")).filter("n > 1").select("fname")
    pieces = images.join(shared, "fname", "left_semi").select("fname", "plate", "cntr").distinct()
    other = pieces.select("fname", F.col("plate").alias("plate_2"), F.col("cntr").alias("cntr_2"))
    return pieces.join(other, "fname").filter("plate < plate_2")


def global_ids(images: DataFrame, ranges: int = 64) -> DataFrame:
    """Plate-local ids (plate, cntr) with ids that are unique over all plates: each plate's ids are
    shifted by the sizes of the plates before it. A plate is numbered in hash ranges of its own order,
    so neither all plates nor one large plate pass through one task."""
    ends = images.groupBy("plate").agg(F.min("cntr").alias("low"), F.max("cntr").alias("high"))
    part = F.floor((ranges - 1) * (F.col("cntr") - F.col("low")) / F.nullif((F.col("high") - F.col("low")).cast("double"), F.lit(0.0)))
    ranged = images.join(ends, "plate").withColumn("part", F.coalesce(part, F.lit(0))).drop("low", "high")
    sizes = ranged.groupBy("plate", "part").agg(F.count("*").alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("plate", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("plate", "part").orderBy("cntr"))
    return ranged.join(sizes.select("plate", "part", shift.alias("shift")), ["plate", "part"]).withColumn("id", F.col("shift") + number).drop("shift", "part")


def plate_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with global ids (id) back on their plates: plate and cntr of :func:`global_ids`."""
    return rows.join(ids.select("id", "plate", "cntr"), "id")


def neighbour_tiles(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (i, j) that share a side, each once: every tile looks to its right and up."""
    moved = tiles.select("i", "j", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("d"))
    moved = moved.select("i", "j", (F.col("i") + F.col("d.a")).alias("i_2"), (F.col("j") + F.col("d.b")).alias("j_2"))
    other = tiles.select(F.col("i").alias("i_2"), F.col("j").alias("j_2")).distinct()
    return moved.join(other, ["i_2", "j_2"], "left_semi").select("i", "j", "i_2", "j_2")


def bounding_box(points: DataFrame, key: str) -> DataFrame:
    """North-aligned box of positions by key. Longitudes are taken about the mean direction, so that a
    field over longitude 0 isn't split."""
    v = unit(F.col("ra"), F.col("dec"))
    centre = points.groupBy(key).agg(F.sum(v[0]).alias("sx"), F.sum(v[1]).alias("sy")).select(key, F.degrees(F.atan2("sy", "sx")).alias("lon0"))
    offset = F.pmod(F.col("ra") - F.col("lon0") + 180, F.lit(360.0)) - 180
    near = points.join(centre, key)
    return near.groupBy(key).agg(F.first("lon0").alias("lon0"), F.min(offset).alias("west"), F.max(offset).alias("east"), F.min("dec").alias("south"), F.max("dec").alias("north"))
