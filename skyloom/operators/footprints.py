"""Images as convex polygons on the sphere: their corners, overlaps, coverage and selection.

A footprint table has (cntr, ra, dec, corners): the image's centre and an array of unit vectors, one a
corner, in order around it (either way). Candidate pairs meet in grid cells by their centres
(:mod:`skyloom.operators.near`); the geometry is that of :mod:`skyloom.operators.polygons`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.coords import bind, dot, lon_lat, parts, unit, vector
from skyloom.functions.projections import CODES, Wcs, pixel_vector
from skyloom.operators import near
from skyloom.operators.polygons import Polygons, arc_distance, inside_each_other, share_a_point


def normalised(v: list[Column]) -> list[Column]:
    size = F.sqrt(dot(v, v))
    return [c / size for c in v]


def square(lon: Column, lat: Column, half: float) -> Column:
    """Corners of a north-up image of half-size ``half`` degrees on its tangent plane."""
    t, at = math.tan(math.radians(half)), F.struct(F.sin(F.radians(lon)).alias("sa"), F.cos(F.radians(lon)).alias("ca"), F.sin(F.radians(lat)).alias("sd"), F.cos(F.radians(lat)).alias("cd"))

    def corners_of(p: Column) -> Column:
        c = [p["cd"] * p["ca"], p["cd"] * p["sa"], p["sd"]]
        east, north = [-p["sa"], p["ca"], F.lit(0.0)], [-p["sd"] * p["ca"], -p["sd"] * p["sa"], p["cd"]]
        raw = lambda x, y: vector([c[k] + east[k] * (x * t) + north[k] * (y * t) for k in range(3)])
        return F.transform(F.array(raw(-1, -1), raw(1, -1), raw(1, 1), raw(-1, 1)), lambda v: vector(normalised(parts(v))))

    return bind(at, corners_of)


def pixel_places(naxis1: Column, naxis2: Column) -> Column:
    """An image's centre and the outer edges of its corner pixels, as pixel coordinates (i, j)."""
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    low, high1, high2 = F.lit(0.5), naxis1 + 0.5, naxis2 + 0.5
    return F.array(at((naxis1 + 1) / 2, (naxis2 + 1) / 2), at(low, low), at(high1, low), at(high1, high2), at(low, high2))


def corners(w: Wcs, naxis1: Column, naxis2: Column) -> Column:
    """Corners of an image from its keywords."""
    return F.slice(F.transform(pixel_places(naxis1, naxis2), lambda p: pixel_vector(p["i"], p["j"], w)), 2, 4)


def overlaps(images: DataFrame, radius: float) -> DataFrame:
    """Unordered pairs (plus, minus) of footprints that overlap. No corner is farther than ``radius``
    degrees from its image's centre."""
    return _pairs(images, radius, 0)


def _pairs(images: DataFrame, radius: float, steps: int) -> DataFrame:
    images = images.select("cntr", "ra", "dec", "corners")
    pairs = near.pairs(images, images, 2 * radius, ["cntr", "cntr_2"], rising=True, steps=steps)
    return pairs.select(F.col("cntr").alias("plus"), F.col("cntr_2").alias("minus"))


def overlaps_by_boundary(images: DataFrame, radius: float, steps: int) -> DataFrame:
    """As :func:`overlaps`, by testing ``steps`` points of each side of either image, at equal steps along the
    chord, in the other."""
    return _pairs(images, radius, steps)


def polygon_of(places: list[tuple[float, float]]) -> Column:
    """A constant polygon from (lon, lat) corners."""
    return F.array(*[vector(unit(F.lit(float(a)), F.lit(float(d)))) for a, d in places])


def _test(test, image: Column, other: Column, *more: Column) -> Column:
    """``test`` of polygons, or polygons and points, by whole batches: as an expression over the corners it would be
    worked out again for every use of a corner."""
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array(test(*[Polygons.of(c) for c in columns]))

    return F.arrow_udf(run, "boolean")(near.packed(image), near.packed(other), *map(near.packed, more))


def subset(images: DataFrame, template: Column, steps: int | None = None) -> DataFrame:
    """Images that a template polygon selects: one of their corners is inside (or, with ``steps``, one of
    so many points of each side), or a corner of the template is inside the image."""
    return images.filter(_test(lambda image, t: inside_each_other(image, t, steps or 1, 1), F.col("corners"), template))


def covers(images: DataFrame, mode: str, region: list[tuple[float, float]], radius: float = 0.0) -> DataFrame:
    """Images by region. ``points`` and ``box``: they overlap the polygon of the corners in ``region``; ``circle``:
    they come within ``radius`` degrees of its first point; ``point``: they hold that point; ``cutout``:
    they overlap the north-up square of half-size ``radius`` around it."""
    image, first = F.col("corners"), polygon_of(region[:1])
    if mode in ("points", "box"):
        return images.filter(_test(share_a_point, image, polygon_of(region)))
    if mode == "cutout":
        return images.filter(_test(share_a_point, image, square(F.lit(float(region[0][0])), F.lit(float(region[0][1])), radius)))
    if mode == "point":
        return images.filter(_test(lambda p, q: p.holds(q.a[0]), image, first))
    if mode == "circle":
        def reached(p: Polygons, q: Polygons) -> np.ndarray:
            found = p.holds(q.a[0])
            for a, b in zip(p.a, p.b, strict=True):
                found |= arc_distance(a, b, q.a[0]) <= radius
            return found

        return images.filter(_test(reached, image, first))
    raise ValueError(f"unknown mode {mode!r}")


def best_images(images: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """For each point (cntr, ra, dec) the image that holds it farthest from its edge: (cntr, image,
    margin); ties take the least image. ``radius`` bounds the corners' distance from the centre."""
    return near.best(points, images.select("cntr", "ra", "dec", "corners"), radius).select("cntr", F.col("found").alias("image"), F.col("score").alias("margin"))


def covering_count(images: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Number of footprints that hold each point; points in none are left out."""
    return near.counts(points, images.select("cntr", "ra", "dec", "corners"), radius)


def index_images(headers: DataFrame) -> DataFrame:
    """The metadata row of each image from its header (file, hdu, header map): size, projection keywords,
    centre and four corners. Images named ``*_area.fits`` are weights and left out; a header
    that lacks a keyword or has another projection than those of ``projections`` gives nulls."""
    h = lambda k, default=None: F.coalesce(F.element_at("header", F.lit(k)).try_cast("double"), F.lit(default))
    base = headers.filter(~F.col("path").rlike(r"_area\.fits?(\.gz)?$")).select(
        "path", "hdu", *[h(k).alias(k.lower()) for k in ("NAXIS1", "NAXIS2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CDELT1", "CDELT2")], h("CROTA2", 0.0).alias("crota2"),
        F.element_at("header", F.lit("CTYPE1")).alias("ctype1"), F.element_at("header", F.lit("CTYPE2")).alias("ctype2"),
    )
    c, code = F.col, F.right(F.trim("ctype1"), F.lit(3))

    def place(p: Column) -> Column:
        found = F.lit(None).cast("struct<x:double,y:double,z:double>")
        for name in CODES:
            w = Wcs(name, *[c(k) for k in ("crval1", "crval2", "crpix1", "crpix2", "cdelt1", "cdelt2", "crota2")])
            found = F.when(code == name, pixel_vector(p["i"], p["j"], w)).otherwise(found)
        return found

    placed = base.withColumn("places", F.transform(pixel_places(c("naxis1"), c("naxis2")), place))
    out = []
    for k, name in enumerate(("", "1", "2", "3", "4")):
        lon, lat = lon_lat(parts(F.col("places")[k]))
        out += [F.when(lat.isNotNull(), lon).alias(f"ra{name}"), lat.alias(f"dec{name}")]
    return placed.select(*base.columns, *out)


def region_header(lon: float, lat: float, width: float, height: float, scale: float, code: str = "TAN") -> dict[str, str]:
    """Template keywords of a north-up region of ``width`` x ``height`` degrees with square pixels of ``scale``."""
    nx, ny = math.ceil(width / scale), math.ceil(height / scale)
    text = {"SIMPLE": "T", "BITPIX": "-64", "NAXIS": "2", "NAXIS1": nx, "NAXIS2": ny, "CTYPE1": f"RA---{code}", "CTYPE2": f"DEC--{code}", "CRVAL1": lon, "CRVAL2": lat}
    text |= {"CRPIX1": (nx + 1) / 2, "CRPIX2": (ny + 1) / 2, "CDELT1": -scale, "CDELT2": scale, "CROTA2": 0.0, "EQUINOX": 2000.0}
    return {k: str(v) for k, v in text.items()}


def bounding_circles(points: DataFrame, key: str) -> DataFrame:
    """(key, ra, dec, radius) of a circle around each group's positions: about their mean direction,
    as far as the farthest. Two partial aggregates; at most twice the least circle's radius."""
    v = unit(F.col("ra"), F.col("dec"))
    centre = points.groupBy(key).agg(*[F.sum(x).alias(n) for x, n in zip(v, ("sx", "sy", "sz"), strict=True)])
    c = normalised([F.col("sx"), F.col("sy"), F.col("sz")])
    far = points.join(centre, key).groupBy(key, "sx", "sy", "sz").agg(F.min(dot(v, c)).alias("least"))
    lon, lat = lon_lat(normalised([F.col("sx"), F.col("sy"), F.col("sz")]))
    return far.select(key, lon.alias("ra"), lat.alias("dec"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))).alias("radius"))
