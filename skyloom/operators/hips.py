"""Equal-area sky tiles in nested order: tile of a position, position of a tile, missing tiles, tile pictures."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.coords import bind, interleave, tile_path

#: Ring (in half faces from the north) and longitude (in eighths of a turn) of the twelve faces' lowest corners.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_TURN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def face_cell(lon: Column, lat: Column, order: int) -> Column:
    """The base face of a position and its cell (face, x, y) among the 4**order of that face."""
    n = 1 << order

    def place(p: Column) -> Column:
        z, t = p["z"], p["t"]
        # near the equator the cells' diagonals are straight lines in (longitude, sine of latitude)
        rise, fall = F.floor(n * (0.5 + t) - n * z * 0.75), F.floor(n * (0.5 + t) + n * z * 0.75)
        up, down = F.floor(rise / n), F.floor(fall / n)
        face = F.when(up == down, F.when(up == 4, 4).otherwise(up + 4)).when(up < down, up).otherwise(down + 8)
        middle = F.struct(face.cast("int").alias("face"), F.pmod(fall, F.lit(n)).cast("int").alias("x"), (n - 1 - F.pmod(rise, F.lit(n))).cast("int").alias("y"))
        # near a pole they converge
        quarter = F.least(F.lit(3), F.floor(t))
        width = n * F.sqrt(3 * (1 - F.abs(z)))
        a, b = F.least(F.lit(n - 1), F.floor((t - quarter) * width)), F.least(F.lit(n - 1), F.floor((1 - t + quarter) * width))
        north = F.struct(quarter.cast("int").alias("face"), (n - 1 - b).cast("int").alias("x"), (n - 1 - a).cast("int").alias("y"))
        south = F.struct((quarter + 8).cast("int").alias("face"), a.cast("int").alias("x"), b.cast("int").alias("y"))
        return F.when(F.abs(z) <= 2 / 3, middle).when(z > 0, north).otherwise(south)

    return bind(F.struct(F.sin(F.radians(lat)).alias("z"), (F.pmod(lon, F.lit(360.0)) / 90).alias("t")), place)


def tile_of(lon: Column, lat: Column, order: int) -> Column:
    """The nested number of the tile that holds a position."""
    cell = lambda c: c["face"].cast("long") * (1 << (2 * order)) + interleave(c["x"], c["y"], order)
    return bind(face_cell(lon, lat, order), cell)


def deinterleave(tile: Column, order: int) -> tuple[Column, Column]:
    """(x, y) within its face of a tile number: its even and its odd bits."""
    def bits(first: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(max(0, order - 1))), F.lit(0).cast("long"), lambda s, k: s + F.call_function("shiftleft", F.call_function("shiftright", tile, 2 * k + first).bitwiseAND(F.lit(1)), k))

    return (bits(0), bits(1)) if order else (F.lit(0).cast("long"), F.lit(0).cast("long"))


def tile_centre(tile: Column, order: int) -> tuple[Column, Column]:
    """(lon, lat) of a tile's centre."""
    n = 1 << order
    x, y = deinterleave(tile, order)
    face = F.floor(tile / (1 << (2 * order))).cast("int")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)

    def place(c: Column) -> Column:
        ring = pick(FACE_RING, c["f"]) * n - c["x"] - c["y"] - 1
        size = F.when(ring < n, ring).when(ring > 3 * n, 4 * n - ring).otherwise(F.lit(n))
        z = F.when(ring < n, 1 - ring * ring / (3.0 * n * n)).when(ring > 3 * n, (4 * n - ring) * (4 * n - ring) / (3.0 * n * n) - 1).otherwise((2 * n - ring) * 2 / (3.0 * n))
        shifted = F.when((ring < n) | (ring > 3 * n), F.lit(0)).otherwise(F.pmod(ring - n, F.lit(2)))
        k = F.floor((pick(FACE_TURN, c["f"]) * size + c["x"] - c["y"] + 1 + shifted) / 2)
        k = F.pmod(k - 1, 4 * size) + 1
        return F.struct(((k - (shifted + 1) / 2) * 90 / size).alias("lon"), F.degrees(F.asin(z)).alias("lat"))

    found = bind(F.struct(x.alias("x"), y.alias("y"), face.alias("f")), place)
    return F.pmod(found["lon"], F.lit(360.0)), found["lat"]


def tile_header(order: int, size: int = 512) -> dict[str, str]:
    """Keywords of the whole-sky plane that the tiles of an order cut up, ``size`` pixels a tile's side."""
    across, scale = 5 * (1 << order) * size, 90.0 / math.sqrt(2) / ((1 << order) * size)
    text = {"SIMPLE": "T", "BITPIX": "-64", "NAXIS": "2", "NAXIS1": across, "NAXIS2": across, "CTYPE1": "GLON-HPX", "CTYPE2": "GLAT-HPX", "CRVAL1": 0.0, "CRVAL2": 0.0}
    return {k: str(v) for k, v in (text | {"CRPIX1": (across + 1) / 2, "CRPIX2": (across + 1) / 2, "CDELT1": -scale, "CDELT2": scale, "CROTA2": 45.0}).items()}


def all_tiles(spark: SparkSession, order: int) -> DataFrame:
    """(norder, npix) of every tile of an order."""
    return spark.range(12 << (2 * order)).select(F.lit(order).alias("norder"), F.col("id").alias("npix"))


def missing_tiles(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The tiles (norder, npix) that should be there and aren't."""
    return expected.join(actual.select("norder", "npix").distinct(), ["norder", "npix"], "left_anti")


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey picture; row 0 is at its foot, as in images."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = grey.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), grey[::-1].astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def tile_pictures(pix: DataFrame, size: int) -> DataFrame:
    """(norder, npix, path, png) of pixels (norder, npix, i, j, grey): one picture of size x size a tile, blanks black.
    A tile is a bounded group."""
    def draw(g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size), np.uint8)
        own = g.dropna(subset=["grey"])
        out[own["j"].to_numpy(int), own["i"].to_numpy(int)] = own["grey"].to_numpy(float).clip(0, 255)
        return pd.DataFrame({"norder": [int(g["norder"].iloc[0])], "npix": [int(g["npix"].iloc[0])], "png": [png(out)]})

    inside = pix.filter(F.col("i").between(0, size - 1) & F.col("j").between(0, size - 1)).select("norder", "npix", "i", "j", "grey")
    drawn = inside.groupBy("norder", "npix").applyInPandas(draw, "norder int, npix long, png binary")
    return drawn.select("norder", "npix", F.concat(tile_path(F.col("norder"), F.col("npix")), F.lit(".png")).alias("path"), "png")
