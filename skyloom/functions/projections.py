"""World coordinates of images as column expressions: eleven projections in both directions.

A :class:`Wcs` holds one image's keywords, as numbers or as columns of a table of images, so one plan
serves a single image and an equi-join of pixels with their images alike. Zenithal projections
have their native pole at the reference point, the others their native origin; north is up there.
Angles are degrees, pixels count from 1 as in the headers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.coords import bind, lon_lat, parts, vector

Number = float | Column
ZENITHAL = ("TAN", "SIN", "STG", "ARC", "ZEA")
CODES = (*ZENITHAL, "CAR", "CEA", "MER", "SFL", "AIT", "HPX")


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Wcs:
    code: str
    crval1: Number
    crval2: Number
    crpix1: Number
    crpix2: Number
    cdelt1: Number
    cdelt2: Number
    crota2: Number = 0.0

    def __post_init__(self):
        if self.code not in CODES:
            raise ValueError(f"no projection {self.code!r}; there are {', '.join(CODES)}")

    @classmethod
    def of(cls, header: dict[str, str]) -> Wcs:
        """From header keywords; a CD matrix is read as scales and a rotation."""
        number = lambda k, default=None: float(header[k]) if k in header or default is None else default
        code = header["CTYPE1"].strip()[-3:]
        if "CD1_1" in header:
            a, b, c, d = (number(k, 0.0) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2"))
            scale1 = math.copysign(math.hypot(a, c), a * d - b * c)
            return cls(code, number("CRVAL1"), number("CRVAL2"), number("CRPIX1"), number("CRPIX2"), scale1, math.hypot(b, d), math.degrees(math.atan2(-b, d)))
        return cls(code, number("CRVAL1"), number("CRVAL2"), number("CRPIX1"), number("CRPIX2"), number("CDELT1"), number("CDELT2"), number("CROTA2", 0.0))


def _native(lon: Column, lat: Column, w: Wcs) -> tuple[Column, Column, Column]:
    """A direction along the reference point, to its east and to its north."""
    a, d, d0 = F.radians(lon - _c(w.crval1)), F.radians(lat), F.radians(_c(w.crval2))
    along = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    return along, F.cos(d) * F.sin(a), F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)


def _sky(along: Column, east: Column, north: Column, w: Wcs) -> Column:
    """The unit vector (struct) of a direction given along, east and north of the reference point."""
    a0, d0 = F.radians(_c(w.crval1)), F.radians(_c(w.crval2))
    x, z = along * F.cos(d0) - north * F.sin(d0), along * F.sin(d0) + north * F.cos(d0)
    return vector([x * F.cos(a0) - east * F.sin(a0), x * F.sin(a0) + east * F.cos(a0), z])


def project(lon: Column, lat: Column, w: Wcs) -> tuple[Column, Column]:
    """Plane coordinates (east, north) in degrees; null where the projection shows no such point."""
    native = F.struct(*[c.alias(n) for c, n in zip(_native(lon, lat, w), ("s", "e", "n"), strict=True)])
    plane = bind(native, lambda p: F.struct(*[c.alias(n) for c, n in zip(_plane(p["s"], p["e"], p["n"], w), ("x", "y"), strict=True)]))
    return plane["x"], plane["y"]


def _plane(along: Column, east: Column, north: Column, w: Wcs) -> tuple[Column, Column]:
    if w.code in ZENITHAL:
        scale = {
            "TAN": F.when(along > 0, 1 / along), "SIN": F.when(along >= 0, F.lit(1.0)), "STG": F.when(along > -1, 2 / (1 + along)),
            "ARC": _ratio(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), along))), F.sqrt(east**2 + north**2)), "ZEA": F.when(along > -1, F.sqrt(2 / (1 + along))),
        }[w.code]
        return F.degrees(east * scale), F.degrees(north * scale)
    phi, theta = F.atan2(east, along), F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), north)))
    if w.code == "AIT":
        g = F.sqrt(2 / (1 + F.cos(theta) * F.cos(phi / 2)))
        return F.degrees(2 * g * F.cos(theta) * F.sin(phi / 2)), F.degrees(g * F.sin(theta))
    if w.code == "HPX":
        # facets of 90 degrees; beyond sin(lat) = 2/3 they narrow towards the poles
        part = F.sqrt(3 * (1 - F.abs(north)))
        middle = F.radians(-135 + 90 * F.least(F.lit(3), F.floor((F.degrees(phi) + 180) / 90)))
        polar = F.abs(north) > 2 / 3
        x = F.when(polar, middle + (phi - middle) * part).otherwise(phi)
        y = F.when(polar, F.signum(north) * (2 - part) * (math.pi / 4)).otherwise(north * (3 * math.pi / 8))
        return F.degrees(x), F.degrees(y)
    y = {"CAR": theta, "CEA": north, "MER": F.when(F.abs(north) < 1, F.atanh(north)), "SFL": theta}[w.code]
    return F.degrees(phi * F.cos(theta) if w.code == "SFL" else phi), F.degrees(y)


def unproject(x: Column, y: Column, w: Wcs) -> Column:
    """The unit vector (struct x, y, z) of plane coordinates; its parts are null outside of the projected sky."""
    if w.code in ZENITHAL:
        return bind(F.struct(F.radians(x).alias("x"), F.radians(y).alias("y"), F.sqrt(F.radians(x) ** 2 + F.radians(y) ** 2).alias("r")), lambda p: _from_pole(p["x"], p["y"], p["r"], w))
    native = bind(F.struct(F.radians(x).alias("x"), F.radians(y).alias("y")), lambda p: _from_origin(p["x"], p["y"], w))

    def turned(p: Column) -> Column:
        phi, north = p["phi"], F.when((F.abs(p["north"]) <= 1) & (F.abs(p["phi"]) <= math.pi + 1e-12), p["north"])
        level = F.sqrt(F.greatest(F.lit(0.0), 1 - north**2))
        return _sky(level * F.cos(phi), level * F.sin(phi), north, w)

    return bind(native, turned)


def _from_pole(x: Column, y: Column, r: Column, w: Wcs) -> Column:
    along, rho = {
        "TAN": (1 / F.sqrt(1 + r**2), r / F.sqrt(1 + r**2)), "SIN": (F.when(r <= 1, F.sqrt(1 - r**2)), r), "STG": ((4 - r**2) / (4 + r**2), 4 * r / (4 + r**2)),
        "ARC": (F.when(r <= math.pi, F.cos(r)), F.sin(r)), "ZEA": (F.when(r <= 2, 1 - r**2 / 2), r * F.sqrt(1 - r**2 / 4)),
    }[w.code]
    return bind(F.struct(along.alias("s"), _ratio(rho, r).alias("k")), lambda p: _sky(p["s"], p["k"] * x, p["k"] * y, w))


def _from_origin(x: Column, y: Column, w: Wcs) -> Column:
    """Native longitude and the sine of the native latitude, as a struct."""
    if w.code == "AIT":
        z2 = 1 - (x / 4) ** 2 - (y / 2) ** 2
        z = F.when(z2 >= 0.5, F.sqrt(z2))
        phi, north = 2 * F.atan2(z * x / 2, 2 * z2 - 1), y * z
    elif w.code == "HPX":
        part = 2 - F.abs(y) / (math.pi / 4)
        middle = F.radians(-135 + 90 * F.least(F.lit(3), F.floor((F.degrees(x) + 180) / 90)))
        polar = F.abs(y) > math.pi / 4
        phi = F.when(polar, F.when(part > 0, middle + (x - middle) / part).otherwise(middle)).otherwise(x)
        north = F.when(polar, F.signum(y) * (1 - part**2 / 3)).otherwise(y / (3 * math.pi / 8))
        phi = F.when((part >= 0) & (~polar | (F.abs(x - middle) <= part * (math.pi / 4) + 1e-12)), phi)
    else:
        north = {"CAR": F.sin(y), "CEA": y, "MER": F.tanh(y), "SFL": F.sin(y)}[w.code]
        phi = x / F.cos(y) if w.code == "SFL" else x
        if w.code in ("CAR", "SFL"):
            phi = F.when(F.abs(y) <= math.pi / 2, phi)
    return F.struct(phi.alias("phi"), north.alias("north"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where both vanish."""
    return F.when(b > 1e-12, a / b).otherwise(F.lit(1.0))


def sky_to_pixel(lon: Column, lat: Column, w: Wcs) -> tuple[Column, Column]:
    """Pixel coordinates of a position; null off the projection."""
    x, y = project(lon, lat, w)
    c, s = F.cos(F.radians(_c(w.crota2))), F.sin(F.radians(_c(w.crota2)))
    return _c(w.crpix1) + (x * c + y * s) / _c(w.cdelt1), _c(w.crpix2) + (y * c - x * s) / _c(w.cdelt2)


def pixel_vector(i: Column, j: Column, w: Wcs) -> Column:
    """The unit vector (struct x, y, z) of a pixel; its parts are null off the projected sky."""
    c, s = F.cos(F.radians(_c(w.crota2))), F.sin(F.radians(_c(w.crota2)))
    x, y = (i - _c(w.crpix1)) * _c(w.cdelt1), (j - _c(w.crpix2)) * _c(w.cdelt2)
    return unproject(x * c - y * s, x * s + y * c, w)


def pixel_to_sky(i: Column, j: Column, w: Wcs) -> tuple[Column, Column]:
    """The position of a pixel; null off the projected sky."""
    place = bind(pixel_vector(i, j, w), lambda v: F.struct(*[c.alias(n) for c, n in zip(lon_lat(parts(v)), ("lon", "lat"), strict=True)]))
    return F.when(place["lat"].isNotNull(), place["lon"]), place["lat"]
