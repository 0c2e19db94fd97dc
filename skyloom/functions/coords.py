"""Sky coordinates and vector algebra as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rotation from equatorial J2000 to galactic axes (IAU 1958 pole in J2000), row-wise.
GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)
OBLIQUITY = 23.4392911  # degrees, J2000


def unit(lon: Column, lat: Column) -> list[Column]:
    """Unit vector of a position in degrees."""
    a, d = F.radians(lon), F.radians(lat)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def lon_lat(v: list[Column]) -> tuple[Column, Column]:
    """Longitude in [0, 360) and latitude of a vector; null where it is."""
    lon = F.degrees(F.atan2(v[1], v[0]))
    return F.when(lon < 0, lon + 360).otherwise(lon), F.degrees(F.asin(F.when(v[2] > 1, 1.0).when(v[2] < -1, -1.0).otherwise(v[2])))  # greatest and least would skip a null


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``: the optimizer would copy a projected
    column into each use, but not a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector(v: list[Column]) -> Column:
    """The three parts as one struct (x, y, z)."""
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def parts(v: Column) -> list[Column]:
    return [v["x"], v["y"], v["z"]]


def product(*matrices):
    """The matrix of rotations done one after the other, the first one first."""
    out = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    for m in matrices:
        out = tuple(tuple(sum(m[i][k] * out[k][j] for k in range(3)) for j in range(3)) for i in range(3))
    return out


def rotate(v: list[Column], matrix, inverse: bool = False) -> list[Column]:
    rows = list(zip(*matrix, strict=True)) if inverse else matrix
    return [v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in rows]


def equatorial_to_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon_lat(rotate(unit(lon, lat), GALACTIC))


def galactic_to_equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon_lat(rotate(unit(lon, lat), GALACTIC, inverse=True))


def _about_x(degrees: float):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return ((1.0, 0.0, 0.0), (0.0, c, s), (0.0, -s, c))


def equatorial_to_ecliptic(lon: Column, lat: Column, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    return lon_lat(rotate(unit(lon, lat), _about_x(obliquity)))


def ecliptic_to_equatorial(lon: Column, lat: Column, obliquity: float = OBLIQUITY) -> tuple[Column, Column]:
    return lon_lat(rotate(unit(lon, lat), _about_x(obliquity), inverse=True))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two positions in degrees; the dot product is clamped to [-1, 1]."""
    d = dot(unit(lon1, lat1), unit(lon2, lat2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))))


def sexagesimal(value: Column, digits: int = 2) -> Column:
    """Degrees as [-]ddd:mm:ss.ss, rounded once so that seconds never read 60."""
    scale = 10**digits
    n = F.round(F.abs(value) * 3600 * scale).cast("long")
    sec, left = n % (60 * scale), F.floor(n / (60 * scale))
    return F.concat(
        F.when((value < 0) & (n > 0), "-").otherwise(""), F.lpad((F.floor(left / 60)).cast("string"), 3, "0"), F.lit(":"), F.lpad((left % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.floor(sec / scale).cast("string"), 2, "0"), F.lit("."), F.lpad((sec % scale).cast("string"), digits, "0"),
    )


def parse_sexagesimal(text: Column) -> Column:
    """Degrees of [+-]d:m:s (colons or blanks); null where the text is none."""
    pattern = r"^\s*([+-]?)(\d+)[:\s]+(\d+)[:\s]+(\d+(?:\.\d*)?)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    size = F.try_divide(part(2).try_cast("double") * 3600 + part(3).try_cast("double") * 60 + part(4).try_cast("double"), F.lit(3600.0))
    return F.when(part(1) == "-", -size).otherwise(size)


def tan_project(lon: Column, lat: Column, lon0: float, lat0: float, scale: float) -> tuple[Column, Column]:
    """Gnomonic pixel offsets from (lon0, lat0) at ``scale`` degrees a pixel; null beyond 90 degrees."""
    a, d = F.radians(lon - lon0), F.radians(lat)
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    z = s0 * F.sin(d) + c0 * F.cos(d) * F.cos(a)
    x, y = F.cos(d) * F.sin(a), c0 * F.sin(d) - s0 * F.cos(d) * F.cos(a)
    return tuple(F.when(z > 0, F.degrees(q / z) / scale) for q in (-x, y))


def magnitude_to_flux(m: Column, reference: float) -> Column:
    return F.pow(F.lit(10.0), 0.4 * (F.lit(reference) - m))


def interleave(x: Column, y: Column, bits: int = 16) -> Column:
    """Tile id within a base face: the bits of y above those of x, in turn."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1)), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(y.cast("long"), b).bitwiseAND(F.lit(1)), 2 * b + 1))
    return out


def pivot(x: Column, y: Column, x0: float, y0: float, clockwise: bool = False) -> tuple[Column, Column]:
    """Turn by 90 degrees about a point."""
    dx, dy = x - x0, y - y0
    return (x0 + dy, y0 - dx) if clockwise else (x0 - dy, y0 + dx)

#: Supergalactic pole and zero point in galactic longitude and latitude, degrees.
SUPERGALACTIC_POLE, SUPERGALACTIC_ZERO = (47.37, 6.32), 137.37
#: Seconds of arc (or degrees) in units of angle.
UNITS = {"deg": 1.0, "rad": 180 / math.pi, "mrad": 0.18 / math.pi, "arcsec": 1 / 3600, "mas": 1 / 3_600_000}


#: IAU 1976 precession, seconds of arc a Julian century from J2000 and its powers.
ZETA, Z, THETA = (2306.2181, 0.30188, 0.017998), (2306.2181, 1.09468, 0.018203), (2004.3109, -0.42665, -0.041833)
#: Newcomb's precession, seconds of arc a tropical century from B1950 and its powers.
ZETA_B, Z_B, THETA_B = (2304.948, 0.302, 0.0179), (2304.948, 1.093, 0.0192), (2004.255, -0.426, -0.0416)
#: Elliptic terms of aberration in B1950 positions, and the rotation B1950 to J2000 (row-wise).
E_TERMS = (-1.62557e-6, -0.31919e-6, -0.13843e-6)
B1950_TO_J2000 = (
    (0.9999256782, -0.0111820611, -0.0048579477),
    (0.0111820610, 0.9999374784, -0.0000271765),
    (0.0048579479, -0.0000271474, 0.9999881997),
)


def _angles(t: float, series) -> list[float]:
    return [sum(c * t ** (k + 1) for k, c in enumerate(terms)) / 3600 for terms in series]


def _precession(t: float, series, back: bool = False):
    """The rotation of ``t`` centuries from (or ``back`` to) the standard equinox."""
    zeta, z, theta = (math.radians(a) for a in _angles(t, series))
    about_z = lambda a: ((math.cos(a), -math.sin(a), 0.0), (math.sin(a), math.cos(a), 0.0), (0.0, 0.0, 1.0))
    tilt = ((math.cos(theta), 0.0, -math.sin(theta)), (0.0, 1.0, 0.0), (math.sin(theta), 0.0, math.cos(theta)))
    m = product(about_z(zeta), tilt, about_z(z))
    return tuple(zip(*m, strict=True)) if back else m


def precess(lon: Column, lat: Column, year: float, back: bool = False) -> tuple[Column, Column]:
    """Mean equatorial position of J2000 at a Julian epoch (IAU 1976 angles), or ``back``."""
    return lon_lat(rotate(unit(lon, lat), _precession((year - 2000.0) / 100.0, (ZETA, Z, THETA), back)))


def galactic_to_supergalactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Rotation that takes the supergalactic pole to latitude 90 and the zero point to longitude 0."""
    a, d = (math.radians(x) for x in SUPERGALACTIC_POLE)
    pole = (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))
    zero = (math.cos(math.radians(SUPERGALACTIC_ZERO)), math.sin(math.radians(SUPERGALACTIC_ZERO)), 0.0)
    third = (pole[1] * zero[2] - pole[2] * zero[1], pole[2] * zero[0] - pole[0] * zero[2], pole[0] * zero[1] - pole[1] * zero[0])
    return lon_lat(rotate(unit(lon, lat), (zero, third, pole)))


def convert_angle(value: Column, source: str, target: str) -> Column:
    return value * (UNITS[source] / UNITS[target])


def tile_path(order: Column, tile: Column) -> Column:
    """Folder path of a pyramid tile: ten thousand tiles share a folder."""
    return F.concat(F.lit("Norder"), order.cast("string"), F.lit("/Dir"), (F.floor(tile / 10_000) * 10_000).cast("string"), F.lit("/Npix"), tile.cast("string"))


def _supergalactic():
    a, d = (math.radians(x) for x in SUPERGALACTIC_POLE)
    pole = (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))
    zero = (math.cos(math.radians(SUPERGALACTIC_ZERO)), math.sin(math.radians(SUPERGALACTIC_ZERO)), 0.0)
    return zero, (pole[1] * zero[2] - pole[2] * zero[1], pole[2] * zero[0] - pole[0] * zero[2], pole[0] * zero[1] - pole[1] * zero[0]), pole


def besselian_to_julian(lon: Column, lat: Column) -> tuple[Column, Column]:
    """B1950 to J2000 without proper motion: the elliptic terms go, then one rotation."""
    return convert(lon, lat, "EQUB", "EQUJ")


def julian_to_besselian(lon: Column, lat: Column) -> tuple[Column, Column]:
    """J2000 to B1950."""
    return convert(lon, lat, "EQUJ", "EQUB")


def obliquity(year: float) -> float:
    """Mean obliquity of the ecliptic at a Julian epoch (IAU 1976)."""
    t = (year - 2000.0) / 100.0
    return OBLIQUITY - (46.8150 * t + 0.00059 * t**2 - 0.001813 * t**3) / 3600


SYSTEMS = ("EQUJ", "EQUB", "ECLJ", "ECLB", "GAL", "SGAL")


def convert(lon: Column, lat: Column, source: str, target: str, source_epoch: float | None = None, target_epoch: float | None = None) -> tuple[Column, Column]:
    """A position in another system: EQUJ and ECLJ at a Julian epoch (2000 where none is given), EQUB and
    ECLB at a Besselian one (1950), GAL and SGAL. Everything goes over J2000."""
    found = place(lon, lat, source, target, source_epoch, target_epoch)
    return found["lon"], found["lat"]


def place(lon: Column, lat: Column, source: str, target: str, source_epoch: float | None = None, target_epoch: float | None = None) -> Column:
    """As :func:`convert`, as one struct (lon, lat). In numpy: as an expression, each use of a part would work out
    all steps before it again, in code too long to be compiled."""
    for name in (source, target):
        if name not in SYSTEMS:
            raise ValueError(f"no system {name!r}; there are {', '.join(SYSTEMS)}")
    usual = lambda name, epoch: epoch if epoch is not None else 1950.0 if name.endswith("B") else 2000.0
    a, b = usual(source, source_epoch), usual(target, target_epoch)
    if (source, a) == (target, b):
        return F.struct(lon.alias("lon"), lat.alias("lat"))
    turned = lambda m: tuple(zip(*m, strict=True))
    newcomb, julian = (ZETA_B, Z_B, THETA_B), (ZETA, Z, THETA)

    def from_standard(name: str, epoch: float):
        """From B1950 for the Besselian systems and from J2000 for the others: rotations only."""
        if name == "GAL":
            return GALACTIC
        if name == "SGAL":
            return product(GALACTIC, _supergalactic())
        t = (epoch - (1950.0 if name.endswith("B") else 2000.0)) / 100.0
        moved = _precession(t, newcomb if name.endswith("B") else julian)
        return product(moved, _about_x(obliquity(epoch))) if name.startswith("ECL") else moved

    first, last = np.array(turned(from_standard(source, a))), np.array(from_standard(target, b))
    to_julian, to_besselian = source.endswith("B") and not target.endswith("B"), target.endswith("B") and not source.endswith("B")
    moved, terms = np.array(B1950_TO_J2000), np.array(E_TERMS)[:, None]

    def run(lon: pa.Array, lat: pa.Array) -> pa.Array:
        blank = np.array(pc.or_(lon.is_null(), lat.is_null()).to_numpy(zero_copy_only=False), bool)
        x, y = (np.radians(c.to_numpy(zero_copy_only=False).astype(float)) for c in (lon, lat))
        v = first @ np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])
        if to_julian:  # the elliptic terms go, then one rotation
            v = moved @ (v - terms + (v * terms).sum(axis=0) * v)
        elif to_besselian:  # the terms depend on the position that has them, which three rounds settle
            free = placed = moved.T @ v
            for _ in range(3):
                placed = free + terms - (placed * terms).sum(axis=0) * placed
            v = placed
        v = last @ v
        v /= np.sqrt((v * v).sum(axis=0))
        east = np.degrees(np.arctan2(v[1], v[0]))
        columns = np.where(east < 0, east + 360, east), np.degrees(np.arcsin(np.clip(v[2], -1, 1)))
        return pa.StructArray.from_arrays([pa.array(c, mask=blank) for c in columns], names=["lon", "lat"])

    return F.arrow_udf(run, "lon double, lat double")(lon.cast("double"), lat.cast("double"))


def hours(value: Column, digits: int = 2) -> Column:
    """Degrees as hh:mm:ss.ss of right ascension."""
    scale = 10**digits
    n = F.round(F.pmod(value, F.lit(360.0)) * 240 * scale).cast("long") % (86400 * scale)
    cell = lambda x, k: F.lpad(x.cast("string"), k, "0")
    return F.concat(cell(F.floor(n / (3600 * scale)), 2), F.lit(":"), cell(F.floor(n / (60 * scale)) % 60, 2), F.lit(":"), cell(F.floor(n / scale) % 60, 2), F.lit("."), cell(n % scale, digits))


def parse_position(text: Column) -> Column:
    """(lon, lat, system, epoch) in degrees of strings such as ``10:41:04.0 +41d16m09s EQUB B1950``,
    ``12.5 -3.25 gal`` or ``10h41m4s 41.5``. A longitude with colons or ``h`` is in hours unless the
    system is not equatorial. Without a system it is EQUJ, without an epoch its usual one; null
    where the text is no position."""
    word = F.split(F.trim(F.regexp_replace(text, r"[\s,]+", " ")), " ")
    lon, lat, third, fourth = (F.get(word, F.lit(k)) for k in range(4))
    named = third.rlike("(?i)^(equ?|ecl?|gal|sgal)")
    first = F.upper(F.when(named, third).otherwise(F.lit("EQUJ")))
    mark = F.upper(F.coalesce(F.when(named, fourth).otherwise(third), F.lit("")))
    system = (
        F.when(first.startswith("SG"), "SGAL").when(first.startswith("GA"), "GAL")
        .otherwise(F.concat(F.when(first.startswith("EC"), "ECL").otherwise("EQU"), F.when(F.right(first, F.lit(1)).eqNullSafe("B") | mark.startswith("B"), "B").otherwise("J")))
    )
    epoch = F.coalesce(F.regexp_extract(mark, r"^[BJ]?(\d+(?:\.\d*)?)$", 1).try_cast("double"), F.when(system.endswith("B"), 1950.0).when(system.endswith("J"), 2000.0))

    def angle(s: Column) -> Column:
        cells = F.split(F.regexp_replace(F.regexp_replace(F.lower(s), r"^[+-]", ""), r"[dhms]$", ""), r"[:dhm]")
        value = [F.get(cells, F.lit(k)).try_cast("double") for k in range(3)]
        size = value[0] + F.when(F.size(cells) > 1, value[1]).otherwise(0.0) / 60 + F.when(F.size(cells) > 2, value[2]).otherwise(0.0) / 3600
        return F.when(F.size(cells) <= 3, F.when(s.startswith("-"), -size).otherwise(size))

    turned = F.when(F.lower(lon).rlike("[:h]") & ~F.lower(lon).contains("d") & system.startswith("EQU"), 15.0).otherwise(1.0)
    x, y = angle(lon) * turned, angle(lat)
    return F.when(x.isNotNull() & (F.abs(y) <= 90) & (F.size(word) <= 4), F.struct(x.alias("lon"), y.alias("lat"), system.alias("system"), epoch.alias("epoch")))
