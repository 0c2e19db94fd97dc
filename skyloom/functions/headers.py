"""Arithmetic and checks on image headers, as maps of keyword to text (columns or Python dicts)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords that place an image on the sky.
NEEDED = ("NAXIS1", "NAXIS2", "CTYPE1", "CTYPE2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")
#: Known projection codes.
KNOWN = ("LIN", "AZP", "TAN", "SIN", "STG", "ARC", "ZPN", "ZEA", "AIR", "CYP", "CAR", "MER", "CEA", "COP", "COD", "COE", "COO", "BON", "PCO", "SFL", "PAR", "AIT", "MOL", "CSC", "QSC", "TSC", "HPX", "GLS", "NCP")
#: Named colours as red, green, blue.
COLOURS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0),
    "magenta": (255, 0, 255), "cyan": (0, 255, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "orange": (255, 165, 0), "purple": (128, 0, 128),
}


def header_errors(header: Column) -> Column:
    """What is wrong with a header: an array of messages, empty where it can be used."""
    value = lambda k: F.element_at(header, F.lit(k))
    number = lambda k: value(k).try_cast("double")
    checks = [F.when(value(k).isNull(), F.lit(f"no {k}")) for k in NEEDED]
    checks += [F.when(value(k).isNotNull() & number(k).isNull(), F.lit(f"{k} is no number")) for k in NEEDED if not k.startswith("CTYPE")]
    checks += [F.when(number(k) < 1, F.lit(f"{k} is below 1")) for k in ("NAXIS1", "NAXIS2")]
    checks += [F.when(value(k).isNotNull() & ~F.right(F.trim(value(k)), F.lit(3)).isin(*KNOWN), F.lit(f"{k} has an unknown projection")) for k in ("CTYPE1", "CTYPE2")]
    scale = number("CDELT1").isNull() & number("CD1_1").isNull() & number("PC1_1").isNull()
    checks += [F.when(scale, F.lit("no pixel scale")), F.when(F.abs(number("CRVAL2")) > 90, F.lit("CRVAL2 is no latitude"))]
    return F.filter(F.array(*checks), lambda m: m.isNotNull())


def set_keywords(header: Column, values: dict[str, Column]) -> Column:
    """A header with some keywords replaced or added."""
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return F.map_concat(F.map_filter(header, lambda k, _: ~k.isin(*values)), own)


def replace_header(header: Column, template: Column) -> Column:
    """The template's keywords with the data's own size and type, as they describe the stored pixels."""
    stored = ("SIMPLE", "XTENSION", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "NAXIS4", "BSCALE", "BZERO", "BLANK")
    return F.map_concat(F.map_filter(template, lambda k, _: ~k.isin(*stored)), F.map_filter(header, lambda k, _: k.isin(*stored)))


def fixed_line(line: Column) -> Column:
    """A header line as a card: upper-case keyword in eight characters, ``= `` and the value; comments, END and blank
    lines stay. Lines without ``=`` after the keyword get it where they hold two words."""
    found = r"^\s*([A-Za-z0-9_-]{1,8})\s*=\s*(.*?)\s*$"
    key, value = F.upper(F.regexp_extract(line, found, 1)), F.regexp_extract(line, found, 2)
    loose = r"^\s*([A-Za-z0-9_-]{1,8})\s+(\S+)\s*$"
    plain = F.trim(line)
    return (
        F.when(plain.rlike("(?i)^(END|COMMENT|HISTORY)") | (plain == ""), plain)
        .when(line.rlike(found), F.concat(F.rpad(key, 8, " "), F.lit("= "), value))
        .when(line.rlike(loose), F.concat(F.rpad(F.upper(F.regexp_extract(line, loose, 1)), 8, " "), F.lit("= "), F.regexp_extract(line, loose, 2)))
        .otherwise(plain)
    )


def header_text(header: Column) -> Column:
    """A header as lines of cards in order of their keywords, END last."""
    cards = F.transform(F.sort_array(F.map_entries(header)), lambda e: F.concat(F.rpad(e["key"], 8, " "), F.lit("= "), e["value"]))
    return F.concat_ws("\n", cards, F.array(F.lit("END")))


def cutout_keywords(naxis1: Column, naxis2: Column, crpix1: Column, crpix2: Column, i0: Column, j0: Column, width: Column, height: Column) -> list[Column]:
    """(naxis1, naxis2, crpix1, crpix2) of a box that begins at pixel (i0, j0), counted from 0, cut at the image's edge."""
    left, low = F.greatest(i0, F.lit(0)), F.greatest(j0, F.lit(0))
    right, high = F.least(i0 + width, naxis1), F.least(j0 + height, naxis2)
    return [F.greatest(right - left, F.lit(0)), F.greatest(high - low, F.lit(0)), crpix1 - left, crpix2 - low]


def tile_keywords(naxis1: Column, naxis2: Column, crpix1: Column, crpix2: Column, nx: int, ny: int, ix: Column, iy: Column, xpad: int = 0, ypad: int = 0) -> list[Column]:
    """(naxis1, naxis2, crpix1, crpix2) of tile (ix, iy) of nx x ny, each ``xpad`` and ``ypad`` pixels wider on its inner
    sides. Tiles have equal sizes, rounded up; the last ones take what is left."""
    def axis(n: Column, count: int, k: Column, pad: int, ref: Column) -> tuple[Column, Column]:
        size = F.ceil(n / count)
        low, high = F.greatest(k * size - pad, F.lit(0)), F.least((k + 1) * size + pad, n)
        return F.greatest(high - low, F.lit(0)), ref - low

    (n1, r1), (n2, r2) = axis(naxis1, nx, ix, xpad, crpix1), axis(naxis2, ny, iy, ypad, crpix2)
    return [n1, n2, r1, r2]


def shrunken_keywords(naxis1: Column, naxis2: Column, crpix1: Column, crpix2: Column, cdelt1: Column, cdelt2: Column, most: int = 200) -> list[Column]:
    """(naxis1, naxis2, crpix1, crpix2, cdelt1, cdelt2) of an image shrunk so that no side is above ``most`` pixels; smaller ones stay."""
    factor = F.greatest(F.lit(1.0), F.greatest(naxis1, naxis2) / most)
    return [F.ceil(naxis1 / factor - 1e-9), F.ceil(naxis2 / factor - 1e-9), (crpix1 - 0.5) / factor + 0.5, (crpix2 - 0.5) / factor + 0.5, cdelt1 * factor, cdelt2 * factor]


def shifted_keywords(crval1: Column, crval2: Column, d_ra: Column, d_dec: Column) -> list[Column]:
    """Reference position after a pointing correction in seconds of arc on the sky."""
    lat = crval2 + d_dec / 3600
    return [F.pmod(crval1 + d_ra / 3600 / F.cos(F.radians(crval2)), F.lit(360.0)), lat]


def file_name(path: Column) -> Column:
    """What stands after the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_path(folder: Column, name: Column) -> Column:
    """A name within a folder; absolute names and an empty folder stand alone."""
    return F.when(name.startswith("/") | (F.trim(F.coalesce(folder, F.lit(""))) == ""), name).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(name, r"^(\./)+", "")))


def colour(text: Column) -> list[Column]:
    """Red, green and blue of a colour's name or hex digits with or without ``#``; null where it is neither."""
    name = F.lower(F.trim(text))
    digits = F.regexp_extract(name, "^#?([0-9a-f]{6})$", 1)
    out = []
    for k in range(3):
        value = F.when(digits != "", F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int"))
        for c, rgb in COLOURS.items():
            value = F.when(name == c, F.lit(rgb[k])).otherwise(value)
        out.append(value)
    return out


def spherical_area(corners: Column) -> Column:
    """Area in steradians of a convex polygon of unit vectors (an array of structs x, y, z): the sum of its
    angles less that of a plane one (Girard). Corners that repeat the one before are left out."""
    n = F.size(corners)
    d = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    own = F.filter(corners, lambda p, k: d(p, F.get(corners, (k + n - 1) % n)) < 1 - 1e-14)

    def angle(p: Column, k: Column) -> Column:
        m = F.size(own)
        before, after = F.get(own, (k + m - 1) % m), F.get(own, (k + 1) % m)
        c = d(before, after) - d(before, p) * d(p, after)
        s = F.sqrt((1 - d(before, p) ** 2) * (1 - d(p, after) ** 2))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / s)))

    whole = F.aggregate(F.transform(own, angle), F.lit(0.0), lambda s, a: s + a)
    return F.when(F.size(own) >= 3, whole - (F.size(own) - 2) * math.pi).otherwise(0.0)
