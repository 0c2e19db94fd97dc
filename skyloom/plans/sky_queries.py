"""Registered queries of projections, footprints, coordinate systems, headers, photometry and stretches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import coords, headers, projections, stretches
from skyloom.operators import background, fits, footprints, photometry, pixels
from skyloom.plans.queries import _ONE, _edges, _one, _r, _table, _uv, _with, query
from skyloom.plans.views import sql, view

# --- projections ---------------------------------------------------------------------------------

#: (lon, lat) of the reference point, pixel, scale and rotation that the queries use.
_WCS = (120.0, 10.0, 50.0, 60.0, -0.1, 0.1, 15.0)
_NATIVE = """SELECT cntr, ra, dec, sin(radians(dec)) * sin(radians(10e0)) + cos(radians(dec)) * cos(radians(10e0)) * cos(radians(ra - 120)) AS s, cos(radians(dec)) * sin(radians(ra - 120)) AS e,
  sin(radians(dec)) * cos(radians(10e0)) - cos(radians(dec)) * sin(radians(10e0)) * cos(radians(ra - 120)) AS n FROM stars"""
#: east and north in radians of a direction (s along the reference point, e, n) with native angles p and t
_PLANE = {
    "TAN": ("e / s", "n / s"), "SIN": ("e", "n"), "STG": ("2 * e / (1 + s)", "2 * n / (1 + s)"), "ARC": ("acos(s) * e / sqrt(e * e + n * n)", "acos(s) * n / sqrt(e * e + n * n)"),
    "ZEA": ("e * sqrt(2 / (1 + s))", "n * sqrt(2 / (1 + s))"), "CAR": ("p", "t"), "CEA": ("p", "n"), "MER": ("p", "ln(tan(pi() / 4 + t / 2))"), "SFL": ("p * cos(t)", "t"),
    "AIT": ("2 * sqrt(2 / (1 + cos(t) * cos(p / 2))) * cos(t) * sin(p / 2)", "sqrt(2 / (1 + cos(t) * cos(p / 2))) * n"),
    "HPX": ("CASE WHEN abs(n) <= 2e0 / 3 THEN p ELSE radians(-135 + 90 * floor((degrees(p) + 180) / 90)) + (p - radians(-135 + 90 * floor((degrees(p) + 180) / 90))) * sqrt(3 * (1 - abs(n))) END",
            "CASE WHEN abs(n) <= 2e0 / 3 THEN n * 3 * pi() / 8 ELSE sign(n) * pi() / 4 * (2 - sqrt(3 * (1 - abs(n)))) END"),
}


def _projected(code: str) -> str:
    x, y = _PLANE[code]
    return f"""SELECT cntr, '{code}' AS code, round(50 + (x * cos(radians(15e0)) + y * sin(radians(15e0))) / -0.1e0, 3) AS x, round(60 + (y * cos(radians(15e0)) - x * sin(radians(15e0))) / 0.1e0, 3) AS y
  FROM (SELECT cntr, degrees({x}) AS x, degrees({y}) AS y FROM nat)"""


@query("f12_sky_to_pixel", _with(f"nat AS (SELECT *, atan2(e, s) AS p, asin(n) AS t FROM ({_NATIVE}) WHERE s > 0.1) " + " UNION ALL ".join(map(_projected, projections.CODES))))
def _(spark, sf_dir):
    s, out = view(spark, sf_dir, "stars"), None
    s = s.filter(coords.dot(coords.unit(F.col("ra"), F.col("dec")), coords.unit(F.lit(120.0), F.lit(10.0))) > 0.1)
    for code in projections.CODES:
        x, y = projections.sky_to_pixel(F.col("ra"), F.col("dec"), projections.Wcs(code, *_WCS))
        one = s.select("cntr", F.lit(code).alias("code"), _r(x, 3).alias("x"), _r(y, 3).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


@query("f12_pixel_to_sky", _with(f"nat AS ({_NATIVE}) SELECT cntr, code, round(ra, 5) AS ra, round(dec, 5) AS dec FROM nat, (SELECT unnest([{', '.join(map(repr, projections.CODES))}]) AS code) WHERE s > 0.1"))
def _(spark, sf_dir):
    s, out = view(spark, sf_dir, "stars"), None
    s = s.filter(coords.dot(coords.unit(F.col("ra"), F.col("dec")), coords.unit(F.lit(120.0), F.lit(10.0))) > 0.1)
    for code in projections.CODES:
        w = projections.Wcs(code, *_WCS)
        x, y = projections.sky_to_pixel(F.col("ra"), F.col("dec"), w)
        there = s.select("cntr", x.alias("x"), y.alias("y"))
        ra, dec = projections.pixel_to_sky(F.col("x"), F.col("y"), w)
        one = there.select("cntr", F.lit(code).alias("code"), _r(ra, 5).alias("ra"), _r(dec, 5).alias("dec"))
        out = one if out is None else out.unionByName(one)
    return out


# --- footprints ----------------------------------------------------------------------------------

_HALF = 8.0


def _polygons(half: float = _HALF, table: str = "sky") -> str:
    """Corners, edges with unit normals and centres of north-up squares."""
    t = math.tan(math.radians(half))
    return f"""cor AS (SELECT cntr, k, cx, cy, cz, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM (SELECT cntr, k, cx, cy, cz,
  cx + dx * {t!r} * -sin(radians(ra)) + dy * {t!r} * -sin(radians(dec)) * cos(radians(ra)) AS x, cy + dx * {t!r} * cos(radians(ra)) + dy * {t!r} * -sin(radians(dec)) * sin(radians(ra)) AS y, cz + dy * {t!r} * cos(radians(dec)) AS z
  FROM (SELECT cntr, ra, dec, {_uv(p='c')} FROM {table}), (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) AS o(k, dx, dy)))),
edn AS (SELECT a.cntr, a.k, a.cx, a.cy, a.cz, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz
  FROM cor a JOIN cor b ON a.cntr = b.cntr AND b.k = (a.k + 1) % 4),
ed AS (SELECT * REPLACE (nx / l AS nx, ny / l AS ny, nz / l AS nz) FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM edn))"""


def _inside(points: str, p: str = "p") -> str:
    """(one, k, other): points (one, k, x, y, z) that a square holds."""
    d = f"e.nx * {p}.x + e.ny * {p}.y + e.nz * {p}.z"
    return f"SELECT {p}.one, {p}.k, e.cntr AS other FROM {points} {p}, ed e WHERE e.cx * {p}.x + e.cy * {p}.y + e.cz * {p}.z > 0 GROUP BY {p}.one, {p}.k, e.cntr HAVING bool_and({d} <= 1e-12) OR bool_and({d} >= -1e-12)"


_OVERLAP = f"""{_polygons()}, pts AS (SELECT cntr AS one, k, x, y, z FROM cor), ins AS ({_inside('pts')}),
crs AS (SELECT a.cntr AS one, b.cntr AS other FROM ed a JOIN ed b ON a.cntr < b.cntr WHERE (a.nx*b.ax + a.ny*b.ay + a.nz*b.az) * (a.nx*b.bx + a.ny*b.by_ + a.nz*b.bz) < 0 AND (b.nx*a.ax + b.ny*a.ay + b.nz*a.az) * (b.nx*a.bx + b.ny*a.by_ + b.nz*a.bz) < 0
  AND ((a.ny*b.nz - a.nz*b.ny) * (a.ax + a.bx) + (a.nz*b.nx - a.nx*b.nz) * (a.ay + a.by_) + (a.nx*b.ny - a.ny*b.nx) * (a.az + a.bz)) * ((a.ny*b.nz - a.nz*b.ny) * (b.ax + b.bx) + (a.nz*b.nx - a.nx*b.nz) * (b.ay + b.by_) + (a.nx*b.ny - a.ny*b.nx) * (b.az + b.bz)) > 0)"""


def _squares(spark, sf_dir, half: float = _HALF):
    s = view(spark, sf_dir, "sky")
    return s.select("cntr", "ra", "dec", footprints.square(F.col("ra"), F.col("dec"), half).alias("corners"))


@query("j01_overlap", _with(_OVERLAP + " SELECT DISTINCT least(one, other) AS plus, greatest(one, other) AS minus FROM (SELECT one, other FROM ins WHERE one <> other UNION ALL SELECT one, other FROM crs)"))
def _(spark, sf_dir):
    return footprints.overlaps(_squares(spark, sf_dir), 1.5 * _HALF)


_STEPS = 6
_BOUNDARY = f"""pts AS (SELECT one, k, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM (SELECT cntr AS one, k * {_STEPS} + s AS k,
  ax + (bx - ax) * s / {_STEPS}e0 AS x, ay + (by_ - ay) * s / {_STEPS}e0 AS y, az + (bz - az) * s / {_STEPS}e0 AS z FROM ed, (SELECT unnest(range({_STEPS}))::INT AS s))))"""


@query("j02_overlap_by_boundary", _with(f"{_polygons()}, {_BOUNDARY}, ins AS ({_inside('pts')}) SELECT DISTINCT least(one, other) AS plus, greatest(one, other) AS minus FROM ins WHERE one <> other"))
def _(spark, sf_dir):
    return footprints.overlaps_by_boundary(_squares(spark, sf_dir), 1.5 * _HALF, _STEPS)


_TEMPLATE = [(118.0, 5.0), (130.0, 5.0), (130.0, 20.0), (118.0, 20.0)]


def _template() -> str:
    rows = ", ".join(f"({k}, {a!r}, {d!r})" for k, (a, d) in enumerate(_TEMPLATE))
    return f"""tc AS (SELECT k, cos(radians(d)) * cos(radians(a)) AS x, cos(radians(d)) * sin(radians(a)) AS y, sin(radians(d)) AS z FROM (VALUES {rows}) AS t(k, a, d)),
te AS (SELECT * REPLACE (nx / l AS nx, ny / l AS ny, nz / l AS nz) FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM (SELECT a.k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz FROM tc a JOIN tc b ON b.k = (a.k + 1) % 4)))"""


def _in_template(points: str) -> str:
    d = "e.nx * p.x + e.ny * p.y + e.nz * p.z"
    return f"SELECT one AS cntr FROM {points} p, te e, (SELECT sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM tc) WHERE sx * p.x + sy * p.y + sz * p.z > 0 GROUP BY one, p.k HAVING bool_and({d} <= 1e-12) OR bool_and({d} >= -1e-12)"


_HOLDS = f"SELECT other AS cntr FROM ({_inside('(SELECT -1 AS one, k, x, y, z FROM tc)')})"


@query("p04_subset", _with(f"{_polygons()}, {_template()}, pts AS (SELECT cntr AS one, k, x, y, z FROM cor) SELECT DISTINCT cntr FROM ({_in_template('pts')} UNION ALL {_HOLDS})"))
def _(spark, sf_dir):
    return footprints.subset(_squares(spark, sf_dir), footprints.polygon_of(_TEMPLATE)).select("cntr")


@query("p04_subset_by_boundary", _with(f"{_polygons()}, {_template()}, {_BOUNDARY} SELECT DISTINCT cntr FROM ({_in_template('pts')} UNION ALL {_HOLDS})"))
def _(spark, sf_dir):
    return footprints.subset(_squares(spark, sf_dir), footprints.polygon_of(_TEMPLATE), _STEPS).select("cntr")


_POINT = "(SELECT -1 AS one, 0 AS k, cos(radians(10e0)) * cos(radians(120e0)) AS x, cos(radians(10e0)) * sin(radians(120e0)) AS y, sin(radians(10e0)) AS z)"
_CIRCLE = f"""SELECT 'circle' AS mode, cntr FROM (SELECT e.cntr, CASE WHEN ((ny*az - nz*ay) * x + (nz*ax - nx*az) * y + (nx*ay - ny*ax) * z) >= 0 AND ((by_*nz - bz*ny) * x + (bz*nx - bx*nz) * y + (bx*ny - by_*nx) * z) >= 0
  THEN degrees(asin(least(1, abs(nx*x + ny*y + nz*z)))) ELSE least(degrees(acos(least(1, ax*x + ay*y + az*z))), degrees(acos(least(1, bx*x + by_*y + bz*z)))) END AS d FROM ed e, {_POINT} p) WHERE d <= 6 GROUP BY cntr"""


@query("p05_coverage", _with(f"{_polygons()}, {_template()}, held AS (SELECT other AS cntr FROM ({_inside(_POINT)})) SELECT 'point' AS mode, cntr FROM held UNION ALL SELECT DISTINCT mode, cntr FROM ({_CIRCLE} UNION ALL SELECT 'circle', cntr FROM held)"))
def _(spark, sf_dir):
    s = _squares(spark, sf_dir)
    modes = [(m, footprints.covers(s, m, [(120.0, 10.0)], r)) for m, r in (("point", 0.0), ("circle", 6.0))]
    return modes[0][1].select(F.lit("point").alias("mode"), "cntr").unionByName(modes[1][1].select(F.lit("circle").alias("mode"), "cntr"))


@query("j09_best_images", _with(f"""{_polygons()}, pts AS (SELECT cntr AS one, 0 AS k, {_uv()} FROM stars),
 m AS (SELECT p.one AS cntr, e.cntr AS image, degrees(asin(greatest(min(e.nx * p.x + e.ny * p.y + e.nz * p.z), -max(e.nx * p.x + e.ny * p.y + e.nz * p.z)))) AS margin FROM pts p, ed e WHERE e.cx * p.x + e.cy * p.y + e.cz * p.z > 0 GROUP BY 1, 2)
 SELECT cntr, image, round(margin, 5) AS margin FROM m WHERE margin >= 0 QUALIFY row_number() OVER (PARTITION BY cntr ORDER BY margin DESC, image) = 1"""))
def _(spark, sf_dir):
    return footprints.best_images(_squares(spark, sf_dir), view(spark, sf_dir, "stars"), 1.5 * _HALF).withColumn("margin", _r("margin", 5))


@query("j11_covering_footprints", _with(f"{_polygons()}, pts AS (SELECT cntr AS one, 0 AS k, {_uv()} FROM stars), ins AS ({_inside('pts')}) SELECT one AS cntr, count(*) AS n FROM ins GROUP BY one"))
def _(spark, sf_dir):
    return footprints.covering_count(_squares(spark, sf_dir), view(spark, sf_dir, "stars"), 1.5 * _HALF)


def _headers(spark, sf_dir):
    """A header a position of the sky."""
    s = view(spark, sf_dir, "sky")
    values = {"NAXIS1": F.col("cntr") % 50 + 100, "NAXIS2": F.col("cntr") % 30 + 80, "CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.lit("DEC--TAN"), "CRVAL1": F.col("ra"), "CRVAL2": F.col("dec"), "CRPIX1": F.lit(20.5), "CRPIX2": F.lit(30.5), "CDELT1": F.lit(-0.05), "CDELT2": F.lit(0.05)}
    header = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return s.select("cntr", F.concat(F.lit("im"), "cntr", F.when(F.col("cntr") % 9 == 0, "_area").otherwise(""), F.lit(".fits")).alias("path"), F.lit(0).alias("hdu"), header.alias("header"))


def _corner_sql(i: str, j: str, name: str) -> str:
    x, y = f"(radians(({i} - 20.5e0) * -0.05e0))", f"(radians(({j} - 30.5e0) * 0.05e0))"
    return f"""round((ra + degrees(atan2({x}, cos(radians(dec)) - {y} * sin(radians(dec)))) + 720) % 360, 6) AS ra{name}, round(degrees(asin((sin(radians(dec)) + {y} * cos(radians(dec))) / sqrt(1 + {x} * {x} + {y} * {y}))), 6) AS dec{name}"""


@query("s08_image_index", sql("SELECT 'im' || cntr || '.fits' AS path, n1 AS naxis1, n2 AS naxis2, " + ", ".join(_corner_sql(i, j, k) for k, i, j in (("", "((n1 + 1) / 2e0)", "((n2 + 1) / 2e0)"), ("1", "0.5e0", "0.5e0"), ("3", "(n1 + 0.5e0)", "(n2 + 0.5e0)"))) + " FROM (SELECT *, (cntr % 50 + 100)::DOUBLE AS n1, (cntr % 30 + 80)::DOUBLE AS n2 FROM sky) WHERE cntr % 9 <> 0"))
def _(spark, sf_dir):
    found = footprints.index_images(_headers(spark, sf_dir))
    return found.select("path", "naxis1", "naxis2", *[_r(c, 6).alias(c) for c in ("ra", "dec", "ra1", "dec1", "ra3", "dec3")])


@query("p13_header_check", sql("SELECT cntr, CASE WHEN cntr % 5 = 0 THEN 'no CRPIX1' WHEN cntr % 7 = 0 THEN 'CTYPE1 has an unknown projection' ELSE '' END AS errors FROM sky"))
def _(spark, sf_dir):
    h = _headers(spark, sf_dir)
    broken = F.when(F.col("cntr") % 5 == 0, F.map_filter("header", lambda k, _: k != "CRPIX1")).when(F.col("cntr") % 7 == 0, headers.set_keywords(F.col("header"), {"CTYPE1": F.lit("RA---XYZ")})).otherwise(F.col("header"))
    return h.select("cntr", F.array_join(headers.header_errors(broken), "; ").alias("errors"))


@query("a21_bounding_circle", sql(f"""SELECT field, round((degrees(atan2(sy, sx)) + 360) % 360, 5) AS ra, round(degrees(asin(sz / sqrt(sx*sx + sy*sy + sz*sz))), 5) AS dec, round(degrees(acos(min((x*sx + y*sy + z*sz) / sqrt(sx*sx + sy*sy + sz*sz)))), 4) AS radius
  FROM (SELECT *, sum(x) OVER f AS sx, sum(y) OVER f AS sy, sum(z) OVER f AS sz FROM (SELECT floor(ra / 30)::INT * 10 + floor((dec + 90) / 30)::INT AS field, {_uv()} FROM stars) WINDOW f AS (PARTITION BY field)) GROUP BY field, sx, sy, sz"""))
def _(spark, sf_dir):
    s = view(spark, sf_dir, "stars").withColumn("field", (F.floor(F.col("ra") / 30) * 10 + F.floor((F.col("dec") + 90) / 30)).cast("int"))
    return footprints.bounding_circles(s, "field").select("field", _r("ra", 5).alias("ra"), _r("dec", 5).alias("dec"), _r("radius").alias("radius"))


@query("f17_spherical_area", _with(f"""{_polygons()}, ang AS (SELECT a.cntr, acos(((p.x*n.x + p.y*n.y + p.z*n.z) - (p.x*a.x + p.y*a.y + p.z*a.z) * (a.x*n.x + a.y*n.y + a.z*n.z)) / sqrt((1 - (p.x*a.x + p.y*a.y + p.z*a.z) ** 2) * (1 - (a.x*n.x + a.y*n.y + a.z*n.z) ** 2))) AS w
  FROM cor a JOIN cor p ON p.cntr = a.cntr AND p.k = (a.k + 3) % 4 JOIN cor n ON n.cntr = a.cntr AND n.k = (a.k + 1) % 4) SELECT cntr, round(sum(w) - 2 * pi(), 7) AS area FROM ang GROUP BY cntr"""))
def _(spark, sf_dir):
    return _squares(spark, sf_dir).select("cntr", _r(headers.spherical_area(F.col("corners")), 7).alias("area"))


# --- headers -------------------------------------------------------------------------------------

_SIZE = "SELECT cntr, cntr % 50 + 100 AS n1, cntr % 30 + 80 AS n2 FROM sky"


def _sizes(spark, sf_dir):
    return view(spark, sf_dir, "sky").select("cntr", (F.col("cntr") % 50 + 100).alias("n1"), (F.col("cntr") % 30 + 80).alias("n2"))


@query("p12_header_cutout", sql(f"SELECT cntr, greatest(least(90, n1) - 10, 0) AS n1, greatest(least(95, n2), 0) AS n2, 10.5e0 AS r1, 30.5e0 AS r2 FROM ({_SIZE})"))
def _(spark, sf_dir):
    c = headers.cutout_keywords(F.col("n1"), F.col("n2"), F.lit(20.5), F.lit(30.5), F.lit(10), F.lit(-5), F.lit(80), F.lit(100))
    return _sizes(spark, sf_dir).select("cntr", *[x.alias(n) for x, n in zip(c, ("n1", "n2", "r1", "r2"), strict=True)])


@query("f25_tile_header", sql(f"""SELECT cntr, ix, iy, greatest(least((ix + 1) * w + 2, n1) - greatest(ix * w - 2, 0), 0)::BIGINT AS n1, greatest(least((iy + 1) * h + 1, n2) - greatest(iy * h - 1, 0), 0)::BIGINT AS n2, 20.5e0 - greatest(ix * w - 2, 0) AS r1, 30.5e0 - greatest(iy * h - 1, 0) AS r2
  FROM (SELECT *, ceil(n1 / 4e0) AS w, ceil(n2 / 3e0) AS h FROM ({_SIZE})), (SELECT unnest(range(4)) AS ix), (SELECT unnest(range(3)) AS iy)"""))
def _(spark, sf_dir):
    s = _sizes(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("ix")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("iy"))
    c = headers.tile_keywords(F.col("n1"), F.col("n2"), F.lit(20.5), F.lit(30.5), 4, 3, F.col("ix"), F.col("iy"), 2, 1)
    return s.select("cntr", "ix", "iy", *[x.alias(n) for x, n in zip(c, ("n1", "n2", "r1", "r2"), strict=True)])


@query("f26_shrunken_header", sql(f"SELECT cntr, ceil(n1 / f - 1e-9)::BIGINT AS n1, ceil(n2 / f - 1e-9)::BIGINT AS n2, round(20 / f + 0.5e0, 6) AS r1, round(30 / f + 0.5e0, 6) AS r2, round(-0.05e0 * f, 8) AS d1, round(0.05e0 * f, 8) AS d2 FROM (SELECT *, greatest(1, greatest(n1, n2) / 64e0) AS f FROM ({_SIZE}))"))
def _(spark, sf_dir):
    c = headers.shrunken_keywords(F.col("n1"), F.col("n2"), F.lit(20.5), F.lit(30.5), F.lit(-0.05), F.lit(0.05), 64)
    return _sizes(spark, sf_dir).select("cntr", c[0].alias("n1"), c[1].alias("n2"), *[_r(x, k).alias(n) for x, n, k in zip(c[2:], ("r1", "r2", "d1", "d2"), (6, 6, 8, 8), strict=True)])


@query("f14_pointing", sql("SELECT cntr, round((ra + 7.5e0 / 3600 / cos(radians(dec)) + 360) % 360, 7) AS ra, round(dec - 2e0 / 3600, 7) AS dec FROM sky"))
def _(spark, sf_dir):
    ra, dec = headers.shifted_keywords(F.col("ra"), F.col("dec"), F.lit(7.5), F.lit(-2.0))
    return view(spark, sf_dir, "sky").select("cntr", _r(ra, 7).alias("ra"), _r(dec, 7).alias("dec"))


@query("k03_replace_header", sql("SELECT cntr, (cntr % 50 + 100)::VARCHAR AS naxis1, 'GLON-CAR' AS ctype1, 'M 31' AS object, NULL::VARCHAR AS crpix1 FROM sky"))
def _(spark, sf_dir):
    template = F.create_map(*[F.lit(x) for x in ("NAXIS1", "7", "CTYPE1", "GLON-CAR", "OBJECT", "M 31")])
    h = headers.replace_header(F.col("header"), template)
    return _headers(spark, sf_dir).select("cntr", *[F.element_at(h, F.lit(k.upper())).alias(k) for k in ("naxis1", "ctype1", "object", "crpix1")])


@query("k04_fix_header", sql("SELECT cntr, 'CRVAL1  = ' || cntr AS a, 'NAXIS   = 2' AS b, 'COMMENT any text' AS c, 'END' AS d FROM sky"))
def _(spark, sf_dir):
    lines = {"a": F.concat(F.lit("crval1= "), "cntr", F.lit("  ")), "b": F.lit(" naxis 2"), "c": F.lit("COMMENT any text "), "d": F.lit("END   ")}
    return view(spark, sf_dir, "sky").select("cntr", *[headers.fixed_line(v).alias(k) for k, v in lines.items()])


@query("f27_paths", "SELECT s_suppkey, 'im' || s_suppkey || '.fits' AS name, '/data/' || s_suppkey || '/a.fits' AS joined, '/x/y' AS absolute FROM supplier")
def _(spark, sf_dir):
    path = F.concat(F.lit("/data/raw/im"), "s_suppkey", F.lit(".fits"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", headers.file_name(path).alias("name"), headers.file_path(F.concat(F.lit("/data/"), "s_suppkey", F.lit("//")), F.lit("./a.fits")).alias("joined"), headers.file_path(F.lit("/data"), F.lit("/x/y")).alias("absolute"))


@query("f30_colours", "SELECT p_partkey, p_partkey % 256 AS red, 16 AS green, 255 AS blue, CASE WHEN p_size % 2 = 0 THEN 255 ELSE 128 END AS named FROM part")
def _(spark, sf_dir):
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") % 256)), 2, "0"), F.lit("10ff"))
    r, g, b = headers.colour(code)
    named = headers.colour(F.when(F.col("p_size") % 2 == 0, "Red").otherwise("grey"))[0]
    return _table(spark, sf_dir, "part").select("p_partkey", r.cast("long").alias("red"), g.alias("green"), b.alias("blue"), named.alias("named"))


# --- coordinates ---------------------------------------------------------------------------------

def _lon(x: str, y: str) -> str:
    return f"round((degrees(atan2({y}, {x})) + 360) % 360, 5)"


def _lat(z: str) -> str:
    return f"round(degrees(asin(greatest(-1, least(1, {z})))), 5)"


def _times(matrix, v=("x", "y", "z")) -> list[str]:
    return ["(" + " + ".join(f"{c!r}::DOUBLE * {n}" for c, n in zip(row, v, strict=True)) + ")" for row in matrix]


_ECL = coords._about_x(coords.OBLIQUITY)


def _position(name: str, body: str, f):
    @query(name, body)
    def run(spark, sf_dir):
        lon, lat = f(F.col("ra"), F.col("dec"))
        return view(spark, sf_dir, "stars").select("cntr", _r(lon, 5).alias("lon"), _r(lat, 5).alias("lat"))


def _rotated(matrix) -> str:
    x, y, z = _times(matrix)
    return sql(f"SELECT cntr, {_lon(x, y)} AS lon, {_lat(z)} AS lat FROM (SELECT cntr, {_uv()} FROM stars)")


def _turn(axis: str, degrees_: float):
    c, s = math.cos(math.radians(degrees_)), math.sin(math.radians(degrees_))
    return ((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0)) if axis == "z" else ((c, 0.0, -s), (0.0, 1.0, 0.0), (s, 0.0, c))


def _times3(*m):
    out = m[0]
    for k in m[1:]:
        out = tuple(tuple(sum(out[i][l] * k[l][j] for l in range(3)) for j in range(3)) for i in range(3))
    return out


def _precession(series, t: float):
    zeta, z, theta = (sum(c * t ** (k + 1) for k, c in enumerate(terms)) / 3600 for terms in series)
    return _times3(_turn("z", z), _turn("y", theta), _turn("z", zeta))


_SUPER = ((-0.7357425748043749, 0.6772612964138943, 0.0), (-0.07455377836523366, -0.08099147130697662, 0.9939225903997749), (0.6731453021092076, 0.7312711658169645, 0.11008126222478193))
_position("f03_ecliptic_position", _rotated(_ECL), lambda a, d: coords.convert(a, d, "EQUJ", "ECLJ"))
_position("f04_supergalactic_position", _rotated(_SUPER), coords.galactic_to_supergalactic)
_position("f07_precession_position", _rotated(_precession((coords.ZETA, coords.Z, coords.THETA), 0.25)), lambda a, d: coords.convert(a, d, "EQUJ", "EQUJ", target_epoch=2025.0))
_position("f07_precession_back", _rotated(tuple(zip(*_precession((coords.ZETA, coords.Z, coords.THETA), 0.25), strict=True))), lambda a, d: coords.convert(a, d, "EQUJ", "EQUJ", source_epoch=2025.0))
_E = coords.E_TERMS
_FREE = f"SELECT cntr, x - {_E[0]!r}::DOUBLE + g * x AS x, y - {_E[1]!r}::DOUBLE + g * y AS y, z - {_E[2]!r}::DOUBLE + g * z AS z FROM (SELECT *, x * {_E[0]!r}::DOUBLE + y * {_E[1]!r}::DOUBLE + z * {_E[2]!r}::DOUBLE AS g FROM (SELECT cntr, {_uv()} FROM stars))"
_M = _times(coords.B1950_TO_J2000)
_position("f05_besselian_to_julian", sql(f"SELECT cntr, {_lon('x', 'y')} AS lon, {_lat('z / sqrt(x*x + y*y + z*z)')} AS lat FROM (SELECT cntr, {_M[0]} AS x, {_M[1]} AS y, {_M[2]} AS z FROM ({_FREE}))"), lambda a, d: coords.convert(a, d, "EQUB", "EQUJ"))


@query("f01_convert_and_back", sql("SELECT cntr, a || '-' || b AS pair, true AS back FROM stars, (SELECT unnest(['EQUJ', 'EQUB', 'ECLJ', 'ECLB', 'GAL', 'SGAL']) AS a), (SELECT unnest(['EQUJ', 'EQUB', 'ECLJ', 'ECLB', 'GAL', 'SGAL']) AS b) WHERE a < b AND abs(dec) < 85"))
def _(spark, sf_dir):
    s, out = view(spark, sf_dir, "stars").filter("abs(dec) < 85").repartition(spark.sparkContext.defaultParallelism), None  # much work on few bytes
    for a in coords.SYSTEMS:
        for b in coords.SYSTEMS:
            if a < b:
                first, last = 1980.0 if a.endswith("B") else None, 2010.0 if b.endswith("J") else None
                there = s.select("cntr", "ra", "dec", coords.place(F.col("ra"), F.col("dec"), a, b, first, last).alias("p"))
                here = there.select("cntr", "ra", "dec", coords.place(F.col("p.lon"), F.col("p.lat"), b, a, last, first).alias("q"))
                near = (F.abs(F.pmod(F.col("q.lon") - F.col("ra") + 180, F.lit(360.0)) - 180) < 1e-6) & (F.abs(F.col("q.lat") - F.col("dec")) < 1e-6)
                one = here.select("cntr", F.lit(f"{a}-{b}").alias("pair"), near.alias("back"))
                out = one if out is None else out.unionByName(one)
    return out


@query("f08_hours", sql("SELECT cntr, lpad((n // 360000)::VARCHAR, 2, '0') || ':' || lpad((n // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((n // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((n % 100)::VARCHAR, 2, '0') AS hms FROM (SELECT cntr, round(ra * 24000)::BIGINT % 8640000 AS n FROM stars)"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", coords.hours(F.col("ra")).alias("hms"))


@query("f09_parse_position", sql("""SELECT cntr, round(15 * (cntr % 24 + (cntr % 60) / 60e0 + 12.5e0 / 3600), 6) AS lon, round(-(cntr % 80 + 5 / 60e0 + 6 / 3600e0), 6) AS lat, CASE cntr % 4 WHEN 0 THEN 'EQUJ' WHEN 1 THEN 'EQUB' WHEN 2 THEN 'EQUJ' ELSE 'EQUB' END AS system,
  CASE cntr % 4 WHEN 0 THEN 2000 WHEN 1 THEN 1950 WHEN 2 THEN 2010 ELSE 1975 END::DOUBLE AS epoch FROM stars"""))
def _(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", " B1950", " equ J2010", " EQUB 1975")]), (F.col("cntr") % 4 + 1).cast("int"))
    text = F.concat((F.col("cntr") % 24).cast("string"), F.lit("h"), (F.col("cntr") % 60).cast("string"), F.lit("m12.5s  -"), (F.col("cntr") % 80).cast("string"), F.lit(":05:06"), tail)
    p = coords.parse_position(text)
    return view(spark, sf_dir, "stars").select("cntr", _r(p["lon"], 6).alias("lon"), _r(p["lat"], 6).alias("lat"), p["system"].alias("system"), p["epoch"].alias("epoch"))


# --- fits, photometry, stretches -------------------------------------------------------------------

_SUMS = "sum(1e0*i*i) AS xx, sum(1e0*i*j) AS xy, sum(1e0*j*j) AS yy, sum(1e0*i) AS x, sum(1e0*j) AS y, sum(i*v) AS xz, sum(j*v) AS yz, sum(v) AS z, sum(v*v) AS zz, count(*)::DOUBLE AS n"
_SOLVE = "(xz*(yy*n-y*y) - xy*(yz*n-y*z) + x*(yz*y-yy*z)) / dt AS a, (xx*(yz*n-y*z) - xz*(xy*n-y*x) + x*(xy*z-yz*x)) / dt AS b, (xx*(yy*z-yz*y) - xy*(xy*z-yz*x) + xz*(xy*y-yy*x)) / dt AS c"


def _clipped_sql(rounds: int, level_only: bool) -> str:
    """One pair of common table expressions a round."""
    out = []
    for k in range(rounds):
        near = "pix p" if k == 0 else f"pix p JOIN f{k - 1} q ON q.image_id = p.image_id AND abs(v - (q.a * i + q.b * j + q.c)) <= 2 * q.rms"
        out.append(f"s{k} AS MATERIALIZED (SELECT p.image_id, {_SUMS} FROM {near} GROUP BY p.image_id)")
        solved = f"SELECT *, 0e0 AS a, 0e0 AS b, z / n AS c FROM s{k}" if level_only else f"SELECT *, {_SOLVE} FROM (SELECT *, xx*(yy*n-y*y) - xy*(xy*n-y*x) + x*(xy*y-yy*x) AS dt FROM s{k})"
        out.append(f"f{k} AS MATERIALIZED (SELECT image_id, a, b, c, n::BIGINT AS npixel, sqrt(greatest(0, (zz - 2*(a*xz + b*yz + c*z) + a*a*xx + b*b*yy + c*c*n + 2*(a*b*xy + a*c*x + b*c*y)) / n)) AS rms FROM ({solved}))")
    return ", ".join(out)


@query("a05_clipped_planes", _with(_clipped_sql(20, False) + " SELECT image_id, round(a, 2) AS a, round(b, 2) AS b, round(c, 1) AS c, round(rms, 1) AS rms, npixel FROM f19"))
def _(spark, sf_dir):
    f = background.clipped_planes(view(spark, sf_dir, "pix"), ["image_id"])
    return f.select("image_id", _r("a", 2).alias("a"), _r("b", 2).alias("b"), _r("c", 1).alias("c"), _r("rms", 1).alias("rms"), "npixel")


@query("a06_clipped_levels", _with(_clipped_sql(20, True) + " SELECT image_id, round(c, 2) AS c, round(rms, 2) AS rms, npixel FROM f19"))
def _(spark, sf_dir):
    f = background.clipped_planes(view(spark, sf_dir, "pix"), ["image_id"], level_only=True)
    return f.select("image_id", _r("c", 2).alias("c"), _r("rms", 2).alias("rms"), "npixel")


_EDGE_FITS = """e AS (SELECT image_id AS plus, (image_id + 1) % 16 AS minus, stddev_pop(v) AS rms, count(*) AS npixel, (max(i) - min(i) + 1) * (image_id % 5) / 12e0 AS box_x, (max(j) - min(j) + 1) * (image_id % 3) / 12e0 AS box_y FROM pix GROUP BY image_id)"""


@query("a24_usable_edges", _with(_EDGE_FITS + " SELECT plus, minus FROM e, (SELECT avg(rms) AS m, stddev_pop(rms) AS s FROM e) WHERE (box_x >= 8 OR box_y >= 8) AND rms <= m + 2 * s AND npixel >= 0.002e0 * 1024"))
def _(spark, sf_dir):
    p, c = view(spark, sf_dir, "pix"), F.col
    e = p.groupBy("image_id").agg(F.stddev_pop("v").alias("rms"), F.count("*").alias("npixel"), (F.max("i") - F.min("i") + 1).alias("w"), (F.max("j") - F.min("j") + 1).alias("h"))
    e = e.select(c("image_id").alias("plus"), ((c("image_id") + 1) % 16).alias("minus"), "rms", "npixel", (c("w") * (c("image_id") % 5) / 12.0).alias("box_x"), (c("h") * (c("image_id") % 3) / 12.0).alias("box_y"))
    images = spark.range(16).select(c("id").cast("int").alias("image_id"), F.lit(32).alias("nx"), F.lit(32).alias("ny"))
    return background.usable_edges(e, images).select("plus", "minus")


def _relaxed(rounds: int) -> str:
    from skyloom.plans.queries import _EDGE

    out = [_EDGE + ", w0 AS MATERIALIZED (SELECT plus, minus, c FROM e UNION ALL SELECT minus, plus, -c FROM e)"]
    for k in range(rounds):
        out.append(f"m{k} AS MATERIALIZED (SELECT plus AS id, avg(c) / 2 AS m FROM w{k} GROUP BY plus), w{k + 1} AS MATERIALIZED (SELECT w.plus, w.minus, w.c - (p.m - q.m) AS c FROM w{k} w JOIN m{k} p ON p.id = w.plus JOIN m{k} q ON q.id = w.minus)")
    return ", ".join(out) + " SELECT id, round(sum(m), 2) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(rounds)) + ") GROUP BY id"


@query("u05_level_rounds", _with(_relaxed(8)))
def _(spark, sf_dir):
    from skyloom.plans.queries import _offsets

    return background.level_relaxation(_offsets(spark, sf_dir), 8).select("id", _r("c", 2).alias("c"))


def _images(spark, sf_dir):
    """Eight images of one sky on a common grid, each with a level of its own, two pixels apart."""
    p = _one(spark, sf_dir).filter("image_id < 8")
    return p.select("image_id", (F.col("i") + 2 * F.col("image_id")).alias("i"), "j", ((F.col("i") * 3 + F.col("j") * 5) % 11 + 100.0 * F.col("image_id")).alias("v"), "area")


@query("x02_mosaic_without_background", _with(_ONE + """, im AS (SELECT image_id, i + 2 * image_id AS i, j, (i * 3 + j * 5) % 11 + 100e0 * image_id AS v, area FROM p1 WHERE image_id < 8)
 SELECT i, j, round(sum(v * area) FILTER (WHERE area > 0) / nullif(sum(area) FILTER (WHERE area > 0), 0) + 3.3e-7, 4) + 0e0 AS v FROM im GROUP BY i, j"""))
def _(spark, sf_dir):
    return background.mosaic(_images(spark, sf_dir), background=False).select("i", "j", (F.round(F.col("v") + 3.3e-7, 4) + 0.0).alias("v"))


@query("x02_mosaic")
def _(spark, sf_dir):
    return background.mosaic(_images(spark, sf_dir))


@query("x03_flatten", _with(_clipped_sql(20, False) + " SELECT p.image_id, i, j, round(CASE WHEN area > 0 THEN v - (a * i + b * j + c) END, 1) AS v FROM pix p JOIN f19 USING (image_id)"))
def _(spark, sf_dir):
    return background.flatten(view(spark, sf_dir, "pix")).select("image_id", "i", "j", _r("v", 1).alias("v"))


_PEAK = _ONE + """, top AS (SELECT image_id, i AS x, j AS y FROM p1 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, j, i) = 1),
ap AS (SELECT image_id, i, j, sqrt((i - x) * (i - x) + (j - y) * (j - y)) AS r, v FROM p1 JOIN top USING (image_id) WHERE (i - x) * (i - x) + (j - y) * (j - y) <= 36)"""


@query("w09_profile_width", _with(_PEAK + """, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r, i, j, v) AS k, count(*) OVER (PARTITION BY image_id) AS n, min(v) OVER (PARTITION BY image_id) AS low FROM ap),
 t AS (SELECT *, max(v) FILTER (WHERE k <= n // 4) OVER (PARTITION BY image_id) AS peak FROM k)
 SELECT image_id, round(any_value(peak), 4) AS peak, round(any_value(low + (peak - low) / 2.718281828459045e0), 4) AS level, round(arg_min(r, k) FILTER (WHERE v < low + (peak - low) / 2.718281828459045e0), 6) AS width FROM t GROUP BY image_id"""))
def _(spark, sf_dir):
    p = _one(spark, sf_dir)
    w = photometry.profile_width(photometry.aperture(p, photometry.brightest(p), 6.0))
    return w.select("image_id", _r("peak").alias("peak"), _r("level").alias("level"), _r("width", 6).alias("width"))


def _background_sql(rounds: int) -> str:
    out = ["b0 AS MATERIALIZED (SELECT image_id, avg(v) AS b, stddev_pop(v) AS s, count(*) AS n FROM ap GROUP BY image_id)"]
    for k in range(1, rounds):
        out.append(f"b{k} AS MATERIALIZED (SELECT image_id, avg(v) AS b, stddev_pop(v) AS s, count(*) AS n FROM ap JOIN b{k - 1} USING (image_id) WHERE abs(v - b{k - 1}.b) <= 3 * b{k - 1}.s GROUP BY image_id)")
    return ", ".join(out)


@query("a09_aperture_photometry", _with(_PEAK + ", " + _background_sql(15) + " SELECT image_id, x, y, round(any_value(b.b), 3) AS background, any_value(b.n) AS n, round(sum(ap.v - b.b), 2) AS flux FROM ap JOIN b14 b USING (image_id) JOIN top USING (image_id) GROUP BY image_id, x, y"))
def _(spark, sf_dir):
    a = photometry.aperture_photometry(_one(spark, sf_dir), 6.0)
    return a.select("image_id", "x", "y", _r("background", 3).alias("background"), "n", _r("flux", 2).alias("flux"))


def _hist(spark, sf_dir):
    return pixels.histogram(view(spark, sf_dir, "pix"), 200)


_LEVELS = """h AS (SELECT bin, low + bin * (high - low) / 199 AS datalev, count(*) AS n FROM (SELECT least(floor(199 * (v - low) / (high - low)), 199)::INT AS bin, low, high FROM pix, (SELECT min(v) AS low, max(v) AS high FROM pix)) GROUP BY bin, low, high),
c AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(lead(datalev) OVER (ORDER BY bin), datalev) AS nx FROM h)"""


def _at(p: str) -> str:
    return f"(SELECT datalev + greatest(0, {p} * total - before) / n * (nx - datalev) FROM c WHERE before < {p} * total AND {p} * total <= before + n OR {p} <= 0 AND before = 0)"


_BOUNDS = ("min", "med+5", "97.5%", "-1.5s", "max-1", "1200", "0%")


@query("f21_range_levels", _with(_LEVELS + f"""SELECT 'min' AS bound, round({_at('0e0')}, 4) AS level UNION ALL SELECT 'med+5', round({_at('0.5e0')} + 5, 4) UNION ALL SELECT '97.5%', round({_at('0.975e0')}, 4)
 UNION ALL SELECT '-1.5s', round({_at('0.5e0')} - 1.5e0 * ({_at('0.84e0')} - {_at('0.16e0')}) / 2, 4) UNION ALL SELECT 'max-1', round({_at('1e0')} - 1, 4) UNION ALL SELECT '1200', 1200e0 UNION ALL SELECT '0%', round({_at('0e0')}, 4)"""))
def _(spark, sf_dir):
    h, out = _hist(spark, sf_dir), None
    for b in _BOUNDS:
        one = stretches.bound_level(h, stretches.parse_bound(b)).select(F.lit(b).alias("bound"), _r("level").alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a12_value_percentile", _with(_LEVELS + " SELECT round(sum(CASE WHEN nx <= 30000 THEN n WHEN datalev < 30000 THEN n * (30000 - datalev) / (nx - datalev) ELSE 0 END) / any_value(total), 6) AS share FROM c"))
def _(spark, sf_dir):
    return stretches.share_at(_hist(spark, sf_dir), 30000.0).select(_r("share", 6).alias("share"))


@query("f20_asinh_stretch", sql("SELECT image_id, i, j, floor(255 * asinh(least(1, greatest(0, (v - 1000) / 90000e0)) / 0.1e0) / asinh(10e0) + 0.5e0)::INT AS grey FROM pix"))
def _(spark, sf_dir):
    from skyloom.functions.mathematics import stretch

    return view(spark, sf_dir, "pix").select("image_id", "i", "j", stretch(F.col("v"), 1000.0, 91000.0, "asinh").alias("grey"))


_STEP_LEVELS = [1000.0 + 350.0 * k for k in range(256)]


@query("w04_table_stretch", sql("SELECT image_id, i, j, greatest(0, least(255, floor((v - 1000) / 350)))::INT AS grey FROM pix"))
def _(spark, sf_dir):
    table = spark.createDataFrame([(k, x) for k, x in enumerate(_STEP_LEVELS)], "step int, datalev double")
    return stretches.stretch_by_table(view(spark, sf_dir, "pix"), table).select("image_id", "i", "j", "grey")


@query("w04_gaussian_table")
def _(spark, sf_dir):
    return stretches.lookup_table(stretches.gaussian_levels(_hist(spark, sf_dir)), -2.0, 3.0)


@query("k09_convert", sql("SELECT image_id, i, j, CASE WHEN v IS NULL OR v < 2000 OR v > 60000 THEN -32768 ELSE round(v / 10)::INT END AS v FROM pix"))
def _(spark, sf_dir):
    return pixels.to_integers(view(spark, sf_dir, "pix").withColumn("v", F.when(F.col("v").between(2000, 60000), F.col("v") / 10)), 16, -32768).select("image_id", "i", "j", "v")


@query("p21_plane_layout", "SELECT vec_id % 10 AS i, (vec_id // 10)::BIGINT AS j, k, round(v, 4) AS v FROM (SELECT vec_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("k"), F.floor(F.col("vec_id") / 10).alias("j"), F.posexplode("embedding").alias("i", "v"))
    return pixels.transpose(e.select(F.col("i").alias("a"), "j", F.col("k").alias("b"), F.col("v").cast("double").alias("v")), {"i": "b", "k": "a"}).select("i", "j", "k", _r("v").alias("v"))
