"""Registered queries: each operator on the star-schema views, next to SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import coords
from skyloom.operators import fits, geometry, pixels
from skyloom.plans.views import sql, view

#: name: (function of (spark, sf_dir), SQL or None)
QUERIES: dict = {}
#: Corners (lon, lat) of the test region, clockwise from outside, and its edge normals' source.
REGION = [(100.0, -30.0), (100.0, 30.0), (160.0, 30.0), (160.0, -30.0)]


def query(name: str, statement: str | None = None):
    def register(f):
        QUERIES[name] = (f, statement)
        return f

    return register


def _r(c, digits: int = 4):
    return F.round(c, digits)


def _off(c: str):
    """Rounded a little off the exact halves, which engines round after differently ordered sums."""
    return F.round(F.col(c) + 3.3e-7, 4) + 0.0


def _edges(spark: SparkSession) -> DataFrame:
    """Neighbouring image ids (0,1), (1,2), ... of the sixteen images."""
    return spark.range(15).select(F.col("id").cast("int").alias("plus"), (F.col("id") + 1).cast("int").alias("minus"))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- co-adds and pixel operators ---------------------------------------------------------------

_COADD = "SELECT i, j, round({}, 4) AS v, round(sum(area) FILTER (WHERE area > 0), 4) AS area FROM pix GROUP BY i, j"


def _coadd(mode: str, value: str):
    @query(f"a0{1 if mode == 'mean' else 2}_coadd_{mode}", sql(_COADD.format(value)))
    def run(spark, sf_dir):
        return pixels.coadd(view(spark, sf_dir, "pix"), mode).select("i", "j", _r("v").alias("v"), _r("area").alias("area"))


_coadd("mean", "sum(v * area) FILTER (WHERE area > 0) / nullif(sum(area) FILTER (WHERE area > 0), 0)")
_coadd("median", "median(v) FILTER (WHERE area > 0)")
_coadd("count", "(count(v) FILTER (WHERE area > 0))::DOUBLE")
_coadd("sum", "sum(v) FILTER (WHERE area > 0)")


@query("a03_cube_coadd", "SELECT vec_id % 10 AS i, k, round(avg(v) + 3.3e-7, 4) + 0e0 AS v FROM (SELECT vec_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def _(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("area", F.lit(1.0))
    return pixels.coadd(cube, "mean", ("i", "k")).select("i", "k", _off("v").alias("v"))


_ONE = "p1 AS (SELECT image_id, i, j, avg(v) AS v, avg(area) AS area FROM pix GROUP BY image_id, i, j)"


def _one(spark, sf_dir):
    """At most one value a pixel and image."""
    return view(spark, sf_dir, "pix").groupBy("image_id", "i", "j").agg(F.avg("v").alias("v"), F.avg("area").alias("area"))


_DIFF = f"""{_ONE}, b AS (SELECT a.image_id AS plus, c.image_id AS minus, a.i, a.j, a.v AS v1, c.v AS v2, a.area AS a1, c.area AS a2 FROM p1 a JOIN p1 c
  ON c.image_id = a.image_id + 1 AND a.i = c.i AND a.j = c.j WHERE a.area > 0 AND c.area > 0),
u AS (SELECT plus, avg(a1) + avg(a2) AS usual FROM b GROUP BY plus),
d AS (SELECT plus, minus, i, j, 2 * (v1 * a1 - v2 * a2) / (a1 + a2) AS v FROM b JOIN u USING (plus) WHERE abs(a1 + a2 - usual) / usual <= {1 / 3!r})"""


def _with(body: str) -> str:
    """``body`` starts with further common table expressions."""
    return sql("").rstrip() + ", " + body


@query("j04_difference", _with(_DIFF + " SELECT plus, minus, i, j, round(v, 3) AS v FROM d"))
def _(spark, sf_dir):
    return pixels.difference(_one(spark, sf_dir), _edges(spark)).select("plus", "minus", "i", "j", _r("v", 3).alias("v"))


@query("a04_difference_statistics", _with(_DIFF + " SELECT plus, minus, count(*) AS n, round(min(v), 3) AS low, round(max(v), 3) AS high, round(min(abs(v)), 3) AS abs_low, round(max(abs(v)), 3) AS abs_high FROM d GROUP BY plus, minus"))
def _(spark, sf_dir):
    d = pixels.difference(_one(spark, sf_dir), _edges(spark))
    v = F.col("v")
    return d.groupBy("plus", "minus").agg(F.count("*").alias("n"), _r(F.min(v), 3).alias("low"), _r(F.max(v), 3).alias("high"), _r(F.min(F.abs(v)), 3).alias("abs_low"), _r(F.max(F.abs(v)), 3).alias("abs_high"))


@query("a08_region_statistics", sql("""SELECT image_id, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS n_blank, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS rms,
  round(min(v) FILTER (WHERE (i-16)*(i-16)+(j-16)*(j-16) <= 64), 4) AS low, round(max(v) FILTER (WHERE (i-16)*(i-16)+(j-16)*(j-16) <= 64), 4) AS high
  FROM pix WHERE i BETWEEN 8 AND 24 AND j BETWEEN 8 AND 24 GROUP BY image_id"""))
def _(spark, sf_dir):
    s = pixels.region_statistics(view(spark, sf_dir, "pix"), 16, 16, 8)
    return s.select("image_id", "n", "n_blank", *[_r(c).alias(c) for c in ("mean", "rms", "low", "high")])


_HIST = """e AS (SELECT min(v) AS low, max(v) AS high FROM pix), h0 AS (SELECT least(floor(199 * (v - low) / (high - low)), 199)::INT AS bin, count(*) AS n, any_value(low) AS low, any_value(high) AS high FROM pix, e GROUP BY 1),
h AS (SELECT bin, low + bin * (high - low) / 199 AS datalev, n, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cumulative FROM h0)"""


@query("a10_histogram", _with(_HIST + " SELECT bin, round(datalev, 4) AS datalev, n, cumulative FROM h"))
def _(spark, sf_dir):
    return pixels.histogram(view(spark, sf_dir, "pix"), 200).withColumn("datalev", _r("datalev"))


@query("a11_combine_histograms", _with(_HIST + """, c AS (SELECT min(datalev) AS a, max(datalev) AS b FROM h)
 SELECT least(floor(49 * (datalev - a) / (b - a)), 49)::INT AS bin, sum(n)::BIGINT AS n FROM h, c GROUP BY 1"""))
def _(spark, sf_dir):
    return pixels.combine_histograms(pixels.histogram(view(spark, sf_dir, "pix"), 200), 50)


@query("a12_percentile_level", _with(_HIST + """, t AS (SELECT *, sum(n) OVER () AS total, lead(datalev) OVER (ORDER BY bin) AS nx FROM h)
 SELECT round(datalev + (floor(total * 0.9::DOUBLE) - cumulative) / n * (coalesce(nx, datalev) - datalev), 4) AS level FROM t WHERE cumulative + n >= floor(total * 0.9::DOUBLE) AND cumulative < floor(total * 0.9::DOUBLE)"""))
def _(spark, sf_dir):
    return pixels.percentile_level(pixels.histogram(view(spark, sf_dir, "pix"), 200), 0.9).select(_r("level").alias("level"))


@query("w02_cumulative_histogram", _with(_HIST + " SELECT bin, cumulative FROM h"))
def _(spark, sf_dir):
    return pixels.histogram(view(spark, sf_dir, "pix"), 200).select("bin", "cumulative")


@query("a13_shrink", sql("SELECT image_id, floor(i / 4)::INT AS i, floor(j / 4)::INT AS j, round(avg(v), 4) AS v FROM pix GROUP BY 1, 2, 3"))
def _(spark, sf_dir):
    return pixels.shrink(view(spark, sf_dir, "pix"), 4).withColumn("v", _r("v"))


@query("a13_shrink_fractional", sql("""SELECT image_id, x AS i, y AS j, round(sum(v * wx * wy) / sum(wx * wy) + 3.3e-7, 4) AS v FROM (SELECT image_id, v, x, y,
  least(i + 1, (x + 1) * 2.5e0) - greatest(i, x * 2.5e0) AS wx, least(j + 1, (y + 1) * 2.5e0) - greatest(j, y * 2.5e0) AS wy FROM pix, (SELECT unnest(range(13))::INT AS x), (SELECT unnest(range(13))::INT AS y)
  WHERE x * 2.5e0 < i + 1 AND (x + 1) * 2.5e0 > i AND y * 2.5e0 < j + 1 AND (y + 1) * 2.5e0 > j) GROUP BY image_id, x, y"""))
def _(spark, sf_dir):
    return pixels.shrink_fractional(view(spark, sf_dir, "pix"), 2.5).withColumn("v", _off("v"))


def _cube(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("i"), "vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


_CUBE = "WITH c AS (SELECT vec_id AS i, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) "


@query("a15_plane_average", _CUBE + "SELECT i, round(CASE WHEN count(v) = 8 THEN sum(v) / 8 END, 4) AS v FROM c WHERE k BETWEEN 4 AND 11 GROUP BY i")
def _(spark, sf_dir):
    return pixels.plane_average(_cube(spark, sf_dir).withColumn("i", F.col("vec_id")), 4, 8).withColumn("v", _r("v"))


@query("a16_plane_median", _CUBE + "SELECT i, round(list_sort(list(v))[4 + 1], 4) AS v FROM c WHERE k BETWEEN 4 AND 11 GROUP BY i")
def _(spark, sf_dir):
    return pixels.plane_median(_cube(spark, sf_dir).withColumn("i", F.col("vec_id")), 4, 8).withColumn("v", _r("v"))


@query("a17_spectrum", _CUBE + "SELECT k, round(avg(v), 4) AS v, count(v) AS n FROM c WHERE i BETWEEN 5 AND 60 GROUP BY k")
def _(spark, sf_dir):
    return pixels.spectrum(_cube(spark, sf_dir).withColumn("i", F.col("vec_id")), 5, 60).withColumn("v", _r("v"))


@query("p11_cube_slice", _CUBE + "SELECT i, dense_rank() OVER (ORDER BY k) - 1 AS k, round(v, 4) AS v FROM c WHERE (k BETWEEN 2 AND 4 OR k BETWEEN 9 AND 10)")
def _(spark, sf_dir):
    from skyloom.functions.parsing import parse_select_list, renumber

    c = _cube(spark, sf_dir).withColumn("i", F.col("vec_id"))
    wanted = parse_select_list("2:4,9:10")
    return c.select("i", renumber(F.col("k"), wanted).alias("k"), _r("v").alias("v")).filter("k IS NOT NULL")


@query("p19_transpose", _CUBE + "SELECT k AS i, i AS k, round(v + 3.3e-7, 4) + 0e0 AS v FROM c")
def _(spark, sf_dir):
    c = _cube(spark, sf_dir).select(F.col("vec_id").alias("i"), "k", _off("v").alias("v"))
    return pixels.transpose(c, {"i": "k", "k": "i"}).select("i", "k", "v")


@query("p07_fix_blanks", sql("SELECT image_id, i, j, CASE WHEN v <= 2000 OR v BETWEEN 40000 AND 50000 THEN -1.0 ELSE v END AS v FROM pix"))
def _(spark, sf_dir):
    return pixels.fix_blanks(view(spark, sf_dir, "pix"), -1.0, ((None, 2000.0), (40000.0, 50000.0))).select("image_id", "i", "j", "v")


@query("p09_box_mask", sql("SELECT image_id, i, j, CASE WHEN (i BETWEEN 2 AND 9 AND j BETWEEN 3 AND 12) OR (i BETWEEN 20 AND 22 AND j BETWEEN 0 AND 31) THEN NULL ELSE v END AS v FROM pix"))
def _(spark, sf_dir):
    return pixels.mask_boxes(view(spark, sf_dir, "pix"), [(2, 9, 3, 12), (20, 22, 0, 31)]).select("image_id", "i", "j", "v")


@query("p10_cutout", sql("SELECT image_id, i - 5 AS i, j - 7 AS j, v FROM pix WHERE i BETWEEN 5 AND 14 AND j BETWEEN 7 AND 18"))
def _(spark, sf_dir):
    return pixels.cutout(view(spark, sf_dir, "pix"), 5, 7, 10, 12).select("image_id", "i", "j", "v")


@query("p10_tight_box", sql("SELECT image_id, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM pix WHERE v IS NOT NULL GROUP BY image_id"))
def _(spark, sf_dir):
    return pixels.tight_box(view(spark, sf_dir, "pix"))


@query("p16_border", sql("SELECT image_id, i, j, v FROM pix WHERE i BETWEEN 3 AND 28 AND j BETWEEN 3 AND 28"))
def _(spark, sf_dir):
    return pixels.without_border(view(spark, sf_dir, "pix"), 32, 32, 3).select("image_id", "i", "j", "v")


@query("p18_pad", _with(_ONE + """ SELECT g.image_id, g.i, g.j, round(v + 3.3e-7, 4) AS v FROM (SELECT image_id, i::INT AS i, j::INT AS j FROM (SELECT DISTINCT image_id FROM p1), (SELECT unnest(range(36)) AS i), (SELECT unnest(range(37)) AS j)) g
  LEFT JOIN p1 ON p1.image_id = g.image_id AND p1.i + 1 = g.i AND p1.j + 3 = g.j"""))
def _(spark, sf_dir):
    return pixels.pad(_one(spark, sf_dir), 32, 32, 1, 3, 2, 3).select("image_id", "i", "j", _off("v").alias("v"))


@query("p22_background_removal", sql("SELECT image_id, i, j, round(CASE WHEN area > 0 THEN v - (0.5e0 * (i - 3) + 0.25e0 * (j - 4) + 7) END, 4) AS v FROM pix"))
def _(spark, sf_dir):
    p = pixels.subtract_plane(view(spark, sf_dir, "pix"), F.lit(0.5), F.lit(0.25), F.lit(7.0), 3, 4)
    return p.select("image_id", "i", "j", _r("v").alias("v"))


@query("w07_row_extent", sql("SELECT image_id, j, min(i) AS first, max(i) AS last FROM pix WHERE v IS NOT NULL GROUP BY image_id, j"))
def _(spark, sf_dir):
    return pixels.row_extent(view(spark, sf_dir, "pix"))


@query("w01_radial_flux", _with(_ONE + """ SELECT image_id, i, j, round(sum(v) OVER (PARTITION BY image_id ORDER BY sqrt((i - 16) * (i - 16) + (j - 16) * (j - 16)), i, j, v ROWS UNBOUNDED PRECEDING) + 3.3e-6, 3) AS flux
  FROM p1 WHERE (i - 16) * (i - 16) + (j - 16) * (j - 16) <= 81"""))
def _(spark, sf_dir):
    return pixels.radial_profile(_one(spark, sf_dir), 16, 16, 9).select("image_id", "i", "j", _r(F.col("flux") + 3.3e-6, 3).alias("flux"))


@query("w05_neighbour_smoothing", sql("""SELECT a.i, a.j, sum(b.n)::BIGINT AS n FROM (SELECT i, j, count(*) AS n FROM pix GROUP BY i, j) a JOIN (SELECT i, j, count(*) AS n FROM pix GROUP BY i, j) b
  ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j"""))
def _(spark, sf_dir):
    return pixels.smooth_neighbours(view(spark, sf_dir, "pix").groupBy("i", "j").agg(F.count("*").alias("n")))


@query("x01_tiles", sql("""SELECT tile_x, tile_y, count(*) AS n, round(sum(v), 3) AS v FROM (SELECT v, x AS tile_x, y AS tile_y FROM pix, (SELECT unnest(range(5))::INT AS x), (SELECT unnest(range(5))::INT AS y)
  WHERE x BETWEEN greatest(0, floor((i - 2) / 8.0)) AND floor((i + 2) / 8.0) AND y BETWEEN greatest(0, floor((j - 2) / 8.0)) AND floor((j + 2) / 8.0)) GROUP BY 1, 2"""))
def _(spark, sf_dir):
    return pixels.tiles(view(spark, sf_dir, "pix"), 8, 2).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), _r(F.sum("v"), 3).alias("v"))


@query("a18_catalogue_map", sql("""SELECT floor(ra)::INT + dx - 1 AS i, floor(dec)::INT + dy - 1 AS j, round(sum(flux * [0.25e0, 0.5e0, 0.25e0][dx + 1] * [0.25e0, 0.5e0, 0.25e0][dy + 1]) + 3.3e-7, 4) AS v
  FROM stars, (SELECT unnest(range(3))::INT AS dx), (SELECT unnest(range(3))::INT AS dy) GROUP BY 1, 2"""))
def _(spark, sf_dir):
    s = view(spark, sf_dir, "stars").select(F.floor("ra").cast("int").alias("x"), F.floor("dec").cast("int").alias("y"), "flux")
    return pixels.catalogue_map(s, [0.25, 0.5, 0.25]).select("i", "j", _off("v").alias("v"))


# --- fits and background -------------------------------------------------------------------------

_FIT = """s AS (SELECT image_id, sum(1e0*i*i) AS xx, sum(1e0*i*j) AS xy, sum(1e0*j*j) AS yy, sum(1e0*i) AS x, sum(1e0*j) AS y, sum(i*v) AS xz, sum(j*v) AS yz, sum(v) AS z, count(*)::DOUBLE AS n FROM pix GROUP BY image_id),
f AS (SELECT image_id, n, (xz*(yy*n-y*y) - xy*(yz*n-y*z) + x*(yz*y-yy*z)) / dt AS a, (xx*(yz*n-y*z) - xz*(xy*n-y*x) + x*(xy*z-yz*x)) / dt AS b, (xx*(yy*z-yz*y) - xy*(xy*z-yz*x) + xz*(xy*y-yy*x)) / dt AS c
  FROM (SELECT *, xx*(yy*n-y*y) - xy*(xy*n-y*x) + x*(xy*y-yy*x) AS dt FROM s))"""


@query("a05_plane_round", _with(_FIT + " SELECT image_id, round(a, 3) AS a, round(b, 3) AS b, round(c, 2) AS c, n::BIGINT AS npixel FROM f"))
def _(spark, sf_dir):
    return fits.plane_round(view(spark, sf_dir, "pix")).select("image_id", _r("a", 3).alias("a"), _r("b", 3).alias("b"), _r("c", 2).alias("c"), "npixel")


@query("a06_clipped_level", sql("""SELECT l.image_id, round(avg(v), 3) AS c, count(*) AS npixel FROM pix l JOIN (SELECT image_id, avg(v) AS m, stddev_pop(v) AS s FROM pix GROUP BY image_id) q ON l.image_id = q.image_id AND abs(v - m) <= 2 * s GROUP BY 1"""))
def _(spark, sf_dir):
    p = view(spark, sf_dir, "pix")
    first = fits.clipped_plane(p, rounds=1, level_only=True).select("image_id", F.col("c").alias("m"), "rms")
    return p.join(first, "image_id").filter(F.abs(F.col("v") - F.col("m")) <= 2 * F.col("rms")).groupBy("image_id").agg(_r(F.avg("v"), 3).alias("c"), F.count("*").alias("npixel"))


@query("a23_usable_fits", sql("""SELECT image_id, npixel FROM (SELECT image_id, npixel, rms, avg(rms) OVER () AS m, stddev_pop(rms) OVER () AS s, avg(npixel) OVER () AS area FROM (SELECT image_id, count(*) AS npixel, stddev_pop(v) AS rms FROM pix GROUP BY image_id)) WHERE rms <= m + 2 * s AND npixel >= 0.002e0 * area"""))
def _(spark, sf_dir):
    f = view(spark, sf_dir, "pix").groupBy("image_id").agg(F.count("*").alias("npixel"), F.stddev_pop("v").alias("rms"))
    return fits.usable_fits(f).select("image_id", "npixel")


_EDGE = _DIFF + ", e AS (SELECT plus, minus, avg(v) AS c FROM d GROUP BY plus, minus)"


def _offsets(spark, sf_dir):
    d = pixels.difference(_one(spark, sf_dir), _edges(spark))
    return d.groupBy("plus", "minus").agg(F.avg("v").alias("c")).select("plus", "minus", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), "c")


@query("j12_both_ways", _with(_EDGE + " SELECT plus, minus, round(c, 3) AS c FROM e UNION ALL SELECT minus, plus, round(-c, 3) FROM e"))
def _(spark, sf_dir):
    return fits.both_ways(_offsets(spark, sf_dir)).select("plus", "minus", _r("c", 3).alias("c"))


_ROUND = """, w AS (SELECT plus, minus, c FROM e UNION ALL SELECT minus, plus, -c FROM e), m1 AS (SELECT plus AS id, avg(c) / 2 AS m FROM w GROUP BY plus),
w2 AS (SELECT w.plus, w.minus, w.c - (p.m - q.m) AS c FROM w JOIN m1 p ON p.id = w.plus JOIN m1 q ON q.id = w.minus), m2 AS (SELECT plus AS id, avg(c) / 2 AS m FROM w2 GROUP BY plus)"""


@query("u05_level_relaxation", _with(_EDGE + _ROUND + " SELECT m1.id, round(m1.m + m2.m, 3) AS c FROM m1 JOIN m2 USING (id)"))
def _(spark, sf_dir):
    return fits.level_corrections(_offsets(spark, sf_dir), 2).select("id", _r("c", 3).alias("c"))


@query("u05_background_model")
def _(spark, sf_dir):
    d = pixels.difference(_one(spark, sf_dir), _edges(spark)).withColumn("edge", F.struct("plus", "minus").cast("string"))
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    sums = {"xx": i * i, "xy": i * j, "yy": j * j, "x": i, "y": j, "n": F.lit(1.0)}
    per = d.groupBy("edge").agg(F.first("plus").alias("plus"), F.first("minus").alias("minus"), *[F.sum(v).alias(k) for k, v in sums.items()])
    edges = per.join(fits.clipped_plane_grouped(d, "edge").select("edge", "a", "b", "c"), "edge").drop("edge").filter("NOT isnan(a)")  # at most 15 rows
    return spark.createDataFrame(fits.solve_corrections(edges.toPandas()))


@query("j03_corrections", sql("SELECT p.image_id, count(*) AS n, round(sum(v - coalesce(c, 0)), 2) AS v, count(*) FILTER (WHERE c IS NULL) AS no_correction FROM pix p LEFT JOIN (SELECT unnest(range(0, 16, 2))::INT AS image_id, 10e0 AS c) k ON k.image_id = p.image_id GROUP BY p.image_id"))
def _(spark, sf_dir):
    c = spark.range(0, 16, 2).select(F.col("id").cast("int").alias("id"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(10.0).alias("c"))
    p = fits.apply_corrections(view(spark, sf_dir, "pix"), c)
    return p.groupBy("image_id").agg(F.count("*").alias("n"), _r(F.sum(F.col("v") - F.col("c")), 2).alias("v"), F.count_if("no_correction").alias("no_correction"))


# --- sky -----------------------------------------------------------------------------------------

def _uv(a: str = "ra", d: str = "dec", p: str = "") -> str:
    return f"cos(radians({d})) * cos(radians({a})) AS {p}x, cos(radians({d})) * sin(radians({a})) AS {p}y, sin(radians({d})) AS {p}z"


@query("p01_cone", sql(f"SELECT cntr FROM (SELECT cntr, {_uv()} FROM stars) WHERE x * cos(radians(20e0)) * cos(radians(120e0)) + y * cos(radians(20e0)) * sin(radians(120e0)) + z * sin(radians(20e0)) > cos(radians(15e0))"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").filter(geometry.in_cone(F.col("ra"), F.col("dec"), 120.0, 20.0, 15.0)).select("cntr")


def _normal_sql(k: int) -> str:
    import math

    v = [(math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))) for a, d in (REGION[k], REGION[(k + 1) % 4])]
    (a, b, c), (x, y, z) = v
    return f"x * {b * z - c * y:.17e} + y * {c * x - a * z:.17e} + z * {a * y - b * x:.17e} <= 1e-15"


@query("p02_polygon", sql(f"SELECT cntr FROM (SELECT cntr, {_uv()} FROM stars) WHERE " + " AND ".join(map(_normal_sql, range(4)))))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").filter(geometry.in_polygon(F.col("ra"), F.col("dec"), REGION)).select("cntr")


_DIST = "degrees(acos(greatest(-1, least(1, a.x * b.x + a.y * b.y + a.z * b.z))))"
_UNITS = f"a AS (SELECT cntr, ra, dec, {_uv()} FROM sky), b AS (SELECT cntr, ra, dec, {_uv()} FROM stars)"


@query("j01_overlap_quick", _with(f"{_UNITS} SELECT a.cntr AS plus, b.cntr AS minus, round({_DIST}, 4) AS dist FROM a JOIN a b ON a.cntr < b.cntr WHERE {_DIST} <= 24"))
def _(spark, sf_dir):
    return geometry.overlaps(view(spark, sf_dir, "sky"), 12.0).withColumn("dist", _r("dist"))


@query("j10_nearest_source", _with(f"{_UNITS} SELECT cntr, source, round(dist, 4) AS dist FROM (SELECT a.cntr, b.cntr AS source, {_DIST} AS dist, row_number() OVER (PARTITION BY a.cntr ORDER BY {_DIST}, b.cntr) AS k FROM a, b WHERE {_DIST} <= 8) WHERE k = 1"))
def _(spark, sf_dir):
    return geometry.nearest(view(spark, sf_dir, "sky"), view(spark, sf_dir, "stars"), 8.0).withColumn("dist", _r("dist"))


@query("j11_covering", _with(f"{_UNITS} SELECT a.cntr, count(*) AS n FROM a, b WHERE {_DIST} <= 10 GROUP BY a.cntr"))
def _(spark, sf_dir):
    return geometry.covering(view(spark, sf_dir, "stars"), view(spark, sf_dir, "sky"), 10.0)


@query("j09_best_image", sql("SELECT cntr, round(margin, 4) AS margin FROM (SELECT cntr, 15 - greatest(abs(((120e0 - ra + 540) % 360 - 180) * cos(radians(dec))), abs(10e0 - dec)) AS margin FROM sky) WHERE margin > 0 ORDER BY margin DESC, cntr LIMIT 1"))
def _(spark, sf_dir):
    return geometry.best_image(view(spark, sf_dir, "sky"), 120.0, 10.0, 15.0).withColumn("margin", _r("margin"))


@query("f16_distance", sql(f"SELECT cntr, round(degrees(acos(greatest(-1, least(1, z)))), 4) AS dist FROM (SELECT cntr, {_uv()} FROM stars)"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", _r(coords.distance(F.col("ra"), F.col("dec"), F.lit(0.0), F.lit(90.0))).alias("dist"))


_G = coords.GALACTIC


@query("f02_galactic", sql("SELECT cntr, round(CASE WHEN l < 0 THEN l + 360 ELSE l END, 4) AS lon, round(b, 4) AS lat FROM (SELECT cntr, degrees(atan2(" + " + ".join(f"{c} * {m!r}::DOUBLE" for c, m in zip("xyz", _G[1], strict=True)) + ", " + " + ".join(f"{c} * {m!r}::DOUBLE" for c, m in zip("xyz", _G[0], strict=True)) + ")) AS l, degrees(asin(" + " + ".join(f"{c} * {m!r}::DOUBLE" for c, m in zip("xyz", _G[2], strict=True)) + f")) AS b FROM (SELECT cntr, {_uv()} FROM stars))"))
def _(spark, sf_dir):
    lon, lat = coords.equatorial_to_galactic(F.col("ra"), F.col("dec"))
    return view(spark, sf_dir, "stars").select("cntr", _r(lon).alias("lon"), _r(lat).alias("lat"))


@query("f02_galactic_round_trip", sql("SELECT cntr, round(ra, 3) AS lon, round(dec, 3) AS lat FROM stars WHERE abs(dec) < 89"))
def _(spark, sf_dir):
    g = view(spark, sf_dir, "stars").filter("abs(dec) < 89").select("cntr", *[c.alias(n) for c, n in zip(coords.equatorial_to_galactic(F.col("ra"), F.col("dec")), "lb", strict=True)])
    lon, lat = coords.galactic_to_equatorial(F.col("l"), F.col("b"))
    return g.select("cntr", _r(lon, 3).alias("lon"), _r(lat, 3).alias("lat"))


@query("f03_ecliptic", sql(f"SELECT cntr, round(degrees(asin(z * cos(radians({coords.OBLIQUITY}e0)) - y * sin(radians({coords.OBLIQUITY}e0)))), 4) AS lat FROM (SELECT cntr, {_uv()} FROM stars)"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", _r(coords.equatorial_to_ecliptic(F.col("ra"), F.col("dec"))[1]).alias("lat"))


@query("f08_sexagesimal", sql("""SELECT cntr, CASE WHEN dec < 0 AND n > 0 THEN '-' ELSE '' END || lpad((n // 360000)::VARCHAR, 3, '0') || ':' || lpad((n // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((n % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((n % 100)::VARCHAR, 2, '0') AS dms
  FROM (SELECT cntr, dec, round(abs(dec) * 3600 * 100)::BIGINT AS n FROM stars)"""))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", coords.sexagesimal(F.col("dec")).alias("dms"))


@query("f12_tan_projection", sql("""SELECT cntr, round(CASE WHEN z > 0 THEN degrees(-x / z) / 0.1e0 END, 3) AS x, round(CASE WHEN z > 0 THEN degrees(y / z) / 0.1e0 END, 3) AS y FROM (SELECT cntr,
  sin(radians(10e0)) * sin(radians(dec)) + cos(radians(10e0)) * cos(radians(dec)) * cos(radians(ra - 120e0)) AS z, cos(radians(dec)) * sin(radians(ra - 120e0)) AS x,
  cos(radians(10e0)) * sin(radians(dec)) - sin(radians(10e0)) * cos(radians(dec)) * cos(radians(ra - 120e0)) AS y FROM stars) WHERE z > 0.1"""))
def _(spark, sf_dir):
    x, y = coords.tan_project(F.col("ra"), F.col("dec"), 120.0, 10.0, 0.1)
    near = view(spark, sf_dir, "stars").filter(coords.dot(coords.unit(F.col("ra"), F.col("dec")), coords.unit(F.lit(120.0), F.lit(10.0))) > 0.1)
    return near.select("cntr", _r(x, 3).alias("x"), _r(y, 3).alias("y"))


@query("f22_magnitude", "SELECT p_partkey, round(pow(10e0, 0.4e0 * (20 - p_size)), 6) AS flux FROM part")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", _r(coords.magnitude_to_flux(F.col("p_size"), 20.0), 6).alias("flux"))


@query("f23_tile_id", sql("SELECT DISTINCT i, j, (" + " | ".join(f"((i::BIGINT >> {b} & 1) << {2 * b}) | ((j::BIGINT >> {b} & 1) << {2 * b + 1})" for b in range(5)) + ")::BIGINT AS id FROM pix"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "pix").select("i", "j").distinct().withColumn("id", coords.interleave(F.col("i"), F.col("j"), 5))


@query("f24_pivot", sql("SELECT DISTINCT i, j, 16 - (j - 15) AS x, 15 + (i - 16) AS y FROM pix"))
def _(spark, sf_dir):
    x, y = coords.pivot(F.col("i"), F.col("j"), 16, 15)
    return view(spark, sf_dir, "pix").select("i", "j").distinct().select("i", "j", x.cast("int").alias("x"), y.cast("int").alias("y"))


# --- tables --------------------------------------------------------------------------------------

@query("o01_table_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def _(spark, sf_dir):
    from skyloom.operators.tables import sort_places

    return sort_places(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", descending=True).select("o_orderkey", "place")


@query("o06_restart", "SELECT event_id, user_id, recno FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS recno FROM events) WHERE recno >= 500")
def _(spark, sf_dir):
    from skyloom.operators.tables import from_record

    return from_record(_table(spark, sf_dir, "events").select("event_id", "user_id"), 500, "event_id")


@query("u01_union", "SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def _(spark, sf_dir):
    from skyloom.operators.tables import union_all

    s, c = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    return union_all([s.select("s_name", "s_acctbal"), c.select("c_name", "c_acctbal")], ["name", "balance"])


@query("j14_fragments", "WITH f AS (SELECT DISTINCT l_partkey % 500 AS fname, l_suppkey % 5 AS plate, min(l_orderkey) AS cntr FROM lineitem GROUP BY 1, 2) SELECT a.fname, a.plate, b.plate AS plate_2, a.cntr, b.cntr AS cntr_2 FROM f a JOIN f b ON a.fname = b.fname AND a.plate < b.plate")
def _(spark, sf_dir):
    f = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("fname"), (F.col("l_suppkey") % 5).alias("plate")).agg(F.min("l_orderkey").alias("cntr"))
    return geometry.fragments(f)


@query("j13_global_ids", "SELECT n_regionkey AS plate, n_nationkey AS cntr, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS id FROM nation")
def _(spark, sf_dir):
    return geometry.global_ids(_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("plate"), F.col("n_nationkey").alias("cntr"))).select("plate", "cntr", "id")


@query("a26_status_counts", "SELECT event_type, count(*) AS count, count(*) FILTER (WHERE value <= 60) AS ok, count(*) FILTER (WHERE value > 60 AND value <= 90) AS warning, count(*) FILTER (WHERE value IS NULL OR value > 90) AS failed FROM events GROUP BY event_type")
def _(spark, sf_dir):
    from skyloom.operators.tables import status_counts

    return status_counts(_table(spark, sf_dir, "events"), "event_type", F.col("value") > 90, F.col("value") > 60)


@query("j13_back_to_plates", "SELECT n_regionkey AS plate, n_nationkey AS cntr, row_number() OVER (ORDER BY n_regionkey, n_nationkey) * 10 AS value FROM nation")
def _(spark, sf_dir):
    ids = geometry.global_ids(_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("plate"), F.col("n_nationkey").alias("cntr")))
    return geometry.plate_ids(ids.select("id", (F.col("id") * 10).alias("value")), ids).select("plate", "cntr", "value")


@query("f29_json_path_lookup", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k.n') AS nested, json_extract_string(props, '$.missing') AS missing FROM events")
def _(spark, sf_dir):
    from skyloom.functions.parsing import json_value

    paths = {"k": "$.k", "nested": "$.k.n", "missing": "$.missing"}
    return _table(spark, sf_dir, "events").select("event_id", *[json_value(F.col("props"), p).alias(n) for n, p in paths.items()])


@query("s01_table_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf_dir):
    from skyloom.operators.tables import table_round_trip

    return table_round_trip(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"))


# --- resampling, pyramids, searches ----------------------------------------------------------------

@query("j07_planar_resample", _with(_ONE + """ SELECT image_id, x AS i, y AS j, round(sum(v * wx * wy) / sum(wx * wy) + 3.3e-7, 4) + 0e0 AS v, round(sum(wx * wy), 4) AS area FROM (SELECT image_id, v, x, y,
  least((i + 1) * 0.75e0 + 0.3e0, x + 1e0) - greatest(i * 0.75e0 + 0.3e0, x * 1e0) AS wx, least((j + 1) * 0.75e0 + 0.6e0, y + 1e0) - greatest(j * 0.75e0 + 0.6e0, y * 1e0) AS wy
  FROM p1, (SELECT unnest(range(26))::INT AS x), (SELECT unnest(range(26))::INT AS y)) WHERE wx > 1e-12 AND wy > 1e-12 GROUP BY image_id, x, y"""))
def _(spark, sf_dir):
    from skyloom.operators.resample import planar_overlap

    return planar_overlap(_one(spark, sf_dir), 0.75, 0.3, 0.6).select("image_id", "i", "j", _off("v").alias("v"), _r("area").alias("area"))


@query("j08_nearest_resample", _with(_ONE + " SELECT image_id, floor((i + 0.5e0) * 0.5e0 + 2)::INT AS i, floor((j + 0.5e0) * 0.5e0 + 1)::INT AS j, round(avg(v) + 3.3e-7, 4) + 0e0 AS v FROM p1 GROUP BY 1, 2, 3"))
def _(spark, sf_dir):
    from skyloom.operators.resample import nearest_pixel

    return nearest_pixel(_one(spark, sf_dir), 0.5, 2.0, 1.0).withColumn("v", _off("v"))


@query("a14_cube_shrink", _CUBE + "SELECT i // 4 AS i, (k // 8)::INT AS k, round(avg(v) + 3.3e-7, 4) + 0e0 AS v FROM c GROUP BY 1, 2")
def _(spark, sf_dir):
    from skyloom.operators.resample import cube_shrink

    return cube_shrink(_cube(spark, sf_dir).withColumn("i", F.col("vec_id")), 4, 8).select("i", "k", _off("v").alias("v"))


@query("u08_pyramid", _with("l1 AS (SELECT image_id, i // 2 AS i, j // 2 AS j, avg(v) AS v FROM pix GROUP BY 1, 2, 3), l2 AS (SELECT image_id, i // 2 AS i, j // 2 AS j, avg(v) AS v FROM l1 GROUP BY 1, 2, 3) SELECT 1 AS level, image_id, i::INT AS i, j::INT AS j, round(v + 3.3e-7, 4) + 0e0 AS v FROM l1 UNION ALL SELECT 2, image_id, i::INT, j::INT, round(v + 3.3e-7, 4) + 0e0 FROM l2"))
def _(spark, sf_dir):
    from skyloom.operators.resample import pyramid

    return pyramid(view(spark, sf_dir, "pix"), 2).select("level", "image_id", "i", "j", _off("v").alias("v"))


@query("j19_aperture_sums", sql("SELECT s.cntr, round(sum(v), 2) AS flux, count(*) AS n FROM (SELECT cntr, (cntr * 7 % 32)::INT AS x, (cntr * 11 % 32)::INT AS y FROM sky) s JOIN pix ON (i - x) * (i - x) + (j - y) * (j - y) <= 9 WHERE image_id = 3 GROUP BY s.cntr"))
def _(spark, sf_dir):
    from skyloom.operators.resample import aperture_sums

    s = view(spark, sf_dir, "sky").selectExpr("cntr", "CAST(cntr * 7 % 32 AS INT) AS x", "CAST(cntr * 11 % 32 AS INT) AS y")
    return aperture_sums(s, view(spark, sf_dir, "pix").filter("image_id = 3"), 3.0).select("cntr", _r("flux", 2).alias("flux"), "n")


@query("j19_aperture_sums_by_image", sql("SELECT image_id, s.cntr, round(sum(v), 2) AS flux, count(*) AS n FROM (SELECT cntr, (cntr * 7 % 32)::INT AS x, (cntr * 11 % 32)::INT AS y FROM sky) s JOIN pix ON (i - x) * (i - x) + (j - y) * (j - y) <= 9 GROUP BY image_id, s.cntr"))
def _(spark, sf_dir):
    from skyloom.operators.resample import aperture_sums

    s = view(spark, sf_dir, "sky").selectExpr("cntr", "CAST(cntr * 7 % 32 AS INT) AS x", "CAST(cntr * 11 % 32 AS INT) AS y")
    return aperture_sums(s, view(spark, sf_dir, "pix"), 3.0, "image_id").select("image_id", "cntr", _r("flux", 2).alias("flux"), "n")


_BOX = "b AS (SELECT cntr AS id, ra AS x0, ra + 3e0 AS x1, dec AS y0, dec + 2e0 AS y1 FROM stars), q AS (SELECT cntr AS id, ra AS x0, ra + 9e0 AS x1, dec AS y0, dec + 7e0 AS y1 FROM sky)"


def _boxes(spark, sf_dir, name, w, h):
    return view(spark, sf_dir, name).select(F.col("cntr").alias("id"), F.col("ra").alias("x0"), (F.col("ra") + w).alias("x1"), F.col("dec").alias("y0"), (F.col("dec") + h).alias("y1"))


@query("j17_rectangle_overlap", _with(_BOX + " SELECT q.id AS query, b.id FROM b, q WHERE b.x0 <= q.x1 AND q.x0 <= b.x1 AND b.y0 <= q.y1 AND q.y0 <= b.y1"))
def _(spark, sf_dir):
    from skyloom.operators.resample import rectangle_search

    return rectangle_search(_boxes(spark, sf_dir, "stars", 3.0, 2.0), _boxes(spark, sf_dir, "sky", 9.0, 7.0), 5.0)


@query("j17_rectangle_contained", _with(_BOX + " SELECT q.id AS query, b.id FROM b, q WHERE b.x0 >= q.x0 AND b.x1 <= q.x1 AND b.y0 >= q.y0 AND b.y1 <= q.y1"))
def _(spark, sf_dir):
    from skyloom.operators.resample import rectangle_search

    return rectangle_search(_boxes(spark, sf_dir, "stars", 3.0, 2.0), _boxes(spark, sf_dir, "sky", 9.0, 7.0), 5.0, contained=True)


@query("w08_core_peak", _with(_ONE + """ SELECT image_id, round(max(v) + 3.3e-7, 4) + 0e0 AS peak FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY (i - 16) * (i - 16) + (j - 16) * (j - 16), i, j) AS k, count(*) OVER (PARTITION BY image_id) AS n
  FROM p1 WHERE (i - 16) * (i - 16) + (j - 16) * (j - 16) <= 81) WHERE k <= n // 4 GROUP BY image_id"""))
def _(spark, sf_dir):
    from skyloom.operators.resample import peak_in_core

    return peak_in_core(pixels.radial_profile(_one(spark, sf_dir), 16, 16, 9)).select("image_id", _off("peak").alias("peak"))


@query("p23_gap_rotation", _with(_FIT + " SELECT image_id, round(b, 3) AS a, round(-a, 3) AS b FROM f"))
def _(spark, sf_dir):
    from skyloom.operators.resample import gap_rotation

    a, b = gap_rotation(F.col("a"), F.col("b"))
    return fits.plane_round(view(spark, sf_dir, "pix")).select("image_id", _r(a, 3).alias("a"), _r(b, 3).alias("b"))


@query("a22_flux_calibration", "SELECT p_size % 5 AS image_id, round(avg(log10(p_retailprice) + p_size / 2.512e0), 6) AS m, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf_dir):
    from skyloom.operators.resample import flux_calibration

    m = _table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("image_id"), F.col("p_retailprice").alias("flux"), F.col("p_size").alias("mag"))
    return flux_calibration(m, rounds=1).select("image_id", _r("m", 6).alias("m"), "n")


@query("a20_pyramid_order", "SELECT round(min(p_retailprice / 1e6), 6) AS scale, greatest(0, ceil(log2(90 / sqrt(2e0) / min(p_retailprice / 1e6))))::INT AS \"order\" FROM part")
def _(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select((-F.col("p_retailprice") / 1e6).alias("cdelt1"), (F.col("p_retailprice") / 1e6).alias("cdelt2"))
    return geometry.pixel_scale_order(p).select(_r("scale", 6).alias("scale"), "order")


@query("f20_stretch", sql("SELECT image_id, i, j, floor(255 * least(1, greatest(0, (v - 1000) / 90000e0)) + 0.5e0)::INT AS linear, floor(255 * log10(1 + 9 * least(1, greatest(0, (v - 1000) / 90000e0))) + 0.5e0)::INT AS logarithmic FROM pix"))
def _(spark, sf_dir):
    from skyloom.functions.mathematics import stretch

    return view(spark, sf_dir, "pix").select("image_id", "i", "j", stretch(F.col("v"), 1000.0, 91000.0).alias("linear"), stretch(F.col("v"), 1000.0, 91000.0, "log").alias("logarithmic"))


@query("f18_inverse_normal")
def _(spark, sf_dir):
    from skyloom.functions.mathematics import inverse_normal

    return spark.range(1, 1000).select("id", inverse_normal(F.col("id") / 1000.0).alias("x"))


@query("f28_strings", """SELECT s_suppkey, trim('  ' || s_name || ' ') AS name, replace(s_name, '#', '%23') AS encoded, s_name AS decoded, s_suppkey % 2 = 0 AS is_blank, '&lt;b&gt; &amp; &quot;' || s_suppkey AS html, s_name || '|a b|c' AS words FROM supplier""")
def _(spark, sf_dir):
    from skyloom.operators import tables

    s = _table(spark, sf_dir, "supplier")
    words = tables.split_command(F.concat(F.lit("'"), "s_name", F.lit("'  \"a b\" c")))
    return s.select(
        "s_suppkey", F.trim(F.concat(F.lit("  "), "s_name", F.lit(" "))).alias("name"), F.url_encode("s_name").alias("encoded"), F.url_decode(F.url_encode("s_name")).alias("decoded"),
        tables.is_blank(F.when(F.col("s_suppkey") % 2 == 0, F.lit(" \t")).otherwise(F.lit("x "))).alias("is_blank"), tables.html_encode(F.concat(F.lit('<b> & "'), "s_suppkey")).alias("html"), F.array_join(words, "|").alias("words"),
    )


@query("f31_multimap", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first, list_sort(list(n_name))[2] AS second, NULL::VARCHAR AS missing FROM nation GROUP BY n_regionkey")
def _(spark, sf_dir):
    from skyloom.operators.tables import look_up, multimap

    m = multimap(_table(spark, sf_dir, "nation"), "n_regionkey", "n_name")
    key = F.col("n_regionkey")
    return m.select("n_regionkey", F.size(F.element_at("entries", key.cast("string"))).cast("long").alias("n"), *[look_up(F.col("entries"), k, i).alias(c) for k, i, c in ((key, 0, "first"), (key, 1, "second"), (key, 99, "missing"))])


# --- more coordinates and tiles ---------------------------------------------------------------------

@query("f07_precession", sql("""SELECT cntr, round(degrees(asin(sin(t) * cos(radians(dec)) * cos(radians(ra + ze)) + cos(t) * sin(radians(dec)))), 4) AS lat FROM stars,
  (SELECT (2306.2181e0 * -0.5e0 + 0.30188e0 * 0.25e0 + 0.017998e0 * -0.125e0) / 3600 AS ze, radians((2004.3109e0 * -0.5e0 - 0.42665e0 * 0.25e0 - 0.041833e0 * -0.125e0) / 3600) AS t)"""))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", _r(coords.precess(F.col("ra"), F.col("dec"), 1950.0)[1]).alias("lat"))


@query("f04_supergalactic", sql("SELECT cntr, round(degrees(asin(greatest(-1, least(1, cos(radians(6.32e0)) * cos(radians(dec)) * cos(radians(ra - 47.37e0)) + sin(radians(6.32e0)) * sin(radians(dec)))))), 4) AS lat FROM stars"))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", _r(coords.galactic_to_supergalactic(F.col("ra"), F.col("dec"))[1]).alias("lat"))


@query("f10_units", sql("SELECT cntr, round(ra * 3600, 2) AS arcsec, round(radians(dec), 6) AS rad FROM stars"))
def _(spark, sf_dir):
    s = view(spark, sf_dir, "stars")
    return s.select("cntr", _r(coords.convert_angle(F.col("ra"), "deg", "arcsec"), 2).alias("arcsec"), _r(coords.convert_angle(F.col("dec"), "deg", "rad"), 6).alias("rad"))


@query("f15_edge_normals", sql(f"SELECT cntr, round(y, 5) + 0e0 AS nx, round(-x, 5) + 0e0 AS ny FROM (SELECT cntr, {_uv()} FROM stars)"))
def _(spark, sf_dir):
    n = coords.cross(coords.unit(F.col("ra"), F.col("dec")), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return view(spark, sf_dir, "stars").select("cntr", (_r(n[0], 5) + 0.0).alias("nx"), (_r(n[1], 5) + 0.0).alias("ny"))


@query("k06_tile_paths", sql("SELECT DISTINCT i, j, 'Norder5/Dir' || ((i * 1000 + j) // 10000 * 10000) || '/Npix' || (i * 1000 + j) AS path FROM pix"))
def _(spark, sf_dir):
    p = view(spark, sf_dir, "pix").select("i", "j").distinct()
    return p.withColumn("path", coords.tile_path(F.lit(5), F.col("i") * 1000 + F.col("j")))


@query("j16_tile_pairs", sql("SELECT a.i, a.j, b.i AS i_2, b.j AS j_2 FROM (SELECT DISTINCT i, j FROM pix) a JOIN (SELECT DISTINCT i, j FROM pix) b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)"))
def _(spark, sf_dir):
    return geometry.neighbour_tiles(view(spark, sf_dir, "pix").select("i", "j").distinct())


@query("a07_bounding_info", sql("SELECT image_id, min(i) AS xmin, max(i) AS xmax, min(j) AS ymin, max(j) AS ymax, round(avg(i), 4) AS xcenter, round(avg(j), 4) AS ycenter, count(*) AS npixel FROM pix WHERE v IS NOT NULL GROUP BY image_id"))
def _(spark, sf_dir):
    return pixels.bounding_info(view(spark, sf_dir, "pix")).withColumns({c: _r(c) for c in ("xcenter", "ycenter")})


@query("a07_oriented_box", sql("""SELECT image_id, round(min(area), 4) AS area FROM (SELECT image_id, a, (max(i * cos(radians(a)) + j * sin(radians(a))) - min(i * cos(radians(a)) + j * sin(radians(a)))) * (max(j * cos(radians(a)) - i * sin(radians(a))) - min(j * cos(radians(a)) - i * sin(radians(a)))) AS area
  FROM (SELECT image_id, i, j FROM pix WHERE i + j BETWEEN 20 AND 40), (SELECT unnest(range(180)) / 2e0 AS a) GROUP BY image_id, a) GROUP BY image_id"""))
def _(spark, sf_dir):
    b = pixels.oriented_box(view(spark, sf_dir, "pix").filter("i + j BETWEEN 20 AND 40"))
    return b.select("image_id", _r(F.col("width") * F.col("height")).alias("area"))


@query("a19_synthetic_sky", sql("""SELECT floor(ra)::INT + dx AS i, floor(dec)::INT + dy AS j, round(sum(greatest(3, pow(10e0, 0.4e0 * (5 - cntr % 8)))) / 9 + 3.3e-7, 4) + 0e0 AS v FROM stars, (SELECT unnest([-1, 0, 1])::INT AS dx), (SELECT unnest([-1, 0, 1])::INT AS dy) GROUP BY 1, 2"""))
def _(spark, sf_dir):
    from skyloom.operators.resample import synthetic_sky

    s = view(spark, sf_dir, "stars").select(F.floor("ra").cast("int").alias("x"), F.floor("dec").cast("int").alias("y"), (F.col("cntr") % 8).alias("mag"))
    return synthetic_sky(s, 1, 5.0).select("i", "j", _off("v").alias("v"))


@query("a21_bounding_box", sql("SELECT cntr % 7 AS field, round(min(dec), 4) AS south, round(max(dec), 4) AS north FROM stars GROUP BY 1"))
def _(spark, sf_dir):
    s = view(spark, sf_dir, "stars").withColumn("field", F.col("cntr") % 7)
    return geometry.bounding_box(s, "field").select("field", _r("south").alias("south"), _r("north").alias("north"))
