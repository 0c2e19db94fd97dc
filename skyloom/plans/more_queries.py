"""Registered queries of sky tiles, files and lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyloom.operators import fits as fitted
from skyloom.operators import hips, pixels
from skyloom.plans.queries import _HIST, _ONE, _one, _r, _table, _with, query
from skyloom.plans.sky_queries import _clipped_sql
from skyloom.plans.views import sql, view
from skyloom.sources import files, fits, fixed_width
from skyloom.storage import shared_folder

_ORDER = 4


@query("f23_sky_to_tile", sql("""SELECT cntr, (face * 256 + """ + " + ".join(f"((x >> {b} & 1) << {2 * b}) + ((y >> {b} & 1) << {2 * b + 1})" for b in range(4)) + """)::BIGINT AS tile FROM (SELECT cntr,
 CASE WHEN abs(z) <= 2e0 / 3 THEN CASE WHEN jp // 16 = jm // 16 THEN (jp // 16) % 4 + 4 WHEN jp // 16 < jm // 16 THEN jp // 16 ELSE jm // 16 + 8 END WHEN z > 0 THEN q ELSE q + 8 END AS face,
 CASE WHEN abs(z) <= 2e0 / 3 THEN jm % 16 WHEN z > 0 THEN 15 - b ELSE a END AS x, CASE WHEN abs(z) <= 2e0 / 3 THEN 15 - jp % 16 WHEN z > 0 THEN 15 - a ELSE b END AS y
 FROM (SELECT *, floor(16 * (0.5e0 + t) - 12 * z)::INT AS jp, floor(16 * (0.5e0 + t) + 12 * z)::INT AS jm, least(15, floor((t - q) * 16 * sqrt(3 * (1 - abs(z)))))::INT AS a, least(15, floor((1 - t + q) * 16 * sqrt(3 * (1 - abs(z)))))::INT AS b
 FROM (SELECT cntr, sin(radians(dec)) AS z, ra / 90 AS t, least(3, floor(ra / 90))::INT AS q FROM stars)))"""))
def _(spark, sf_dir):
    return view(spark, sf_dir, "stars").select("cntr", hips.tile_of(F.col("ra"), F.col("dec"), _ORDER).alias("tile"))


@query("f23_tile_to_sky", "SELECT range AS npix, range AS back FROM range(3072)")
def _(spark, sf_dir):
    centre = hips.all_tiles(spark, _ORDER).select("npix", *[c.alias(n) for c, n in zip(hips.tile_centre(F.col("npix"), _ORDER), ("lon", "lat"), strict=True)])
    return centre.select("npix", hips.tile_of(F.col("lon"), F.col("lat"), _ORDER).alias("back"))


@query("x04_missing_tiles", "SELECT 4 AS norder, range AS npix FROM range(3072) WHERE range NOT IN (SELECT DISTINCT c_custkey * 7 % 3072 FROM customer)")
def _(spark, sf_dir):
    there = _table(spark, sf_dir, "customer").select(F.lit(_ORDER).alias("norder"), (F.col("c_custkey") * 7 % 3072).alias("npix"))
    return hips.missing_tiles(hips.all_tiles(spark, _ORDER), there)


@query("k06_tile_files", _with(_ONE + " SELECT DISTINCT 'Norder4/Dir0/Npix' || image_id || '.png' AS path FROM p1"))
def _(spark, sf_dir):
    p = _one(spark, sf_dir).select(F.lit(_ORDER).alias("norder"), F.col("image_id").cast("long").alias("npix"), "i", "j", F.floor(F.col("v") / 400).alias("grey"))
    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    return files.write_files(hips.tile_pictures(p, 32), folder, content="png").select("path")


@query("s01_table_files", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf_dir):
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    fixed_width.write_fixed_width(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder, 24, {"origin": "supplier"})
    return fixed_width.read_fixed_width(spark, folder)


@query("s03_record_access", "SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS recno FROM supplier) WHERE recno IN (0, 3, 7)")
def _(spark, sf_dir):
    from skyloom.operators.tables import with_record

    return with_record(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").filter(F.col("recno").isin(0, 3, 7)).drop("recno")


@query("s11_image_files", _with(_ONE + " SELECT image_id, i, j, round(v, 6) AS v FROM p1 WHERE v IS NOT NULL"))
def _(spark, sf_dir):
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    made = fits.assemble(_one(spark, sf_dir), 32, 32).select(F.concat(F.lit("im"), "image_id", F.lit(".fits")).alias("path"), F.col("fits").alias("content"))
    files.write_files(made, folder).write.format("noop").mode("overwrite").save()
    back = fits.long_view(fits.read_pixels(spark, folder)).filter("v IS NOT NULL")
    return back.select(F.regexp_extract("path", r"im(\d+)\.fits$", 1).cast("int").alias("image_id"), "i", "j", _r("v", 6).alias("v"))


@query("s10_header_text", sql("SELECT cntr, 'CRVAL1  = ' || cntr || chr(10) || 'NAXIS   = 2' || chr(10) || 'END' AS text FROM sky"))
def _(spark, sf_dir):
    from skyloom.functions.headers import header_text

    h = F.create_map(F.lit("NAXIS"), F.lit("2"), F.lit("CRVAL1"), F.col("cntr").cast("string"))
    return view(spark, sf_dir, "sky").select("cntr", header_text(h).alias("text"))


@query("s19_box_mask", sql("""SELECT image_id, i, j, CASE WHEN EXISTS (SELECT 1 FROM (SELECT s_suppkey % 29 AS x, s_suppkey % 31 AS y FROM supplier) b WHERE i BETWEEN x AND x + 1 AND j BETWEEN y AND y + 2) THEN NULL ELSE v END AS v FROM pix"""))
def _(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = _table(spark, sf_dir, "supplier").select(F.concat_ws(" ", k % 29, k % 29 + 1, k % 31, k % 31 + 2, F.lit("star")).alias("value"))
    return files.mask_by_boxes(view(spark, sf_dir, "pix"), files.box_lines(lines)).select("image_id", "i", "j", "v")


@query("s20_fit_status", sql("SELECT image_id AS plus, image_id + 1 AS minus, 0.5e0 AS a, -1e0 AS b, image_id + 0.25e0 AS c, 2e0 AS rms, count(*) AS npixel FROM pix WHERE image_id % 5 <> 4 GROUP BY image_id"))
def _(spark, sf_dir):
    p = view(spark, sf_dir, "pix").groupBy("image_id").agg(F.count("*").alias("n"))
    good = F.format_string('[struct stat="OK", a=0.5, b=-1.0, c=%d.25, crpix1=1, npixel=%d, rms=2.0]', F.col("image_id"), F.col("n"))
    text = F.when(F.col("image_id") % 5 == 4, F.lit('[struct stat="ERROR", msg="no overlap"]')).otherwise(good)
    return files.fit_status(p.select(F.col("image_id").alias("plus"), (F.col("image_id") + 1).alias("minus"), text.alias("text")))


@query("f29_struct_lookup", "SELECT s_suppkey, s_name AS name, s_suppkey::VARCHAR AS n, NULL::VARCHAR AS missing, '[struct ra=1 dec=2]' AS coord FROM supplier")
def _(spark, sf_dir):
    text = F.concat(F.lit('[struct stat="OK", name="'), "s_name", F.lit('", coord=[struct ra=1 dec=2], n='), F.col("s_suppkey").cast("string"), F.lit("]"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", *[files.struct_value(text, k).alias(k) for k in ("name", "n", "missing", "coord")])


@query("a03_cube_modes", "SELECT vec_id % 10 AS i, k, round(median(v), 4) AS median, count(v)::DOUBLE AS n FROM (SELECT vec_id, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def _(spark, sf_dir):
    from skyloom.plans.queries import _cube

    cube = _cube(spark, sf_dir).withColumn("area", F.lit(1.0))
    median = pixels.coadd(cube, "median", ("i", "k")).select("i", "k", _r("v").alias("median"))
    return median.join(pixels.coadd(cube, "count", ("i", "k")).select("i", "k", F.col("v").alias("n")), ["i", "k"])


@query("f18_normal_quantiles", "SELECT id, p FROM (SELECT range AS id, range / 1000e0 AS p FROM range(1, 1000))")
def _(spark, sf_dir):
    """The distribution function of each quantile is the share again."""
    from skyloom.functions.mathematics import inverse_normal, normal_cdf

    quantiles = spark.range(1, 1000).select("id", inverse_normal(F.col("id") / 1000.0).alias("x"))
    return quantiles.select("id", _r(normal_cdf(F.col("x")), 9).alias("p"))


@query("w03_gaussian_levels", _with(_HIST + ", t AS (SELECT bin, cumulative, sum(n) OVER () AS total FROM h) SELECT bin, CASE WHEN cumulative = 0 THEN NULL ELSE round(least(cumulative, total - 1) / total::DOUBLE, 8) END AS share, cumulative = 0 AS lowest FROM t"))
def _(spark, sf_dir):
    """The distribution function of each bin's level is the share before the bin; the first bin has the least level."""
    from skyloom.functions.mathematics import normal_cdf
    from skyloom.functions.stretches import GAUSSIAN_LIMIT, gaussian_levels

    levels = gaussian_levels(pixels.histogram(view(spark, sf_dir, "pix"), 200))
    lowest = F.col("gausslev") == -GAUSSIAN_LIMIT
    return levels.select("bin", F.when(~lowest, _r(normal_cdf(F.col("gausslev")), 8)).alias("share"), lowest.alias("lowest"))


def _calibrated(rounds: int) -> str:
    """One pair of common table expressions a round; ``z`` starts wide open."""
    out = ["WITH d AS (SELECT p_size % 5 AS image_id, log10(p_retailprice) + p_size / 2.512e0 AS d FROM part), c0 AS (SELECT DISTINCT image_id, 0e0 AS m, 1e300 AS s, 0 AS n FROM d)"]
    for k in range(rounds):
        out.append(f"a{k} AS MATERIALIZED (SELECT image_id, avg(d) AS m, count(*) AS n FROM d JOIN c{k} c USING (image_id) WHERE abs(d - c.m) <= 2 * c.s GROUP BY image_id)")
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT image_id, any_value(a.m) AS m, sqrt(avg((d - a.m) ** 2)) AS s, any_value(a.n) AS n FROM d JOIN c{k} c USING (image_id) JOIN a{k} a USING (image_id) WHERE abs(d - a.m) <= 2 * c.s GROUP BY image_id)")
    return ", ".join(out) + f" SELECT image_id, round(m, 6) AS m, n FROM c{rounds}"


@query("a22_flux_calibration_converged", _calibrated(30))
def _(spark, sf_dir):
    from skyloom.operators.resample import converged_calibration

    m = _table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("image_id"), F.col("p_retailprice").alias("flux"), F.col("p_size").alias("mag"))
    return converged_calibration(m).select("image_id", _r("m", 6).alias("m"), "n")


@query("a05_clipped_plane", _with(_clipped_sql(20, False) + " SELECT image_id, round(a, 2) AS a, round(b, 2) AS b, round(c, 1) AS c, npixel FROM f19"))
def _(spark, sf_dir):
    f = fitted.clipped_plane_grouped(view(spark, sf_dir, "pix"))
    return f.select("image_id", _r("a", 2).alias("a"), _r("b", 2).alias("b"), _r("c", 1).alias("c"), "npixel")
