"""Projections, footprints, tiles, photometry, stretches, headers and the mosaic against planted answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import coords, headers, projections, stretches
from skyloom.operators import background, footprints, hips, photometry, tables
from skyloom.sources import files
from skyloom.sources import fits as fits_files


def positions(spark, rows):
    return spark.createDataFrame([(k, float(a), float(d)) for k, (a, d) in enumerate(rows)], "cntr int, ra double, dec double")


@pytest.mark.parametrize("code", projections.CODES)
def test_projections_come_back(spark, code):
    rng = random.Random(code)
    w = projections.Wcs(code, 355.0, -40.0, 10.5, 20.5, -0.02, 0.03, 33.0)
    near = [(355 + rng.uniform(-30, 30), -40 + rng.uniform(-30, 30)) for _ in range(60)] + [(355, -40)]
    x, y = projections.sky_to_pixel(F.col("ra"), F.col("dec"), w)
    there = positions(spark, near).select("ra", "dec", x.alias("x"), y.alias("y"))
    ra, dec = projections.pixel_to_sky(F.col("x"), F.col("y"), w)
    for r in there.select("*", ra.alias("a"), dec.alias("d")).collect():
        assert abs((r["a"] - r["ra"] + 180) % 360 - 180) < 1e-8 and abs(r["d"] - r["dec"]) < 1e-8
    middle = there.filter("ra = 355 AND dec = -40").first()
    assert abs(middle["x"] - 10.5) < 1e-9 and abs(middle["y"] - 20.5) < 1e-9


def test_points_off_the_projection_are_null(spark):
    df = positions(spark, [(180.0, 0.0)])
    for code in ("TAN", "SIN"):
        assert df.select(projections.sky_to_pixel(F.col("ra"), F.col("dec"), projections.Wcs(code, 0, 0, 0, 0, -1, 1))[0].alias("x")).first()["x"] is None
    for code in ("SIN", "AIT", "HPX", "CAR", "SFL", "CEA"):
        w = projections.Wcs(code, 0, 0, 0, 0, -1, 1)
        assert df.select(projections.pixel_to_sky(F.lit(185.0), F.lit(95.0), w)[1].alias("d")).first()["d"] is None, code


def test_headers_with_a_matrix():
    turn, s1, s2 = math.radians(25), -0.01, 0.02
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "10", "CRVAL2": "20", "CRPIX1": "1", "CRPIX2": "2"}
    matrix = {"CD1_1": s1 * math.cos(turn), "CD1_2": -s2 * math.sin(turn), "CD2_1": s1 * math.sin(turn), "CD2_2": s2 * math.cos(turn)}
    w = projections.Wcs.of(base | {k: str(v) for k, v in matrix.items()})
    assert np.allclose([w.cdelt1, w.cdelt2, w.crota2], [s1, s2, 25.0])
    assert projections.Wcs.of(base | {"CDELT1": "-1", "CDELT2": "1"}).crota2 == 0
    with pytest.raises(ValueError):
        projections.Wcs("XYZ", 0, 0, 0, 0, 1, 1)


def unit(a, d):
    a, d = np.radians(a), np.radians(d)
    return np.array([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])


def square(a, d, half):
    t, c = math.tan(math.radians(half)), unit(a, d)
    east = np.array([-np.sin(np.radians(a)), np.cos(np.radians(a)), 0])
    north = np.cross(c, east)
    return [v / np.linalg.norm(v) for v in (c + t * (x * east + y * north) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1)))]


def test_overlaps_equal_dense_sampling(spark):
    """Squares overlap where a point of a fine grid of one lies in the other; also at the pole and at longitude 0."""
    rng = random.Random(5)
    rows = [(rng.uniform(-8, 8) % 360, rng.uniform(-8, 8)) for _ in range(14)] + [(rng.uniform(0, 360), rng.uniform(82, 90)) for _ in range(14)]
    df = positions(spark, rows).withColumn("corners", footprints.square(F.col("ra"), F.col("dec"), 2.0))
    got = {(r["plus"], r["minus"]) for r in footprints.overlaps(df, 3.0).collect()}
    polygons = [square(a, d, 2.0) for a, d in rows]

    def inside(poly, p):
        s = [np.cross(poly[k], poly[(k + 1) % 4]) @ p for k in range(4)]
        return np.sum(poly, axis=0) @ p > 0 and (max(s) <= 1e-12 or min(s) >= -1e-12)

    grid = np.linspace(-1, 1, 25)
    for i, (a, d) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            met = False
            t, c = math.tan(math.radians(2.0)), unit(a, d)
            east = np.array([-np.sin(np.radians(a)), np.cos(np.radians(a)), 0])
            north = np.cross(c, east)
            for x in grid:
                met = met or any(inside(polygons[j], (p := c + t * (x * east + y * north)) / np.linalg.norm(p)) for y in grid)
            if met:
                assert (i, j) in got
            elif (i, j) in got:  # they touch by less than the grid's step
                assert np.degrees(np.arccos(unit(*rows[i]) @ unit(*rows[j]))) > 2.5
    assert got


def test_long_thin_images_do_not_overlap_by_their_circles(spark):
    thin = lambda d: F.array(*[coords.vector(coords.unit(F.lit(float(x)), F.lit(float(y)))) for x, y in ((10, d), (30, d), (30, d + 0.5), (10, d + 0.5))])
    df = spark.range(3).select(F.col("id").alias("cntr"), F.lit(20.0).alias("ra"), F.col("id").cast("double").alias("dec"), F.when(F.col("id") == 0, thin(0)).when(F.col("id") == 1, thin(1)).otherwise(thin(1.2)).alias("corners"))
    assert {tuple(r) for r in footprints.overlaps(df, 10.5).collect()} == {(1, 2)}


def test_crossing_images_overlap_without_corners_inside(spark):
    box = lambda *p: F.array(*[coords.vector(coords.unit(F.lit(float(x)), F.lit(float(y)))) for x, y in p])
    wide, tall = box((0, -1), (20, -1), (20, 1), (0, 1)), box((9, -10), (11, -10), (11, 10), (9, 10))
    df = spark.range(2).select(F.col("id").alias("cntr"), F.lit(10.0).alias("ra"), F.lit(0.0).alias("dec"), F.when(F.col("id") == 0, wide).otherwise(tall).alias("corners"))
    assert footprints.overlaps(df, 11.0).count() == 1
    assert footprints.overlaps_by_boundary(df, 11.0, 40).count() == 1
    assert footprints.covers(df, "box", [(30, 0), (31, 0), (31, 1), (30, 1)]).count() == 0 and footprints.covers(df, "cutout", [(10, 0)], 0.5).count() == 2
    with pytest.raises(ValueError):
        footprints.covers(df, "moon", [(0, 0)])


def test_image_index_of_files(spark, tmp_path):
    head = footprints.region_header(10.0, 20.0, 2.0, 1.0, 0.1)
    words = {k: float(v) if k[:2] == "CR" or k[:2] == "CD" else v for k, v in head.items() if k not in ("SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2")}
    made = spark.createDataFrame([("a/im.fits", bytearray(fits_files.to_fits(np.zeros((10, 20)), words))), ("a/im_area.fits", bytearray(fits_files.to_fits(np.zeros((10, 20)), words)))], "path string, content binary")
    assert files.write_files(made, str(tmp_path)).count() == 2
    row = footprints.index_images(fits_files.read_headers(spark, str(tmp_path))).collect()
    assert len(row) == 1 and abs(row[0]["ra"] - 10) < 1e-9 and abs(row[0]["dec"] - 20) < 1e-9 and row[0]["ra1"] > row[0]["ra3"] and row[0]["dec1"] < row[0]["dec3"]
    with pytest.raises(Exception, match="within the folder"):
        files.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "path string, content binary"), str(tmp_path)).count()


def test_images_from_pixels_keep_the_template(spark):
    pix = spark.createDataFrame([(1, i, j, float(i + 10 * j)) for i in range(3, 6) for j in range(2, 4)] + [(1, 0, 0, None)], "image_id int, i int, j int, v double")
    data = bytes(fits_files.assemble(pix, 8, 8, {"CRPIX1": 4.5, "CRPIX2": 4.5, "CTYPE1": "RA---TAN", "NAXIS1": "8"}).first()["fits"])
    (_, head, pixels), = fits_files.images(data)
    assert pixels.tolist() == [[23.0, 24.0, 25.0], [33.0, 34.0, 35.0]] and head["CRPIX1"] == "1.5" and head["CRPIX2"] == "2.5" and head["CTYPE1"] == "RA---TAN"
    whole = bytes(fits_files.assemble(pix, 8, 8).first()["fits"])
    assert next(fits_files.images(whole))[2].shape == (8, 8)


def test_tiles(spark):
    for order in (0, 1, 3, 6):
        t = hips.all_tiles(spark, order)
        lon, lat = hips.tile_centre(F.col("npix"), order)
        back = t.select("npix", lon.alias("lon"), lat.alias("lat")).withColumn("again", hips.tile_of(F.col("lon"), F.col("lat"), order))
        assert back.count() == 12 * 4**order and back.filter("npix <> again").count() == 0
    # a child lies within its parent
    p = positions(spark, [(random.Random(k).uniform(0, 360), math.degrees(math.asin(random.Random(k + 999).uniform(-1, 1)))) for k in range(300)])
    both = p.select(hips.tile_of(F.col("ra"), F.col("dec"), 3).alias("a"), hips.tile_of(F.col("ra"), F.col("dec"), 6).alias("b"))
    assert both.filter("floor(b / 64) <> a").count() == 0


def test_tile_pictures(spark, tmp_path):
    import struct
    import zlib

    pix = spark.createDataFrame([(2, 12345, i, j, float(10 * i + j)) for i in range(4) for j in range(4) if i != j], "norder int, npix long, i int, j int, grey double")
    r = hips.tile_pictures(pix, 4).first()
    data = bytes(r["png"])
    assert r["path"] == "Norder2/Dir10000/Npix12345.png" and data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (4, 4)
    at = data.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(4, 5)[::-1, 1:]
    assert rows.tolist() == [[0 if i == j else 10 * i + j for i in range(4)] for j in range(4)]
    files.write_files(hips.tile_pictures(pix, 4), str(tmp_path), content="png").collect()
    assert (tmp_path / "Norder2/Dir10000/Npix12345.png").read_bytes() == data


def test_mosaic_takes_out_levels_and_slopes(spark):
    planes = {0: (0.0, 0.0, 0.0), 1: (0.02, -0.01, 5.0), 2: (-0.01, 0.03, -3.0), 3: (0.01, 0.01, 8.0)}
    rows = []
    for k, (a, b, c) in planes.items():
        for i in range(16):
            for j in range(16):
                x, y = i + 8 * (k % 2), j + 8 * (k // 2)
                rows.append((k, x, y, 50.0 + 7 * math.sin(x) * math.cos(y) + a * x + b * y + c + (400.0 if (x * 31 + y * 17 + k) % 211 == 0 else 0.0), 1.0))
    pix = spark.createDataFrame(rows, "image_id int, i int, j int, v double, area double")
    assert {tuple(r) for r in background.overlapping_pairs(pix).collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    out = {(r["i"], r["j"]): r["v"] for r in background.mosaic(pix, rounds=20_000).collect()}
    flat = np.array([out[x, y] - 50 - 7 * math.sin(x) * math.cos(y) for x, y in out if not any((x * 31 + y * 17 + k) % 211 == 0 for k in planes)])
    x, y = (np.array([p[k] for p in out if not any((p[0] * 31 + p[1] * 17 + m) % 211 == 0 for m in planes)], float) for k in (0, 1))
    m = np.stack([x, y, np.ones(len(x))], 1)
    left = flat - m @ np.linalg.lstsq(m, flat, rcond=None)[0]  # what is left is one plane
    assert np.abs(left).max() < 0.05 and len(out) == 24 * 24


def test_clipped_planes_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 3, int(i), int(j), float(2.0 * i - j + 5 + rng.normal() + (300 if n % 23 == 0 else 0))) for k in range(3) for n, (i, j) in enumerate(rng.integers(0, 30, (200, 2)))] + [(9, 1, 1, 4.0), (9, 1, 1, 5.0)]
    got = {r["image_id"]: r for r in background.clipped_planes(spark.createDataFrame(rows, "image_id int, i int, j int, v double"), ["image_id"]).collect()}
    assert set(got) == {0, 1, 2}  # a single place has no plane
    for k in range(3):
        g = np.array([r[1:] for r in rows if r[0] == k], float)
        m, z, near = np.stack([g[:, 0], g[:, 1], np.ones(len(g))], 1), g[:, 2], np.ones(len(g), bool)
        for _ in range(20):
            p = np.linalg.lstsq(m[near], z[near], rcond=None)[0]
            rms = np.sqrt(((z[near] - m[near] @ p) ** 2).mean())
            n, near = near.sum(), np.abs(z - m @ p) <= 2 * rms
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"], got[k]["rms"]], [*p, rms], atol=1e-6) and got[k]["npixel"] == n


def test_edges_that_a_model_may_use(spark):
    images = spark.createDataFrame([(k, 100, 100) for k in range(5)], "image_id int, nx int, ny int")
    edges = spark.createDataFrame([(0, 1, 1.0, 500, 30, 5), (1, 2, 1.0, 500, 5, 5), (2, 3, 1.1, 10, 90, 90), (3, 4, 1.2, 900, 10, 25)], "plus int, minus int, rms double, npixel long, box_x int, box_y int")
    assert {r["plus"] for r in background.usable_edges(edges, images).collect()} == {0, 3}


def test_photometry_of_a_planted_source(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, j, 100.0 + float(rng.normal(0, 0.5)) + 5000 * math.exp(-((i - 20) ** 2 + (j - 15) ** 2) / (2 * 1.5**2))) for i in range(40) for j in range(40)] + [(2, 0, 0, None), (2, 1, 1, 3.0)]
    got = {r["image_id"]: r for r in photometry.aperture_photometry(spark.createDataFrame(rows, "image_id int, i int, j int, v double"), 12.0).collect()}
    r = got[1]
    assert (r["x"], r["y"]) == (20, 15) and abs(r["background"] - 100) < 0.3 and abs(r["flux"] / (5000 * 2 * math.pi * 1.5**2) - 1) < 0.02
    assert 1.9 < r["width"] < 2.6 and got[2]["n"] == 1  # 1.5 * sqrt(2) is where a Gaussian falls to 1/e
    curve = photometry.growth_curve(photometry.aperture(spark.createDataFrame(rows, "image_id int, i int, j int, v double"), spark.createDataFrame([(1, 20, 15)], "image_id int, x int, y int"), 12.0), spark.createDataFrame([(1, 100.0)], "image_id int, background double"))
    last = curve.orderBy(F.desc("r"), F.desc("i"), F.desc("j")).first()
    assert abs(last["flux"] - sum(v - 100 for _, i, j, v in rows[:-2] if (i - 20) ** 2 + (j - 15) ** 2 <= 144)) < 1e-6


def test_range_grammar():
    p = stretches.parse_bound
    assert p("min") == stretches.Bound("percentile", 0.0) and p("max-1.5") == stretches.Bound("percentile", 100.0, -1.5) and p("med+2") == stretches.Bound("percentile", 50.0, 2.0)
    assert p("-2s") == p("-2S") == stretches.Bound("sigma", -2.0) and p("99.5%+3") == stretches.Bound("percentile", 99.5, 3.0) and p("1e3") == stretches.Bound("value", 1000.0)
    for bad in ("", "abc", "120%", "5x", "min max", "--3"):
        with pytest.raises(ValueError):
            p(bad)


def test_gaussian_table_evens_out_the_histogram(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(3.0, 20_000)
    low, high = values.min(), values.max()
    counts = np.bincount(np.minimum(np.floor(999 * (values - low) / (high - low)), 999).astype(int), minlength=1000)
    hist = spark.createDataFrame([(k, float(low + k * (high - low) / 999), int(n)) for k, n in enumerate(counts) if n], "bin int, datalev double, n long")
    levels = stretches.gaussian_levels(hist)
    table = [r["datalev"] for r in stretches.lookup_table(levels, -2.0, 2.0).orderBy("step").collect()]
    from statistics import NormalDist

    g = [-2 + 4 * k / 255 for k in range(256)]
    want = np.quantile(values, [NormalDist().cdf(x) for x in g])
    assert np.abs(np.array(table) - want).max() < 0.1 and all(a <= b for a, b in zip(table, table[1:], strict=False))
    log = [r["datalev"] for r in stretches.lookup_table(levels, -2.0, 2.0, logarithmic=True).orderBy("step").collect()]
    assert log[0] == table[0] and abs(log[255] - table[255]) < 1e-9 and log[100] > table[100]
    grey = stretches.stretch_by_table(spark.createDataFrame([(-5.0,), (table[10] + 1e-9,), (1e9,), (None,)], "v double"), spark.createDataFrame(list(enumerate(table)), "step int, datalev double"))
    assert [r["grey"] for r in grey.collect()][1:] == [10, 255, None]


def test_positions_in_other_systems(spark):
    # published: the galactic centre and pole, the B1950 equinox and the ecliptic pole in J2000
    df = positions(spark, [(266.40499, -28.93617), (192.85948, 27.12825), (270.0, 66.560709), (0.640691, 0.278409)])
    def at(k, *names, **more):
        lon, lat = coords.convert(F.col("ra"), F.col("dec"), *names, **more)
        r = df.filter(f"cntr = {k}").select(lon.alias("l"), lat.alias("b")).first()
        return r["l"], r["b"]

    l, b = at(0, "EQUJ", "GAL")
    assert min(l, 360 - l) < 1e-4 and abs(b) < 1e-4
    assert abs(at(1, "EQUJ", "GAL")[1] - 90) < 1e-3 and abs(at(2, "EQUJ", "ECLJ")[1] - 90) < 1e-4
    l, b = at(3, "EQUJ", "EQUB")
    assert min(l, 360 - l) < 2e-4 and abs(b) < 2e-4
    with pytest.raises(ValueError):
        coords.convert(F.lit(0.0), F.lit(0.0), "EQUJ", "MOON")


def test_position_strings(spark):
    texts = ["10:41:04.0 +41d16m09s EQUB B1950", "12.5 -3.25 gal", "10h41m4s 41.5", "160.5, 41.5", "10:30:00 5 ecl", "nothing", "1 2 3 4 5", "10 95", "1.5 -0:30:00 equ J2010", None]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(coords.parse_position(F.col("t")).alias("p")).collect()]
    near = lambda p, lon, lat, system, epoch: abs(p["lon"] - lon) < 1e-9 and abs(p["lat"] - lat) < 1e-9 and p["system"] == system and p["epoch"] == epoch
    assert near(got[0], 15 * (10 + 41 / 60 + 4 / 3600), 41 + 16 / 60 + 9 / 3600, "EQUB", 1950.0) and near(got[1], 12.5, -3.25, "GAL", None) and near(got[2], 15 * (10 + 41 / 60 + 4 / 3600), 41.5, "EQUJ", 2000.0)
    assert near(got[3], 160.5, 41.5, "EQUJ", 2000.0) and near(got[4], 10.5 * 15, 5.0, "ECLJ", 2000.0) is False and got[4]["system"] == "ECLJ" and abs(got[4]["lon"] - 10.5) < 1e-9
    assert got[5] is None and got[6] is None and got[7] is None and near(got[8], 1.5, -0.5, "EQUJ", 2010.0) and got[9] is None


def test_colours_paths_and_area(spark):
    df = spark.createDataFrame([("Red",), ("#10fF00",), ("0000ff",), ("nothing",)], "c string")
    assert [tuple(r) for r in df.select(*headers.colour(F.col("c"))).collect()] == [(255, 0, 0), (16, 255, 0), (0, 0, 255), (None, None, None)]
    octant = F.array(*[coords.vector([F.lit(float(x)) for x in v]) for v in ((1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))])
    assert abs(df.limit(1).select(headers.spherical_area(octant).alias("a")).first()["a"] - math.pi / 2) < 1e-12


def test_sort_places_with_an_outlier(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["7", "abc", " 3.5x", "1e3", str(rng.random()), None])) for k in range(500)] + [(500, "1e30")]
    got = sorted((r["place"], r["k"]) for r in tables.sort_places(spark.createDataFrame(rows, "k int, v string"), "v", "k", ranges=16).collect())
    value = {"7": 7.0, "abc": 0.0, " 3.5x": 3.5, "1e3": 1000.0, "1e30": 1e30, None: 0.0}
    want = sorted(rows, key=lambda r: (value[r[1]] if r[1] in value else float(r[1]), r[0]))
    assert got == [(k + 1, r[0]) for k, r in enumerate(want)]


def test_box_lists(spark):
    lines = spark.createDataFrame([("3 5 4 4",), ("# no box",), ("0 40 0 0 star",), ("5 3 1 1",)], "value string")
    pix = spark.createDataFrame([(1, i, j, 1.0, 1.0) for i in range(40) for j in range(6)], "image_id int, i int, j int, v double, area double")
    out = files.mask_by_boxes(pix, files.box_lines(lines))
    assert out.columns == pix.columns and {(r["i"], r["j"]) for r in out.filter("v IS NULL").collect()} == {(i, 0) for i in range(40)} | {(3, 4), (4, 4), (5, 4)} and out.count() == pix.count()
