"""Operators against planted answers, edge cases and slower definitions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyloom.functions import coords
from skyloom.functions.parsing import parse_select_list
from skyloom.operators import fits, geometry, pixels
from skyloom.sources import fits as fits_files
from skyloom.sources import fixed_width


def planted(spark, outliers=True):
    rows = [(0, i, j, 2.0 * i - 3.0 * j + 7 + (500.0 if outliers and (i * 31 + j) % 97 == 0 else 0.0), 1.0) for i in range(20) for j in range(20)]
    return spark.createDataFrame(rows, "image_id int, i int, j int, v double, area double")


def test_clipped_plane_finds_the_planted_plane(spark):
    for f in (lambda p: fits.clipped_plane_grouped(p), lambda p: fits.clipped_plane(p, rounds=4)):
        r = f(planted(spark)).first()
        assert np.allclose([r["a"], r["b"], r["c"]], [2, -3, 7], atol=1e-6)


def test_background_model_recovers_offsets():
    true = {0: 5.0, 1: -2.0, 2: 1.0, 3: 0.5}
    edges = [(0, 1), (1, 2), (2, 3), (0, 3)]
    table = pd.DataFrame([(p, m, 0.0, 0.0, true[p] - true[m], 10.0, 0.0, 0.0, 10.0, 0.0, 10.0) for p, m in edges], columns=["plus", "minus", "a", "b", "c", "xx", "xy", "x", "yy", "y", "n"])
    got = fits.solve_corrections(table, rounds=6000)
    left = np.array([true[i] - c for i, c in zip(got["id"], got["c"], strict=True)])
    assert np.ptp(left) < 1e-6


def test_blank_rules(spark):
    p = spark.createDataFrame([(0, 0, 0, None, 1.0), (0, 0, 0, 4.0, 0.0), (1, 1, 1, float("nan"), 2.0), (1, 1, 1, 3.0, 2.0)], "image_id int, i int, j int, v double, area double")
    got = {(r["i"], r["j"]): r["v"] for r in pixels.coadd(pixels.fix_blanks(p)).collect()}
    assert got == {(0, 0): None, (1, 1): 3.0}
    assert pixels.coadd(p.limit(0)).count() == 0


def test_overlap_join_equals_brute_force_at_the_poles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(a), float(d)) for k, (a, d) in enumerate(zip(rng.uniform(0, 360, 80), np.concatenate([rng.uniform(85, 90, 40), rng.uniform(-5, 5, 40)]), strict=True))]
    df = spark.createDataFrame(rows, "cntr long, ra double, dec double")
    got = {(r["plus"], r["minus"]) for r in geometry.overlaps(df, 4.0).collect()}
    v = [np.array([np.cos(np.radians(d)) * np.cos(np.radians(a)), np.cos(np.radians(d)) * np.sin(np.radians(a)), np.sin(np.radians(d))]) for _, a, d in rows]
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if np.degrees(np.arccos(np.clip(v[i] @ v[j], -1, 1))) <= 8.0}


def test_sexagesimal_round_trip(spark):
    df = spark.createDataFrame([(-0.5,), (12.3456789,), (0.0,), (359.9999999,)], "x double")
    out = df.select("x", coords.parse_sexagesimal(coords.sexagesimal(F.col("x"), 4)).alias("y")).collect()
    assert all(abs(r["x"] - r["y"]) < 1e-7 for r in out)
    assert spark.createDataFrame([("abc",)], "t string").select(coords.parse_sexagesimal(F.col("t")).alias("y")).first()["y"] is None


def test_inverse_normal(spark):
    from statistics import NormalDist

    from skyloom.functions.mathematics import hex_colour, inverse_normal, polygon_area

    p = [1e-5, 0.001, 0.16, 0.5, 0.6, 0.84, 0.999, 0.99999, 1e-9, 1e-100, 1 - 1e-7, 0.0, 1.0]
    got = [r["x"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(p)], "k int, p double").orderBy("k").select(inverse_normal(F.col("p")).alias("x")).collect()]
    assert got[-2:] == [None, None] and np.allclose(got[:-2], [NormalDist().inv_cdf(x) for x in p[:-2]], atol=1e-6)
    one = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 3.0, 3.0], "#10fF00")], "x array<double>, y array<double>, c string")
    assert tuple(one.select(polygon_area(F.col("x"), F.col("y")), *hex_colour(F.col("c"))).first()) == (6.0, 16, 255, 0)


def test_select_list():
    assert parse_select_list("5,1:3") == [(1, 3), (5, 5)]


def test_fixed_width_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 1.5), (2, None, None)], "n long, s string, x double")
    fixed_width.write_fixed_width(df.coalesce(1), str(tmp_path / "t"), keywords={"origin": "test"})
    back = fixed_width.read_fixed_width(spark, str(tmp_path / "t"))
    assert back.dtypes == [("n", "bigint"), ("s", "string"), ("x", "double")]
    assert sorted(map(tuple, back.collect())) == [(1, "a b", 1.5), (2, None, None)]
    spark.dataSource.register(fixed_width.FixedWidthDataSource)
    part = next((tmp_path / "t").glob("part-*"))
    assert spark.read.format("fixedwidth").load(str(part)).count() == 2
    assert fixed_width.header_of(spark, str(tmp_path / "t")).keywords == {"origin": "test"}


def test_fits_files(spark, tmp_path):
    image = np.arange(12.0).reshape(3, 4)
    image[1, 2] = np.nan
    (tmp_path / "a.fits").write_bytes(fits_files.to_fits(image, {"CTYPE1": "RA---TAN", "CRVAL1": 10.5}))
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in fits_files.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.fits"]["header"]["CTYPE1"] == "RA---TAN" and heads["bad.fits"]["header"] is None and heads["bad.fits"]["error"]
    (tmp_path / "bad.fits").unlink()
    got = {(r["i"], r["j"]): r["v"] for r in fits_files.long_view(fits_files.read_pixels(spark, str(tmp_path))).collect()}
    assert got[(3, 2)] == 11.0 and got[(2, 1)] is None and len(got) == 12


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_json_paths_equal_duckdb(spark):
    import duckdb

    from skyloom.functions.parsing import json_value

    texts = ['{"k": 87}', '{"k": {"n": "x y", "l": [1, {"z": true}]}}', '{"k": null}', "{}", '{"k": "a\\"b"}', None]
    paths = ["$.k", "$.k.n", "$.k.l[1].z", "$.missing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [tuple(r) for r in df.select("id", *[json_value(F.col("t"), p).alias(f"c{k}") for k, p in enumerate(paths)]).sort("id").collect()]
    db = duckdb.connect()
    for row, t in zip(got, texts, strict=True):
        want = [db.execute("SELECT json_extract_string(?::VARCHAR, ?)", [t, p]).fetchone()[0] for p in paths]
        assert [v and v.replace(" ", "") for v in row[1:]] == [v and v.replace(" ", "") for v in want]


def test_apertures_of_every_image(spark):
    from skyloom.operators.resample import aperture_sums

    rng = np.random.default_rng(4)
    pix = [(int(m), int(i), int(j), float(v)) for m, i, j, v in zip(rng.integers(0, 5, 400), rng.integers(0, 20, 400), rng.integers(0, 20, 400), rng.normal(size=400), strict=True)]
    stars = [(k, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 20, (12, 2)))]
    got = {(r["image_id"], r["cntr"]): (r["flux"], r["n"]) for r in aperture_sums(spark.createDataFrame(stars, "cntr int, x int, y int"), spark.createDataFrame(pix, "image_id int, i int, j int, v double"), 3.0, "image_id").collect()}
    want = {}
    for m, i, j, v in pix:
        for k, x, y in stars:
            if (i - x) ** 2 + (j - y) ** 2 <= 9:
                want.setdefault((m, k), []).append(v)
    assert got.keys() == want.keys() and all(n == len(want[k]) and abs(f - sum(want[k])) < 1e-9 for k, (f, n) in got.items())


def test_converged_calibration_equals_brute_force(spark):
    from skyloom.operators.resample import converged_calibration

    rng = np.random.default_rng(5)
    rows = [(k % 3, float(10 ** (2 + rng.normal(0, 0.02) + (3 if k % 11 == 0 else 0.3 if k % 7 == 0 else 0))), 0.0) for k in range(300)] + [(7, 10.0, 0.0)]
    got = {r["image_id"]: r for r in converged_calibration(spark.createDataFrame(rows, "image_id int, flux double, mag double")).collect()}
    for image in (0, 1, 2, 7):
        y, b, s = np.array([np.log10(f) for k, f, _ in rows if k == image]), 0.0, np.inf
        for k in range(100):
            use = y[np.abs(y - b) <= 2 * s]
            old, b = b, use.mean()
            near = y[np.abs(y - b) <= 2 * s]
            s = np.sqrt(((near - b) ** 2).mean())
            if k and abs(old - b) <= 1e-8 * abs(old):
                break
        assert abs(got[image]["m"] - b) < 1e-9 and got[image]["n"] == len(use)


def test_corrections_go_on_to_planes():
    x, y = (g.ravel().astype(float) for g in np.meshgrid(np.arange(-4, 5), np.arange(-4, 5)))
    sums = {"xx": (x * x).sum(), "xy": (x * y).sum(), "yy": (y * y).sum(), "x": 0.0, "y": 0.0, "n": float(len(x))}
    planes = np.array([[0.1, -0.2, 0.0], [0.3, 0.1, 0.0], [-0.4, 0.1, 0.0]])  # slopes only: the level rounds have nothing to do
    edges = pd.DataFrame([{"plus": p, "minus": q, **dict(zip("abc", planes[p] - planes[q], strict=True)), **sums} for p, q in ((0, 1), (1, 2), (0, 2))])
    got = fits.solve_corrections(edges)[["a", "b", "c"]].to_numpy()
    assert np.allclose(got[0] - got[1], planes[0] - planes[1]) and np.allclose(got[1] - got[2], planes[1] - planes[2])
