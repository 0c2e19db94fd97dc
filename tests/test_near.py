"""Near pairs in blocks against brute force, and the amount of work where many rows share a place or a cell."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import footprints, geometry, near
from skyloom.operators.resample import aperture_sums, rectangle_search


def sky(spark, n, seed, low=-1.0):
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(low, 1, n)))
    a, d = np.radians(ra), np.radians(dec)
    rows = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(zip(ra, dec, strict=True))]
    return spark.createDataFrame(rows, "cntr long, ra double, dec double"), np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 24)


def test_aperture_sums_follow_places_not_rows(spark):
    """3,000 sources and 300,000 pixels on one place are 900 million pairs of rows, but one pair of places."""
    s = spark.range(3_000).select(F.col("id").alias("cntr"), F.lit(5).alias("x"), F.lit(5).alias("y"))
    p = spark.range(300_000).select((F.col("id") % 2).cast("int").alias("image_id"), F.lit(5).alias("i"), (F.col("id") % 3 * 3 + 5).cast("int").alias("j"), F.lit(0.5).alias("v"))
    began = time.perf_counter()
    got = aperture_sums(s, p, 3.0, "image_id").agg(F.count("*"), F.min("flux"), F.max("flux"), F.max("n")).first()
    assert tuple(got) == (6_000, 50_000.0, 50_000.0, 100_000)
    assert time.perf_counter() - began < 60
    one = aperture_sums(s.limit(1).unionByName(spark.createDataFrame([(0, 8, 8)], "cntr long, x int, y int")), p, 3.0).collect()
    assert [(r["cntr"], r["n"]) for r in one] == [(0, 300_000)]  # a source with two places has both, the second one 8, 8 also sees 5, 8


def test_overlapping_squares_equal_brute_force(spark):
    """2,000 squares are two million pairs; 1,000 took 24 seconds on eight cores as expressions over both arrays."""
    df, v = sky(spark, 2_000, 1)
    df = df.withColumn("corners", footprints.square(F.col("ra"), F.col("dec"), 3.0))
    began = time.perf_counter()
    got = {tuple(r) for r in footprints.overlaps(df, 4.5).collect()}
    assert time.perf_counter() - began < 60
    angle = np.degrees(np.arccos(np.clip(v @ v.T, -1, 1)))
    i, j = np.nonzero(np.triu(angle < 6.0 - 1e-6, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) <= got  # inscribed circles meet
    assert all(angle[a, b] < 2 * 4.25 for a, b in got)  # circumscribed ones do
    c = np.array([[[p["x"], p["y"], p["z"]] for p in r["corners"]] for r in df.sort("cntr").collect()])
    n = np.cross(c, np.roll(c, -1, 1))
    n /= np.linalg.norm(n, axis=2, keepdims=True)
    n *= -np.sign(np.einsum("pec,pc->pe", n, c.sum(1)))[:, :, None]
    for a, b in np.argwhere(np.triu((angle >= 6.0) & (angle < 8.5), 1))[:3000]:
        apart = (n[a] @ c[b].T).min(1).max() > 0 or (n[b] @ c[a].T).min(1).max() > 0
        assert ((a, b) in got) == (not apart)


def test_boundary_overlaps_equal_brute_force(spark):
    df, v = sky(spark, 300, 2)
    df = df.withColumn("corners", footprints.square(F.col("ra"), F.col("dec"), 5.0))
    got = {tuple(r) for r in footprints.overlaps_by_boundary(df, 7.5, 6).collect()}
    c = np.array([[[p["x"], p["y"], p["z"]] for p in r["corners"]] for r in df.sort("cntr").collect()])
    b = np.roll(c, -1, 1)
    points = np.concatenate([c + (b - c) * (k / 6) for k in range(6)], 1)
    points /= np.linalg.norm(points, axis=2, keepdims=True)
    n = np.cross(c, b)
    n *= -np.sign(np.einsum("pec,pc->pe", n, c.sum(1)))[:, :, None]
    held = lambda i, j: ((points[i] @ n[j].T).max(1) <= 1e-12).any()
    angle = np.degrees(np.arccos(np.clip(v @ v.T, -1, 1)))
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if angle[i, j] <= 15 and (held(i, j) or held(j, i))}


def test_best_and_number_of_squares_equal_brute_force(spark, small_blocks):
    """Points of one region in many blocks; two squares at one place tie, and the lesser id is taken."""
    images, v = sky(spark, 400, 3, 0.2)
    images = images.unionByName(images.filter("cntr < 50").withColumn("cntr", F.col("cntr") + 1_000)).withColumn("corners", footprints.square(F.col("ra"), F.col("dec"), 6.0))
    points, p = sky(spark, 700, 4, 0.2)
    rows = images.sort("cntr").collect()
    c = np.array([[[q["x"], q["y"], q["z"]] for q in r["corners"]] for r in rows])
    n = np.cross(c, np.roll(c, -1, 1))
    n /= np.linalg.norm(n, axis=2, keepdims=True)
    n *= -np.sign(np.einsum("pec,pc->pe", n, c.sum(1)))[:, :, None]
    margin = -np.einsum("qc,iec->qie", p, n).max(2)
    best = {r["cntr"]: (r["image"], r["margin"]) for r in footprints.best_images(images, points, 9.0).collect()}
    number = {r["cntr"]: r["n"] for r in footprints.covering_count(images, points, 9.0).collect()}
    for q in range(700):
        inside = margin[q] >= 0
        assert number.get(q, 0) == inside.sum()
        assert (q in best) == inside.any()
        if inside.any():
            assert best[q][0] == rows[int(margin[q].argmax())]["cntr"] and abs(best[q][1] - np.degrees(np.arcsin(margin[q].max()))) < 1e-9


def test_nearest_and_covering_equal_brute_force_in_blocks(spark, small_blocks):
    points, p = sky(spark, 500, 5, 0.8)  # one cap: its cells are crowded
    sources, s = sky(spark, 900, 6, 0.8)
    twice = sources.unionByName(sources.withColumn("cntr", F.col("cntr") + 5_000))
    angle = np.degrees(np.arccos(np.clip(p @ s.T, -1, 1)))
    got = {r["cntr"]: (r["source"], r["dist"]) for r in geometry.nearest(points, twice, 3.0).collect()}
    number = {r["cntr"]: r["n"] for r in geometry.covering(twice, points, 3.0).collect()}
    for q in range(500):
        assert (q in got) == (angle[q].min() <= 3.0) and number.get(q, 0) == 2 * (angle[q] <= 3.0).sum()
        if q in got:
            assert got[q][0] == angle[q].argmin() and abs(got[q][1] - angle[q].min()) < 1e-6
    assert geometry.nearest(points.limit(0), sources, 3.0).count() == 0 and geometry.covering(sources.limit(0), points, 3.0).count() == 0


def test_a_crowded_cell_goes_to_several_tasks(spark, small_blocks):
    one = spark.range(400).select(F.col("id").alias("cntr"), (10 + F.col("id") * 1e-4).alias("ra"), F.lit(5.0).alias("dec"))
    found = geometry.overlaps(one, 12.0)
    assert found.count() == 400 * 399 // 2
    assert found.select(F.spark_partition_id()).distinct().count() > 4


@pytest.mark.parametrize("contained", [False, True])
def test_rectangles_equal_brute_force_in_blocks(spark, small_blocks, contained):
    rng = np.random.default_rng(7)
    made = lambda n, w: np.round(np.stack([x := rng.uniform(-20, 20, n), x + rng.uniform(0, w, n), y := rng.uniform(-20, 20, n), y + rng.uniform(0, w, n)], 1), 1)
    boxes, queries = made(400, 3), made(300, 11)
    frame = lambda rows: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, x0 double, x1 double, y0 double, y1 double")
    found = rectangle_search(frame(boxes), frame(queries), 5.0, contained)
    got = sorted(tuple(r) for r in found.collect())
    q, b = queries[:, None, :], boxes[None, :, :]
    if contained:
        hit = (b[..., 0] >= q[..., 0]) & (b[..., 1] <= q[..., 1]) & (b[..., 2] >= q[..., 2]) & (b[..., 3] <= q[..., 3])
    else:
        hit = (b[..., 0] <= q[..., 1]) & (q[..., 0] <= b[..., 1]) & (b[..., 2] <= q[..., 3]) & (q[..., 2] <= b[..., 3])
    assert got == sorted(map(tuple, np.argwhere(hit).tolist())) and len(got) > 100


def test_selecting_images_takes_time_by_image(spark):
    """40,000 images against a template and around a point."""
    df = spark.range(40_000).select(F.col("id").alias("cntr"), (F.col("id") * 0.75487766624669 % 1 * 360).alias("ra"), F.degrees(F.asin(2 * (F.col("id") * 0.56984029099805 % 1) - 1)).alias("dec"))
    df = df.withColumn("corners", footprints.square(F.col("ra"), F.col("dec"), 2.0))
    place = [(118.0, 5.0), (130.0, 5.0), (130.0, 20.0), (118.0, 20.0)]
    began = time.perf_counter()
    some, more = (footprints.subset(df, footprints.polygon_of(place), steps).count() for steps in (None, 6))
    circle, point = (footprints.covers(df, mode, [(120.0, 10.0)], 3.0).count() for mode in ("circle", "point"))
    assert time.perf_counter() - began < 60
    assert 0 < point < circle < some <= more
