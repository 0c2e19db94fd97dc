"""Clipped planes of groups of any size: nothing of a group but its sums reaches a task."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import background, fits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouped_planes_hold_no_group_in_a_worker(spark):
    pix = spark.range(400).select((F.col("id") % 2).cast("int").alias("image_id"), (F.col("id") % 20).cast("int").alias("i"), F.floor(F.col("id") / 20).cast("int").alias("j"), F.rand(1).alias("v"))
    assert "InPandas" not in plan_of(fits.clipped_plane_grouped(pix, rounds=2))


def test_grouped_planes_keep_every_group(spark):
    line = [(1, k, k, float(k), 1.0) for k in range(5)]
    lost = [(2, 0, 0, 1.0), (2, 1, 0, 2.0), (2, 0, 1, 3.0), (2, 5, 5, 400.0), (2, 5, 5, -400.0), (2, 5, 5, 400.0)]
    rng = np.random.default_rng(3)
    good = [(0, int(i), int(j), float(2 * i - j + rng.normal())) for i, j in rng.integers(0, 30, (200, 2))]
    rows = [r[:4] for r in line] + lost + good + [(None, 1, 1, 4.0)]
    got = {r["image_id"]: r for r in fits.clipped_plane_grouped(spark.createDataFrame(rows, "image_id int, i int, j int, v double")).collect()}
    assert set(got) == {None, 0, 1, 2}
    assert np.isnan(got[1]["a"]) and got[1]["npixel"] == 0 and np.isnan(got[None]["c"])
    assert not np.isnan(got[2]["a"]) and got[2]["npixel"] >= 3
    assert np.allclose([got[0]["a"], got[0]["b"]], [2, -1], atol=0.1)


def test_rounds_do_not_move_the_pixels(spark):
    """The exchanges of a round carry sums; the pixels are joined where they lie."""
    seen = []
    pix = spark.range(3_000).select((F.col("id") % 3).cast("int").alias("image_id"), (F.col("id") % 30).cast("int").alias("i"), F.floor(F.col("id") / 30).cast("int").alias("j"), F.rand(2).alias("v"), F.lit(1.0).alias("area"))
    own = background.cut
    background.cut = lambda df: (seen.append(plan_of(df)), own(df))[1]
    try:
        background.clipped_planes(pix, ["image_id"], rounds=3)
        flat = plan_of(background.flatten(pix))
    finally:
        background.cut = own
    assert len(seen) >= 3 and all("SortMergeJoin" not in p and "ShuffledHashJoin" not in p for p in [*seen, flat])
    assert all("BroadcastHashJoin" in p for p in [*seen[1:3], flat])
