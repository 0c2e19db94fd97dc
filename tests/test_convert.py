"""Conversions of positions are worked out once for both of their parts."""

from pyspark.sql import functions as F

from skyloom.functions import coords


def test_a_conversion_is_one_step(spark):
    df = spark.createDataFrame([(10.0, 20.0), (None, 5.0), (300.0, None)], "ra double, dec double")
    lon, lat = coords.convert(F.col("ra"), F.col("dec"), "EQUB", "SGAL")
    there = df.select("ra", "dec", lon.alias("l"), lat.alias("b"))
    lon, lat = coords.convert(F.col("l"), F.col("b"), "SGAL", "EQUB")
    back = there.select("ra", "dec", lon.alias("x"), lat.alias("y"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("run(") <= 8  # two steps, each named in its node and by its result
    rows = back.collect()
    assert abs(rows[0]["x"] - 10) < 1e-6 and abs(rows[0]["y"] - 20) < 1e-6
    assert all(r["x"] is None and r["y"] is None for r in rows[1:])
