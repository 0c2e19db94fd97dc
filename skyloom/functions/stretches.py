"""Brightness stretches: range grammar, levels of a histogram, and the stretch functions themselves."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.mathematics import inverse_normal

GAUSSIAN_LIMIT = 1000.0
STEPS = 256


@dataclass(frozen=True)
class Bound:
    """One end of a display range: a ``value``, a ``percentile`` or a number of ``sigma`` from the median;
    ``extra`` is added to the level found."""

    kind: str
    number: float
    extra: float = 0.0


def parse_bound(text: str) -> Bound:
    """``[+-]number[%|s|S][+-extra]`` or ``min``, ``med``, ``max`` with an optional extra; raises ValueError."""
    number = r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"
    found = re.fullmatch(rf"\s*(?:(min|med|max)|([+-]?(?:{number}))([%sS]?))([+-](?:{number}))?\s*", text)
    if not found:
        raise ValueError(f"{text!r} is no range")
    word, value, unit, extra = found.groups()
    if word:
        return Bound("percentile", {"min": 0.0, "med": 50.0, "max": 100.0}[word], float(extra or 0))
    kind = {"": "value", "%": "percentile"}.get(unit, "sigma")
    if kind == "percentile" and not 0 <= float(value) <= 100:
        raise ValueError(f"{text!r} is no percentage")
    return Bound(kind, float(value), float(extra or 0))


def cumulative(hist: DataFrame) -> DataFrame:
    """A histogram (bin, datalev, n) with total, the counts before and up to each bin, and the next bin's level.
    One row a bin, so one window holds it."""
    by = Window.orderBy("bin")
    return hist.select(
        "bin", "datalev", "n", F.sum("n").over(Window.partitionBy()).alias("total"), F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.lead("datalev").over(by), F.col("datalev")).alias("next"),
    )


def level_at(hist: DataFrame, share: Column) -> DataFrame:
    """``level``: the data level below which a share of the pixels lies, interpolated in its bin; the ends of
    the data at 0 and 1."""
    c = cumulative(hist).withColumn("wanted", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.col("total"))
    hit = c.filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n")) | (F.col("wanted") <= 0) & (F.col("before") == 0))
    part = F.greatest(F.lit(0.0), F.col("wanted") - F.col("before")) / F.col("n")
    return hit.select((F.col("datalev") + part * (F.col("next") - F.col("datalev"))).alias("level"))


def share_at(hist: DataFrame, value: float) -> DataFrame:
    """``share``: the part of the pixels below a data level, 0 and 1 beyond the ends."""
    c = cumulative(hist)
    low, high, total = F.min("datalev"), F.max("next"), F.first("total")
    v = F.lit(float(value))
    below = F.sum(F.when(F.col("next") <= v, F.col("n")).when(F.col("datalev") < v, F.col("n") * (v - F.col("datalev")) / (F.col("next") - F.col("datalev"))).otherwise(0))
    return c.agg(F.when(v <= low, 0.0).when(v >= high, 1.0).otherwise(below / total).alias("share"))


def bound_level(hist: DataFrame, bound: Bound) -> DataFrame:
    """``level``: the data level that a bound means. One sigma is half the way from the 16th to the 84th percentile."""
    at = lambda p: level_at(hist, F.lit(p / 100))
    if bound.kind == "value":
        return hist.sparkSession.range(1).select(F.lit(bound.number + bound.extra).alias("level"))
    if bound.kind == "percentile":
        return at(bound.number).select((F.col("level") + bound.extra).alias("level"))
    ends = at(16.0).select(F.col("level").alias("p16")).crossJoin(at(84.0).select(F.col("level").alias("p84"))).crossJoin(at(50.0))  # one row each
    return ends.select((F.col("level") + bound.number * (F.col("p84") - F.col("p16")) / 2 + bound.extra).alias("level"))


def gaussian_levels(hist: DataFrame) -> DataFrame:
    """(bin, datalev, gausslev): the normal quantile of the share before each bin, within +-1000."""
    c = cumulative(hist)
    share = F.least(F.col("before"), F.col("total") - 1) / F.col("total")
    level = F.when(share <= 0, -GAUSSIAN_LIMIT).otherwise(F.greatest(F.lit(-GAUSSIAN_LIMIT), F.least(F.lit(GAUSSIAN_LIMIT), inverse_normal(share))))
    return c.select("bin", "datalev", level.alias("gausslev"))


def lookup_table(levels: DataFrame, low: float, high: float, logarithmic: bool = False) -> DataFrame:
    """(step, datalev): the data level at ``STEPS`` equal steps of the Gaussian level from ``low`` to ``high`` (or of
    steps whose antilogarithms 1 to 10 are equally far), interpolated between neighbouring bins. Steps beyond the
    last bin take its level. Both sides have one row a bin or step."""
    spark = levels.sparkSession
    part = F.col("id") / (STEPS - 1)
    part = F.log10(1 + 9 * part) if logarithmic else part
    steps = spark.range(STEPS).select(F.col("id").cast("int").alias("step"), (F.lit(low) + (high - low) * part).alias("g"))
    by = Window.orderBy("bin")
    pairs = levels.select("datalev", "gausslev", F.lead("datalev").over(by).alias("d2"), F.lead("gausslev").over(by).alias("g2"))
    met = steps.join(F.broadcast(pairs), (F.col("g") >= F.col("gausslev")) & (F.col("g") < F.coalesce("g2", F.lit(float("inf")))), "left")  # one row a bin
    between = F.col("datalev") + F.coalesce((F.col("g") - F.col("gausslev")) / (F.col("g2") - F.col("gausslev")) * (F.col("d2") - F.col("datalev")), F.lit(0.0))
    least = levels.agg(F.min("datalev").alias("least"))
    return met.crossJoin(F.broadcast(least)).select("step", F.coalesce(between, F.col("least")).alias("datalev"))  # one row


def stretch_by_table(pix: DataFrame, table: DataFrame) -> DataFrame:
    """``pix`` with ``grey`` 0..255: the number of the table's levels below or at the value, less one. The
    table's 256 rows travel as one array with every task, and a value is placed by halving."""
    levels = table.agg(F.sort_array(F.collect_list("datalev")).alias("__levels"))  # STEPS values
    joined = pix.crossJoin(F.broadcast(levels))
    place = F.lit(0)
    for k in range(7, -1, -1):
        place = F.when(F.get("__levels", place + (1 << k)) <= F.col("v"), place + (1 << k)).otherwise(place) if k == 7 else _halved(place, k)
    return joined.withColumn("grey", F.when(F.col("v").isNotNull(), place)).drop("__levels")


def _halved(place: Column, k: int) -> Column:
    # the place so far is bound once by an array, since a column expression would be repeated in each step
    return F.element_at(F.transform(F.array(place), lambda p: F.when(F.get("__levels", p + (1 << k)) <= F.col("v"), p + (1 << k)).otherwise(p)), 1)
