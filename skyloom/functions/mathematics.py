"""Scalar functions beyond the built-in ones, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column, terms: int = 120) -> Column:
    """The standard normal distribution function by its series, for |x| < 9."""
    # 0.5 + phi(x) (x + x^3/3 + x^5/15 + ...)
    summed = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("s")),
        lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")),
    )["s"]
    return 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * summed


def inverse_normal(p: Column, steps: int = 10) -> Column:
    """The standard normal quantile. Shares of 1e-6 to 1 - 1e-6: Newton steps on the distribution function, taken
    of the upper half, where steps from below can't pass the root, and mirrored. Beyond: fixed-point
    steps on the tail's continued fraction. Null for shares that are not between 0 and 1."""
    tail = F.least(p, 1 - p)
    upper = 1 - tail
    start = 0.6 * F.sqrt(-2 * F.log(F.greatest(2 * tail, F.lit(1e-9))))
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: x - (normal_cdf(x, 60) - upper) / (F.exp(-x * x / 2) / math.sqrt(2 * math.pi)))

    def outward(x: Column, _: Column) -> Column:
        # tail = phi(x) / (x + 1/(x + 2/(x + 3/(x + 4/(x + ...)))))
        below = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), x, lambda s, k: x + k / s)
        return F.sqrt(-2 * (F.log(tail) + F.log(below) + math.log(2 * math.pi) / 2))

    far = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.sqrt(-2 * F.log(tail)), outward)
    refined = F.when(tail > 1e-6, newton).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -refined).otherwise(refined))


def stretch(v: Column, low: float, high: float, kind: str = "linear", beta: float = 0.1, power: int = 1) -> Column:
    """Brightness 0..255 of a value: linear, log (nested ``power`` times) or asinh."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
    if kind == "log":
        for _ in range(power):
            x = F.log10(1 + 9 * x)
    elif kind == "asinh":
        x = F.asinh(x / beta) / math.asinh(1 / beta)
    elif kind != "linear":
        raise ValueError(f"unknown stretch {kind!r}")
    return F.floor(255 * x + 0.5).cast("int")


def polygon_area(x: Column, y: Column) -> Column:
    """Signed area of a polygon whose corners are two arrays."""
    following = F.transform(x, lambda _, k: F.struct(F.get(x, k).alias("x0"), F.get(y, k).alias("y0"), F.get(x, (k + 1) % F.size(x)).alias("x1"), F.get(y, (k + 1) % F.size(x)).alias("y1")))
    return F.aggregate(following, F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def hex_colour(text: Column) -> list[Column]:
    """Red, green and blue of ``#rrggbb``; null where the text is none."""
    ok = text.rlike("^#[0-9a-fA-F]{6}$")
    return [F.when(ok, F.conv(F.substring(text, k, 2), 16, 10).cast("int")) for k in (2, 4, 6)]
