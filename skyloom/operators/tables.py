"""Operators on tables: distributed row places, and cells of fixed-width lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.sources.fixed_width import format_fixed_width


def number(text: Column) -> Column:
    """The number a cell begins with, as C's atof reads it (``12abc`` is 12), 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def union_all(tables: list[DataFrame], names: list[str]) -> DataFrame:
    """Tables one after the other with ``names`` for their columns, by place; types must agree."""
    out = tables[0].toDF(*names)
    for t in tables[1:]:
        out = out.unionByName(t.toDF(*names))
    return out


def with_record(df: DataFrame, order: str) -> DataFrame:
    """``df`` with its record number ``recno``, from 0, in the order of a numeric column (ties by all others)."""
    placed = sort_places(df, order, [c for c in df.columns if c != order])
    return placed.withColumn("recno", F.col("place") - 1).drop("place")


def from_record(df: DataFrame, first: int, order: str) -> DataFrame:
    """The records after the first ``first`` ones: where a run that stopped goes on."""
    return with_record(df, order).filter(F.col("recno") >= first)


def status_counts(results: DataFrame, key: str, failed: Column, warned: Column) -> DataFrame:
    """Per kind of job: how many there were, succeeded, warned and failed. A failure isn't a warning, and
    a status that is null is a failure."""
    bad = F.coalesce(failed, F.lit(True))
    odd = ~bad & F.coalesce(warned, F.lit(False))
    return results.groupBy(key).agg(F.count("*").alias("count"), F.count_if(~bad & ~odd).alias("ok"), F.count_if(odd).alias("warning"), F.count_if(bad).alias("failed"))


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, map_key): all values of each key, sorted, as one map entry. A key's values must fit in a row."""
    return rows.groupBy(key).agg(F.create_map(F.col(key).cast("string"), F.sort_array(F.collect_list(value))).alias("entries"))


def look_up(entries: Column, key: Column, k: int = 0) -> Column:
    """The ``k``-th value of a key of a multimap, or null."""
    return F.get(F.element_at(entries, key.cast("string")), F.lit(k))


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return F.coalesce(text.rlike(r"^\s*$"), F.lit(True))


def html_encode(text: Column) -> Column:
    """The characters that mark up HTML as references."""
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def split_command(text: Column) -> Column:
    """The words of a command line; quotes of either kind hold blanks together."""
    found = F.regexp_extract_all(text, F.lit(r'"[^"]*"|\'[^\']*\'|\S+'), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, r'^(["\'])(.*)\1$', "$2"))


def sort_places(df: DataFrame, column: str, tie: str | list[str], descending: bool = False, ranges: int = 1024) -> DataFrame:
    """``df`` with each row's ``place`` in the order of a numeric column, ties by ``tie``.
    Values fall into ranges of about equally many rows (quantiles), so one outlier doesn't send all
    others to one task; range totals shift the row numbers within a range. Rows that share one
    value share a range."""
    key = number(F.col(column).cast("string"))
    key = -key if descending else key
    keyed = df.withColumn("__key", key)
    cuts = keyed.agg(F.array_sort(F.array_distinct(F.percentile_approx("__key", [k / ranges for k in range(1, ranges)], 10 * ranges))).alias("__cuts"))
    ties = [tie] if isinstance(tie, str) else tie
    ranged = keyed.crossJoin(F.broadcast(cuts))  # one row of at most ``ranges`` numbers
    ranged = ranged.withColumn("__range", _place_in("__cuts", F.col("__key"), ranges)).drop("__cuts")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    shift = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__range", shift.alias("__shift"))
    placed = ranged.join(F.broadcast(shifts), "__range").withColumn("place", F.col("__shift") + F.row_number().over(Window.partitionBy("__range").orderBy("__key", *ties)))
    return placed.select(*df.columns, "place")


def _place_in(cuts: str, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, by halving."""
    def step(low: Column, k: Column) -> Column:
        return F.when(F.get(cuts, low + k - 1) < value, low + k).otherwise(low)

    powers = [1 << k for k in range(most.bit_length(), -1, -1)]
    return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), step)


def table_round_trip(df: DataFrame, width: int = 24) -> DataFrame:
    """Rows written as fixed-width lines and cut back into typed columns."""
    lines = format_fixed_width(df, width)
    cells = [F.trim(F.substring("value", 2 + k * (width + 1), width)) for k in range(len(df.columns))]
    return lines.select(*[F.nullif(c, F.lit("null")).cast(t).alias(n) for c, (n, t) in zip(cells, df.dtypes, strict=True)])
