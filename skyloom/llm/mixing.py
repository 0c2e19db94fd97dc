"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target number of words. A document's expected copies are its source's target
over the source's size (times an optional weight); the whole part is taken for certain. The rest
of the target is filled by Pareto order sampling: documents are ranked by random odds over
inclusion odds and taken in that order until the target is met, so a source's sample has a fixed
size in words. The last document taken may give a part of its words.

Nothing is ranked globally: rank statistics fall into ``BINS`` equal ranges, range totals (a
partial aggregate of at most sources x BINS rows) show the one range where a source's target is
met, and only that range is ordered. A source with a third of all rows is thus never one task.

Defined cases: null texts have size 0; a null source is a source of its own, ranked last; sources
without words have target 0; repeated rows are sampled one by one; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import cut, plain_names, table

#: Weights of the sources by rank, repeating; no document is taken more than MAX_COPIES times.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"
BINS = 4096


#: Largest per-source table that is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null. Splitting leaves an empty string before a
    leading and after a trailing separator."""
    ends = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(F.length(text) > 0, F.size(F.split(text, r"[\x20\x09-\x0D]+")) - ends).otherwise(F.lit(0)).cast("long")


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A reproducible number strictly between 0 and 1: the first 52 bits of an MD5 digest of the id,
    or of the text where there is no id (so that such rows don't tie)."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(seed + ":"), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): all words shared out by weight, where
    no target is above ``cap`` times its source. The water level is the largest of the levels that
    result when the sources are capped in the order of cap over weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("w"), (F.lit(cap) * F.col("source_size")).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - before).cast("double") / rest
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _per_source(df: DataFrame) -> DataFrame:
    """A per-source table, written once; broadcast where its counted size allows it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_SOURCES else df


def _ranked(base: DataFrame, plan: DataFrame, weight_col: str | None, cap: int) -> DataFrame:
    """``base`` with its certain copies ``whole`` and, for the rest, the Pareto statistic as a
    number ``p`` of (0, 1) and its range ``bin``; p / (1 - p) is random odds over inclusion odds."""
    copies = F.col("target") * F.col("pref") / F.col("weighed") if weight_col else F.col("target") / F.col("source_size")
    odds, inclusion = F.col("u") * (1 - F.col("chance")), F.col("chance") * (1 - F.col("u"))
    return (
        base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0.0)))
        .withColumn("whole", F.least(F.floor("copies"), F.lit(cap)))
        .withColumn("chance", F.when(F.col("whole") < cap, F.col("copies") - F.col("whole")).otherwise(F.lit(0.0)))
        .withColumn("p", F.when(F.col("chance") > 0, odds / (odds + inclusion)).otherwise(F.lit(1.0)))
        .withColumn("bin", F.when(F.col("chance") > 0, F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")))
    )


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED, weight_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and ``taken``, the words that the
    mix takes of it (repeats counted, at most ``cap`` times its size), and columns ``keep``.

    ``weight_col`` (positive, null counts as 1) scales a document's expected copies within its source.
    """
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    columns = ["doc_id", "source", n_words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), weight.alias("pref")]
    base = cut(docs.select(*columns))
    plan = source_targets(base, weights, cap)
    if weight_col:
        weighed = base.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("pref")).alias("weighed"))
        plan = plan.join(weighed, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = _per_source(plan)
    bins = _ranked(base, plan, weight_col, cap).groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target")
    )
    by_bin = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(by_bin), F.lit(0))).withColumn(
        "rest", F.round("target").cast("long") - F.sum("certain").over(Window.partitionBy("source"))
    )
    # the range of the rank statistic in which a source's target is met
    met = _per_source(
        bins.filter(F.col("bin").isNotNull() & (F.col("before") < F.col("rest"))).groupBy(F.col("source").alias("s"))
        .agg(F.max("bin").alias("last"), F.max_by("before", "bin").alias("before"), F.max("rest").alias("rest"))
    )
    if keep:  # read again rather than kept: the columns may be wide
        base = docs.select(*columns, *keep)
    placed = _ranked(base, plan, weight_col, cap).join(met, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    certain = F.col("whole") * F.col("size")
    out = ["doc_id", "source", "size", "source_size", "target", *keep]
    inner = F.coalesce(F.col("bin") == F.col("last"), F.lit(False))
    clear = placed.filter(~inner).select(*out, (certain + F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("taken"))
    order = Window.partitionBy("source").orderBy("p", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = placed.filter(inner).withColumn("left", left).select(*out, (certain + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))).cast("long").alias("taken"))
    return clear.unionByName(edge)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row whole and as often as it is taken. The row at
    which a source's target is met gives a last copy where at least half of its words are left to
    take, so texts are never cut and a source's words are off its target by half a document at most.
    Rows that aren't taken go."""
    plain = plain_names(docs, ("doc_id", "text", "source"))
    size = F.greatest(F.col("__size"), F.lit(1))
    taken = mix(plain.select("doc_id", "text", "source", F.struct(*plain.columns).alias("__row")), keep=("__row",), **options).withColumnRenamed("size", "__size")
    copies = F.floor((2 * F.col("taken") + size) / (2 * size)).cast("int")
    rows = taken.filter("taken > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return rows.select("__row.*").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s2 AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT)::BIGINT AS w, {MAX_COPIES} * source_size AS most FROM s),
s3 AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM s2 WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS LAST)),
s4 AS (SELECT source, source_size, least(most::DOUBLE, max(level) OVER () * w) AS target FROM s3),
r AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN target / source_size ELSE 0 END AS copies FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
r2 AS (SELECT *, least(floor(copies), {MAX_COPIES})::BIGINT AS whole FROM r),
r3 AS (SELECT *, CASE WHEN whole < {MAX_COPIES} THEN copies - whole ELSE 0 END AS chance FROM r2),
r4 AS (SELECT *, CASE WHEN chance > 0 THEN u * (1 - chance) / (u * (1 - chance) + chance * (1 - u)) END AS p,
  round(target)::BIGINT - (sum(whole * size) OVER (PARTITION BY source))::BIGINT AS rest FROM r3)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN chance > 0 THEN greatest(0, least(size, rest - coalesce(sum(size) OVER
  (PARTITION BY source, chance > 0 ORDER BY p, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END)::BIGINT AS taken FROM r4"""
