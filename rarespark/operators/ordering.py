"""Ranks and running sums over an order, without a window over the whole data.

A bare ``Window.orderBy`` sends every row to one task. Here rows are cut into
ranges at approximate quantiles, each range is windowed on its own, and the sum
of the ranges before it is added. Equal values always share a range, and a range
holds about ``rows / ranges`` rows (or one single value), however skewed the
values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.session import materialize, shuffle_width

MAX_RANGES = 2048
_STEP = 32


def with_range(df: DataFrame, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: the number of cut points of the row's group below ``value``.

    The cut points are approximate quantiles, one array per group of at most
    ``MAX_RANGES`` numbers. Groups are scenarios or boosting iterations, so what
    is collected and broadcast is bounded by the set-up of the experiment and
    not by its data.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = shuffle_width(spark)
    ranges = max(1, min(ranges, MAX_RANGES))
    if ranges == 1:
        return df.withColumn("_range", F.lit(0))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    quantiles = F.percentile_approx(value, points, F.lit(max(1_000, 20 * ranges)))
    cuts = df.groupBy(*by).agg(F.array_distinct(quantiles).alias("_cuts"))
    known = spark.createDataFrame(cuts.collect(), cuts.schema)
    if by:
        joined = df.join(F.broadcast(known), by, "left")
    else:
        joined = df.withColumn("_cuts", known.scalar())
    return joined.withColumn("_range", _count_below("_cuts", F.col(value), ranges)).drop("_cuts")


def _count_below(cuts: str, value: Column, ranges: int) -> Column:
    """Number of sorted ``cuts`` below ``value``; long arrays in two steps."""
    if ranges <= 2 * _STEP:
        return F.size(F.filter(cuts, lambda cut: cut < value))
    lasts = F.filter(cuts, lambda cut, i: i % _STEP == _STEP - 1)
    whole = F.size(F.filter(lasts, lambda cut: cut < value)) * _STEP
    return whole + F.size(F.filter(F.slice(cuts, whole + 1, _STEP), lambda cut: cut < value))


def dense_index(df: DataFrame, key: str, out: str = "index", ranges: int | None = None) -> DataFrame:
    """Exact 0-based position of each row in ascending order of the unique ``key``."""
    ranged = with_range(df, [], key, ranges)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(key)
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_start"))
        .drop("_range", "_start")
    )


def cumulative_counts(
    scores: DataFrame, by: list[str], score: str = "score", target: str = "y", ranges: int | None = None
) -> DataFrame:
    """One row per group and distinct score, in effect ordered from high to low.

    Columns: ``by``, ``score``, ``pos`` and ``neg`` at this score, ``tp`` and
    ``fp`` at or above it, ``all_pos`` and ``all_neg`` of the group, ``next_pos``
    and ``next_neg`` at the next lower score (NULL on the last row), ``is_top`` on
    the first row.

    The score rows are read once: they are counted by score, and these counts,
    which are needed for the cuts, the range totals and the running sums, are
    stored.
    """
    y = F.col(target).cast("bigint")
    rows = scores.select(*by, F.col(score).alias("score"), y.alias("y"))
    counts = rows.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cells = with_range(materialize(counts, "score-counts"), by, "score", ranges)
    first = F.max_by(F.struct("pos", "neg"), F.col("score"))
    totals = cells.groupBy(*by, "_range").agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), first.alias("_first")
    )
    # at most MAX_RANGES rows per group from here on
    group = Window.partitionBy(*by)
    down = group.orderBy(F.desc("_range"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_range",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp0"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp0"),
        F.sum("_pos").over(group).alias("all_pos"),
        F.sum("_neg").over(group).alias("all_neg"),
        F.lead("_first").over(down).alias("_below"),
        (F.row_number().over(down) == 1).alias("_top_range"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("_below"))
    return (
        cells.join(F.broadcast(offsets), by + ["_range"])
        .withColumn("tp", F.sum("pos").over(running) + F.col("_tp0"))
        .withColumn("fp", F.sum("neg").over(running) + F.col("_fp0"))
        .withColumn("_next", nxt)
        .withColumn("is_top", F.col("_top_range") & (F.row_number().over(inside) == 1))
        .select(
            *by, "score", "pos", "neg", "tp", "fp", "all_pos", "all_neg",
            F.col("_next.pos").alias("next_pos"), F.col("_next.neg").alias("next_neg"), "is_top",
        )
    )


def top_one(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """First row of each (small) group in the given order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")
