"""Ranking metrics, curves and threshold choice over long score tables.

Input everywhere: rows ``(by..., y, score)``, so all scenarios, splits or
boosting iterations are judged together in the same shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.values import ratio_or_zero
from rarespark.operators.ordering import cumulative_counts, top_one


def usable(score: str) -> Column:
    """The score; NULL and NaN, which have no place in a ranking, raise an error."""
    c = F.col(score).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.raise_error(F.lit(f"NULL or NaN in column {score}")).cast("double")).otherwise(c)


def threshold_grid(rounded: bool = False) -> list[float]:
    """0.01, 0.02, ... 0.99, as raw sums or rounded to two decimals."""
    grid = np.arange(0.01, 1.0, 0.01)
    return [float(t) for t in (np.round(grid, 2) if rounded else grid)]


def ranking_metrics(
    scores: DataFrame, by: list[str], score: str = "score", target: str = "y", ranges: int | None = None
) -> DataFrame:
    """Average precision (step-wise) and ROC-AUC (ties count half) per group.

    No positives: average precision 0. One class only: ROC-AUC NULL.
    """
    steps = cumulative_counts(scores.withColumn(score, usable(score)), by, score, target, ranges)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return steps.groupBy(*by).agg(
        F.coalesce(
            F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0)),
            F.lit(0.0),
        ).alias("average_precision"),
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
    )


def pr_curve(scores: DataFrame, by: list[str], score: str = "score", target: str = "y") -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (NULL, 1, 0)."""
    steps = cumulative_counts(scores.withColumn(score, usable(score)), by, score, target)
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif("all_pos", F.lit(0)), F.lit(1.0)).alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _with_end(steps, by, point, end)


def roc_curve(
    scores: DataFrame, by: list[str], score: str = "score", target: str = "y", drop_intermediate: bool = True
) -> DataFrame:
    """(threshold, fpr, tpr) from (NULL, 0, 0) on; collinear points may be dropped.

    A point lies on the line of its neighbours exactly when the step into it and
    the step out of it have the same positives and the same negatives.
    """
    steps = cumulative_counts(scores.withColumn(score, usable(score)), by, score, target)
    if drop_intermediate:
        corner = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        steps = steps.where(F.col("is_top") | F.col("next_pos").isNull() | corner)
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.nullif("all_neg", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("all_pos", F.lit(0))).alias("tpr"),
    )
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _with_end(steps, by, point, start)


def _with_end(steps: DataFrame, by: list[str], point: Column, end: Column) -> DataFrame:
    """The points, and the extra one beside the highest score of each group."""
    both = F.when(F.col("is_top"), F.array(point, end)).otherwise(F.array(point))
    return steps.select(*by, F.inline(both))


def decide(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def threshold_metrics(
    scores: DataFrame, thresholds: DataFrame, by: list[str], score: str = "score", target: str = "y"
) -> DataFrame:
    """Precision, recall and F1 at each group's own threshold (0 where undefined).

    ``thresholds``: one row ``(by..., threshold)`` per group.
    """
    y = F.col(target).cast("bigint")
    hit = decide(usable(score), F.col("threshold")).cast("bigint")
    counts = (
        scores.join(F.broadcast(thresholds), by)
        .groupBy(*by, "threshold")
        .agg(F.sum(hit * y).alias("tp"), F.sum(hit).alias("predicted"), F.sum(y).alias("positives"))
    )
    return counts.select(*by, "threshold", *_prf())


def _prf() -> list[Column]:
    tp, predicted, positives = F.col("tp"), F.col("predicted"), F.col("positives")
    return [
        ratio_or_zero(tp, predicted).alias("precision"),
        ratio_or_zero(tp, positives).alias("recall"),
        ratio_or_zero(2 * tp, predicted + positives).alias("f1"),
    ]


def _grid_position(score: Column, grid: list[float]) -> Column:
    """Number of grid values not above ``score``.

    ``floor(100 * score)`` is off by one for some scores, so the guess is
    corrected by comparing with the grid itself.
    """
    values = F.array(*[F.lit(t) for t in grid])
    size = len(grid)
    guess = F.greatest(F.lit(0), F.least(F.lit(size), F.floor(score * (size + 1)).cast("int")))
    up = (guess < size) & (F.get(values, guess) <= score)
    down = (guess > 0) & (F.get(values, guess - 1) > score)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def threshold_sweep(
    scores: DataFrame, by: list[str], score: str = "score", target: str = "y", rounded: bool = False
) -> DataFrame:
    """Precision, recall, F1 at every grid threshold, from one pass over the scores.

    Rows are counted by the number of thresholds they reach (at most 100 counts
    per group); what a threshold predicts is a suffix sum of these counts.
    """
    grid = threshold_grid(rounded)
    y = F.col(target).cast("bigint")
    counts = (
        scores.select(*by, usable(score).alias("_score"), y.alias("_y"))
        .select(*by, _grid_position(F.col("_score"), grid).alias("reached"), "_y")
        .groupBy(*by, "reached")
        .agg(F.sum("_y").alias("_tp"), F.count("*").alias("_n"))
    )
    frame = counts.groupBy(*by).agg(
        F.sum("_tp").alias("positives"), F.map_from_entries(F.collect_list(F.struct("reached", "_tp"))).alias("_tps"),
        F.map_from_entries(F.collect_list(F.struct("reached", "_n"))).alias("_ns"),
    )
    # at most len(grid) + 1 map entries, by construction
    rows = frame.select(*by, "positives", "_tps", "_ns", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("p", "threshold"))
    at = lambda m: F.coalesce(F.element_at(m, F.col("p") + 1), F.lit(0))
    suffix = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(
        *by, "positives", "p", "threshold", F.sum(at("_tps")).over(suffix).alias("tp"),
        F.sum(at("_ns")).over(suffix).alias("predicted"),
    )
    return summed.select(*by, "threshold", *_prf())


def mark_selected(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Add ``selected``: best F1, then best recall, then lowest threshold."""
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), F.desc("recall"), F.asc("threshold"))
    return sweep.withColumn("selected", F.row_number().over(order) == 1)


def best_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    return top_one(sweep, by, F.desc("f1"), F.desc("recall"), F.asc("threshold"))


def evaluate(valid: DataFrame, test: DataFrame, by: list[str], rounded: bool = False) -> DataFrame:
    """Threshold chosen on ``valid``; all five metrics on ``test``."""
    chosen = best_threshold(threshold_sweep(valid, by, rounded=rounded), by).select(*by, "threshold")
    return ranking_metrics(test, by).join(threshold_metrics(test, chosen, by), by)
