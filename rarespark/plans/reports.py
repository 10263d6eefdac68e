"""Result tables: scenario metrics, comparisons, score tables, plotted data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarespark.operators.metrics import pr_curve, roc_curve
from rarespark.settings import COMPARISONS, RATE_GRID, SCENARIOS

SCENARIO_NAMES = [name for name, _ in SCENARIOS]


def scenario_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, label) for i, (name, label) in enumerate(SCENARIOS)]
    return spark.createDataFrame(rows, "position int, scenario string, label string")


def metric_table(metrics: DataFrame) -> DataFrame:
    """One row per scenario present, with position and label, in protocol order."""
    dimension = F.broadcast(scenario_table(metrics.sparkSession))
    rest = [c for c in metrics.columns if c != "scenario"]
    return metrics.join(dimension, "scenario").select("position", "scenario", "label", *rest).orderBy("position")


def scenario_deltas(metrics: DataFrame, pairs: list[tuple[str, str, str]] = COMPARISONS) -> DataFrame:
    """Difference in average precision for each compared pair that is present."""
    spark = metrics.sparkSession
    ap = metrics.select("scenario", F.col("average_precision").alias("ap"))
    wanted = spark.createDataFrame(pairs, "comparison string, left_name string, right_name string")
    left = ap.select(F.col("scenario").alias("left_name"), F.col("ap").alias("left_ap"))
    right = ap.select(F.col("scenario").alias("right_name"), F.col("ap").alias("right_ap"))
    joined = wanted.join(left, "left_name").join(right, "right_name")
    return joined.select("comparison", (F.col("left_ap") - F.col("right_ap")).alias("delta"))


def best_scenario(metrics: DataFrame) -> DataFrame:
    """The row of highest average precision; the earlier scenario wins a tie."""
    return metric_table(metrics).orderBy(F.desc("average_precision"), "position").limit(1)


def scores_wide(scores: DataFrame, names: list[str] = SCENARIO_NAMES, key: str = "id", target: str = "y") -> DataFrame:
    """Long scores to one row per id with a column per scenario."""
    return scores.groupBy(key, target).pivot("scenario", list(names)).agg(F.first("score"))


def scores_long(scores: DataFrame, names: list[str] = SCENARIO_NAMES, key: str = "id", target: str = "y") -> DataFrame:
    return scores.unpivot([key, target], list(names), "scenario", "score")


def sensitivity_sorted(cells: DataFrame) -> DataFrame:
    return cells.orderBy(F.desc("average_precision"), "cell")


def best_cell(cells: DataFrame) -> DataFrame:
    """Highest average precision; the first cell in grid order wins a tie."""
    return cells.orderBy(F.desc("average_precision"), "cell").limit(1)


def sensitivity_pivot(cells: DataFrame, rates: list[float] = RATE_GRID) -> DataFrame:
    """Latent dimension by rate, columns named ``rate_<percent>``."""
    named = cells.withColumn("_rate", F.format_string("rate_%02d", F.round(F.col("rate") * 100).cast("int")))
    names = [f"rate_{round(r * 100):02d}" for r in rates]
    return named.groupBy("latent_dim").pivot("_rate", names).agg(F.first("average_precision")).orderBy("latent_dim")


def rate_percent(summary: DataFrame) -> DataFrame:
    return summary.select("split", (F.col("fraud_rate") * 100).alias("fraud_rate_percent"))


def ap_bars(metrics: DataFrame) -> DataFrame:
    return metric_table(metrics).select(
        "position", "label", "average_precision", F.col("scenario").endswith("_tuned").alias("tuned")
    )


def curve_scenarios(scores: DataFrame) -> DataFrame:
    """Names of the scenarios to draw: the tuned ones, or else the default ones."""
    names = scores.select("scenario").distinct().withColumn("tuned", F.col("scenario").endswith("_tuned"))
    # one row per scenario, so one window over all of them is small
    any_tuned = F.max("tuned").over(Window.partitionBy(F.lit(0)))
    return names.withColumn("wanted", F.col("tuned") == any_tuned).where("wanted").select("scenario")


def curves(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(precision-recall, ROC) points of the scenarios to draw."""
    shown = scores.join(F.broadcast(curve_scenarios(scores)), "scenario", "left_semi")
    return pr_curve(shown, ["scenario"]), roc_curve(shown, ["scenario"])


def best_threshold_table(sweep: DataFrame, metrics: DataFrame) -> DataFrame:
    """The threshold table of the best scenario."""
    best = best_scenario(metrics).select("scenario")
    return sweep.join(F.broadcast(best), "scenario", "left_semi")


# The two sets of names result tables are known by.
SHORT_NAMES = {"average_precision": "pr_auc"}
LONG_NAMES = {"threshold": "selected_threshold"}
SHORT_CELL_NAMES = {"average_precision": "val_pr_auc"}
LONG_CELL_NAMES = {"rate": "target_fraud_rate", "average_precision": "validation_average_precision"}


def named_metrics(metrics: DataFrame, short: bool = True) -> DataFrame:
    """Metric table with the short (``pr_auc``) or the long column names."""
    return metrics.withColumnsRenamed(SHORT_NAMES if short else LONG_NAMES)


def named_cells(cells: DataFrame, short: bool = True) -> DataFrame:
    """Grid results: short = grid order and three columns; long = all columns, best first."""
    if short:
        kept = cells.orderBy("cell").select("latent_dim", "rate", "average_precision")
        return kept.withColumnsRenamed(SHORT_CELL_NAMES)
    return sensitivity_sorted(cells).drop("cell").withColumnsRenamed(LONG_CELL_NAMES)


TUNED_PARAMS = "learning_rate double, num_leaves int, min_child_samples int, subsample double, colsample_bytree double"


def result_document(
    config: dict, split_summary: DataFrame, preprocessing: DataFrame, sensitivity: DataFrame, results: DataFrame,
    training_info: DataFrame, locked: DataFrame, comparisons: DataFrame,
) -> DataFrame:
    """Everything about one run as a single row of nested values.

    Each input has a handful of rows (splits, cells, scenarios), so the lists
    are small by construction.
    """
    spark = results.sparkSession

    def listed(df: DataFrame, order: str) -> DataFrame:
        fields = [order] + [c for c in df.columns if c != order]
        return df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("v"))

    def single(df: DataFrame) -> DataFrame:
        return df.limit(1).select(F.struct("*").alias("v"))

    # parameters are nested values, not text
    training_info = training_info.withColumn("best_params", F.from_json("best_params", TUNED_PARAMS))
    settings = [F.lit(value).alias(name) for name, value in config.items()]
    return spark.range(1).select(
        F.struct(*settings).alias("config"),
        single(locked).scalar().alias("locked"),
        locked.limit(1).select("n_synthetic").scalar().alias("n_synthetic"),
        listed(split_summary, "split").scalar().alias("split_summary"),
        single(preprocessing).scalar().alias("preprocessing_summary"),
        listed(sensitivity, "cell").scalar().alias("sensitivity"),
        listed(results, "position").scalar().alias("results"),
        listed(comparisons, "comparison").scalar().alias("comparisons"),
        listed(training_info, "scenario").scalar().alias("training_info"),
    )
