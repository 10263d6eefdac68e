"""The protocol's inputs, derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespark.functions.draws import uniform
from rarespark.operators.features import as_vector, column_roles, feature_columns, fit_features
from rarespark.operators.joins import left_join_side
from rarespark.operators.split import fit_split
from rarespark.plans.reports import scores_long
from rarespark.session import materialize
from rarespark.settings import LATENT_GRID, RATE_GRID, SEED

LINE_FEATURES, DEAR_LINE = ["l_quantity", "l_discount", "l_tax"], 60_000.0
CATEGORICAL = ["o_custkey", "o_orderstatus", "max_returnflag"]
NUMERIC = ["o_totalprice", "n_lines", "sum_price", "avg_discount", "const_one", "all_null"]

# scenario, pull of the true signal, decimals kept (few decimals make many ties)
SCORE_RECIPES = [
    ("baseline", 0.10, 4),
    ("baseline_tuned", 0.15, 3),
    ("smote", 0.20, 3),
    ("smote_tuned", 0.25, 2),
    ("ae_oversample", 0.30, 2),
    ("ae_oversample_tuned", 0.35, 4),
]


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def target_column():
    return ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).cast("int")


def fact_rows(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), target_column().alias("y"), "o_custkey", "o_orderstatus", "o_totalprice"
    )


def side_rows(spark: SparkSession, root: str) -> DataFrame:
    return (
        read(spark, root, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.max("l_returnflag").alias("max_returnflag"), F.count("*").alias("n_lines"),
            F.sum("l_extendedprice").alias("sum_price"), F.avg("l_discount").alias("avg_discount"),
        )
    )


def transactions(spark: SparkSession, root: str) -> DataFrame:
    joined = left_join_side(fact_rows(spark, root), side_rows(spark, root), "id")
    return joined.select(
        "id", "y", *CATEGORICAL, "o_totalprice", "n_lines", "sum_price", "avg_discount",
        F.lit(1.0).alias("const_one"), F.lit(None).cast("double").alias("all_null"),
    )


def split_transactions(spark: SparkSession, root: str) -> DataFrame:
    """The cut points need the fact table only, so the join is not run for them."""
    return fit_split(fact_rows(spark, root), "id", "y").assign(transactions(spark, root))


def encoder(spark: SparkSession, root: str, layout: str = "dense"):
    """(fitted features, all rows with their split).

    The split join is written once; every fitting pass is then a pruned scan.
    """
    rows = materialize(split_transactions(spark, root), "split", ["split"])
    cats, nums = column_roles(rows, feature_columns(rows, ["id", "y", "split"]), ["o_custkey"])
    return fit_features(rows.where("split = 'train'"), cats, nums, layout), rows


def encoded(spark: SparkSession, root: str) -> DataFrame:
    """``(id, y, split, features)``."""
    model, rows = encoder(spark, root)
    keep = ["id", "y", "split"]
    return as_vector(model.transform(rows, keep, key="id"), model.output_columns, keep)


def labelled_documents(spark: SparkSession, root: str) -> DataFrame:
    return left_join_side(read(spark, root, "documents").drop("text"), read(spark, root, "labels"), "doc_id")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").alias("features")
    )


def dirty_numbers(spark: SparkSession, root: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return read(spark, root, "events").select("event_id", text.alias("raw"))


def _wide_scores(spark: SparkSession, root: str) -> DataFrame:
    signal = (F.col("o_orderstatus") == "F").cast("double")
    return fact_rows(spark, root).select(
        "id", "y",
        *[F.round(0.6 * uniform(SEED, name, F.col("id")) + pull * signal, places).alias(name) for name, pull, places in SCORE_RECIPES],
    )


def scores(spark: SparkSession, root: str) -> DataFrame:
    """Long ``(id, y, scenario, score)`` for six scenarios."""
    return scores_long(_wide_scores(spark, root))


def held_out_scores(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The same scores on the validation rows and on the test rows."""
    split = fit_split(fact_rows(spark, root), "id", "y")
    marked = split.assign(_wide_scores(spark, root))
    return tuple(scores_long(marked.where(F.col("split") == part)) for part in ("validation", "test"))


DIRTY_TEXT = "doc_id string, title string, size string, code string, hole string"


# line ends would keep a CSV file from being split; none of these pairs is part of another one's text
LINE_MARKS = [("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r")]


def without_line_ends(text: Column) -> Column:
    for sign, mark in LINE_MARKS:
        text = F.replace(text, F.lit(sign), F.lit(mark))
    return text


def with_line_ends(text: Column) -> Column:
    """The inverse of ``without_line_ends``."""
    for sign, mark in reversed(LINE_MARKS):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def dirty_csv_lines(spark: SparkSession, root: str, whole: bool = False) -> DataFrame:
    """CSV lines with doubled quotes, commas inside quotes, missing markers, padded numbers and blanks.

    The title holds the ``whole`` text with marked line ends, or its first 30 characters."""
    text = F.coalesce("text", F.lit(""))
    head = without_line_ends(text) if whole else F.regexp_replace(F.substring(text, 1, 30), "[\\r\\n]", " ")
    title = F.concat(F.lit('"<'), F.regexp_replace(F.concat(head, F.lit(', "'), "lang", F.lit('">')), '"', '""'), F.lit('"'))
    kind = F.pmod("doc_id", F.lit(5))
    size = F.when(kind == 0, "NA").when(kind == 1, "").when(kind == 2, F.concat(F.lit(" "), "n_chars", F.lit(" "))).otherwise(F.concat("n_chars", F.lit(".5")))
    code = F.when(kind == 3, "null").when(kind == 4, "1.0d").otherwise(F.col("n_chars").cast("string"))
    return read(spark, root, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), title, size, code, F.lit("")).alias("value"))


def grid_cells(spark: SparkSession, root: str) -> DataFrame:
    """One row per (latent dimension, rate); every order falls into one cell."""
    cell = F.pmod("o_orderkey", F.lit(len(LATENT_GRID) * len(RATE_GRID))).cast("int")
    means = read(spark, root, "orders").groupBy(cell.alias("cell")).agg(
        (F.avg("o_totalprice") / F.max("o_totalprice")).alias("average_precision")
    )
    of = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    return means.select(
        "cell",
        of(LATENT_GRID, F.floor(F.col("cell") / len(RATE_GRID)).cast("int")).alias("latent_dim"),
        of(RATE_GRID, F.col("cell") % len(RATE_GRID)).alias("rate"),
        "average_precision",
    )


def line_rows(spark: SparkSession, root: str) -> DataFrame:
    """Order lines with few-valued features, so that every value is a possible split; dear lines are the positive ones."""
    features = F.array(*[F.col(c).cast("double") for c in LINE_FEATURES]).alias("features")
    y = F.coalesce((F.col("l_extendedprice") > DEAR_LINE).cast("int"), F.lit(0)).alias("y")
    return read(spark, root, "lineitem").select("l_orderkey", "l_linenumber", y, features)
