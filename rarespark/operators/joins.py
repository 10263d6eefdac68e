"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespark.session import shuffle_width
from rarespark.settings import HEAVY_SHARE

MAX_SALTS = 256


def left_join_side(fact: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Keep every fact row; attach the side row of the same key if there is one.

    Keys are unique on both sides (``require_unique`` checks the result), so
    this join cannot be skewed.
    """
    return fact.join(side, key, "left")


def heavy_keys(df: DataFrame, key: str, rows: int | None = None, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of the ``rows`` of ``df``: at most ``1 / share``.

    The count is combined on the map side, so a hot key costs one row per task.
    The keys are collected here, being needed on both sides of a join.
    """
    rows = df.count() if rows is None else rows
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    heavy = counts.where(F.col("_n") >= F.lit(share * rows)).select(key)
    return df.sparkSession.createDataFrame(heavy.collect(), heavy.schema)


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, heavy_key: str, spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join with ``right`` unique on ``on``. Rows of ``left`` whose ``heavy_key``
    is heavy are spread over up to ``MAX_SALTS`` tasks by ``spread``; only the few
    matching rows of ``right`` are repeated, all others travel once.
    """
    width = min(shuffle_width(left.sparkSession), MAX_SALTS)
    marks = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    left = left.join(marks, heavy_key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(width))).otherwise(F.lit(0).cast("bigint"))
    )
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    right = right.join(marks, heavy_key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every_salt).otherwise(F.array(F.lit(0).cast("bigint"))))
    )
    return left.drop("_hot").join(right.drop("_hot"), on + ["_salt"], how).drop("_salt")
