"""Keys and sizes that the document operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
KEY = ["_id", "_th"]


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, _id, _th)``: all other columns are left behind, so their names can't clash.

    ``_id`` and ``_th`` (a hash of the text) are never null and tell rows with
    the same ``doc_id`` but other texts apart. Side tables are made unique on
    them before they are joined back, so repeated rows are never multiplied.
    A null text is an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.select("*", *key_columns())


def wrapped(docs: DataFrame) -> DataFrame:
    """``(_row, _id, _th)``: all columns of a row in one, so that none of them can clash;
    ``select("_row.*")`` gives them back."""
    return docs.select(F.struct("*").alias("_row"), *key_columns())


def key_columns(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"),
    ]


def few_rows(batches, rows: int = 256):
    """The rows of Arrow batches, a few at a time: neither decoded texts nor answers get as large as a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts_for(units: int, per_part: int) -> int:
    """Number of parts so that each holds about ``per_part``; grows with the data."""
    return max(1, -(-int(units) // per_part))
