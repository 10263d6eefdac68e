"""A broadcast bitmap of hashed keys that thins rows out before a join on these keys.

The bitmap has ``BITS`` bits whatever the number of keys, as a table of at most
``BITS / 64`` rows (4 MB), so it may always be broadcast. A row whose bit is
not set has no partner; the others still go through the join. With many more keys
than bits nearly all rows pass, and the join does the work alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def mark_possible(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with ``_maybe``: false for rows that have no partner in ``keys``."""
    slot = F.pmod(F.xxhash64(*on), F.lit(BITS))
    word = F.shiftright(slot, 6).alias("_word")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({', '.join(f'`{c}`' for c in on)}), {BITS}L) & 63 AS INT))")
    words = keys.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.select(*df.columns, maybe.alias("_maybe"))


def possible_partners(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` that may have a partner in ``keys``."""
    return mark_possible(df, keys, on).where("_maybe").drop("_maybe")
