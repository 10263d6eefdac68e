"""Seeded draws that depend on a row's key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 52
_HEX_DIGITS = DRAW_BITS // 4


def draw_bits(seed: int, tag: str, key: Column) -> Column:
    """52 uniform bits as a bigint: the head of ``md5("seed:tag:key")``."""
    text = F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(seed: int, tag: str, key: Column) -> Column:
    """Uniform double in [0, 1)."""
    return draw_bits(seed, tag, key) / F.lit(float(1 << DRAW_BITS))


def uniform_index(seed: int, tag: str, key: Column, size: Column) -> Column:
    """Uniform integer in [0, size)."""
    return F.floor(uniform(seed, tag, key) * size).cast("bigint")


def log_uniform(low: float, high: float, u: Column) -> Column:
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
