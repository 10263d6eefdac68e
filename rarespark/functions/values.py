"""Column expressions for cleaning, scaling and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rarespark.settings import CLIP, MISSING_TOKEN

# Text a number parser accepts: decimal or exponent form, infinities and nan.
# Spark's own cast would also take Java suffixes such as "1.5d".
NUMBER_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

INTEGER_TEXT = r"^\s*[+-]?\d{1,18}\s*$"


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number; missing must be NULL instead."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_number(c: Column, is_text: bool) -> Column:
    """Double, with unparseable text and NaN as NULL."""
    if not is_text:
        return nan_to_null(c)
    return nan_to_null(F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double")))


def normal_category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING_TOKEN))


def clipped_score(c: Column, mean: Column, std: Column, clip: float = CLIP) -> Column:
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (c - mean) / std))


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + share * (y - x))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0).cast("bigint")), F.lit(0.0))
