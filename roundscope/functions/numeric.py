"""Numeric column helpers: guarded division, half-even rounding, correlation, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % normal quantile of the confidence interval (fixed value).
Z95 = 1.96

#: Spelling of a decimal number accepted by ``numeric_or_null``; Spark's own cast also takes
#: suffixes such as ``1d``, which are not numbers here.
_NUMBER = (
    r"^\s*[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as a double, 0.0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def summary_round(value: Column) -> Column:
    """Six digits, whatever the size of the value."""
    return half_even(value, 6)


def clamp_low(value: Column, low: float) -> Column:
    return F.greatest(value, F.lit(low))


def clamp_high(value: Column, high: float) -> Column:
    return F.least(value, F.lit(high))


def ceil_log2(value: Column) -> Column:
    """Bits needed for ``value`` states, at least 1."""
    return F.when(value <= 1, F.lit(1)).otherwise(F.ceil(F.log2(value.cast("double")))).cast("int")


def bytes_of_bits(bits: Column) -> Column:
    return F.ceil(bits / F.lit(8)).cast("bigint")


def safe_corr(x: str, y: str, over=None) -> Column:
    """Pearson correlation that is 0.0 for constant series or fewer than two rows.

    Works as an aggregate, or as a window function when ``over`` is given. Zero spread is
    tested on min and max, which is exact; a computed deviation of a constant series need not
    be.
    """
    def agg(column: Column) -> Column:
        return column.over(over) if over is not None else column

    flat = (agg(F.max(x)) == agg(F.min(x))) | (agg(F.max(y)) == agg(F.min(y)))
    spread = agg(F.stddev_pop(x)) * agg(F.stddev_pop(y))
    return F.when(flat, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(agg(F.covar_pop(x, y)), spread), F.lit(0.0))
    )


def ci95(value: str, unit_interval: bool = False) -> tuple[Column, Column, Column]:
    """Mean and 95 % bounds of a column as three aggregates; nulls are skipped.

    One value gives ``low = high = mean``. ``unit_interval`` clamps the bounds to [0, 1].
    """
    mean = F.avg(value)
    half = F.lit(Z95) * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))
    low, high = mean - half, mean + half
    if unit_interval:
        low = F.when(low.isNotNull(), clamp_low(low, 0.0))
        high = F.when(high.isNotNull(), clamp_high(high, 1.0))
    return summary_round(mean), summary_round(low), summary_round(high)


def numeric_or_null(text: Column) -> Column:
    """Text to double; null for blank or malformed text."""
    return F.when(
        text.rlike(_NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double")
    )


def is_false(value: Column) -> Column:
    """True for boolean false or the text "false" in any case; never null."""
    return F.coalesce(F.lower(value.cast("string")) == "false", F.lit(False))
