"""Numeric column expressions for positions, legends and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range of standard scores on the color scale and its number of steps.
SCALE_MIN, SCALE_MAX, SCALE_STEPS = -1.0, 3.0, 400


# Fixed: the formulas of the color scale, which the result dictates.
def bin_position(z: Column, low: float = SCALE_MIN, high: float = SCALE_MAX, steps: int = SCALE_STEPS) -> Column:
    """Step (1..steps) of a standard score on the color scale; 0 where there is none."""
    width = (high - low) / steps
    step = F.least(F.lit(float(steps)), F.greatest(F.rint((z - low) / width) + 1, F.lit(1.0)))
    missing = z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))
    return F.when(missing, 0).otherwise(step.cast("int"))


def bin_counts(low: float = SCALE_MIN, high: float = SCALE_MAX, steps: int = SCALE_STEPS) -> tuple[int, int]:
    """Number of steps above and below the mean."""
    return round(abs(high) / (high - low) * steps), round(abs(low) / (high - low) * steps)


def band(mean: Column, std: Column) -> Column:
    """Legend entries in percent: upper end, mean and lower end of the color scale."""
    upper = F.least(mean + 3 * std, F.lit(1.0)) * 100
    lower = F.greatest(mean - std, F.lit(0.0)) * 100
    shown_upper, shown_lower = F.format_string("%.2f", upper), F.format_string("%.2f", lower)
    return F.struct(
        F.concat(F.when(shown_upper.cast("double") < 100, ">").otherwise(""), shown_upper, F.lit("%")).alias("upper"),
        F.concat(F.format_string("%.2f", mean * 100), F.lit("%")).alias("mean"),
        F.concat(F.when(shown_lower.cast("double") > 0, "<").otherwise(""), shown_lower, F.lit("%")).alias("lower"),
    )


def percent_one_decimal(share: Column) -> Column:
    return F.floor(share * 1000 + 0.5) / 10


def thousands(count: Column) -> Column:
    return F.format_number(count, 0)
