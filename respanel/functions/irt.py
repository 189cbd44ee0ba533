"""The two-parameter logistic model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from respanel.schema import RATE_CLAMP, START_B_LIMIT


def probability(a: Column, b: Column, theta: Column) -> Column:
    return 1 / (1 + F.exp(-(a * (theta - b))))


def information(a: Column, b: Column, theta: Column) -> Column:
    """Fisher information of an item at an ability."""
    p = probability(a, b, theta)
    return a * a * p * (1 - p)


def clamped_logit(rate: Column) -> Column:
    """log(p / (1 - p)) with the rate kept inside [clamp, 1 - clamp]."""
    p = F.least(F.greatest(rate, F.lit(RATE_CLAMP)), F.lit(1 - RATE_CLAMP))
    return F.ln(p / (1 - p))


def start_difficulty(rate: Column) -> Column:
    return F.least(F.greatest(-clamped_logit(rate), F.lit(-START_B_LIMIT)), F.lit(START_B_LIMIT))


def difficulty(a: Column, d: Column) -> Column:
    """b of the slope-intercept form; null where the slope is no slope."""
    return F.when(F.abs(a) > 1e-9, -d / a)


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0 or null."""
    return F.try_divide(x.cast("double"), y.cast("double"))
