"""Arithmetic on the two sides of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges, floors and group edges used by the pair features.
CLOSE_GAP, MODERATE_GAP = 3, 7
AVERAGE_FLOOR = 0.001
LOG_FLOOR = 0.5
GROUP_EDGES = (0, 2, 4)


def ordinal_group(c: Column) -> Column:
    """Ordinal → coarse group: ≤0, ≤2, ≤4 and the rest."""
    branch = F.when(c.isNull(), F.lit(None).cast("int"))
    for group, edge in enumerate(GROUP_EDGES):
        branch = branch.when(c <= edge, F.lit(group))
    return branch.otherwise(F.lit(len(GROUP_EDGES)))


def pct_diff(a: Column, b: Column, denominator: str = "clip", floor: float = AVERAGE_FLOOR) -> Column:
    """Difference over the average of both sides.

    ``clip`` floors the signed average (a negative one becomes the floor),
    ``abs_clip`` floors its absolute value.
    """
    average = (a + b) / F.lit(2.0)
    if denominator == "abs_clip":
        average = F.abs(average)
    elif denominator != "clip":
        raise ValueError(f"unknown denominator {denominator!r}")
    return (a - b) / F.greatest(average, F.lit(floor))


def safe_diff(a: Column, b: Column) -> Column:
    return a - b


def safe_pct_diff(a: Column, b: Column) -> Column:
    """Difference over the plain average; 0.0 where the average is zero."""
    average = (a + b) / F.lit(2.0)
    return F.when(average == 0, F.lit(0.0)).otherwise(F.try_divide(a - b, average))


def log_ratio(a: Column, b: Column, floor: float | None = None) -> Column:
    """ln a − ln b, of values raised to ``floor`` if one is given; NULL where a side is missing."""
    x, y = a.cast("double"), b.cast("double")
    if floor is None:
        return F.ln(x) - F.ln(y)
    raised = F.ln(F.greatest(x, F.lit(floor))) - F.ln(F.greatest(y, F.lit(floor)))
    return F.when(x.isNotNull() & y.isNotNull(), raised)


def diff_bucket(diff: Column) -> Column:
    """0 up to 3 apart, 1 up to 7, 2 beyond; a missing difference counts as 2."""
    return (
        F.when(F.abs(diff) <= CLOSE_GAP, F.lit(0))
        .when(F.abs(diff) <= MODERATE_GAP, F.lit(1))
        .otherwise(F.lit(2))
    )


def pair_arith(a: Column, b: Column, prefix: str = "seed", log_floor: float | None = None) -> list[Column]:
    """Difference, sum, product, symmetric percentage and log ratio of one pair."""
    return [
        (a - b).alias(f"{prefix}_diff"),
        (a + b).alias(f"{prefix}_sum"),
        (a * b).alias(f"{prefix}_product"),
        pct_diff(a, b).alias(f"{prefix}_pct_diff"),
        log_ratio(a, b, log_floor).alias(f"log_{prefix}_ratio"),
    ]


def round_digits(x: Column, digits: int) -> Column:
    """``F.round`` of doubles, to the last bit, mostly by arithmetic in place of decimal text.

    A value clear of the middle between two results goes to the nearer one, whichever way
    ties go; any other, and one too large for that to be certain, goes through ``F.round``.
    ``x`` should be a stored or projected column, as it is used several times.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.floor(scaled)
    above = scaled - whole
    certain = (F.abs(scaled) < 1e9) & (F.abs(above - F.lit(0.5)) > 1e-4)
    nearest = (whole + F.when(above > 0.5, 1).otherwise(0)).cast("double") / F.lit(10.0**digits)
    return F.when(certain, nearest).otherwise(F.round(x, digits))


def impute_zero(c: Column) -> Column:
    """NULL and NaN → 0, infinities → largest finite double of that sign."""
    big = 1.7976931348623157e308
    value = F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(-big)), F.lit(big))
