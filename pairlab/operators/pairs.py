"""Orientation and labelling of contests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def away_first(away_seed: Column, home_seed: Column, away_name: Column, home_name: Column) -> Column:
    """Is the away side listed first? Lower seed, then the only seeded side, then the name."""
    both = away_seed.isNotNull() & home_seed.isNotNull()
    return (
        F.when(both, away_seed <= home_seed)
        .when(away_seed.isNotNull(), F.lit(True))
        .when(home_seed.isNotNull(), F.lit(False))
        .otherwise(F.coalesce(away_name <= home_name, F.lit(True)))
    )


def orient_pairs(
    games: DataFrame,
    attributes: Sequence[str] = ("id", "name", "seed", "score"),
    keep: Sequence[str] = (),
    flag: str = "winner",
) -> DataFrame:
    """``away_*``/``home_*`` → ``a_*``/``b_*`` with a 0/1 label that is never NULL.

    One projection: no shuffle, no Python.
    """
    first = away_first(
        F.col("away_seed"), F.col("home_seed"), F.col("away_name"), F.col("home_name")
    )
    staged = games.withColumn("_away_first", first)
    is_a = F.col("_away_first")
    cols: list[Column] = [F.col(c) for c in keep]
    for attribute in attributes:
        away, home = F.col(f"away_{attribute}"), F.col(f"home_{attribute}")
        cols.append(F.when(is_a, away).otherwise(home).alias(f"a_{attribute}"))
        cols.append(F.when(is_a, home).otherwise(away).alias(f"b_{attribute}"))
    won = F.when(is_a, F.col(f"away_{flag}")).otherwise(F.col(f"home_{flag}"))
    cols.append(F.coalesce(won, F.lit(False)).cast("int").alias("winner"))
    return staged.select(*cols)


def unresolved(pairs: DataFrame, a_id: str = "a_id", b_id: str = "b_id") -> DataFrame:
    return pairs.filter(F.col(a_id).isNull() | F.col(b_id).isNull())


def period_counts(df: DataFrame, period: str = "period") -> DataFrame:
    """Rows per period, and the total in a row whose period is NULL."""
    return df.rollup(period).agg(F.count(F.lit(1)).alias("n"))
