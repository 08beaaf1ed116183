"""Ranks, first-per-key, top-N and sequential ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an explicit order.

    ``row_number() <= 1`` is a group limit, so each task keeps one row per key
    before the shuffle; a key that holds most rows stays cheap.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; the order must be total to be repeatable."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def assign_ids(df: DataFrame, order: Sequence[str], id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """1-based consecutive ids in sort order, without one task seeing all rows.

    Rows are range-partitioned and sorted, and frozen in the shared folder with
    their partition and place; partition sizes then give each partition's offset.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    frozen = cut_lineage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_place", F.col("_place") - F.shiftleft("_part", 33))
    )
    sizes = frozen.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: the un-partitioned window is over a few thousand rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        frozen.join(F.broadcast(offsets), "_part")
        .withColumn(id_col, F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_offset")
    )


def rank_scores(scores: DataFrame, score: str, position: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """0-based rank, best score first, ties by position.

    The rows are feature names (columns of a table), so a group is small.
    """
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(position))
    return scores.withColumn(out, F.row_number().over(window) - 1)


def combined_rank(
    scores: DataFrame, first: str, second: str, position: str, by: Sequence[str] = ()
) -> DataFrame:
    ranked = rank_scores(scores, first, position, f"{first}_rank", by)
    ranked = rank_scores(ranked, second, position, f"{second}_rank", by)
    return ranked.withColumn(
        "combined_rank", (F.col(f"{first}_rank") + F.col(f"{second}_rank")) / F.lit(2.0)
    )


def top_features(ranked: DataFrame, position: str, n: int = 20) -> DataFrame:
    return ranked.orderBy("combined_rank", position).limit(n)


def prune_bottom(
    ranked: DataFrame,
    position: str,
    drop_share: float = 0.5,
    at_least: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Keep the best ``max(at_least, floor(n * (1 - drop_share)))`` rows per group."""
    everyone = Window.partitionBy(*by)
    n_keep = F.greatest(
        F.lit(at_least), F.floor(F.count(F.lit(1)).over(everyone) * F.lit(1.0 - drop_share)).cast("int")
    )
    place = F.row_number().over(everyone.orderBy("combined_rank", position))
    return (
        ranked.withColumn("_keep", n_keep)
        .withColumn("place", place)
        .filter(F.col("place") <= F.col("_keep"))
        .drop("_keep")
    )
