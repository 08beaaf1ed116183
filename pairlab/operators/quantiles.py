"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a group's values are only counted into bins of a fixed scale, the order
index: one pass that gives totals, extremes and the bin of every wanted rank. A wide
bin that holds one is split into bins again, and the few values left are ranked. Each
pass is an aggregation with map-side combine whose result is bounded by the bins, so a
group with most of the rows does no harm.

The index and the ranges that a pass narrows are stored. The next pass then joins a
table of known size: a small one is broadcast and the values are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.session import cut_lineage


_RANGE = ["_lo", "_hi"]
LARGEST = 1.7976931348623157e308


def _spread(x: Column) -> Column:
    """A scale on which bins are even: nearly x for small values, its logarithm for large ones.

    It rises with x and stays finite, so one extreme value neither overflows the width of
    a range nor leaves all others in one bin. Only the bins depend on it, not the result.
    """
    return F.signum(x) * F.log1p(F.least(F.abs(x), F.lit(LARGEST)))


#: Bins of the index per unit of the scale: at most 2 * 256 * 710 for a group, whatever its values.
PER_UNIT = 256
_NAN_BIN = 1 << 30


def fixed_bin(x: Column) -> Column:
    """The bin of a value in the order index; it rises with x and needs no range. NaN is last."""
    bin_ = F.floor(_spread(x) * F.lit(float(PER_UNIT))).cast("int")
    return F.when(F.isnan(x), F.lit(_NAN_BIN)).otherwise(bin_)


def _share(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The part of a range, 0 to bins - 1, that x lies in; the two ends lie in different ones.

    So a range of different values always narrows: where the scale can't tell the ends
    apart, the plain distance does, and the upper end is in the last part by itself.
    """
    width = _spread(high) - _spread(low)
    even = F.when(width > 0, (_spread(x) - _spread(low)) / width).otherwise(F.try_divide(x - low, high - low))
    part = F.least(F.floor(F.coalesce(F.nanvl(even, F.lit(0.0)), F.lit(0.0)) * bins), F.lit(bins - 1))
    return F.when(x == low, 0).when(x == high, bins - 1).otherwise(F.least(part, F.lit(bins - 2))).cast("int")


def order_index(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group…, _bin, _n, _from, _to), stored: how many values lie in each bin, its smallest and largest.

    One pass over the rows; NULL values must be filtered out before. Totals and extremes
    of a group, the place of any rank and cuts into ranges follow from it.
    """
    counts = df.groupBy(*group, fixed_bin(F.col(value)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to")
    )
    return cut_lineage(counts, "order-index")


def totals_of(index: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group…, n): the rows of each group of an index."""
    return index.groupBy(*group).agg(F.sum("_n").alias("n"))


def cut_points(df: DataFrame, group: Sequence[str], value: str, most: Column | int, bins: int = 4096) -> DataFrame:
    """(group…, _cuts): ascending values that part each group into ranges of about ``most`` rows, stored.

    ``most`` may use ``n``, the rows of the group. A range holds the values above one
    cut and up to the next, at most ``2 * most`` rows unless one value has more. Bins of
    the order index beyond ``most`` are split again, by joins on the bin, until none is left.
    """
    group = list(group)
    index = order_index(df, group, value)
    limit = F.lit(most) if isinstance(most, int) else most
    wanted = totals_of(index, group).withColumn("_most", F.greatest(limit, F.lit(1)))
    rows, level, path, parts = df.withColumn("_bin", fixed_bin(F.col(value))), index, ["_bin"], []
    while True:
        judged = level.join(wanted.select(*group, "_most"), group)
        heavy = (F.col("_n") > F.col("_most")) & (F.col("_from") < F.col("_to"))
        parts.append(judged.filter(~heavy).select(*group, "_n", "_from", "_to"))
        split = judged.filter(heavy).select(*group, *path, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
        if split.isEmpty():
            break
        split = cut_lineage(split, "heavy")
        deeper = f"_bin{len(path)}"
        rows = rows.join(split, [*group, *path]).withColumn(deeper, _share(F.col(value), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")
        path = [*path, deeper]
        level = cut_lineage(
            rows.groupBy(*group, *path).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to")),
            "order-index",
        )
    leaves = parts[0]
    for more in parts[1:]:
        leaves = leaves.unionByName(more)
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_from"))
    placed = leaves.withColumn("_upto", upto).join(wanted, group)
    turn = F.floor((F.col("_upto") - F.col("_n")) / F.col("_most")) < F.floor(F.col("_upto") / F.col("_most"))
    cut = F.when(turn & (F.col("_upto") < F.col("n")), F.col("_to"))
    return cut_lineage(placed.groupBy(*group).agg(F.array_sort(F.collect_list(cut)).alias("_cuts")), "cuts")


def _counted(df: DataFrame, wanted: DataFrame, group: list[str], value: str, bins: int | None) -> DataFrame:
    """Counts per bin (or per value) of every distinct range, with the rows below each.

    A range that several ranks share is counted once.
    """
    ranges = wanted.select(*group, *_RANGE, "_below").distinct()
    inside = df.join(ranges, group).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
    part = F.col(value) if bins is None else _share(F.col(value), F.col("_lo"), F.col("_hi"), bins)
    counts = inside.groupBy(*group, *_RANGE, "_below", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to")
    )
    upto = F.sum("_n").over(Window.partitionBy(*group, *_RANGE).orderBy("_part"))
    return (
        counts.withColumn("_upto", F.col("_below") + upto)
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .drop("_below", "_part")
    )


def _locate(wanted: DataFrame, counted: DataFrame, group: list[str]) -> DataFrame:
    """Each wanted rank with the bin that holds it."""
    hit = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    return wanted.drop("_below").join(counted, [*group, *_RANGE]).filter(hit)


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: DataFrame,
    bins: int = 4096,
    max_left: int = 1_000_000,
    index: DataFrame | None = None,
) -> DataFrame:
    """(group…, _rank, _v): the value of 0-based ``_rank`` in ascending order per group.

    ``wanted`` holds (group…, _rank). NULL values must be filtered out before. ``index``
    is the order index of the same rows, made here if absent. While a bin of different
    values that holds a wanted rank has more than ``max_left`` rows, it is split; every
    split narrows it, as its smallest and largest value go apart. So what is ranked in
    the end is one value, or at most ``max_left`` rows per rank.
    """
    group = list(group)
    index = order_index(df, group, value) if index is None else index
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin"))
    bins_of = index.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    hit = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    found = wanted.select(*group, "_rank").distinct().join(bins_of, group).filter(hit)
    while True:
        ranks = cut_lineage(
            found.select(
                *group,
                "_rank",
                F.col("_from").alias("_lo"),
                F.col("_to").alias("_hi"),
                F.col("_before").alias("_below"),
                "_n",
            ),
            "ranges",
        )
        wide = ranks.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > max_left))
        narrow = wide.isEmpty()
        ranks = ranks.drop("_n")
        if narrow:
            break
        found = _locate(ranks, _counted(df, ranks, group, value, bins), group)
    # What is left of each range is counted by value, so ties are one row.
    last = _locate(ranks, _counted(df, ranks, group, value, None), group)
    return last.select(*group, "_rank", F.col("_from").alias("_v"))


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float],
    bins: int = 4096,
    max_left: int = 1_000_000,
    index: DataFrame | None = None,
) -> DataFrame:
    """(group…, prob, threshold, n): linearly interpolated quantiles, NULLs skipped.

    ``index`` is the order index of the same rows, where there is one.
    """
    group = list(group)
    data = df.select(*group, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    if not group:
        group, data = ["_all"], data.withColumn("_all", F.lit(0))
    index = order_index(data, group, "_x") if index is None else index
    wanted = totals_of(index, group).select(
        *group, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    )
    at = (F.col("n") - 1) * F.col("prob")
    low = F.floor(at)
    high = F.least(low + 1, F.col("n") - 1)
    both = wanted.select(*group, F.explode(F.array(low, high)).alias("_rank"))
    found = order_statistics(data, group, "_x", both, bins, max_left, index)
    # One row per group and probability, with the one or two ranks around it.
    sides = wanted.select(*group, "prob", "n", F.explode(F.array_distinct(F.array(low, high))).alias("_rank"))
    part = F.max(at - low)
    bottom, top = F.min("_v"), F.max("_v")
    return (
        sides.join(found, [*group, "_rank"])
        .groupBy(*group, "prob", "n")
        .agg((bottom + (top - bottom) * part).alias("threshold"))
        .select(*[g for g in group if g != "_all"], "prob", "threshold", "n")
    )
