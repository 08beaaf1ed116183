"""Relevance of features for a label: MCC over quantile cuts, mutual information.

Input is long: one row per observation and feature (``feature``, ``x``, ``y``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.probability import digamma
from pairlab.operators.quantiles import cut_points, exact_quantiles
from pairlab.session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)


def mcc_from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a class or a prediction is missing."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, scale), F.lit(0.0))


def feature_quantiles(long: DataFrame, probs: Sequence[float] = QUARTILES, by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(long, [*by, "feature"], "x", probs)


def _stored_cuts(long: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """One array of thresholds per feature, stored so that joins know its size."""
    cuts = feature_quantiles(long, probs, by).groupBy(*by, "feature").agg(
        F.array_sort(F.collect_list("threshold")).alias("_cuts")
    )
    return cut_lineage(cuts, "cuts")


def quantile_cells(
    long: DataFrame, label: str = "y", probs: Sequence[float] = QUARTILES, by: Sequence[str] = ()
) -> DataFrame:
    """(by…, feature, _bin, label, _c), stored: rows per quantile bin and label, at most bins × labels a feature.

    The bin is the number of thresholds below x. The thresholds of a feature ride along as
    one array, so a row is not copied per threshold. MCC and binned information over the
    same thresholds are both read from this table, which takes three passes over the rows.
    """
    keys = [*by, "feature"]
    cuts = _stored_cuts(long, probs, by)
    x = F.col("x")
    place = F.when(x.isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: x > c)))
    binned = long.join(cuts, keys).withColumn("_bin", place)
    return cut_lineage(binned.groupBy(*keys, "_bin", label).agg(F.count(F.lit(1)).alias("_c")), "cells")


def mcc_scores(
    long: DataFrame,
    label: str = "y",
    probs: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
    cells: DataFrame | None = None,
) -> DataFrame:
    """Best absolute MCC of ``x > threshold`` over the thresholds of each feature.

    ``cells`` are the ``quantile_cells`` of the same thresholds, where they are known.
    """
    keys = [*by, "feature"]
    cells = quantile_cells(long, label, probs, by) if cells is None else cells
    positive, c = F.col(label) == 1, F.col("_c")
    above = [F.col("_bin") > i for i in range(len(probs))]

    def rows(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, c)), F.lit(0))

    counts = cells.groupBy(*keys).agg(
        F.sum(c).alias("_n"),
        rows(positive).alias("_pos"),
        *[rows(h).alias(f"_hit{i}") for i, h in enumerate(above)],
        *[rows(h & positive).alias(f"_tp{i}") for i, h in enumerate(above)],
    )
    scores = []
    for i in range(len(probs)):
        tp, picked = F.col(f"_tp{i}"), F.col(f"_hit{i}")
        fp, fn = picked - tp, F.col("_pos") - tp
        scores.append(F.abs(mcc_from_counts(tp, fp, fn, F.col("_n") - picked - fn)))
    return counts.select(*keys, F.greatest(*scores, F.lit(0.0)).alias("mcc"))


def mi_binned(
    long: DataFrame, label: str = "y", n_bins: int = 4, by: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Mutual information of the quantile bin and the label, in nats; ``cells`` as for ``mcc_scores``."""
    keys = [*by, "feature"]
    if cells is None:
        cells = quantile_cells(long, label, [i / n_bins for i in range(1, n_bins)], by)
    cells = cells.withColumn("_c", F.col("_c").cast("double"))
    # At most bins × labels rows per feature from here on.
    per_bin = Window.partitionBy(*keys, "_bin")
    per_label = Window.partitionBy(*keys, label)
    everything = Window.partitionBy(*keys)
    total = F.sum("_c").over(everything)
    parts = cells.select(
        *keys,
        (
            F.col("_c") / total
            * F.ln(F.col("_c") * total / (F.sum("_c").over(per_bin) * F.sum("_c").over(per_label)))
        ).alias("_term"),
    )
    return parts.groupBy(*keys).agg(F.greatest(F.sum("_term"), F.lit(0.0)).alias("mi"))


#: Hexadecimal digits of a digest that make a uniform number: 52 bits, exact as a double.
_UNIFORM_DIGITS = 13


def uniform_of(key: Column, feature: Column, draw: int) -> Column:
    """A number in (0, 1) from the MD5 of "key/feature/draw", the same in any engine."""
    digest = F.md5(F.concat_ws("/", key.cast("string"), feature, F.lit(str(draw))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, _UNIFORM_DIGITS), 16, 10).cast("bigint").cast("double")
    return (bits + 0.5) / F.lit(float(16**_UNIFORM_DIGITS))


def _jitter(long: DataFrame, key: str) -> DataFrame:
    """x plus normal noise that depends on the row's key and the feature only."""
    scale = cut_lineage(
        long.groupBy("feature").agg(F.greatest(F.stddev_pop("x"), F.avg(F.abs("x"))).alias("_scale")), "scale"
    )
    one, two = (uniform_of(F.col(key), F.col("feature"), draw) for draw in (1, 2))
    normal = F.sqrt(F.lit(-2.0) * F.ln(one)) * F.cos(F.lit(2 * math.pi) * two)
    return long.join(scale, "feature").withColumn("x", F.col("x") + F.lit(1e-10) * F.col("_scale") * normal)


def _bucket(x: Column, cuts: Column) -> Column:
    """How many cuts lie below x: first over blocks of cuts, then inside one block.

    ``cuts`` is an array of blocks, ascending, of equal length but for the last.
    """
    full = F.size(F.filter(cuts, lambda block: F.element_at(block, -1) < x))
    block = F.get(cuts, full)
    below = F.size(F.filter(block, lambda c: c < x))
    side, last = F.size(F.get(cuts, F.lit(0))), F.size(F.element_at(cuts, -1))
    everything = (F.size(cuts) - 1) * side + last
    return F.when(F.size(cuts) == 0, 0).when(block.isNull(), everything).otherwise(full * side + below)


def mi_knn(
    long: DataFrame,
    label: str = "y",
    k: int = 5,
    rows_per_bucket: int = 250_000,
    buckets: int | None = None,
    jitter_by: str | None = None,
) -> DataFrame:
    """(feature, mi): nearest-neighbour mutual information of a number and a class.

    For each observation r is the distance to its k-th nearest neighbour of the
    same class and m the number of observations nearer than r (at r = 0: as
    near); the estimate is ψ(N) + ⟨ψ(k)⟩ − ⟨ψ(n_class)⟩ − ⟨ψ(m)⟩, at least 0.
    Classes with one member are left out.

    Where many values are equal the estimate is low, as m counts all of them.
    ``jitter_by`` names a row key: a repeatable noise of a ten-billionth of the
    values' scale, drawn from the MD5 of key and feature, then breaks the ties.

    A feature's values are cut into range buckets by counting passes over an order
    index (``quantiles.cut_points``); a bucket takes the last and
    the next k values of its class from its neighbours, and counts below a bound
    are the total of the lower buckets plus a place in its own. So no task sees
    a whole feature. Equal values are one row with a weight throughout.
    """
    data = long if jitter_by is None else _jitter(long, jitter_by)
    data = data.select("feature", "x", F.col(label).alias("_y"))
    members = cut_lineage(data.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("_members")), "members")
    data = data.join(members.filter(F.col("_members") > 1), ["feature", "_y"])
    # Read six times below, so it is stored: one shuffle instead of six.
    weighted = cut_lineage(
        data.groupBy("feature", "x", "_y").agg(
            F.count(F.lit(1)).alias("w"), F.first("_members").alias("members")
        )
    )
    # The cuts decide which bucket a value belongs to, so they are frozen.
    most = rows_per_bucket if buckets is None else F.ceil(F.col("n") / buckets)
    points = cut_points(weighted.select("feature", "x"), ["feature"], "x", most)
    side = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / side).cast("int")),
        lambda i: F.slice("_cuts", i * side + 1, side),
    )
    cuts = points.select(
        "feature",
        F.size("_cuts").alias("_n_cuts"),
        F.when(F.size("_cuts") > 0, block).otherwise(F.array().cast("array<array<double>>")).alias("_cuts"),
    )
    placed = (
        weighted.join(cuts, "feature").withColumn("bucket", _bucket(F.col("x"), F.col("_cuts"))).drop("_cuts", "_n_cuts")
    )

    every = cuts.select(
        "feature", F.explode(F.sequence(F.lit(0), F.col("_n_cuts"))).alias("bucket")
    )
    mass = every.join(
        placed.groupBy("feature", "bucket").agg(F.sum("w").alias("_mass")), ["feature", "bucket"], "left"
    )
    lower = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = mass.select("feature", "bucket", F.coalesce(F.sum("_mass").over(lower), F.lit(0)).alias("_base"))
    near = _count_nearer(placed, _radius(placed, k), cuts, base)

    used = F.least(F.lit(k), F.col("members") - 1)
    sums = near.groupBy("feature").agg(
        F.sum("w").alias("_n"),
        F.sum(F.col("w") * digamma(used)).alias("_k"),
        F.sum(F.col("w") * digamma(F.col("members"))).alias("_c"),
        F.sum(F.col("w") * digamma(F.col("m"))).alias("_m"),
    )
    n = F.col("_n")
    mi = digamma(n) + (F.col("_k") - F.col("_c") - F.col("_m")) / n
    return sums.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


def _radius(placed: DataFrame, k: int) -> DataFrame:
    """Adds r and the open interval (lo, hi) around each value that m is counted in."""
    group = ["feature", "_y", "bucket"]
    # A value with many copies needs k + 1 of them: then its k nearest are its own.
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("w", F.lit(k + 1)))))

    # The first and the last k observations of each bucket go to the buckets around it.
    def ends(order: Column, name: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(order)
        return (
            copies.select(*group, "x", F.row_number().over(window).alias("_p"))
            .filter(F.col("_p") <= k)
            .groupBy(*group)
            .agg(F.array_sort(F.collect_list("x")).alias(name))
        )

    edge = ends(F.asc("x"), "_head").join(ends(F.desc("x"), "_tail"), group)
    line = Window.partitionBy("feature", "_y").orderBy("bucket")
    none = F.array().cast("array<double>")
    before = F.concat(*[F.coalesce(F.lag("_tail", i).over(line), none) for i in range(k, 0, -1)])
    after = F.concat(*[F.coalesce(F.lead("_head", i).over(line), none) for i in range(1, k + 1)])
    outside = F.concat(
        F.slice("_before", F.greatest(F.size("_before") - k, F.lit(0)) + 1, F.lit(k)),
        F.slice("_after", 1, k),
    )
    halo = (
        edge.select(*group, before.alias("_before"), after.alias("_after"))
        .select(*group, F.explode(outside).alias("x"))
        .withColumn("copy", F.lit(0))
    )

    chain = Window.partitionBy(*group).orderBy("x")
    x, far = F.col("x"), F.lit(float("inf"))
    below = [F.col(f"_b{i}") for i in range(1, k + 1)]
    above = [F.col(f"_a{i}") for i in range(1, k + 1)]
    seen = (
        copies.select(*group, "x", "w", "members", "copy")
        .unionByName(halo, allowMissingColumns=True)
        .select(
            *group, "x", "w", "members", "copy",
            *[F.lag("x", i).over(chain).alias(f"_b{i}") for i in range(1, k + 1)],
            *[F.lead("x", i).over(chain).alias(f"_a{i}") for i in range(1, k + 1)],
        )
        .filter(F.col("copy") == 1)
    )
    # The k nearest are i on one side and k - i on the other.
    left = [F.lit(0.0), *[F.coalesce(x - b, far) for b in below]]
    right = [F.lit(0.0), *[F.coalesce(a - x, far) for a in above]]
    kth = F.least(*[F.greatest(left[i], right[k - i]) for i in range(k + 1)])
    farthest = F.greatest(*[x - b for b in below], *[a - x for a in above])
    out = seen.withColumn("r", F.when(F.col("members") > k, kth).otherwise(farthest))
    # A neighbour at r or beyond bounds the interval, whatever x ± r rounds to.
    r = F.col("r")
    floor = F.greatest(x - r, *[F.when((x - b >= r) & (b < x), b) for b in below])
    ceiling = F.least(x + r, *[F.when((a - x >= r) & (a > x), a) for a in above])
    return out.select("feature", "_y", "x", "w", "members", "r", floor.alias("lo"), ceiling.alias("hi"))


def _count_nearer(placed: DataFrame, radius: DataFrame, cuts: DataFrame, base: DataFrame) -> DataFrame:
    """(feature, w, members, m): observations of any class with lo < x < hi, or equal to x where r is 0."""
    # A bound sorts among the values of its bucket, before equal ones (kind 0) or
    # after them (kind 2): the interval is open, but closed where it is a point.
    point = F.col("r") == 0
    bounds = radius.select(
        "feature", "_y", "x", "w", "members",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("at"), F.when(point, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
                F.struct(F.col("hi").alias("at"), F.when(point, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
            )
        ).alias("q"),
    ).select("feature", "_y", "x", "w", "members", "q.*")
    queries = bounds.join(cuts, "feature").withColumn("bucket", _bucket(F.col("at"), F.col("_cuts"))).drop("_cuts", "_n_cuts")
    events = queries.withColumn("_mass", F.lit(0).cast("bigint")).unionByName(
        placed.select(
            "feature", "bucket", F.col("x").alias("at"), F.lit(1).alias("kind"), F.col("w").alias("_mass")
        ),
        allowMissingColumns=True,
    )
    sweep = Window.partitionBy("feature", "bucket").orderBy("at", "kind")
    placed_queries = events.withColumn("_upto", F.sum("_mass").over(sweep)).filter(F.col("kind") != 1)
    rank = F.col("_upto") + F.col("_base")
    return (
        placed_queries.join(base, ["feature", "bucket"])
        .groupBy("feature", "_y", "x")
        .agg(
            F.first("w").alias("w"),
            F.first("members").alias("members"),
            F.sum(F.col("sign") * rank).alias("m"),
        )
    )
