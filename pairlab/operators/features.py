"""Generated pair features and feature layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.pairmath import (
    diff_bucket,
    impute_zero,
    ordinal_group,
    pair_arith,
    pct_diff,
)
from pairlab.functions.text import normalize_category


@dataclass(frozen=True)
class Composite:
    """Weighted sum of side differences; optional terms are left out when absent."""

    name: str
    required: Mapping[str, float]
    optional: Mapping[str, float] = field(default_factory=dict)


def stat_columns(df: DataFrame, metadata: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in metadata]


def _sides(stat: str) -> tuple[Column, Column]:
    return F.col(f"`a_{stat}`"), F.col(f"`b_{stat}`")


def _paired(df: DataFrame, stats: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [s for s in stats if f"a_{s}" in have and f"b_{s}" in have]


def stat_diffs(df: DataFrame, stats: Sequence[str]) -> list[Column]:
    return [(a - b).alias(f"diff_{s}") for s in _paired(df, stats) for a, b in [_sides(s)]]


def stat_pctdiffs(df: DataFrame, stats: Sequence[str], denominator: str = "clip") -> list[Column]:
    return [
        pct_diff(a, b, denominator).alias(f"pctdiff_{s}")
        for s in _paired(df, stats)
        for a, b in [_sides(s)]
    ]


def variant_gaps(
    df: DataFrame, stats: Sequence[str], base: str = "season", other: str = "away"
) -> list[Column]:
    """``base`` minus ``other`` variant of each side, and the difference of both gaps."""
    paired = set(_paired(df, stats))
    out = []
    for stat in stats:
        if not stat.endswith(f"_{base}"):
            continue
        root = stat[: -len(base) - 1]
        twin = f"{root}_{other}"
        if stat not in paired or twin not in paired:
            continue
        (a, b), (a2, b2) = _sides(stat), _sides(twin)
        out += [
            (a - a2).alias(f"a_{other}gap_{root}"),
            (b - b2).alias(f"b_{other}gap_{root}"),
            ((a - a2) - (b - b2)).alias(f"diff_{other}gap_{root}"),
        ]
    return out


def composites(df: DataFrame, specs: Sequence[Composite]) -> list[Column]:
    """Composite indices whose required statistics exist in the frame."""
    out = []
    for spec in specs:
        if set(spec.required) - set(_paired(df, list(spec.required))):
            continue
        terms = {**spec.required, **{s: w for s, w in spec.optional.items() if _paired(df, [s])}}
        parts = [F.lit(float(w)) * (_sides(s)[0] - _sides(s)[1]) for s, w in terms.items()]
        out.append(reduce(lambda x, y: x + y, parts).alias(spec.name))
    return out


def with_rounds(df: DataFrame, text: str = "bracket_round") -> DataFrame:
    """Adds ``round_number`` and ``round_group``.

    The number is a projection of its own: used five times by the group, its
    text rules would otherwise be spelled out, and run, five times.
    """
    return df.withColumn("round_number", normalize_category(F.col(text))).withColumn(
        "round_group", ordinal_group(F.col("round_number"))
    )


def seed_columns(a: Column, b: Column, log_floor: float | None = None) -> list[Column]:
    return [*pair_arith(a, b, log_floor=log_floor), diff_bucket(a - b).alias("seed_diff_bucket")]


def build_pair_features(
    df: DataFrame,
    stats: Sequence[str],
    specs: Sequence[Composite] = (),
    round_col: str = "bracket_round",
    seeds: tuple[str, str] = ("a_seed", "b_seed"),
    denominator: str = "clip",
    log_floor: float | None = None,
) -> DataFrame:
    """All generated columns of the joined pairs; no shuffle.

    The defaults are the training form; serving uses ``abs_clip`` and a ``log_floor``.
    """
    return with_rounds(df, round_col).select(
        "*",
        *seed_columns(F.col(seeds[0]), F.col(seeds[1]), log_floor),
        *stat_diffs(df, stats),
        *stat_pctdiffs(df, stats, denominator),
        *variant_gaps(df, stats),
        *composites(df, specs),
    )


def pick_features(df: DataFrame, exclude: Sequence[str], prefixes: Sequence[str] = ("a_", "b_")) -> list[str]:
    """Columns that are neither excluded nor raw per-side values."""
    return [c for c in df.columns if c not in exclude and not c.startswith(tuple(prefixes))]


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c in have]


def to_long(
    df: DataFrame, features: Sequence[str], ids: Sequence[str], impute: bool = True
) -> DataFrame:
    """(ids…, feature, pos, x): one row per row and feature, narrow enough for codegen."""
    value = (lambda c: impute_zero(c)) if impute else (lambda c: c.cast("double"))
    packed = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(i).alias("pos"), value(F.col(f"`{f}`")).alias("x"))
            for i, f in enumerate(features)
        ]
    )
    return df.select(*ids, F.explode(packed).alias("_f")).select(*ids, "_f.feature", "_f.pos", "_f.x")


def vector_to_long(df: DataFrame, vector: str, ids: Sequence[str], prefix: str = "f") -> DataFrame:
    """An array column as (ids…, feature, pos, x)."""
    flat = df.select(*ids, F.posexplode(vector).alias("pos", "_x"))
    return flat.select(
        *ids,
        F.concat(F.lit(prefix), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("feature"),
        "pos",
        impute_zero(F.col("_x")).alias("x"),
    )


def feature_sets(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(set_name, pos, feature) of the configured features the frame carries."""
    spark = df.sparkSession
    rows = [(n, i, f) for n, fs in sets.items() for i, f in enumerate(available(df, fs))]
    return spark.createDataFrame(rows, "set_name string, pos int, feature string")


def regime_close(diff: str = "seed_diff", limit: int = 7) -> Column:
    return F.abs(F.col(diff)) <= limit


def regime_late(round_number: str = "round_number", start: int = 3) -> Column:
    return F.col(round_number) >= start


def fold_split(df: DataFrame, period: str, held_out: int) -> tuple[DataFrame, DataFrame]:
    """Training rows of all other periods, test rows of this one."""
    return df.filter(F.col(period) != held_out), df.filter(F.col(period) == held_out)


def fold_support(df: DataFrame, period: str, regimes: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Training rows per (held-out period, regime) and whether a specialist is fitted.

    Rows of a fold are all rows minus its own, so one pass over the data serves
    every fold.
    """
    per = df.groupBy(period).agg(
        *[F.count_if(cond).alias(f"n_{name}") for name, (cond, _) in regimes.items()]
    )
    packed = F.array(
        *[
            F.struct(
                F.lit(name).alias("regime"),
                F.col(f"n_{name}").alias("n_own"),
                F.lit(minimum).alias("minimum"),
            )
            for name, (_, minimum) in regimes.items()
        ]
    )
    long = per.select(period, F.explode(packed).alias("r")).select(period, "r.*")
    totals = long.groupBy("regime").agg(F.sum("n_own").alias("n_all"))
    n_train = F.col("n_all") - F.col("n_own")
    return long.join(totals, "regime").select(
        period, "regime", n_train.alias("n_train"), (n_train >= F.col("minimum")).alias("fitted")
    )
