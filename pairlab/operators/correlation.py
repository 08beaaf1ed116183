"""Pearson correlation of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.pairmath import impute_zero

_PARTIAL = "part int, n bigint, mean binary, moment binary"
#: At most so many tasks merge the partial matrices of all tasks before the last one merges theirs.
MERGERS = 64
#: A sum of squares below this share of the raw one is what rounding leaves of a constant.
_ROUNDING = 1e-28


class _Moments:
    """Count, means and centred products of the rows seen so far."""

    def __init__(self) -> None:
        self.n, self.mean, self.moment = 0, None, None

    def add(self, n: int, mean: np.ndarray, moment: np.ndarray) -> None:
        if self.mean is None:
            self.n, self.mean, self.moment = n, mean, moment
            return
        total = self.n + n
        shift = mean - self.mean
        self.moment = self.moment + moment + np.outer(shift, shift) * (self.n * n / total)
        self.mean = self.mean + shift * (n / total)
        self.n = total

    def packed(self, part: int) -> pd.DataFrame:
        """One row: the means, and the upper triangle of the products."""
        upper = self.moment[np.triu_indices(len(self.mean))]
        row = {"part": part, "n": self.n, "mean": self.mean.tobytes(), "moment": upper.tobytes()}
        return pd.DataFrame([row]).astype({"part": "int32", "n": "int64"})


def _unpack(mean: bytes, moment: bytes) -> tuple[np.ndarray, np.ndarray]:
    means = np.frombuffer(mean)
    square = np.zeros((len(means), len(means)))
    square[np.triu_indices(len(means))] = np.frombuffer(moment)
    return means, square + np.triu(square, 1).T


def _merged(batches: Iterator[pd.DataFrame]) -> tuple[_Moments, int]:
    seen, part = _Moments(), 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            seen.add(row.n, *_unpack(row.mean, row.moment))
            part = row.part
    return seen, part


def _correlations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, _ = _merged(batches)
    if seen.mean is None:
        return
    own = np.diag(seen.moment)
    with np.errstate(all="ignore"):
        spread = np.where(own > _ROUNDING * (seen.n * seen.mean**2 + own), np.sqrt(own), np.nan)
        i, j = np.triu_indices(len(own))
        r = seen.moment[i, j] / (spread[i] * spread[j])
    values = [None if np.isnan(v) else float(v) for v in r]
    yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "r": pd.Series(values, dtype="object")})


def pearson_matrix(
    df: DataFrame, features: Sequence[str] | None = None, vector: str | None = None
) -> DataFrame:
    """(i, j, r) for i ≤ j over feature columns, or over the items of an array column.

    NULL and NaN count as 0; r is NULL where a side is constant. An empty frame gives
    no rows. Each task reduces its rows to one centred moment matrix with matrix
    products and sends it as one row; at most ``MERGERS`` tasks merge these, one at a time, and
    one task merges theirs. Partial matrices are merged in the order of their tasks, so
    a task that runs again gives the same bits.
    """
    if vector is None:
        packed = F.array(*[impute_zero(F.col(f"`{f}`")) for f in features])
    else:
        packed = F.transform(vector, lambda v: impute_zero(v))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Moments()
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["_v"].to_numpy())
            mean = x.mean(axis=0)
            centred = x - mean
            seen.add(len(x), mean, centred.T @ centred)
        if seen.mean is not None:
            yield seen.packed(TaskContext.get().partitionId())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, part = _merged(batches)
        if seen.mean is not None:
            yield seen.packed(part)

    partials = df.select(packed.alias("_v")).mapInPandas(partial, _PARTIAL)
    dealt = partials.repartition(F.col("part") % MERGERS).sortWithinPartitions("part")
    merged = dealt.mapInPandas(merge, _PARTIAL)
    last = merged.repartition(1).sortWithinPartitions("part")
    return last.mapInPandas(_correlations, "i int, j int, r double")


def correlated_pairs(matrix: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Pairs i < j beyond the threshold; undefined correlations never are."""
    return matrix.filter((F.col("i") < F.col("j")) & (F.abs("r") > threshold))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation that is NULL, not an error, for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def model_correlation(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """(model_i, model_j, r, n) over rows where both models predicted; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(preds) for b in preds[i:]]
    packed = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_i"),
                F.lit(b).alias("model_j"),
                pearson(F.col(a), F.col(b)).alias("r"),
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
            )
            for a, b in pairs
        ]
    )
    return df.agg(packed.alias("_p")).select(F.explode("_p").alias("_e")).select("_e.*")
