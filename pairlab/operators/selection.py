"""Feature selection: relevance ranks, redundancy removal, pruning."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.correlation import correlated_pairs, pearson_matrix
from pairlab.operators.features import to_long
from pairlab.operators.ranking import combined_rank, prune_bottom
from pairlab.operators.relevance import mcc_scores, mi_binned, mi_knn, quantile_cells
from pairlab.session import cut_lineage


def relevance(long: DataFrame, label: str = "y", mi: str = "knn", jitter_by: str | None = None) -> DataFrame:
    """(feature, pos, mi, mcc, mi_rank, mcc_rank, combined_rank).

    Both binned scores come from one table of cells, which reads ``long`` three times.
    ``jitter_by`` names a row key that breaks ties in the nearest-neighbour information.
    """
    cells = quantile_cells(long, label)
    information = mi_knn(long, label, jitter_by=jitter_by) if mi == "knn" else mi_binned(long, label, cells=cells)
    positions = long.select("feature", "pos").distinct()
    scores = positions.join(information, "feature", "left").join(
        mcc_scores(long, label, cells=cells), "feature", "left"
    )
    filled = scores.select(
        "feature", "pos", F.coalesce("mi", F.lit(0.0)).alias("mi"), F.coalesce("mcc", F.lit(0.0)).alias("mcc")
    )
    # Scores are compared at nine digits, so noise in the last bits decides no rank.
    stable = filled.withColumn("mi", F.round("mi", 9)).withColumn("mcc", F.round("mcc", 9))
    return combined_rank(stable, "mi", "mcc", "pos")


def dedup_correlated(edges: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """(by…, dropped): features to remove so that no surviving pair is an edge.

    Edges have ``i``, ``j`` (i < j) and the ranks ``rank_i``, ``rank_j``. They are
    taken in order of (i, j); of two features still present the worse rank goes,
    at equal ranks the later one. The order matters, so each run is scanned by
    one task; a run holds pairs of feature names, never observations.
    """
    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by)

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        ordered = frame.sort_values(["i", "j"])
        for i, j, ri, rj in ordered[["i", "j", "rank_i", "rank_j"]].itertuples(index=False):
            if i not in gone and j not in gone:
                gone.add(j if ri <= rj else i)
        out = pd.DataFrame({"dropped": sorted(gone)})
        for place, c in enumerate(by):
            out.insert(place, c, frame[c].iloc[0])
        return out

    return edges.groupBy(*by).applyInPandas(scan, f"{kinds}, dropped int")


def redundancy_edges(matrix: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """Correlated pairs with the rank of both features; ``ranks`` has pos and combined_rank."""
    edges = correlated_pairs(matrix, threshold)
    a = ranks.select(F.col("pos").alias("i"), F.col("combined_rank").alias("rank_i"))
    b = ranks.select(F.col("pos").alias("j"), F.col("combined_rank").alias("rank_j"))
    return edges.join(a, "i").join(b, "j")


def select_features(
    df: DataFrame,
    features: Sequence[str] | None = None,
    label: str = "y",
    ids: Sequence[str] = (),
    vector: tuple[DataFrame, str] | None = None,
    threshold: float = 0.90,
    drop_share: float = 0.5,
    at_least: int = 10,
    mi: str = "knn",
    jitter_by: str | None = None,
) -> DataFrame:
    """(feature, pos, mi, mcc, combined_rank, place): relevant, little redundant features.

    ``df`` is wide with ``features``; or long, with the wide array column given as
    ``vector=(frame, column)``. ``jitter_by`` names a row key, one of ``ids`` where ``df``
    is wide, that breaks ties of values.
    """
    if vector is None:
        long = to_long(df, features, [*ids, label])
        matrix = pearson_matrix(df, features)
    else:
        long, matrix = df, pearson_matrix(vector[0], vector=vector[1])
    ranked = cut_lineage(relevance(long, label, mi, jitter_by), "ranked")  # read four times
    edges = redundancy_edges(matrix, ranked, threshold).withColumn("run", F.lit(0))
    dropped = dedup_correlated(edges).select(F.col("dropped").alias("pos"))
    survivors = ranked.join(dropped, "pos", "left_anti")
    return prune_bottom(survivors, "pos", drop_share, at_least).select(
        "feature", "pos", "mi", "mcc", "combined_rank", "place"
    )


def key_feature_status(selected: DataFrame, keys: DataFrame) -> DataFrame:
    """Which of the key features (one column, ``feature``) were kept."""
    kept = selected.select("feature", F.lit(True).alias("_kept"))
    return keys.join(kept, "feature", "left").select(
        "feature", F.when(F.col("_kept"), F.lit("KEPT")).otherwise(F.lit("DROPPED")).alias("status")
    )

