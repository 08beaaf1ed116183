"""Evaluation of probabilistic predictions: aggregates with map-side combine only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.probability import clip_probability, log_loss_term
from pairlab.operators.relevance import mcc_from_counts


def predictions_long(df: DataFrame, preds: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep…, model, p): one row per prediction that exists."""
    packed = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in preds])
    return (
        df.select(*keep, F.explode(packed).alias("_e"))
        .select(*keep, "_e.model", "_e.p")
        .filter(F.col("p").isNotNull())
    )


def accuracy(p: Column, y: Column) -> Column:
    return F.avg(((p > 0.5).cast("int") == y).cast("int"))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(log_loss_term(p, y))


def matthews(p: Column, y: Column) -> Column:
    up, yes = p > 0.5, y == 1
    return mcc_from_counts(
        F.count_if(up & yes), F.count_if(up & ~yes), F.count_if(~up & yes), F.count_if(~up & ~yes)
    )


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def metrics(df: DataFrame, by: Sequence[str], p: str = "p", y: str = "winner") -> DataFrame:
    """n, accuracy, log-loss, MCC and the always-first baseline per group, in one pass."""
    pc, yc = F.col(p), F.col(y)
    baseline = F.avg(yc)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        accuracy(pc, yc).alias("accuracy"),
        log_loss(pc, yc).alias("log_loss"),
        matthews(pc, yc).alias("mcc"),
        baseline.alias("baseline_accuracy"),
        (accuracy(pc, yc) - baseline).alias("improvement"),
    )


def fold_summary(folds: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over folds."""
    return folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(v).alias(f"avg_{v}") for v in values]
    )


def segment_accuracy(
    df: DataFrame, p: str, y: str = "winner", segments: Sequence[str] = ("round_group", "seed_diff_bucket")
) -> DataFrame:
    """(segment, value, n, accuracy): each segment column on its own, one aggregation."""
    packed = F.array(
        *[F.struct(F.lit(s).alias("segment"), F.col(s).cast("int").alias("value")) for s in segments]
    )
    hit = ((F.col(p) > 0.5).cast("int") == F.col(y)).cast("int").alias("_hit")
    return (
        df.select(F.explode(packed).alias("_s"), hit)
        .groupBy(F.col("_s.segment").alias("segment"), F.col("_s.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"))
    )


def calibration_curve(df: DataFrame, p: str, y: str = "winner", bins: int = 10) -> DataFrame:
    """Predicted mean, observed rate and Brier score per equal-width bin."""
    pc, yc = F.col(p), F.col(y)
    place = F.least(F.floor(pc * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return (
        df.withColumn("_bin", place)
        .groupBy(F.col("_bin").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(pc).alias("mean_p"),
            F.avg(yc).alias("observed"),
            brier(pc, yc).alias("brier"),
        )
    )


def clipped_log_loss(p: Column, y: Column) -> Column:
    return log_loss(clip_probability(p), y)


def upset_rate_table(df: DataFrame, diff: str = "seed_diff", y: str = "winner") -> DataFrame:
    """How often the second side wins at each difference."""
    return (
        df.filter(F.col(diff).isNotNull())
        .groupBy(diff)
        .agg(F.avg(F.lit(1.0) - F.col(y)).alias("rate"), F.count(F.lit(1)).alias("n"))
    )


def hit_report(df: DataFrame, p: str, round_col: str, a_seed: str, b_seed: str, y: str = "winner") -> DataFrame:
    """Hits per round and overall (NULL round), and how many actual upsets were called."""
    hit = (F.col(p) > 0.5).cast("int") == F.col(y)
    upset = F.coalesce(
        ((F.col(y) == 1) & (F.col(a_seed) > F.col(b_seed)))
        | ((F.col(y) == 0) & (F.col(b_seed) > F.col(a_seed))),
        F.lit(False),
    )
    return (
        df.withColumn("_hit", hit)
        .withColumn("_upset", upset)
        .rollup(round_col)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_hit").alias("hits"),
            F.avg(F.col("_hit").cast("int")).alias("hit_rate"),
            F.count_if("_upset").alias("upsets"),
            F.count_if(F.col("_upset") & F.col("_hit")).alias("upsets_called"),
            F.try_divide(
                F.count_if(F.col("_upset") & F.col("_hit")).cast("double"), F.count_if("_upset")
            ).alias("upset_recall"),
        )
    )


def leave_group_out_rate(df: DataFrame, group: str, key: str, y: str = "winner") -> DataFrame:
    """(group, key, n_other, rate): mean label of the key over all other groups."""
    own = df.groupBy(group, key).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    totals = own.groupBy(key).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    n_other = F.col("_tn") - F.col("_n")
    return own.join(totals, key).select(
        group,
        key,
        n_other.alias("n_other"),
        F.try_divide((F.col("_ts") - F.col("_s")).cast("double"), n_other).alias("rate"),
    )
