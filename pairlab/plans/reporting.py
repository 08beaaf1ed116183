"""Queries on evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import correlation, evaluation
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_SCORED, r
from pairlab.plans.registry import register, rounded

PREDS = ("p0", "p1", "p2", "p3")
_LONG_SQL = (
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT game_id, period, winner, '{p}' AS model, "
        + ("CASE WHEN round_number >= 3 THEN p2 END" if p == "p2" else p)
        + " AS p FROM scored"
        for p in PREDS
    )
    + "), kept AS (SELECT * FROM long WHERE p IS NOT NULL)"
)
_HIT = "((p > 0.5)::INTEGER = winner)::INTEGER"
_LOSS = "-(winner * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - winner) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"


def _mcc_sql(p: str = "p") -> str:
    def c(cond: str) -> str:
        return f"(count(*) FILTER (WHERE {cond}))::DOUBLE"

    tp, fp = c(f"{p} > 0.5 AND winner = 1"), c(f"{p} > 0.5 AND winner = 0")
    fn, tn = c(f"{p} <= 0.5 AND winner = 1"), c(f"{p} <= 0.5 AND winner = 0")
    return f"coalesce(({tp} * {tn} - {fp} * {fn}) / nullif(sqrt({tp} + {fp}) * sqrt({tp} + {fn}) * sqrt({tn} + {fp}) * sqrt({tn} + {fn}), 0), 0)"


def _long(spark, sf):
    df = views.tolerant_preds(views.scored(spark, sf))
    return evaluation.predictions_long(df, PREDS, ["period", "winner"])


@register(
    "accuracy_by_group",
    f"{WITH_SCORED}, {_LONG_SQL} SELECT model, period, count(*) AS n, {r(f'avg({_HIT})')} AS accuracy FROM kept GROUP BY ALL",
)
def accuracy_by_group(spark, sf):
    by = _long(spark, sf).groupBy("model", "period")
    return rounded(
        by.agg(F.count(F.lit(1)).alias("n"), evaluation.accuracy(F.col("p"), F.col("winner")).alias("accuracy"))
    )


@register(
    "logloss_by_group",
    f"{WITH_SCORED}, {_LONG_SQL} SELECT model, period, {r(f'avg({_LOSS})')} AS log_loss FROM kept GROUP BY ALL",
)
def logloss_by_group(spark, sf):
    by = _long(spark, sf).groupBy("model", "period")
    return rounded(by.agg(evaluation.log_loss(F.col("p"), F.col("winner")).alias("log_loss")))


@register(
    "mcc_by_group",
    f"{WITH_SCORED}, {_LONG_SQL} SELECT model, period, {r(_mcc_sql())} AS mcc FROM kept GROUP BY ALL",
)
def mcc_by_group(spark, sf):
    by = _long(spark, sf).groupBy("model", "period")
    return rounded(by.agg(evaluation.matthews(F.col("p"), F.col("winner")).alias("mcc")))


@register(
    "baseline_compare",
    f"""{WITH_SCORED}, e AS (SELECT period, winner, prob AS p FROM ensemble) SELECT period, count(*) AS n,
      {r(f'avg({_HIT})')} AS accuracy, {r(f'avg({_LOSS})')} AS log_loss, {r(_mcc_sql())} AS mcc,
      {r('avg(winner)')} AS baseline_accuracy, {r(f'avg({_HIT}) - avg(winner)')} AS improvement FROM e GROUP BY period""",
)
def baseline_compare(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    return rounded(evaluation.metrics(df, ["period"], "prob"))


@register(
    "fold_summary",
    f"""{WITH_SCORED}, {_LONG_SQL}, folds AS (SELECT model, period, avg({_HIT}) AS accuracy, avg({_LOSS}) AS log_loss,
      avg(winner) AS baseline_accuracy FROM kept GROUP BY ALL)
    SELECT model, count(*) AS n_folds, {r('avg(accuracy)')} AS avg_accuracy, {r('avg(log_loss)')} AS avg_log_loss,
      {r('avg(baseline_accuracy)')} AS avg_baseline_accuracy FROM folds GROUP BY model""",
)
def fold_summary(spark, sf):
    folds = evaluation.metrics(_long(spark, sf), ["model", "period"])
    return rounded(evaluation.fold_summary(folds, ["accuracy", "log_loss", "baseline_accuracy"], ["model"]))


@register(
    "segment_accuracy",
    f"""{WITH_SCORED}, e AS (SELECT *, ((CASE WHEN a_seed <= b_seed THEN 1.0 ELSE 0.0 END > 0.5)::INTEGER = winner)::INTEGER AS hit FROM scored)
    SELECT 'round_group' AS segment, round_group AS value, count(*) AS n, {r('avg(hit)')} AS accuracy FROM e GROUP BY round_group
    UNION ALL SELECT 'seed_diff_bucket', seed_diff_bucket, count(*), {r('avg(hit)')} FROM e GROUP BY seed_diff_bucket""",
)
def segment_accuracy(spark, sf):
    """The lower seed is picked; accuracy by round group and by seed gap."""
    df = views.scored(spark, sf).withColumn(
        "rule", F.when(F.col("a_seed") <= F.col("b_seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return rounded(evaluation.segment_accuracy(df, "rule"))


@register(
    "model_corr",
    f"""{WITH_SCORED}, t AS (SELECT p0, p1, CASE WHEN round_number >= 3 THEN p2 END AS p2, p3 FROM scored) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS model_i, '{b}' AS model_j, {r(f'corr({a}, {b})')} AS r, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM t"
        for i, a in enumerate(PREDS)
        for b in PREDS[i:]
    ),
)
def model_corr(spark, sf):
    df = views.tolerant_preds(views.scored(spark, sf))
    return rounded(correlation.model_correlation(df, PREDS))


@register(
    "hit_report",
    f"""{WITH_SCORED}, e AS (SELECT round_number, (prob > 0.5)::INTEGER = winner AS hit,
      coalesce((winner = 1 AND a_seed > b_seed) OR (winner = 0 AND b_seed > a_seed), false) AS upset FROM ensemble)
    SELECT round_number, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, {r('avg(hit::INTEGER)')} AS hit_rate,
      count(*) FILTER (WHERE upset) AS upsets, count(*) FILTER (WHERE upset AND hit) AS upsets_called,
      {r('(count(*) FILTER (WHERE upset AND hit))::DOUBLE / nullif(count(*) FILTER (WHERE upset), 0)')} AS upset_recall
    FROM e GROUP BY ROLLUP (round_number)""",
)
def hit_report(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    return rounded(evaluation.hit_report(df, "prob", "round_number", "a_seed", "b_seed"))


@register(
    "brier_calibration",
    f"""{WITH_SCORED} SELECT cast(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r('avg(prob)')} AS mean_p,
      {r('avg(winner)')} AS observed, {r('avg((prob - winner) * (prob - winner))')} AS brier FROM ensemble GROUP BY ALL""",
)
def brier_calibration(spark, sf):
    return rounded(evaluation.calibration_curve(views.with_ensemble(views.scored(spark, sf)), "prob"))


@register(
    "clipped_logloss",
    f"""{WITH_SCORED}, e AS (SELECT period, winner, least(greatest(prob * 1.5 - 0.25, 0.01), 0.99) AS p FROM ensemble)
    SELECT period, {r(f'avg({_LOSS})')} AS log_loss FROM e GROUP BY period""",
)
def clipped_logloss(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    stretched = F.col("prob") * 1.5 - 0.25
    return rounded(
        df.groupBy("period").agg(evaluation.clipped_log_loss(stretched, F.col("winner")).alias("log_loss"))
    )


@register(
    "logo_rate",
    f"""{WITH_SCORED}, own AS (SELECT period, seed_diff_bucket, sum(winner) AS s, count(*) AS n FROM scored GROUP BY ALL)
    SELECT period, seed_diff_bucket, (sum(n) OVER w - n)::BIGINT AS n_other,
      {r('((sum(s) OVER w - s)::DOUBLE / nullif(sum(n) OVER w - n, 0))')} AS rate
    FROM own WINDOW w AS (PARTITION BY seed_diff_bucket)""",
)
def logo_rate(spark, sf):
    return rounded(evaluation.leave_group_out_rate(views.scored(spark, sf), "period", "seed_diff_bucket"))
