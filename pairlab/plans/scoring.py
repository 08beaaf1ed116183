"""Queries on ensemble rows, calibration and conformal sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import probability as pr
from pairlab.operators import conformal, evaluation
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_SCORED, r
from pairlab.plans.registry import register, rounded
from pairlab.session import cut_lineage

_MEAN = "((p0 + p1 + p2 + p3) / 4.0::DOUBLE)"
_STD = f"sqrt((pow(p0 - {_MEAN}, 2) + pow(p1 - {_MEAN}, 2) + pow(p2 - {_MEAN}, 2) + pow(p3 - {_MEAN}, 2)) / 4.0::DOUBLE)"
_STATS_SQL = (
    f"{r(_MEAN, 9)} AS mean_pred, {r(_STD, 9)} AS std_pred, "
    f"{r('greatest(p0, p1, p2, p3) - least(p0, p1, p2, p3)', 9)} AS spread, "
    f"{r('greatest(abs(p0 - 0.5), abs(p1 - 0.5), abs(p2 - 0.5), abs(p3 - 0.5))', 9)} AS max_conf"
)
# The context columns of the meta-learner, in its order.
CONTEXT = ("seed_diff", "seed_sum", "seed_pct_diff", "log_seed_ratio", "round_number", "round_group", "seed_diff_bucket")


@register("ensemble_row_stats", f"{WITH_SCORED} SELECT game_id, {_STATS_SQL} FROM scored")
def ensemble_row_stats(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    stats = pr.row_stats(F.col("preds"))
    return rounded(df.select("game_id", *[c.alias(n) for n, c in stats.items()]), 9)


def meta_columns(preds: list[str]):
    """Predictions, their four row statistics, the context and two interactions."""
    stats = pr.row_stats(F.array(*preds))
    context = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"ctx_{c}") for c in CONTEXT]
    late = F.coalesce(F.col("round_number").cast("double"), F.lit(0.0))
    return [
        *[F.col(p) for p in preds],
        *[c.alias(n) for n, c in stats.items()],
        *context,
        (late * F.coalesce(F.col("seed_diff_bucket").cast("double"), F.lit(0.0))).alias("round_x_bucket"),
        (late * stats["std_pred"]).alias("round_x_std"),
    ]


@register(
    "meta_features",
    f"{WITH_SCORED} SELECT game_id, p0, p1, p2, p3, {_STATS_SQL}, "
    + ", ".join(f"{r(f'coalesce({c}, 0)::DOUBLE', 9)} AS ctx_{c}" for c in CONTEXT)
    + f", (round_number * seed_diff_bucket)::DOUBLE AS round_x_bucket, {r(f'round_number * {_STD}', 9)} AS round_x_std FROM scored",
)
def meta_features(spark, sf):
    df = views.scored(spark, sf)
    return rounded(df.select("game_id", *meta_columns(["p0", "p1", "p2", "p3"])), 9)


@register(
    "simple_average",
    f"""{WITH_SCORED} SELECT game_id, {r('CASE WHEN round_number >= 3 THEN (p0 + p1 + p2 + p3) / 4.0::DOUBLE ELSE (p0 + p1 + p3) / 3.0::DOUBLE END', 9)}
    AS avg_p FROM scored""",
)
def simple_average(spark, sf):
    """One model has no prediction before the third round."""
    df = views.tolerant_preds(views.scored(spark, sf))
    return rounded(df.select("game_id", pr.simple_average(F.array("p0", "p1", "p2", "p3")).alias("avg_p")), 9)


@register(
    "model_agreement",
    f"""{WITH_SCORED} SELECT game_id, cast(((p0 > 0.5) = (prob > 0.5))::INTEGER + ((p1 > 0.5) = (prob > 0.5))::INTEGER
      + ((p2 > 0.5) = (prob > 0.5))::INTEGER + ((p3 > 0.5) = (prob > 0.5))::INTEGER AS INTEGER) AS agree FROM ensemble""",
)
def model_agreement(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    return df.select("game_id", pr.agreement(F.col("preds"), F.col("prob")).alias("agree"))


@register(
    "prob_clip",
    f"""{WITH_SCORED} SELECT game_id, {r('least(greatest(p2 * 1.5 - 0.25, 0.01), 0.99)', 9)} AS clipped FROM scored""",
)
def prob_clip(spark, sf):
    stretched = F.col("p2") * 1.5 - 0.25
    return rounded(
        views.scored(spark, sf).select("game_id", pr.clip_probability(stretched).alias("clipped")), 9
    )


_RATES_SQL = """rates AS (SELECT seed_diff, avg(1 - winner) AS rate, count(*) AS n FROM scored
  WHERE seed_diff IS NOT NULL GROUP BY seed_diff)"""
_VOTES = "((p0 < 0.5)::INTEGER + (p1 < 0.5)::INTEGER + (p2 < 0.5)::INTEGER + (p3 < 0.5)::INTEGER)"
_PULL = f"""(0.35::DOUBLE * (1 - pow(abs(prob - 0.5) * 2, 1.2)) + CASE WHEN {_VOTES} >= 2 THEN 0.15::DOUBLE WHEN {_VOTES} = 1 THEN 0.08::DOUBLE ELSE 0 END)"""
_BLEND_SQL = f"""{_RATES_SQL}, blended AS (SELECT e.*, round(prob * (1 - {_PULL}) + (1 - coalesce(rate, 0.30::DOUBLE)) * {_PULL}, 9) AS final_p
  FROM ensemble e LEFT JOIN rates ON rates.seed_diff = e.seed_diff AND e.seed_diff % 4 <> 0)"""


def _rates(spark, sf):
    return evaluation.upset_rate_table(views.scored(spark, sf))


def blended(spark, sf):
    """Ensemble probability pulled to the base rate; every fourth difference has none."""
    df = views.with_ensemble(views.scored(spark, sf))
    rates = cut_lineage(_rates(spark, sf), "rates").filter(F.col("seed_diff") % 4 != 0).select("seed_diff", "rate")
    final = pr.prior_blend(F.col("prob"), F.col("rate"), F.col("preds"))
    # Stored, the few rates are seen to be few and are broadcast: the pairs stay put.
    return df.join(rates, "seed_diff", "left").withColumn("final_p", F.round(final, 9)).drop("rate")


@register(
    "upset_rate_table",
    f"{WITH_SCORED}, {_RATES_SQL} SELECT seed_diff, {r('rate')} AS rate, n FROM rates",
)
def upset_rate_table(spark, sf):
    return rounded(_rates(spark, sf))


@register(
    "prior_blend",
    f"{WITH_SCORED}, {_BLEND_SQL} SELECT game_id, {r('prob', 9)} AS prob, {r('final_p', 9)} AS final_p FROM blended",
)
def prior_blend(spark, sf):
    return rounded(blended(spark, sf).select("game_id", "prob", "final_p"), 9)


_FIRST = "final_p > 0.5"


@register(
    "decision_columns",
    f"""{WITH_SCORED}, {_BLEND_SQL} SELECT game_id, CASE WHEN {_FIRST} THEN a_name ELSE b_name END AS predicted_winner,
      CASE WHEN {_FIRST} THEN a_seed ELSE b_seed END AS predicted_seed,
      {r(f'CASE WHEN {_FIRST} THEN final_p ELSE 1 - final_p END', 9)} AS predicted_prob,
      {r('greatest(final_p, 1 - final_p)', 9)} AS confidence,
      coalesce((final_p > 0.5 AND a_seed > b_seed) OR (final_p <= 0.5 AND b_seed > a_seed), false) AS is_upset_pick FROM blended""",
)
def decision_columns(spark, sf):
    picked = pr.decision_columns(*[F.col(c) for c in ("final_p", "a_name", "b_name", "a_seed", "b_seed")])
    return rounded(blended(spark, sf).select("game_id", *picked), 9)


def _thresholds_sql(source: str = "ensemble") -> str:
    """Thresholds of all groups but the last, which is then unseen."""
    return f"""nc AS (SELECT round_group, CASE WHEN winner = 1 THEN 1 - prob ELSE prob END AS score FROM {source}),
levels AS (SELECT unnest([0.8, 0.85, 0.9, 0.95])::DOUBLE AS level),
cuts AS (SELECT round_group, unnest([0.8, 0.85, 0.9, 0.95])::DOUBLE AS level,
  unnest(quantile_cont(score, [0.8, 0.85, 0.9, 0.95])) AS threshold, count(*) AS n, median(score) AS median_score
  FROM nc GROUP BY round_group),
seen AS (SELECT * FROM cuts WHERE round_group < 3),
sets AS (SELECT e.*, level, coalesce(c.threshold, (SELECT avg(threshold) FROM seen s WHERE s.level = l.level)) AS cut
  FROM {source} e JOIN levels l ON true LEFT JOIN seen c USING (round_group, level)),
sized AS (SELECT *, (1 - prob <= cut) AS has_a, (prob <= cut) AS has_b FROM sets),
final_sets AS (SELECT *, CASE WHEN has_a AND has_b THEN '1,0' WHEN has_a THEN '1' WHEN has_b THEN '0'
  WHEN prob > 0.5 THEN '1' ELSE '0' END AS prediction_set FROM sized),
counted AS (SELECT *, CASE WHEN prediction_set = '1,0' THEN 2 ELSE 1 END AS set_size FROM final_sets)"""


_CONFORMAL_SQL = f"{WITH_SCORED}, {_thresholds_sql()}"


def _thresholds(spark, sf):
    return conformal.calibrate(views.with_ensemble(views.scored(spark, sf)), "prob")


def _seen(spark, sf):
    return _thresholds(spark, sf).filter(F.col("round_group") < 3)


@register(
    "conformal_thresholds",
    f"{_CONFORMAL_SQL} SELECT round_group, level, {r('threshold')} AS threshold, n, {r('median_score')} AS median_score FROM cuts",
)
def conformal_thresholds(spark, sf):
    return rounded(_thresholds(spark, sf))


@register(
    "conformal_thresholds_finite",
    f"""{_CONFORMAL_SQL}, in_order AS (SELECT round_group, score, row_number() OVER (PARTITION BY round_group ORDER BY score) AS rn,
      count(*) OVER (PARTITION BY round_group) AS n FROM nc)
    SELECT c.round_group, c.level, {r('coalesce(score, 1.0)')} AS threshold, c.n, {r('median_score')} AS median_score FROM cuts c
    LEFT JOIN in_order p ON p.round_group = c.round_group AND rn = ceil((c.n + 1) * c.level - 1e-9)""",
)
def conformal_thresholds_finite(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    return rounded(conformal.calibrate(df, "prob", correction="finite_sample"))


@register(
    "conformal_sets",
    f"{_CONFORMAL_SQL} SELECT game_id, prediction_set, cast(set_size AS INTEGER) AS set_size FROM counted WHERE level = 0.9",
)
def conformal_sets(spark, sf):
    """Sets at 90 %; the last group was not calibrated and takes the mean threshold."""
    df = views.with_ensemble(views.scored(spark, sf))
    sets = conformal.predict_sets(df, _seen(spark, sf), "prob", 0.90)
    return sets.select("game_id", F.array_join("prediction_set", ",").alias("prediction_set"), "set_size")


@register(
    "conformal_coverage",
    f"""{_CONFORMAL_SQL} SELECT level, count(*) AS n, {r("avg(CASE WHEN contains(prediction_set, winner::VARCHAR) THEN 1 ELSE 0 END)")} AS coverage,
      {r('avg((set_size = 1)::INTEGER)')} AS single_share, {r('avg((set_size = 2)::INTEGER)')} AS both_share FROM counted GROUP BY level""",
)
def conformal_coverage(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    return rounded(conformal.coverage(conformal.predict_all_levels(df, _seen(spark, sf), "prob")))


_TIERS_SQL = """tiers AS (SELECT h.game_id, CASE WHEN h.set_size = 1 THEN 'HIGH' WHEN l.set_size = 2 THEN 'LOW' ELSE 'MED' END AS tier
  FROM counted h JOIN counted l USING (game_id) WHERE h.level = 0.9 AND l.level = 0.8)"""


def _tiers(spark, sf):
    df = views.with_ensemble(views.scored(spark, sf))
    cuts = _seen(spark, sf)
    high = conformal.predict_sets(df, cuts, "prob", 0.90).withColumnRenamed("set_size", "size_high")
    both = conformal.predict_sets(high.drop("prediction_set"), cuts, "prob", 0.80)
    return both.withColumn("tier", pr.confidence_tier(F.col("size_high"), F.col("set_size")))


@register("confidence_tier", f"{_CONFORMAL_SQL}, {_TIERS_SQL} SELECT game_id, tier FROM tiers")
def confidence_tier(spark, sf):
    return _tiers(spark, sf).select("game_id", "tier")


@register(
    "tier_distribution",
    f"{_CONFORMAL_SQL}, {_TIERS_SQL} SELECT tier, count(*) AS n FROM tiers GROUP BY tier",
)
def tier_distribution(spark, sf):
    return _tiers(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@register(
    "prediction_table",
    f"""{_CONFORMAL_SQL} SELECT game_id, round_number, bracket_region AS region, a_name, a_seed, b_name, b_seed, {r('prob', 9)} AS prob_a,
      CASE WHEN prob > 0.5 THEN a_name ELSE b_name END AS predicted_winner, CASE WHEN prob > 0.5 THEN a_seed ELSE b_seed END AS predicted_seed,
      {r('greatest(prob, 1 - prob)', 9)} AS confidence, cast(set_size AS INTEGER) AS set_size_90,
      CASE WHEN winner = 1 THEN a_name ELSE b_name END AS actual_winner FROM counted WHERE level = 0.9 AND period = 2000""",
)
def prediction_table(spark, sf):
    """The predictions of one year as they are handed on: pick, confidence, set size, outcome."""
    df = views.with_ensemble(views.scored(spark, sf)).filter(F.col("period") == 2000)
    sets = conformal.predict_sets(df, _seen(spark, sf), "prob", 0.90)
    winner, seed, _, confidence, _ = pr.decision_columns(
        *[F.col(c) for c in ("prob", "a_name", "b_name", "a_seed", "b_seed")]
    )
    actual = F.when(F.col("winner") == 1, F.col("a_name")).otherwise(F.col("b_name"))
    return rounded(
        sets.select(
            "game_id", "round_number", F.col("bracket_region").alias("region"), "a_name", "a_seed", "b_name", "b_seed",
            F.col("prob").alias("prob_a"), winner, seed, confidence, F.col("set_size").alias("set_size_90"),
            actual.alias("actual_winner"),
        ),
        9,
    )
