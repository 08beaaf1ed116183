"""Queries that fit models on the pair features, all at full size.

The boosted specialists grow together (``operators.boosting``), the logistic ones by
Newton steps (``operators.newton``), the forest's trees by levels on counted cells
(``operators.forest``). Each session fits them once for a data folder; the queries read the stored results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import boosting, conformal, ensemble, evaluation, newton, state
from pairlab.operators import forest as forests
from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_SCORED, r
from pairlab.plans.registry import register, rounded
from pairlab.plans.scoring import meta_columns
from pairlab.session import cut_lineage, scratch_path

SELECTED = ("seed_diff", "margin_gap", "diff_qty_season", "diff_price_last3", "diff_ret_away", "pctdiff_tax_season")
CLOSE = ("seed_pct_diff", "log_seed_ratio", "diff_qty_last3", "diff_awaygap_price", "diff_price_season")
LATE = ("seed_pct_diff", "log_seed_ratio", "diff_price_season", "diff_disc_away", "diff_never_collected")
CURATED = ("seed_diff", "seed_sum", "volume_index", "diff_price_season")
SPECIALISTS = ensemble.default_specialists(SELECTED, CLOSE, LATE, CURATED)
BY_NAME = {s.name: s for s in SPECIALISTS}
LEGACY = (
    ensemble.Specialist("first", "boosted", SELECTED, params=ensemble.LEGACY_FIRST),
    ensemble.Specialist("second", "boosted", SELECTED, params=ensemble.LEGACY_SECOND),
)
KEEP = ("game_id", "period", "winner", "seed_diff", "seed_sum", "seed_pct_diff", "log_seed_ratio",
        "round_number", "round_group", "seed_diff_bucket")
PREDS = [f"p_{s.name}" for s in SPECIALISTS]
META_STRENGTH = 0.5


@views.view
def training_frame(spark, sf):
    """The columns the models use, imputed and stored once: every fit reads them again."""
    df = views.pair_features(spark, sf)
    wanted = sorted({f for s in SPECIALISTS for f in s.features if f in df.columns} | set(KEEP))
    features = [c for c in wanted if c not in KEEP]
    df = ensemble.with_regimes(ensemble.impute_features(df.select(*wanted), features))
    return cut_lineage(df, "training", by=("period",))


@views.view
def periods(spark, sf):
    return [x[0] for x in training_frame(spark, sf).select("period").distinct().orderBy("period").collect()]


def _boosted(spark, sf, specialists):
    """Models of all periods and of all but one, the stored blocks with their margins, and the kept columns."""
    df = training_frame(spark, sf)
    keep = [c for c in df.columns if not c.startswith("is_")]
    models, blocks = boosting.fit_boosted(df, [ensemble.boost_spec(s, df) for s in specialists], keep=keep, periods=periods(spark, sf))
    return models, blocks, keep


@views.view
def boosted(spark, sf):
    return _boosted(spark, sf, [s for s in SPECIALISTS if s.kind == "boosted"])


@views.view
def boosted_legacy(spark, sf):
    return _boosted(spark, sf, LEGACY)


def _margins(spark, sf, fit, held_out):
    models, blocks, keep = fit
    return boosting.margins_of(blocks, models, training_frame(spark, sf), keep, held_out)


@views.view
def late_models(spark, sf):
    df, spec = training_frame(spark, sf), BY_NAME["late"]
    present = [f for f in spec.features if f in df.columns]
    return newton.fit_logistic(df, present, periods=periods(spark, sf), c=spec.params["c"], where=F.col("is_late"), min_rows=spec.min_rows)


@views.view
def forest(spark, sf):
    df = training_frame(spark, sf)
    return forests.fit_forest(df, ensemble.forest_spec(BY_NAME["forest"], df))


@views.view
def forest_folds(spark, sf):
    df = training_frame(spark, sf)
    return forests.fit_forest(df, ensemble.forest_spec(BY_NAME["forest"], df), held=periods(spark, sf))


def _whole(models):
    return next(m for m in models if m.held_out is None)


@views.view
def in_sample(spark, sf):
    """(kept columns, features, p_…): every specialist fitted on all periods."""
    df = _margins(spark, sf, boosted(spark, sf), False).withColumn("p_late", _whole(late_models(spark, sf)).probability())
    return cut_lineage(forests.score_forest(df, forest(spark, sf), df.columns), "in-sample")


@views.view
def out_of_fold(spark, sf):
    """(kept columns, p_…): every specialist without the row's own period."""
    df = _margins(spark, sf, boosted(spark, sf), True).withColumn("p_late", newton.held_out_probability(late_models(spark, sf)))
    scored = forests.score_forest(df, forest_folds(spark, sf), df.columns, "period")
    return cut_lineage(scored.select(*KEEP, *PREDS), "out-of-fold", by=("period",))


def _by_period(df, name):
    return rounded(evaluation.metrics(df, ["period"], name))


@register("fit_general")
def fit_general(spark, sf):
    return _by_period(_margins(spark, sf, boosted(spark, sf), False), "p_general")


@register("fit_close")
def fit_close(spark, sf):
    return _by_period(_margins(spark, sf, boosted(spark, sf), False), "p_close")


@register("fit_late")
def fit_late(spark, sf):
    df = training_frame(spark, sf).withColumn("p_late", _whole(late_models(spark, sf)).probability())
    return _by_period(df, "p_late")


@register("fit_forest")
def fit_forest(spark, sf):
    return _by_period(forests.score_forest(training_frame(spark, sf), forest(spark, sf), ["period", "winner"]), "p_forest")


@register("score_ensemble")
def score_ensemble(spark, sf):
    """Three of four specialists; the missing one's column is NULL."""
    df = _margins(spark, sf, boosted(spark, sf), False).withColumn("p_late", _whole(late_models(spark, sf)).probability())
    return rounded(df.withColumn("p_forest", F.lit(None).cast("double")).select("game_id", *PREDS))


@register("logo_oof")
def logo_oof(spark, sf):
    """Out-of-fold predictions of all specialists for every year."""
    return rounded(out_of_fold(spark, sf).select("game_id", "period", "winner", *PREDS))


@register(
    "logo_support",
    f"""{WITH_SCORED}, years AS (SELECT period FROM scored GROUP BY period),
    seen AS (SELECT y.period, count(*) FILTER (WHERE abs(seed_diff) <= 7) AS close, count(*) FILTER (WHERE round_number >= 3) AS late, count(*) AS n
      FROM years AS y LEFT JOIN scored AS s ON s.period <> y.period GROUP BY y.period)
    SELECT s.period, count(*) AS n, CASE WHEN any_value(seen.n) >= 1 THEN count(*) ELSE 0 END AS n_general,
      CASE WHEN any_value(seen.close) >= 20 THEN count(*) ELSE 0 END AS n_close, CASE WHEN any_value(seen.late) >= 15 THEN count(*) ELSE 0 END AS n_late,
      CASE WHEN any_value(seen.n) >= 1 THEN count(*) ELSE 0 END AS n_forest
    FROM scored AS s JOIN seen ON seen.period = s.period GROUP BY s.period""",
)
def logo_support(spark, sf):
    """Out-of-fold predictions by year and specialist; one without enough rows of the other years has none."""
    counts = [F.count(f"p_{n}").alias(f"n_{n}") for n in ("general", "close", "late", "forest")]
    return out_of_fold(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("n"), *counts)


@register(
    "logistic_optimality",
    f"""{WITH_SCORED}, f AS (SELECT unnest(['', 'diff_disc_away', 'diff_price_season', 'log_seed_ratio', 'seed_pct_diff']) AS feature)
    SELECT held_out, feature, 0.0::DOUBLE AS slope FROM (SELECT DISTINCT CAST(period AS BIGINT) AS held_out FROM scored UNION ALL SELECT NULL) AS y, f""",
)
def logistic_optimality(spark, sf):
    """The slopes of every fold's objective at its fitted weights, which are all 0."""
    spec = BY_NAME["late"]
    slopes = newton.optimality(training_frame(spark, sf), late_models(spark, sf), "winner", "period", spec.params["c"], F.col("is_late"))
    return slopes.withColumn("slope", F.abs(F.round("slope", 5)))


@register(
    "boosted_stump",
    f"""{WITH_SCORED}, years AS (SELECT DISTINCT period AS held_out FROM scored UNION ALL SELECT NULL),
    rows_ AS (SELECT held_out, winner AS y, coalesce(seed_diff, 0) AS seed_diff, coalesce(seed_sum, 0) AS seed_sum
      FROM years JOIN scored ON held_out IS NULL OR period <> held_out),
    rates AS (SELECT *, avg(y) OVER (PARTITION BY held_out) AS p FROM rows_),
    x AS (SELECT held_out, y, p, f.name AS feature, f.v FROM rates, unnest([{{'name': 'seed_diff', 'v': seed_diff}}, {{'name': 'seed_sum', 'v': seed_sum}}]) AS u(f)),
    cells AS (SELECT held_out, feature, v, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM x GROUP BY ALL),
    cuts AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER e AS ga, sum(h) OVER e AS ha, sum(n) OVER e AS na
      FROM cells WINDOW w AS (PARTITION BY held_out, feature ORDER BY v), e AS (PARTITION BY held_out, feature)),
    gains AS (SELECT *, round(0.5 * (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)), 8) AS gain FROM cuts WHERE nl >= 5 AND na - nl >= 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY gain DESC, feature, v) AS rn FROM gains)
    SELECT CAST(held_out AS BIGINT) AS held_out, feature, CAST(v AS DOUBLE) AS border, {r('gain')} AS gain,
      {r('-0.1 * gl / (hl + 1)')} AS left_value, {r('-0.1 * (ga - gl) / (ha - hl + 1)')} AS right_value FROM best WHERE rn = 1""",
)
def boosted_stump(spark, sf):
    """The first split of a depth-1 booster on two features, for all years and without each."""
    df = ensemble.impute_features(training_frame(spark, sf), ["seed_diff", "seed_sum"])
    spec = boosting.BoostSpec("stump", ("seed_diff", "seed_sum"), 1, 0.1, 1, l2=1.0, min_leaf=5)
    models, _ = boosting.fit_boosted(df, [spec], periods=periods(spark, sf))
    nodes = boosting.trees_table(spark, models).filter("node IS NOT NULL")
    value = lambda n: F.max(F.when(F.col("node") == n, F.col("value")))
    top = F.col("node") == 0
    out = nodes.groupBy("held_out").agg(
        F.max(F.when(top, F.col("feature"))).alias("feature"), F.max(F.when(top, F.col("border"))).alias("border"),
        F.max(F.when(top, F.col("gain"))).alias("gain"), value(1).alias("left_value"), value(2).alias("right_value"),
    )
    return rounded(out)


@views.view
def meta_frame(spark, sf):
    return cut_lineage(out_of_fold(spark, sf).select("game_id", "winner", "period", F.col("round_group"), *meta_columns(PREDS)), "meta")


def _meta_features(df):
    return [c for c in df.columns if c not in ("game_id", "winner", "period", "round_group")]


@views.view
def meta_models(spark, sf):
    """The meta-learner of all out-of-fold rows, and one without each period."""
    df = meta_frame(spark, sf)
    return newton.fit_logistic(df, _meta_features(df), periods=periods(spark, sf), c=META_STRENGTH)


@register("fit_meta")
def fit_meta(spark, sf):
    """Stacked probability per contest: meta-learner over out-of-fold predictions."""
    whole = _whole(meta_models(spark, sf))
    return rounded(meta_frame(spark, sf).select("game_id", "winner", whole.probability().alias("prob")))


@register("stacked_coverage")
def stacked_coverage(spark, sf):
    """Coverage of the stacked model's sets on the rows that they were calibrated on.

    ``in_sample`` calibrates on the meta-learner's own training rows, ``cross_fitted`` on
    rows of a period that it did not see.
    """
    models, df = meta_models(spark, sf), meta_frame(spark, sf)
    forms = {"in_sample": _whole(models).probability(), "cross_fitted": newton.held_out_probability(models)}
    out = None
    for form, prob in forms.items():
        scored = cut_lineage(df.select("game_id", "winner", "round_group", prob.alias("prob")), form)
        sets = conformal.predict_all_levels(scored, conformal.calibrate(scored, "prob"), "prob")
        part = conformal.coverage(sets, by=("round_group", "level")).select(F.lit(form).alias("form"), "round_group", "level", "n", "coverage")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register(
    "stacked_coverage_bound",
    f"""{WITH_SCORED}, sizes AS (SELECT round_group, count(*) AS n FROM scored GROUP BY round_group)
    SELECT form, round_group, level / 100.0::DOUBLE AS level, n, CAST(((n - 1) * level) // 100 + 1 AS BIGINT) AS least, true AS reached
    FROM sizes, (SELECT unnest(['in_sample', 'cross_fitted']) AS form) AS f, (SELECT unnest([80, 85, 90, 95]) AS level) AS l""",
)
def stacked_coverage_bound(spark, sf):
    """Whether the sets cover the floor((n - 1) · level) + 1 rows that an interpolated quantile must (equal scores may add some)."""
    least = F.floor(F.round((F.col("n") - 1) * F.col("level"), 6)) + 1
    rows = stacked_coverage(spark, sf).withColumn("least", least)
    return rows.select("form", "round_group", "level", "n", "least", (F.round(F.col("coverage") * F.col("n")) >= F.col("least")).alias("reached"))


@views.view
def published_state(spark, sf):
    """Everything that scoring needs, as one version: trees, logistic models, thresholds and the schema."""
    root = scratch_path(spark, "models")
    models, *_ = boosted(spark, sf)
    meta = _whole(meta_models(spark, sf))
    stacked = meta_frame(spark, sf).withColumn("prob", meta.probability())
    frames = {"trees": boosting.trees_table(spark, [*models, *forest(spark, sf)]), "thresholds": conformal.calibrate(stacked, "prob")}
    linear = {"late": _whole(late_models(spark, sf)), "meta": meta}
    values = {name: vars(m) | {"features": list(m.features)} for name, m in linear.items()}
    values["features"] = {s.name: [f for f in s.features if f in training_frame(spark, sf).columns] for s in SPECIALISTS}
    state.commit(spark, root, frames, values=values)
    return root


def score_from_state(df, stored):
    """(given columns, p_…, prob): all specialists and the meta-learner of a stored version on pair features."""
    specs = [ensemble.boost_spec(BY_NAME[n], df) for n in ("general", "close")]
    grown = ensemble.forest_spec(BY_NAME["forest"], df)
    trees = boosting.load_trees(stored.frames["trees"], [*specs, grown])
    shares = trees.pop(grown.name, boosting.Boosted(grown, None, None))
    late, meta = (newton.Logistic(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.values[n].items()}) for n in ("late", "meta"))
    scored = boosting.score_boosted(df, trees, df.columns).withColumn("p_late", late.probability())
    scored = forests.score_forest(scored, [shares], scored.columns)
    wide = scored.select(*df.columns, *meta_columns(PREDS))
    return wide.withColumn("prob", meta.probability()).select(*df.columns, *PREDS, "prob")


@register("persist_model")
def persist_model(spark, sf):
    """Accuracy per year of models that were stored and read back."""
    stored = state.load(spark, published_state(spark, sf))
    scored = score_from_state(training_frame(spark, sf), stored)
    long = evaluation.predictions_long(scored, PREDS, ["period", "winner"])
    return rounded(evaluation.metrics(long, ["model", "period"]))


@register(
    "predict_from_state",
    f"""{WITH_SCORED} SELECT period, count(*) AS n, count(*) AS same, count(*) AS decided FROM scored GROUP BY period""",
)
def predict_from_state(spark, sf):
    """By year: contests, those that the stored version scores as the fitted models do, and those with a prediction set."""
    stored = state.load(spark, published_state(spark, sf))
    scored = cut_lineage(score_from_state(training_frame(spark, sf), stored), "scored")
    fitted = in_sample(spark, sf).select("game_id", *[F.col(p).alias(f"fit_{p}") for p in PREDS])
    alike = F.lit(True)
    for p in PREDS:
        missing = F.col(p).isNull() & F.col(f"fit_{p}").isNull()
        alike = alike & F.coalesce(F.abs(F.col(p) - F.col(f"fit_{p}")) < 1e-9, missing)
    sets = conformal.predict_sets(scored.join(fitted, "game_id"), stored.frames["thresholds"], "prob", 0.90)
    return sets.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(alike).alias("same"), F.count_if(F.col("set_size") >= 1).alias("decided")
    )


@register("legacy_ensemble")
def legacy_ensemble(spark, sf):
    """Plain average of two boosted models and a curated logistic regression, by held-out year."""
    df = training_frame(spark, sf)
    curated = newton.fit_logistic(df, CURATED, periods=periods(spark, sf), c=ensemble.CURATED_LOGISTIC["c"])
    oof = _margins(spark, sf, boosted_legacy(spark, sf), True).withColumn("p_curated", newton.held_out_probability(curated))
    return rounded(ensemble.average_by_period(oof, ["p_first", "p_second", "p_curated"], "period"))


@register("feature_importance")
def feature_importance(spark, sf):
    """The 15 features of the general model with the greatest mean gain."""
    models, *_ = boosted(spark, sf)
    best = boosting.importances(_whole([m for m in models if m.spec.name == "general"]))[:15]
    return rounded(spark.createDataFrame(best, "feature string, importance double"))
