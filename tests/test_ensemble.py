import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import ensemble


def make(spark, n=240, seed=6):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n) * 3 + 1
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.2 * x1 - 0.5 * x2)))).astype(int)
    data = [
        (i, 2000 + i % 3, int(y[i]), float(x1[i]), float(x2[i]) if i % 20 else None, int(i % 15) - 7, 1 + i % 6)
        for i in range(n)
    ]
    schema = "id int, period int, winner int, x1 double, x2 double, seed_diff int, round_number int"
    return spark.createDataFrame(data, schema).repartition(3), data


def ridge(x, y, c):
    """Newton's method on C · Σ loss + ½ |w|², population-scaled, free intercept."""
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    w, penalty = np.zeros(z.shape[1]), np.r_[0.0, np.ones(z.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = c * z.T @ (p - y) + penalty * w
        hessian = c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w -= np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-z @ w))


def test_logistic_specialist_matches_its_objective(spark):
    df, data = make(spark)
    spec = ensemble.Specialist("late", "logistic", ("x1", "x2", "absent"), params={"c": 0.5})
    model = ensemble.fit_specialist(df, spec)
    got = ensemble.score_ensemble(df, {"late": model}, [spec], ["id"]).orderBy("id").collect()
    x = np.array([[r[3], 0.0 if r[4] is None else r[4]] for r in data])
    want = ridge(x, np.array([r[2] for r in data]), 0.5)
    assert [r["p_late"] for r in got] == pytest.approx(want, abs=1e-4)


def test_support_and_missing_models(spark):
    df, _ = make(spark)
    close = ensemble.Specialist("close", "logistic", ("x1",), "close", 20, {"c": 1.0})
    late = ensemble.Specialist("late", "logistic", ("x1",), "late", 10_000, {"c": 1.0})
    models = ensemble.fit_all(df, [close, late])
    assert set(models) == {"close"}
    scored = ensemble.score_ensemble(df, models, [close, late], ["id"])
    assert scored.filter("p_close is null").count() == 0
    assert scored.filter("p_late is not null").count() == 0


def test_out_of_fold_ignores_the_labels_of_its_fold(spark):
    df, _ = make(spark)
    spec = ensemble.Specialist("m", "logistic", ("x1", "x2"), params={"c": 1.0})
    flipped = df.withColumn(
        "winner", F.when(F.col("period") == 2001, 1 - F.col("winner")).otherwise(F.col("winner"))
    )
    one, two = (
        [r[0] for r in ensemble.out_of_fold(d, [spec], "period", ["id", "period"]).filter("period = 2001").orderBy("id").select("p_m").collect()]
        for d in (df, flipped)
    )
    assert one == pytest.approx(two, abs=1e-9)
    assert ensemble.out_of_fold(df, [spec], "period", ["id"]).count() == 240


def test_stored_models_score_the_same(spark, tmp_path):
    df, _ = make(spark)
    specs = [
        ensemble.Specialist("forest", "forest", ("x1", "x2"), params={**ensemble.FOREST, "trees": 5}),
        ensemble.Specialist("general", "boosted", ("x1", "x2"), params={**ensemble.GENERAL, "iterations": 3}),
    ]
    models = ensemble.fit_all(df, specs)
    ensemble.save_models(models, str(tmp_path))
    loaded = ensemble.load_models(str(tmp_path), ["forest", "general"])
    a = ensemble.score_ensemble(df, models, specs, ["id"]).orderBy("id").collect()
    b = ensemble.score_ensemble(df, loaded, specs, ["id"]).orderBy("id").collect()
    assert a == b
    top = ensemble.feature_importance(df, models["general"]).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


def test_importances_carry_the_names_of_fitted_columns(spark):
    rows = [(i, float((i * 7) % 11), int(i % 4 < 2), float(i % 4 < 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x1 double, winner int, x2 double")
    spec = ensemble.Specialist("m", "boosted", ("x1", "absent", "x2"), params={**ensemble.GENERAL, "iterations": 2, "rows": 1.0, "columns": "all"})
    got = {r["feature"]: r["importance"] for r in ensemble.feature_importance(df, ensemble.fit_specialist(df, spec)).collect()}
    assert set(got) == {"x1", "x2"} and got["x2"] == pytest.approx(1.0)


def test_kept_columns_stay_as_they_are(spark):
    df, data = make(spark)
    spec = ensemble.Specialist("m", "logistic", ("x1", "x2"), params={"c": 1.0})
    scored = ensemble.score_ensemble(df, {"m": ensemble.fit_specialist(df, spec)}, [spec], ["id", "x2"])
    assert {r["id"]: r["x2"] for r in scored.collect()} == {r[0]: r[4] for r in data}
    meta = ensemble.score_meta(df, ensemble.fit_meta(df, ["x1", "x2"]), ["x1", "x2"], ["id", "x2"])
    assert {r["id"]: r["x2"] for r in meta.collect()} == {r[0]: r[4] for r in data}


def test_meta_learner_and_averaged_folds(spark):
    df, data = make(spark)
    model = ensemble.fit_meta(df, ["x1", "x2"])
    scored = ensemble.score_meta(df, model, ["x1", "x2"], ["id", "winner"])
    hits = scored.filter("(prob > 0.5) = (winner = 1)").count()
    assert hits > 0.6 * len(data)
    spec = ensemble.Specialist("m", "logistic", ("x1",), params={"c": 1.0})
    folds = ensemble.averaged_folds(df, [spec], "period").orderBy("period").collect()
    assert [r["n"] for r in folds] == [80, 80, 80]
    assert all(r["accuracy"] == r["accuracy_m"] for r in folds)
