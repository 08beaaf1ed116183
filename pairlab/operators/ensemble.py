"""Specialist ensemble on Spark ML: fits, leave-one-group-out folds, stacking, storage.

Specialists differ in features, training rows and learner. Iteration counts are
parameters because boosting adds them up per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.pairmath import impute_zero
from pairlab.operators import evaluation
from pairlab.operators.boosting import BoostSpec
from pairlab.operators.features import available, regime_close, regime_late
from pairlab.operators.forest import ForestSpec


@dataclass(frozen=True)
class Specialist:
    """One base model: learner, features, the rows it is trained on and how many it needs."""

    name: str
    kind: str  # "boosted", "logistic" or "forest"
    features: tuple[str, ...]
    regime: str | None = None  # "close" or "late"
    min_rows: int = 1
    params: Mapping[str, float] = field(default_factory=dict)


# Depths, rates, samplings, leaf sizes, strengths and support limits.
GENERAL = {"max_depth": 4, "step": 0.05, "iterations": 300, "rows": 0.8, "columns": "0.8", "min_leaf": 1, "l1": 0.1, "l2": 1.0, "min_hessian": 1.0}
CLOSE = {"max_depth": 3, "step": 0.03, "iterations": 400, "rows": 0.8, "columns": "0.7", "min_leaf": 15, "l1": 0.2, "l2": 1.5, "min_hessian": 1e-3}
LEGACY_FIRST = {"max_depth": 4, "step": 0.05, "iterations": 300, "rows": 0.8, "columns": "0.8", "min_leaf": 1, "l2": 1.0, "min_hessian": 1.0}
LEGACY_SECOND = {"max_depth": 4, "step": 0.05, "iterations": 300, "rows": 0.8, "columns": "0.8", "min_leaf": 20, "l2": 0.0, "min_hessian": 1e-3}
LATE = {"c": 0.5}
FOREST = {"trees": 300, "max_depth": 6, "min_leaf": 10}
CURATED_LOGISTIC = {"c": 1.0}
CLOSE_ROWS, LATE_ROWS = 20, 15


def default_specialists(
    selected: Sequence[str], close: Sequence[str], late: Sequence[str], curated: Sequence[str]
) -> list[Specialist]:
    return [
        Specialist("general", "boosted", tuple(selected), params=GENERAL),
        Specialist("close", "boosted", tuple(close), "close", CLOSE_ROWS, CLOSE),
        Specialist("late", "logistic", tuple(late), "late", LATE_ROWS, LATE),
        Specialist("forest", "forest", tuple(curated), params=FOREST),
    ]


def with_iterations(specialists: Sequence[Specialist], iterations: int, trees: int) -> list[Specialist]:
    """The same specialists with small fits, for tests."""
    small = {"boosted": {"iterations": iterations}, "forest": {"trees": trees}, "logistic": {}}
    return [replace(s, params={**s.params, **small[s.kind]}) for s in specialists]


def boost_spec(spec: Specialist, df: DataFrame) -> BoostSpec:
    """The specialist for ``boosting.fit_boosted``; its regime becomes the column ``is_<regime>``."""
    p = spec.params
    return BoostSpec(
        spec.name, tuple(available(df, spec.features)), int(p["max_depth"]), p["step"], int(p["iterations"]), p["rows"], float(p["columns"]),
        p.get("l1", 0.0), p.get("l2", 1.0), int(p["min_leaf"]), p.get("min_hessian", 0.0), spec.min_rows,
        f"is_{spec.regime}" if spec.regime else None,
    )


def forest_spec(spec: Specialist, df: DataFrame) -> ForestSpec:
    """The specialist for ``forest.fit_forest``."""
    p = spec.params
    return ForestSpec(spec.name, tuple(available(df, spec.features)), int(p["trees"]), int(p["max_depth"]), int(p["min_leaf"]), spec.min_rows)


def with_regimes(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_close": regime_close(), "is_late": regime_late()})


def _regime(name: str | None) -> Column:
    return {None: F.lit(True), "close": regime_close(), "late": regime_late()}[name]


def _learner(spec: Specialist, n_rows: int, label: str, seed: int):
    vec, p = f"_x_{spec.name}", spec.params
    shared = {
        "labelCol": label,
        "predictionCol": f"_class_{spec.name}",
        "rawPredictionCol": f"_raw_{spec.name}",
        "probabilityCol": f"_prob_{spec.name}",
    }
    if spec.kind == "boosted":
        boosted = GBTClassifier(
            featuresCol=vec, labelCol=label, predictionCol=shared["predictionCol"],
            maxDepth=p["max_depth"], stepSize=p["step"], maxIter=p["iterations"],
            subsamplingRate=p["rows"], featureSubsetStrategy=p["columns"],
            minInstancesPerNode=p["min_leaf"], seed=seed,
        )
        return [
            boosted.setRawPredictionCol(shared["rawPredictionCol"]).setProbabilityCol(shared["probabilityCol"])
        ]
    if spec.kind == "forest":
        return [
            RandomForestClassifier(
                featuresCol=vec, numTrees=p["trees"], maxDepth=p["max_depth"],
                minInstancesPerNode=p["min_leaf"], seed=seed, **shared,
            )
        ]
    return [*_scaling(vec, len(spec.features), n_rows), logistic(f"{vec}_s", p["c"], n_rows, shared)]


def _scaling(vec: str, width: int, n_rows: int):
    """Centre and scale by the population deviation (the scaler's own is the sample's)."""
    factor = (n_rows / max(n_rows - 1, 1)) ** 0.5
    return [
        StandardScaler(inputCol=vec, outputCol=f"{vec}_c", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol=f"{vec}_c", outputCol=f"{vec}_s", scalingVec=Vectors.dense([factor] * width)
        ),
    ]


def logistic(vec: str, c: float, n_rows: int, shared: Mapping[str, str], iterations: int = 1000):
    """Ridge logistic regression; strength C on the sum of losses is 1 / (C n) on their mean."""
    return LogisticRegression(
        featuresCol=vec, regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=iterations, **shared,
    )


def impute_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: impute_zero(F.col(f"`{f}`")) for f in features})


def fit_specialist(
    df: DataFrame, spec: Specialist, label: str = "winner", seed: int = 42
) -> PipelineModel | None:
    """Fit on the specialist's own rows; None when they are fewer than it needs."""
    spec = replace(spec, features=tuple(available(df, spec.features)))
    rows = impute_features(df.filter(_regime(spec.regime)), spec.features)
    n_rows = rows.count()
    if n_rows < spec.min_rows or not spec.features:
        return None
    assembler = VectorAssembler(inputCols=list(spec.features), outputCol=f"_x_{spec.name}")
    return Pipeline(stages=[assembler, *_learner(spec, n_rows, label, seed)]).fit(rows)


def fit_all(
    df: DataFrame, specialists: Sequence[Specialist], label: str = "winner", threads: int = 4
) -> dict[str, PipelineModel]:
    """Every specialist that has enough rows; independent fits share the cluster."""
    with ThreadPoolExecutor(threads) as pool:
        fit = inheritable_thread_target(df.sparkSession)(lambda s: fit_specialist(df, s, label))
        models = list(pool.map(fit, specialists))
    return {s.name: m for s, m in zip(specialists, models) if m is not None}


def _set_aside(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Copies of the kept columns, which imputing does not touch."""
    return df.withColumns({f"_given_{c}": F.col(f"`{c}`") for c in keep})


def _as_given(keep: Sequence[str]) -> list[Column]:
    return [F.col(f"`_given_{c}`").alias(c) for c in keep]


def score_ensemble(
    df: DataFrame, models: Mapping[str, PipelineModel], specialists: Sequence[Specialist], keep: Sequence[str]
) -> DataFrame:
    """(keep…, p_<name>…): probability of the first side per specialist; NULL without a model."""
    features = sorted({f for s in specialists for f in available(df, s.features)})
    out = impute_features(_set_aside(df, keep), features)
    columns = []
    for spec in specialists:
        if spec.name in models:
            out = models[spec.name].transform(out)
            columns.append(vector_to_array(f"_prob_{spec.name}")[1].alias(f"p_{spec.name}"))
        else:
            columns.append(F.lit(None).cast("double").alias(f"p_{spec.name}"))
    return out.select(*_as_given(keep), *columns)


def out_of_fold(
    df: DataFrame,
    specialists: Sequence[Specialist],
    period: str,
    keep: Sequence[str],
    label: str = "winner",
    periods: Sequence[int] | None = None,
    threads: int = 4,
) -> DataFrame:
    """Predictions of every period by models fitted on all the others.

    The frame is filtered once per period, so it should be stored (Parquet by
    period, or a checkpoint). Only the list of periods passes through the driver.
    """
    if periods is None:
        periods = [r[0] for r in df.select(period).distinct().orderBy(period).collect()]

    def one(held_out: int) -> DataFrame:
        models = fit_all(df.filter(F.col(period) != held_out), specialists, label, threads=1)
        return score_ensemble(df.filter(F.col(period) == held_out), models, specialists, keep)

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(one), periods))
    return reduce(DataFrame.unionByName, parts)


def fit_meta(
    meta: DataFrame, features: Sequence[str], label: str = "winner", c: float = 0.5
) -> PipelineModel:
    """Scaled logistic regression on the meta features."""
    spec = Specialist("meta", "logistic", tuple(features), params={"c": c})
    return fit_specialist(meta, spec, label)


def score_meta(meta: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    scored = model.transform(impute_features(_set_aside(meta, keep), features))
    return scored.select(*_as_given(keep), vector_to_array("_prob_meta")[1].alias("prob"))


def save_models(models: Mapping[str, PipelineModel], root: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{root}/{name}")


def load_models(root: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{root}/{name}") for name in names}


def feature_importance(df: DataFrame, model: PipelineModel, n: int = 15) -> DataFrame:
    """(feature, importance) of a tree model, best first. One row per column it was fitted on."""
    features = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = df.sparkSession.createDataFrame(
        [(f, i, v) for i, (f, v) in enumerate(zip(features, values))], "feature string, pos int, importance double"
    )
    return rows.orderBy(F.desc("importance"), "pos").limit(n).select("feature", "importance")


def averaged_folds(
    df: DataFrame,
    specialists: Sequence[Specialist],
    period: str,
    label: str = "winner",
    periods: Sequence[int] | None = None,
) -> DataFrame:
    """Per held-out period: metrics of the plain average of all models, and each model's accuracy."""
    oof = out_of_fold(df, specialists, period, [period, label], label, periods)
    return average_by_period(oof, [f"p_{s.name}" for s in specialists], period, label)


def average_by_period(oof: DataFrame, preds: Sequence[str], period: str, label: str = "winner") -> DataFrame:
    """Metrics of the plain average of the predictions that are there, and each one's accuracy, by period."""
    present = F.filter(F.array(*preds), lambda p: p.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, p: a + p)
    averaged = oof.withColumn("p_avg", F.try_divide(total, F.size(present)))
    y, p = F.col(label), F.col("p_avg")
    return averaged.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        evaluation.accuracy(p, y).alias("accuracy"),
        evaluation.log_loss(p, y).alias("log_loss"),
        F.avg(y).alias("baseline_accuracy"),
        *[evaluation.accuracy(F.col(c), y).alias(f"accuracy_{c[2:]}") for c in preds],
    )
