"""Model families: a name, and how to fit it on a prepared table.

Every family is fitted on ``_features`` (vector) and ``_label`` (double) and
predicts into ``prediction``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.boosting import Settings, counted_fits, fit_boosted
from tabloom.operators.detection import CLASSIFICATION
from tabloom.operators.forest import fit_forest, forest_cells, held_out
from tabloom.operators.huber import WIDEST, equal_rows, fit_huber, stored_linear
from tabloom.operators.kernel import FourierMap, scaled_gamma
from tabloom.operators.neighbours import Neighbours
from tabloom.operators.prep import FEATURES
from tabloom.operators.support import fit_support, stored_support
from tabloom.session import checkpoint_folder, run_jobs

LABEL = "_label"
ROW_ID = "_rid"
NORMAL_SOLVER_WIDTH = 4096
KERNEL_TOLERANCE = 1e-3
# a Newton step that promises less of the objective is not worth its pass
HUBER_TOLERANCE = 1e-5


@dataclass(frozen=True)
class Options:
    """Sizes of the families; the defaults are those of a full run, at every size of table.

    Forests grow to ``forest_depth``: 65,536 leaves a tree, which the driver
    holds as nodes whatever the rows.
    """

    trees: int = 200
    rounds: int = 200
    forest_depth: int = 16
    boosted_depth: int = 6
    boosted_leaves: int = 31
    fourier_features: int = 256
    kernel_iterations: int = 100
    neighbours: int = 5
    seed: int = 42
    parallelism: int = 4


@dataclass(frozen=True)
class Context:
    """What a family may know about the table it is fitted on."""

    rows: int
    classes: int
    width: int
    options: Options = field(default_factory=Options)


Fit = Callable[[DataFrame, Context, dict[str, Any]], Any]


@dataclass(frozen=True)
class Family:
    name: str
    fit: Fit
    leafy: bool | None = None  # boosted trees: best leaf first, or level by level
    # rows to fit on, held-out rows, context -> parameters -> ``y, prediction, n`` of the held-out rows, without a model; ``None`` if not possible
    counted: Callable[[DataFrame, DataFrame, Context], Callable[[dict[str, Any]], DataFrame] | None] | None = None

    def __call__(self, df: DataFrame, context: Context, params: dict[str, Any] | None = None) -> Any:
        return self.fit(df, context, params or {})


def _columns(**extra) -> dict[str, Any]:
    return {"featuresCol": FEATURES, "labelCol": LABEL} | extra


def _logistic(df, context, params):
    # a penalty of 1 on the summed loss is 1/n on the mean loss
    settings = {"maxIter": 2000, "regParam": 1.0 / max(1, context.rows), "standardization": False}
    return LogisticRegression(**_columns(**settings | params)).fit(df)


def _linear(df, context, params):
    solver = "normal" if context.width <= NORMAL_SOLVER_WIDTH else "l-bfgs"
    return LinearRegression(**_columns(**{"solver": solver, "regParam": 0.0} | params)).fit(df)


def _ridge(df, context, params):
    """Squared error plus the squared norm of the weights.

    MLlib divides the penalty by the deviation of the label, so it is given
    times that deviation.
    """
    spread = df.agg(F.stddev_pop(LABEL)).first()[0] or 1.0
    settings = {"regParam": spread / max(1, context.rows), "elasticNetParam": 0.0, "standardization": False}
    return LinearRegression(**_columns(**settings | params)).fit(df)


def group_memory(spark: SparkSession) -> int:
    """Megabytes that a task may hold of node sums: a quarter of its share of the memory.

    With too few, a level of deep trees takes many passes.
    """
    local = spark.sparkContext.master.startswith("local")
    memory = spark.conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", memory).groups()
    whole = int(number) * {"k": 1 / 1024, "m": 1, "": 1, "g": 1024, "t": 1024**2}[unit]
    tasks = spark.sparkContext.defaultParallelism if local else int(spark.conf.get("spark.executor.cores", "1"))
    return max(256, int(whole / max(1, tasks) / 4))


def _forest_estimator(classifier: bool, spark: SparkSession, context: Context, params: dict[str, Any]):
    # rows remember their node, so that tasks are not sent the forest at every level
    checkpoint_folder(spark)
    settings = {
        "cacheNodeIds": True,
        "maxMemoryInMB": group_memory(spark),
        "numTrees": context.options.trees,
        "maxDepth": context.options.forest_depth,
        "seed": context.options.seed,
        "featureSubsetStrategy": "sqrt" if classifier else "all",
    }
    return (RandomForestClassifier if classifier else RandomForestRegressor)(**_columns(**settings | params))


def _values(estimator) -> dict[str, Any]:
    return {param.name: value for param, value in estimator.extractParamMap().items()}


def _forest(classifier: bool) -> Fit:
    def fit(df, context, params):
        estimator = _forest_estimator(classifier, df.sparkSession, context, params)
        return fit_forest(df, LABEL, context.classes if classifier else 0, _values(estimator)) or estimator.fit(df)

    return fit


# parameters of a forest that change the cells it is grown from
CELL_PARAMETERS = {"maxBins", "bootstrap"}


def _counted_forest(classifier: bool):
    def make(train, held, context):
        def settings(params):
            return _values(_forest_estimator(classifier, train.sparkSession, context, params))

        classes = context.classes if classifier else 0
        cells = forest_cells(train, LABEL, classes, settings({}))
        found = held_out(cells, held, LABEL, classes) if cells else None
        return found and (lambda params: found(settings(params)))

    return make


def boosted_settings(leafy: bool, options: Options, params: dict[str, Any]) -> Settings:
    """Trees grown level by level, or best leaf first; ``params`` come under MLlib's names."""
    if leafy:
        own = Settings(options.rounds, 0.05, 0, options.boosted_leaves, penalty=0.0, least_weight=1e-3, least_rows=20, seed=options.seed)
    else:
        own = Settings(options.rounds, 0.05, options.boosted_depth, rows_share=0.9, columns_share=0.9, seed=options.seed)
    names = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows_share", "leaves": "leaves"}
    changed = {names[k]: v for k, v in params.items() if k in names}
    if "featureSubsetStrategy" in params:
        share = params["featureSubsetStrategy"]
        changed["columns_share"] = 1.0 if share == "all" else float(share)
    return replace(own, **changed)


def _boosted(classifier: bool, leafy: bool) -> Fit:
    def fit(df, context, params):
        settings = boosted_settings(leafy, context.options, params)
        return fit_boosted({0: df}, LABEL, context.classes if classifier else 0, settings)[0]

    return fit


def _counted_boosted(leafy: bool):
    def make(train, held, context):
        found = counted_fits(train, held, LABEL, context.classes)
        return found and (lambda params: found(boosted_settings(leafy, context.options, params)))

    return make


def _kernel_svc(df, context, params):
    """Fourier features, linear support vectors, and calibrated probabilities."""
    mapped = FourierMap(
        inputCol=FEATURES,
        outputCol="_fourier",
        size=context.options.fourier_features,
        gamma=scaled_gamma(df, FEATURES),
        seed=context.options.seed,
    )
    settings = {"regParam": 1.0 / max(1, context.rows), "maxIter": context.options.kernel_iterations, "tol": KERNEL_TOLERANCE} | params
    linear = LinearSVC(featuresCol="_fourier", labelCol=LABEL, **settings)
    several = None
    if context.classes > 2:
        several = OneVsRest(
            featuresCol="_fourier", labelCol=LABEL, classifier=linear, parallelism=context.options.parallelism
        )
    platt = LogisticRegression(
        featuresCol="rawPrediction",
        labelCol=LABEL,
        predictionCol="_platt_prediction",
        rawPredictionCol="_platt_raw",
        probabilityCol="probability",
        regParam=1.0 / max(1, context.rows),
        maxIter=min(25, context.options.kernel_iterations),
    )
    if context.options.fourier_features > WIDEST or set(params) - {"regParam", "maxIter", "tol"}:
        return Pipeline(stages=[mapped, several or linear, platt]).fit(df)
    own = {param.name: value for param, value in linear.extractParamMap().items()}
    basis = (mapped.getOrDefault(mapped.size), mapped.getOrDefault(mapped.gamma), context.options.seed)
    counted = equal_rows(df, F.col(LABEL))
    fits = [lambda c=c: fit_support(counted, float(c), *basis, own["regParam"], own["maxIter"], own["tol"]) for c in (range(context.classes) if several else [1])]
    found = [stored_support(df.sparkSession, *fit, own) for fit in run_jobs(fits, context.options.parallelism)]
    model = several._copyValues(OneVsRestModel(models=found)) if several else found[0]
    # equal rows have equal margins
    margins = model.transform(mapped.transform(counted.select(array_to_vector("x").alias(FEATURES), F.col("y").alias(LABEL), "n")))
    calibrated = platt.copy({platt.weightCol: "n"}).fit(margins)
    calibrated.clear(calibrated.weightCol)
    counted.unpersist()
    return PipelineModel([mapped, model, calibrated])


def _kernel_huber(df, context, params):
    """Fourier features and a robust (Huber) linear loss on the scaled target."""
    mapped = FourierMap(
        inputCol=FEATURES,
        outputCol="_fourier",
        size=context.options.fourier_features,
        gamma=scaled_gamma(df, FEATURES),
        seed=context.options.seed,
    )
    mean, spread = df.agg(F.avg(LABEL), F.stddev_pop(LABEL)).first()
    spread = spread or 1.0
    settings = {"regParam": 1.0 / max(1, context.rows), "maxIter": context.options.kernel_iterations, "tol": KERNEL_TOLERANCE} | params
    linear = LinearRegression(
        featuresCol="_fourier", labelCol="_scaled", predictionCol="_scaled_prediction", loss="huber", **settings
    )
    label = (F.col(LABEL) - F.lit(mean)) / F.lit(spread)
    unscale = SQLTransformer(
        statement=f"SELECT * EXCEPT (_scaled_prediction), "
        f"_scaled_prediction * double('{spread!r}') + double('{mean!r}') AS prediction FROM __THIS__"
    )
    if context.options.fourier_features > WIDEST or set(params) - {"regParam", "maxIter", "tol"}:
        return Pipeline(stages=[mapped, linear, unscale]).fit(df.withColumn("_scaled", label))
    own = {param.name: value for param, value in linear.extractParamMap().items()}
    found = fit_huber(
        df, label, mapped.getOrDefault(mapped.size), mapped.getOrDefault(mapped.gamma), context.options.seed,
        own["regParam"], own["maxIter"], min(HUBER_TOLERANCE, own["tol"]),
    )
    return PipelineModel([mapped, stored_linear(df.sparkSession, *found, own), unscale])


def _neighbours(df, context, params):
    settings = {"neighbours": context.options.neighbours, "classes": context.classes} | params
    return Neighbours(features=FEATURES, label=LABEL, row_id=ROW_ID, **settings).fit(df)


def _naive_bayes(df, context, params):
    return NaiveBayes(**_columns(modelType="gaussian", **params)).fit(df)


CLASSIFIERS = (
    Family("LogisticRegression", _logistic),
    Family("RandomForestClassifier", _forest(True), counted=_counted_forest(True)),
    Family("KernelSVC", _kernel_svc),
    Family("KNN", _neighbours),
    Family("NaiveBayes", _naive_bayes),
    Family("BoostedTreesClassifier", _boosted(True, False), False, _counted_boosted(False)),
    Family("LeafyBoostedTreesClassifier", _boosted(True, True), True, _counted_boosted(True)),
)
REGRESSORS = (
    Family("LinearRegression", _linear),
    Family("RandomForestRegressor", _forest(False), counted=_counted_forest(False)),
    Family("KernelHuber", _kernel_huber),
    Family("KNNRegressor", _neighbours),
    Family("BoostedTreesRegressor", _boosted(False, False), False),
    Family("LeafyBoostedTreesRegressor", _boosted(False, True), True),
)
# the small registry of the hold-out comparison
HOLDOUT = {
    CLASSIFICATION: (Family("LogisticRegression", _logistic), Family("KernelSVC", _kernel_svc)),
    "regression": (Family("Ridge", _ridge), Family("KernelHuber", _kernel_huber)),
}
# names under which users of other toolkits may ask for a family
ALIASES = {
    "SVC": "KernelSVC",
    "SVR": "KernelHuber",
    "XGBoostClassifier": "BoostedTreesClassifier",
    "XGBoostRegressor": "BoostedTreesRegressor",
    "LightGBMClassifier": "LeafyBoostedTreesClassifier",
    "LightGBMRegressor": "LeafyBoostedTreesRegressor",
}


def registry(problem_type: str, names: list[str] | None = None) -> dict[str, Family]:
    """All families of a problem type, or those named, in registry order."""
    families = {f.name: f for f in (CLASSIFIERS if problem_type == CLASSIFICATION else REGRESSORS)}
    if names is None:
        return families
    wanted = [ALIASES.get(n, n) for n in names]
    unknown = [n for n in wanted if n not in families]
    if unknown:
        raise ValueError(f"Unknown model families {unknown} for {problem_type}.")
    return {n: families[n] for n in families if n in wanted}


def parameters_json(model: Any) -> str:
    """Parameters of a fitted model as JSON with sorted keys."""
    if model is None:
        return "{}"
    if isinstance(model, PipelineModel):
        merged = {f"{i}_{type(s).__name__}": json.loads(parameters_json(s)) for i, s in enumerate(model.stages)}
        return json.dumps(merged, sort_keys=True)
    params = {}
    for param in model.params:
        if model.isDefined(param):
            value = model.getOrDefault(param)
            params[param.name] = value if isinstance(value, (int, float, str, bool, list)) else str(value)
            if isinstance(params[param.name], float) and not math.isfinite(params[param.name]):
                params[param.name] = str(params[param.name])
    return json.dumps(params, default=str, sort_keys=True)
