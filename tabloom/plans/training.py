"""Fold-major cross-validation.

Preparation depends on the fold, not on the family, so it is fitted once per
fold; the prepared rows are kept while all families use them, then dropped.
Every family sees the same training statistics it would see alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property
from time import perf_counter
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col, missing_to_null
from tabloom.operators.boosting import fit_boosted
from tabloom.operators.detection import CLASSIFICATION, FeatureSchema, feature_schema
from tabloom.operators.folds import SEED, assign_folds
from tabloom.operators.metrics import counted_score, metric_name
from tabloom.operators.neighbours import NeighboursModel
from tabloom.operators.ordering import numbered
from tabloom.operators.prep import FEATURES, FULL, MAX_CATEGORIES, Prep, fit_fold_preps
from tabloom.plans.closed import Joint, joint_fit
from tabloom.plans.families import CELL_PARAMETERS, LABEL, NORMAL_SOLVER_WIDTH, ROW_ID, Context, Family, Options, boosted_settings, parameters_json, registry
from tabloom.session import run_jobs, write_table

FOLD = "_fold"
RESERVED = {"fold", FOLD, ROW_ID, LABEL, FEATURES, "prediction", "predicted", "probability", "rawPrediction"}
ROWS_PER_TASK = 100_000
MOST_CLASSES = 100_000
RESULTS = (
    "run_id string, position bigint, model_name string, mean_score double, std_score double, "
    "train_time double, metric_name string"
)


@dataclass
class TrainingTable:
    """Rows with ``_label``, ``_fold`` and ``_rid``, written once."""

    rows: DataFrame
    target: str
    problem_type: str
    schema: FeatureSchema
    folds: int
    labels: list[str] | None
    dropped_targets: int
    count: int
    key: list[str] | None

    @property
    def feature_columns(self) -> list[str]:
        names = set(self.schema.numeric) | set(self.schema.categorical)
        return [c for c in self.rows.columns if c in names]

    @cached_property
    def fold_sizes(self) -> dict[int, int]:
        return {r[FOLD]: r["n"] for r in self.rows.groupBy(FOLD).agg(F.count("*").alias("n")).collect()}

    def rows_without(self, part: int) -> int:
        """Rows that a fit sees: all but those of a fold, or all for ``FULL``."""
        return self.count - self.fold_sizes.get(part, 0)


@dataclass
class Training:
    """Outcome of a training run."""

    run_id: str
    table: TrainingTable
    results: DataFrame
    fold_scores: DataFrame
    models: dict[str, PipelineModel]
    estimators: dict[str, Any]
    preps: dict[int, Prep]


def class_sizes(df: DataFrame, target: str) -> dict:
    """Rows per label (``None``: no label), for up to ``MOST_CLASSES`` labels, of which a classifier holds a vector each."""
    counts = df.groupBy(col(target).alias("v")).agg(F.count("*").alias("n"))
    found = counts.limit(MOST_CLASSES + 2).collect()
    if sum(r["v"] is not None for r in found) > MOST_CLASSES:
        raise ValueError(f"'{target}' has more than {MOST_CLASSES} labels; a classifier holds one vector per label. label_dictionary numbers any number of them.")
    return {r["v"]: r["n"] for r in found}


def label_dictionary(df: DataFrame, target: str) -> DataFrame:
    """``label, number``: the distinct labels of any number in sorted order, from 0, without gathering them."""
    distinct = df.select(col(target).alias("label")).where(F.col("label").isNotNull()).distinct()
    return write_table(numbered(distinct, [], [F.col("label")], "number", small_rows=0).withColumn("number", F.col("number") - 1), "labels")


def encode_with(df: DataFrame, target: str, dictionary: DataFrame, output: str = LABEL) -> DataFrame:
    """Labels to their numbers in a dictionary (unknown ones and nulls to null); a frequent label is split by the join."""
    known = dictionary.select(F.col("label").alias("_label_text"), F.col("number").cast("double").alias(output))
    return df.drop(output).join(known, col(target) == F.col("_label_text"), "left").drop("_label_text")


def decode_with(df: DataFrame, number: str, dictionary: DataFrame, output: str) -> DataFrame:
    """Numbers back to labels."""
    known = dictionary.select(F.col("number").cast("double").alias("_label_number"), F.col("label").alias(output))
    return df.drop(output).join(known, col(number).cast("double") == F.col("_label_number"), "left").drop("_label_number")


def label_values(df: DataFrame, target: str) -> list:
    """Distinct labels in sorted order."""
    return sorted(v for v in class_sizes(df, target) if v is not None)


def encode_labels(df: DataFrame, target: str, labels: Sequence, output: str = LABEL) -> DataFrame:
    """Sorted classes to ``0 .. k-1``; other values to null."""
    kind = df.schema[target].dataType
    shape = T.StructType([T.StructField("_label_text", kind), T.StructField(output, T.DoubleType())])
    table = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(labels)], shape)
    return df.drop(output).join(F.broadcast(table), col(target) == F.col("_label_text"), "left").drop("_label_text")


def label_texts(labels: Sequence, data_type: T.DataType) -> list[str]:
    if isinstance(data_type, T.BooleanType):
        return [str(v).lower() for v in labels]
    return [str(v) for v in labels]


def training_table(
    df: DataFrame,
    target: str,
    problem_type: str,
    folds: int = 5,
    key: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    seed: int = SEED,
) -> TrainingTable:
    """Drop rows without a target, encode labels, assign folds, write once.

    ``key`` names columns that identify a row; they are used for the fold hash
    and are features only if listed in ``features``.
    """
    taken = sorted(RESERVED & set(df.columns))
    if taken:
        raise ValueError(f"Rename the columns {taken}; training adds columns of that name.")
    df = missing_to_null(df)
    chosen = list(features) if features is not None else [c for c in df.columns if c != target and c not in (key or ())]
    schema = feature_schema(df.select(*[col(c) for c in chosen]))
    extra = [c for c in (key or ()) if c not in chosen]
    rows = df.select(*[col(c) for c in [*chosen, *extra, target]])
    labels = smallest = None
    if problem_type == CLASSIFICATION:
        sizes = class_sizes(rows, target)
        dropped = sizes.pop(None, 0)
        count, values = sum(sizes.values()), sorted(sizes)
        if len(values) < 2:
            raise ValueError(
                f"'{target}' needs at least two unique values besides null."
            )
        smallest = min(sizes.values())
        labels = label_texts(values, df.schema[target].dataType)
        rows = encode_labels(rows.where(col(target).isNotNull()), target, values)
    else:
        count, dropped = rows.agg(F.count(col(target)), F.count_if(col(target).isNull())).first()
        rows = rows.where(col(target).isNotNull()).withColumn(LABEL, col(target).cast("double"))
    rows, k = assign_folds(rows, target, problem_type, folds, key, seed, count, smallest)
    rows = rows.withColumnRenamed("fold", FOLD).withColumn(ROW_ID, F.monotonically_increasing_id())
    rows = write_table(rows, "training")
    return TrainingTable(
        rows, target, problem_type, schema, k, labels, dropped, count, list(key) if key else None
    )


def prepared(table: TrainingTable, prep: Prep) -> DataFrame:
    """Only what a family needs: ids, fold, label and the feature vector."""
    rows = spread(table.rows, table.count)
    return prep.model.transform(rows).select(ROW_ID, FOLD, LABEL, FEATURES)


def spread(rows: DataFrame, count: int) -> DataFrame:
    """Split a table of few files further; a large table is left as it is.

    Training makes many passes over few bytes, so a split that suits a scan is
    too coarse for it; but tasks of a few rows cost more than they save. The split
    follows the rows only, so that a seeded fit does not depend on the cluster.
    """
    wanted = math.ceil(count / ROWS_PER_TASK)
    return rows.repartition(wanted, ROW_ID) if rows.rdd.getNumPartitions() < wanted else rows


def fit_preps(table: TrainingTable, numeric_strategy: str = "median", max_categories: int = MAX_CATEGORIES) -> dict[int, Prep]:
    return fit_fold_preps(table.rows, table.schema, FOLD, table.folds, numeric_strategy, max_categories=max_categories)


def context_for(table: TrainingTable, part: int, width: int, options: Options) -> Context:
    """What a fit on everything but ``part`` knows; penalties depend on its rows."""
    return Context(table.rows_without(part), len(table.labels) if table.labels else 0, width, options)


def equal_rows(rows: DataFrame) -> DataFrame:
    """Features, label and ``n``, how many rows have them: a model predicts the same for all of them."""
    found = rows.groupBy(vector_to_array(F.col(FEATURES)).alias("x"), LABEL).agg(F.count("*").alias("n"))
    return found.select(array_to_vector("x").alias(FEATURES), LABEL, "n")


def fold_score(table: TrainingTable, family: Family, data: DataFrame, fold: int, context: Context, params=None) -> float:
    """Fit on all folds but one and score on that one."""
    scorer = counted_scorer(table, family, data, fold, context, params or {})
    if scorer is not None:
        return scorer(params or {})
    model = family(data.where(F.col(FOLD) != fold), context, params)
    return held_score(table, model, data, fold)


def held_score(table: TrainingTable, model: Any, data: DataFrame, fold: int) -> float:
    """The score on a fold, each different row predicted once."""
    predicted = model.transform(equal_rows(data.where(F.col(FOLD) == fold)))
    return predicted.agg(counted_score(table.problem_type, F.col(LABEL), F.col("prediction"), F.col("n"))).first()[0]


def counted_scorer(
    table: TrainingTable, family: Family, data: DataFrame, fold: int, context: Context, varied: Iterable[str] = ()
) -> Callable[[dict[str, Any]], float] | None:
    """For parameters, the score on a fold of a fit on all others; rows are counted once for all of them.

    ``None`` if the family has no such form, or the parameters ``varied`` change what is counted.
    """
    if family.counted is None or CELL_PARAMETERS & set(varied):
        return None
    found = family.counted(data.where(F.col(FOLD) != fold), data.where(F.col(FOLD) == fold), context)
    measure = counted_score(table.problem_type, F.col("y"), F.col("prediction"), F.col("n"))
    return found and (lambda params: found(params).agg(measure).first()[0])


def fit_together(table: TrainingTable, name: str, family: Family, preps: dict[int, Prep], options: Options) -> Joint | None:
    """All folds of a family in common passes: closed forms from sums, boosted trees side by side. ``None`` for other families."""
    if family.leafy is None:
        return joint_fit(name, table, preps, NORMAL_SOLVER_WIDTH)
    data = {part: prepared(table, prep).persist(StorageLevel.MEMORY_AND_DISK) for part, prep in preps.items()}
    classes = len(table.labels) if table.labels else 0
    models = fit_boosted({p: d.where(F.col(FOLD) != p) for p, d in data.items()}, LABEL, classes, boosted_settings(family.leafy, options, {}))
    scores = {p: held_score(table, models[p], d, p) for p, d in data.items() if p != FULL}
    for d in data.values():
        d.unpersist()
    return Joint(scores, models[FULL])


def train_all(
    table: TrainingTable,
    families: dict[str, Family] | None = None,
    options: Options | None = None,
    numeric_strategy: str = "median",
    run_id: str | None = None,
    max_categories: int = MAX_CATEGORIES,
) -> Training:
    """Cross-validate every family, then refit each on all rows.

    A family that fails is reported by name after the others have run, and
    fails the run.
    """
    options = options or Options()
    families = families if families is not None else registry(table.problem_type)
    run_id = run_id or new_run_id()
    preps = fit_preps(table, numeric_strategy, max_categories)
    times = dict.fromkeys(families, 0.0)
    scores: list[tuple[str, str, int, float]] = []
    failures: dict[str, Exception] = {}
    fitted: dict[str, Any] = {}

    def timed(name, work):
        if name in failures:
            return None
        start = perf_counter()
        try:
            return work()
        except Exception as error:  # noqa: BLE001 - reported below, by family
            failures[name] = error
            return None
        finally:
            times[name] += perf_counter() - start

    for name, family in families.items():
        found = timed(name, lambda n=name, f=family: fit_together(table, n, f, preps, options))
        if found is not None:
            scores += [(run_id, name, part, found.scores[part]) for part in range(table.folds)]
            fitted[name] = found.model
    # the others fold by fold
    left = {n: f for n, f in families.items() if n not in fitted and n not in failures}
    for part in [*range(table.folds), FULL] if left else []:
        data = prepared(table, preps[part]).persist(StorageLevel.MEMORY_AND_DISK)
        data.count()  # fill the cache once, before the families read it side by side
        context = context_for(table, part, len(preps[part].feature_names), options)
        if part == FULL:
            calls = [
                lambda n=n, f=f: timed(n, lambda: _kept(f(data, context), table, preps[FULL], data))
                for n, f in left.items()
            ]
            fitted |= dict(zip(left, run_jobs(calls, options.parallelism)))
        else:
            calls = [
                lambda n=n, f=f: timed(n, lambda: fold_score(table, f, data, part, context))
                for n, f in left.items()
            ]
            found = run_jobs(calls, options.parallelism)
            scores += [(run_id, n, part, s) for n, s in zip(left, found) if n not in failures]
        data.unpersist()
    if failures:
        name, error = next(iter(failures.items()))
        raise RuntimeError(f"Training failed for model '{name}' (all failures: {sorted(failures)}).") from error
    spark = table.rows.sparkSession
    label = metric_name(table.problem_type)
    results = []
    for position, name in enumerate(families):
        values = [s for _, n, _, s in scores if n == name]
        mean = math.fsum(values) / len(values)
        std = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))
        results.append((run_id, position, name, mean, std, times[name], label))
    return Training(
        run_id,
        table,
        spark.createDataFrame(results, RESULTS),
        spark.createDataFrame(scores, "run_id string, model_name string, fold int, score double"),
        {n: scoring_pipeline(table, preps[FULL], fitted[n]) for n in families},
        {n: fitted[n] for n in families},
        preps,
    )


def _kept(model, table, prep, data):
    """Neighbour models keep their references beyond the cached rows."""
    if isinstance(model, NeighboursModel):
        model.references = write_table(model.references, "neighbour-references")
    return model


def scoring_pipeline(table: TrainingTable, prep: Prep, model: Any) -> PipelineModel:
    """Preparation, model, and for classifiers the decoded label."""
    stages = [*prep.model.stages, *(model.stages if isinstance(model, PipelineModel) else [model])]
    if table.labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=table.labels))
    return PipelineModel(stages)


def predict(table_or_rows: TrainingTable | DataFrame, pipeline: PipelineModel) -> DataFrame:
    """Rows with ``predicted``: a label for classifiers, a number otherwise."""
    rows = table_or_rows.rows if isinstance(table_or_rows, TrainingTable) else table_or_rows
    out = pipeline.transform(rows)
    return out if "predicted" in out.columns else out.withColumn("predicted", F.col("prediction"))


def out_of_fold(table: TrainingTable, family: Family, preps: dict[int, Prep], options: Options | None = None) -> DataFrame:
    """Predictions for every row by the model that did not see it."""
    options = options or Options()
    parts = None
    for fold in range(table.folds):
        data = prepared(table, preps[fold])
        context = context_for(table, fold, len(preps[fold].feature_names), options)
        model = family(data.where(F.col(FOLD) != fold), context)
        part = model.transform(data.where(F.col(FOLD) == fold)).select(ROW_ID, FOLD, LABEL, "prediction")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def new_run_id() -> str:
    return f"run_{uuid.uuid4().hex[:12]}"


def model_parameters(training: Training) -> dict[str, str]:
    return {name: parameters_json(model) for name, model in training.estimators.items()}
