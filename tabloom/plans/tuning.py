"""Hyperparameter search with median pruning."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.operators.detection import CLASSIFICATION
from tabloom.operators.prep import FULL
from tabloom.plans.families import ALIASES, Options, registry
from tabloom.plans.training import (
    TrainingTable,
    context_for,
    counted_scorer,
    fit_preps,
    fold_score,
    new_run_id,
    prepared,
    scoring_pipeline,
)
from tabloom.session import run_jobs

# Search ranges and pruning settings.
# (kind, low, high, step) for numbers, ("choice", values) for choices
FOREST_SPACE = {
    "numTrees": ("int", 100, 400, 50),
    "maxDepth": ("int", 3, 20, 1),
    "minInstancesPerNode": ("int", 1, 4, 1),
    "featureSubsetStrategy": ("choice", ("sqrt", "log2", "all")),
}
BOOSTED_SPACE = {
    "maxIter": ("int", 100, 400, 50),
    "maxDepth": ("int", 3, 10, 1),
    "stepSize": ("log", 0.01, 0.3, None),
    "subsamplingRate": ("float", 0.6, 1.0, None),
    "featureSubsetStrategy": ("share", 0.6, 1.0, None),
}
LEAFY_SPACE = {
    "maxIter": ("int", 100, 400, 50),
    "maxDepth": ("int", 3, 12, 1),
    "stepSize": ("log", 0.01, 0.3, None),
    "leaves": ("int", 15, 127, 1),
    "subsamplingRate": ("float", 0.6, 1.0, None),
    "featureSubsetStrategy": ("share", 0.6, 1.0, None),
}
STARTUP_TRIALS = 5
WARMUP_STEPS = 1
TRIALS = 25

SPACES = {
    "RandomForest": FOREST_SPACE,
    "BoostedTrees": BOOSTED_SPACE,
    "LeafyBoostedTrees": LEAFY_SPACE,
}
LEDGER = "study_id string, trial int, step int, score double, running_mean double, pruned boolean, params string"


@dataclass
class Tuning:
    model_name: str
    best_model: PipelineModel
    best_params: dict[str, Any]
    best_score: float
    trials: DataFrame


def tunable(problem_type: str) -> list[str]:
    ending = "Classifier" if problem_type == CLASSIFICATION else "Regressor"
    return [f"{name}{ending}" for name in SPACES]


def search_space(model_name: str) -> dict[str, tuple]:
    name = ALIASES.get(model_name, model_name)
    base = name.removesuffix("Classifier").removesuffix("Regressor")
    if base not in SPACES:
        raise ValueError(f"There is no search space for {model_name}.")
    return SPACES[base]


def space_table(spark: SparkSession, model_name: str) -> DataFrame:
    """The search space as rows."""
    rows = []
    for name, (kind, *limits) in search_space(model_name).items():
        if kind == "choice":
            rows.append((name, kind, None, None, None, [str(v) for v in limits[0]]))
        else:
            low, high, step = limits
            rows.append((name, kind, float(low), float(high), float(step) if step else None, None))
    return spark.createDataFrame(
        rows, "parameter string, kind string, low double, high double, step double, choices array<string>"
    )


def propose(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict[str, Any]]:
    """Seeded random proposals."""
    random = np.random.RandomState(seed)
    proposals = []
    for _ in range(trials):
        params: dict[str, Any] = {}
        for name, (kind, *limits) in space.items():
            if kind == "choice":
                params[name] = limits[0][random.randint(len(limits[0]))]
                continue
            low, high, step = limits
            if kind == "int":
                params[name] = int(low + step * random.randint((high - low) // step + 1))
            elif kind == "log":
                params[name] = float(math.exp(random.uniform(math.log(low), math.log(high))))
            else:
                value = float(random.uniform(low, high))
                params[name] = repr(value) if kind == "share" else value
        proposals.append(params)
    return proposals


def should_prune(best_so_far: float, completed: list[float], step: int, lower_is_better: bool) -> bool:
    """Worse than the median of completed trials at the same step."""
    if step < WARMUP_STEPS or len(completed) < STARTUP_TRIALS:
        return False
    median = float(np.median(completed))
    return best_so_far > median if lower_is_better else best_so_far < median


def tune(
    table: TrainingTable,
    model_name: str,
    n_trials: int = TRIALS,
    options: Options | None = None,
    space: Mapping[str, tuple] | None = None,
    batch: int = 4,
    seed: int = 42,
) -> Tuning:
    """Search, prune, refit the best trial on all rows.

    Trials run in batches of concurrent jobs over the prepared rows of one fold
    at a time; between folds the trials that fall behind are dropped. Forests share
    the counted rows of a fold, which are made once.
    """
    options = options or Options()
    name = ALIASES.get(model_name, model_name)
    if name not in tunable(table.problem_type):
        raise ValueError(
            f"{model_name} is not supported for advanced tuning of this problem; "
            f"there are {', '.join(sorted(tunable(table.problem_type)))}."
        )
    family = registry(table.problem_type, [name])[name]
    lower = table.problem_type != CLASSIFICATION
    pick = min if lower else max
    space = space or search_space(name)
    proposals = propose(space, n_trials, seed)
    preps = fit_preps(table)
    inner = replace(options, parallelism=1)
    study = new_run_id()
    ledger: list[list] = []
    history: dict[int, list[float]] = {}
    completed: list[int] = []
    scorers: dict[int, Callable | None] = {}
    for start in range(0, n_trials, batch):
        alive = list(range(start, min(start + batch, n_trials)))
        means: dict[int, list[float]] = {t: [] for t in alive}
        totals = dict.fromkeys(alive, 0.0)
        for fold in range(table.folds):
            context = context_for(table, fold, len(preps[fold].feature_names), inner)
            data = prepared(table, preps[fold]).persist(StorageLevel.MEMORY_AND_DISK)
            if fold not in scorers:
                scorers[fold] = counted_scorer(table, family, data, fold, context, space)
            scorer = scorers[fold] or (lambda params: fold_score(table, family, data, fold, context, params))
            scores = run_jobs([lambda t=t: scorer(proposals[t]) for t in alive], options.parallelism)
            data.unpersist()
            still = []
            for trial, value in zip(alive, scores):
                totals[trial] += value
                means[trial].append(totals[trial] / (fold + 1))
                earlier = [history[t][fold] for t in completed]
                pruned = should_prune(pick(means[trial]), earlier, fold, lower)
                ledger.append([study, trial, fold, value, means[trial][-1], pruned, json.dumps(proposals[trial], sort_keys=True)])
                if not pruned:
                    still.append(trial)
            alive = still
        for trial in alive:
            history[trial] = means[trial]
            completed.append(trial)
    best = pick(completed, key=lambda t: (history[t][-1], t if lower else -t))
    data = prepared(table, preps[FULL]).persist(StorageLevel.MEMORY_AND_DISK)
    context = context_for(table, FULL, len(preps[FULL].feature_names), options)
    model = family(data, context, proposals[best])
    data.unpersist()
    trials = table.rows.sparkSession.createDataFrame(ledger, LEDGER)
    return Tuning(
        name, scoring_pipeline(table, preps[FULL], model), proposals[best], history[best][-1], trials
    )


def median_prune(ledger: DataFrame, lower_is_better: bool) -> DataFrame:
    """Which trials the median rule would stop, for many studies at once.

    ``ledger`` has ``study_id, trial, step, running_mean``. A study holds at
    most as many trials as its search was given, so its windows stay small.
    """
    best = F.min("running_mean") if lower_is_better else F.max("running_mean")
    own = Window.partitionBy("study_id", "trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("study_id", "step").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    last_step = Window.partitionBy("study_id")
    reached = Window.partitionBy("study_id", "trial")
    marked = ledger.withColumns(
        {
            "best_so_far": best.over(own),
            "_done": F.max("step").over(reached) == F.max("step").over(last_step),
        }
    )
    finished = F.when(F.col("_done"), F.col("running_mean"))
    marked = marked.withColumns(
        {"finished_before": F.count(finished).over(earlier), "median_before": F.percentile(finished, 0.5).over(earlier)}
    )
    behind = (
        F.col("best_so_far") > F.col("median_before")
        if lower_is_better
        else F.col("best_so_far") < F.col("median_before")
    )
    pruned = (F.col("step") >= WARMUP_STEPS) & (F.col("finished_before") >= STARTUP_TRIALS) & behind
    return marked.withColumn("pruned", F.coalesce(pruned, F.lit(False))).drop("_done")


def best_trial(ledger: DataFrame, lower_is_better: bool) -> DataFrame:
    """Best completed trial per study; a tie goes to the earlier trial."""
    value = F.max_by("running_mean", "step")
    trials = ledger.groupBy("study_id", "trial").agg(value.alias("best_score"), F.max("step").alias("steps"))
    steps = trials.groupBy("study_id").agg(F.max("steps").alias("all_steps"))
    done = trials.join(steps, "study_id").where("steps = all_steps")
    signed = F.col("best_score") if lower_is_better else -F.col("best_score")
    return done.groupBy("study_id").agg(
        F.min_by("trial", F.struct(signed, F.col("trial"))).alias("best_trial"),
        (F.min("best_score") if lower_is_better else F.max("best_score")).alias("best_score"),
    )
