"""The registered model queries do the whole job: library sizes, all families, all trials."""

import inspect

import pytest

from __spark_entry__ import queries
from queries import explain, models, operations
from tabloom.operators import attribution
from tabloom.plans import benchmark, tuning, workflow
from tabloom.plans.benchmark import holdout_compare
from tabloom.plans.families import Options, registry

FOLDER = "/root/testdata/sf0.001"


class Reached(Exception):
    pass


def seen(spark, monkeypatch, module, function, query):
    """Arguments with which ``query`` calls ``function`` of ``module``."""
    calls = []

    def note(*args, **named):
        calls.append((args, named))
        raise Reached

    monkeypatch.setattr(module, function, note)
    with pytest.raises(Reached):
        queries()[query](spark, FOLDER)
    return calls[0]


def test_sizes_are_those_of_a_full_run():
    assert models.OPTIONS == explain.OPTIONS == operations.OPTIONS == Options()


@pytest.mark.parametrize(("query", "problem"), [("train_all_classifiers", "classification"), ("train_all_regressors", "regression")])
def test_all_families_are_trained(spark, monkeypatch, query, problem):
    args, _ = seen(spark, monkeypatch, models, "train_all", query)
    assert list(args[1]) == list(registry(problem)) and args[2] == Options()


@pytest.mark.parametrize("query", ["tune_rf", "tune_gbt"])
def test_searches_reach_pruning(spark, monkeypatch, query):
    args, named = seen(spark, monkeypatch, tuning, "tune", query)
    trials = named.get("n_trials", args[2] if len(args) > 2 else tuning.TRIALS)
    assert trials > tuning.STARTUP_TRIALS and len(args) < 5 and "space" not in named


def test_workflow_and_benchmarks_take_all_families(spark, monkeypatch):
    _, named = seen(spark, monkeypatch, workflow, "run", "workflow_run")
    assert named["families"] is None and named["options"] == Options() and "samples" not in named
    args, _ = seen(spark, monkeypatch, benchmark, "run_one", "benchmark_dataset")
    assert args[0].families is None and args[1] == Options()
    args, _ = seen(spark, monkeypatch, benchmark, "run_suite", "benchmark_suite")
    assert all(i.families is None for i in args[0]) and args[1] == Options()


def test_the_holdout_comparison_takes_all_folds_and_models(spark, monkeypatch):
    args, named = seen(spark, monkeypatch, benchmark, "holdout_compare", "holdout_compare")
    assert len(args) == 3 and set(named) == {"options"} and named["options"] == Options()
    assert inspect.signature(holdout_compare).parameters["folds"].default == 5


def test_attribution_takes_all_samples(spark, monkeypatch):
    _, named = seen(spark, monkeypatch, attribution, "sampling_attribution", "shap_sampling")
    assert "samples" not in named
