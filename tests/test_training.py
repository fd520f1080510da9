import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators import metrics
from tabloom.plans import benchmark, training, tuning, workflow
from tabloom.plans.families import Options, parameters_json, registry
from tabloom.plans.training import out_of_fold, predict, train_all, training_table
from tabloom.sources import stores

SMALL = Options(trees=4, rounds=2, forest_depth=4, boosted_depth=3, fourier_features=16, kernel_iterations=5)


@pytest.fixture(scope="module")
def buyers(spark):
    rows = [(22 + 2 * i, 30000 + 4000 * i, "ab"[i % 2], "yes" if i > 4 else "no") for i in range(10)]
    return spark.createDataFrame(rows, "age long, income long, city string, buy string")


@pytest.fixture(scope="module")
def houses(spark):
    rows = [(800 + 90 * i, 1 + i % 4, "ab"[i % 2], 100000 + 12000 * i) for i in range(10)]
    return spark.createDataFrame(rows, "sqft long, bedrooms long, city string, price long")


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_every_family_trains_and_survives_saving(spark, buyers, houses, tmp_path, problem):
    df, target = (buyers, "buy") if problem == "classification" else (houses, "price")
    table = training_table(df, target, problem, 2)
    training = train_all(table, options=SMALL)
    assert set(training.models) == set(registry(problem))
    for row in training.results.collect():
        assert math.isfinite(row["mean_score"]) and row["std_score"] >= 0 and row["train_time"] > 0
    for name, model in training.models.items():
        model.save(str(tmp_path / name))
        again = predict(df, PipelineModel.load(str(tmp_path / name))) if "KNN" not in name else None
        if again is not None:
            first = [r["predicted"] for r in predict(df, model).collect()]
            assert [r["predicted"] for r in again.collect()] == first
            if problem == "classification":
                assert set(first) <= {"yes", "no"}
        assert parameters_json(training.estimators[name]).startswith("{")


def test_null_targets_are_dropped_and_reported(spark, houses):
    df = houses.withColumn("price", F.when(F.col("bedrooms") != 4, F.col("price")))
    table = training_table(df, "price", "regression", 2)
    assert table.dropped_targets == 2 and table.count == 8


def test_labels_of_any_number(spark, monkeypatch):
    from tabloom.plans import training

    df = spark.range(300_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN NULL ELSE concat('l', id) END AS label")
    dictionary = training.label_dictionary(df, "label")
    labels = sorted({"hot", *[f"l{i}" for i in range(300_000) if i % 3 and i % 1000 != 1]})
    assert dictionary.count() == len(labels)
    assert [(r.label, r.number) for r in dictionary.where("number < 5 OR label = 'hot'").orderBy("number").collect()] == [
        *[(x, i) for i, x in enumerate(labels[:5]) if x != "hot"], ("hot", labels.index("hot"))
    ] if labels.index("hot") >= 5 else True
    coded = training.encode_with(df, "label", dictionary, "n")
    back = training.decode_with(coded, "n", dictionary, "again")
    assert back.where("NOT (label <=> again)").count() == 0 and back.count() == 300_000 and back.where("n IS NULL").count() == df.where("label IS NULL").count()
    monkeypatch.setattr(training, "MOST_CLASSES", 1000)
    with pytest.raises(ValueError, match="label_dictionary"):
        training.class_sizes(df, "label")


def test_reserved_names_are_refused(houses):
    with pytest.raises(ValueError, match="Rename the columns"):
        training_table(houses.withColumnRenamed("city", "fold"), "price", "regression", 2)


def test_failure_names_the_family(buyers):
    from tabloom.plans.families import Family

    def broken(df, context, params):
        raise ArithmeticError("no")

    table = training_table(buyers, "buy", "classification", 2)
    with pytest.raises(RuntimeError, match="'Broken'"):
        train_all(table, {"Broken": Family("Broken", broken)}, SMALL)


def test_boolean_and_numeric_classes(spark, buyers):
    df = buyers.withColumn("flag", F.col("buy") == "yes").drop("buy")
    training = train_all(training_table(df, "flag", "classification", 2), registry("classification", ["NaiveBayes"]), SMALL)
    assert {r[0] for r in predict(df, training.models["NaiveBayes"]).select("predicted").distinct().collect()} <= {"true", "false"}


def test_out_of_fold_covers_every_row(buyers):
    table = training_table(buyers, "buy", "classification", 3)
    training = train_all(table, registry("classification", ["NaiveBayes"]), SMALL)
    found = out_of_fold(table, registry("classification")["NaiveBayes"], training.preps, SMALL)
    assert found.count() == 10
    scores = {r["fold"]: r["score"] for r in training.fold_scores.collect()}
    again = {r["_fold"]: r["score"] for r in metrics.fold_scores(found, "classification", "_label", "prediction", "_fold").collect()}
    assert again == pytest.approx(scores)


def test_linear_matches_least_squares(houses):
    training = train_all(training_table(houses, "price", "regression", 2), registry("regression", ["LinearRegression"]), SMALL)
    found = predict(houses, training.models["LinearRegression"]).orderBy("sqft").collect()
    x = np.array([[r["sqft"], r["bedrooms"], r["city"] == "a", 1.0] for r in found], float)
    y = np.array([r["price"] for r in found], float)
    assert [r["predicted"] for r in found] == pytest.approx(x @ np.linalg.lstsq(x, y, rcond=None)[0], rel=1e-4)


def test_tuning(houses):
    table = training_table(houses, "price", "regression", 2)
    space = {"numTrees": ("int", 2, 4, 1), "maxDepth": ("int", 2, 3, 1)}
    found = tuning.tune(table, "RandomForestRegressor", 3, SMALL, space, batch=2)
    assert found.trials.count() == 6 and set(found.best_params) == set(space)
    best = tuning.best_trial(found.trials, True).first()
    assert best["best_score"] == pytest.approx(found.best_score)
    with pytest.raises(ValueError, match="not supported for advanced tuning"):
        tuning.tune(table, "LinearRegression", 1, SMALL)


@pytest.mark.parametrize("name", ["RandomForestClassifier", "XGBoostRegressor", "LightGBMClassifier"])
def test_search_spaces(spark, name):
    for params in tuning.propose(tuning.search_space(name), 50):
        assert 3 <= params["maxDepth"] <= 20
        assert ("leaves" in params) == (name == "LightGBMClassifier") and params.get("leaves", 15) in range(15, 128)
    assert tuning.space_table(spark, name).count() >= 4
    assert tuning.propose(tuning.search_space(name), 3) == tuning.propose(tuning.search_space(name), 3)


def test_pruning_rule():
    done = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert tuning.should_prune(3.5, done, 1, True) and not tuning.should_prune(2.5, done, 1, True)
    assert not tuning.should_prune(9.0, done, 0, True) and not tuning.should_prune(9.0, done[:4], 1, True)
    assert tuning.should_prune(2.5, done, 1, False)


def test_metrics(spark):
    df = spark.createDataFrame([("yes", "yes"), ("no", "no"), ("yes", "no"), ("no", "no"), ("no", "maybe")], "a string, p string")
    assert metrics.evaluate(df, "classification", "a", "p").first()["accuracy"] == pytest.approx(0.6)
    found = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df, "a", "p").collect()}
    assert found == {("yes", "yes"): 1, ("yes", "no"): 1, ("no", "no"): 2, ("no", "yes"): 0}
    mean = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, p double")
    row = metrics.evaluate(mean, "regression", "a", "p").first()
    assert (row["r2"], row["mae"]) == (pytest.approx(0.0), pytest.approx(2 / 3))
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "a double, p double")
    assert metrics.evaluate(constant, "regression", "a", "p").first()["r2"] is None


@pytest.mark.parametrize("target", ["buy", "price"])
def test_workflow(spark, buyers, houses, tmp_path, target):
    df = buyers if target == "buy" else houses
    names = ["NaiveBayes", "KNN"] if target == "buy" else ["LinearRegression", "RandomForestRegressor"]
    found = workflow.run(df, target, folds=2, families=names, options=SMALL, folder=str(tmp_path), samples=2)
    assert found.best_model in names and found.predictions.count() == 10
    assert found.feature_importance.count() >= 4
    assert stores.readiness(spark, str(tmp_path))["model_name"] == found.best_model
    assert spark.read.parquet(f"{tmp_path}/experiments").count() == 2
    assert workflow.top_features(found, 2).count() == 2


def test_holdout_and_suite(spark, houses):
    keyed = houses.withColumn("id", F.monotonically_increasing_id())
    many = keyed.unionByName(keyed.withColumn("id", F.col("id") + 10**12)).unionByName(keyed.withColumn("id", F.col("id") + 10**13))
    found = benchmark.holdout_compare(many, "price", ["id"], folds=2, rule="dtype", options=SMALL).collect()
    assert [r["model"] for r in found] == ["Ridge", "KernelHuber"] and found[0]["best"] == "This is the best fit model"
    item = benchmark.BenchmarkTable("Houses", houses, "price", 2, families=("LinearRegression",))
    rows = benchmark.run_suite([item], SMALL)
    assert rows.first()["Model"] == "LinearRegression" and benchmark.chart_data(rows).first()["regression"] > 0


def test_suite_from_a_registry(spark, houses, buyers, tmp_path):
    import json

    from tabloom.sources import registry as listed

    houses.withColumn("noise", F.lit("x")).write.parquet(str(tmp_path / "houses"))
    buyers.write.parquet(str(tmp_path / "buyers"))
    datasets = [
        {"id": "h", "name": "Houses", "path": "houses", "role": "core", "default_target": "price", "drop_columns": ["noise"], "drop_or_convert_columns": {"city": "drop"}},
        {"id": "b", "name": "Buyers", "path": "buyers", "role": "core", "default_target": "buy"},
        {"id": "n", "name": "No target", "path": "buyers", "role": "core"},
        {"id": "o", "name": "Other", "path": "buyers", "role": "other", "default_target": "buy"},
    ]
    (tmp_path / "registry.json").write_text(json.dumps({"version": 1, "datasets": datasets}))
    entries = listed.entries(listed.read_registry(spark, str(tmp_path / "registry.json")))
    items = benchmark.suite_of(entries, lambda e: spark.read.parquet(str(tmp_path / e.path)), role="core", folds=2)
    assert [(i.name, i.target, i.folds) for i in items] == [("Houses", "price", 2), ("Buyers", "buy", 2)]
    assert items[0].table.columns == ["sqft", "bedrooms", "price"]
    with pytest.raises(ValueError, match="no table"):
        benchmark.run_suite([])


def test_a_model_predicts_each_different_row_of_a_fold_once(spark, monkeypatch):
    rows = [(i, float(i % 5), float(i % 5 * 2 + i % 2)) for i in range(60)]
    table = training.training_table(spark.createDataFrame(rows, "k long, a double, y double"), "y", "regression", 2, ["k"])
    data = training.prepared(table, training.fit_preps(table)[0])
    family, context = registry("regression")["LinearRegression"], training.context_for(table, 0, 1, Options())
    model = family(data.where("_fold != 0"), context)
    held = model.transform(data.where("_fold = 0")).agg(F.count("*"), F.sqrt(F.avg(F.pow(F.col("_label") - F.col("prediction"), F.lit(2.0))))).first()
    seen, equal = [], training.equal_rows
    monkeypatch.setattr(training, "equal_rows", lambda rows: seen.append(equal(rows)) or seen[0])
    assert training.fold_score(table, family, data, 0, context) == pytest.approx(held[1])
    found = seen[0].agg(F.count("*"), F.sum("n")).first()
    assert found[0] <= 10 and found[1] == held[0]
