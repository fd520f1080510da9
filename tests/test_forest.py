import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import attribution
from tabloom.operators import forest as fo
from tabloom.operators.metrics import rmse
from tabloom.operators.prep import FEATURES
from tabloom.plans import tuning
from tabloom.plans.families import LABEL, Context, Options, registry
from tabloom.plans.training import context_for, fit_preps, prepared, training_table

SMALL = Options(trees=12, forest_depth=6)


def drawn(n=600, seed=1):
    random = np.random.default_rng(seed)
    x = np.column_stack([random.integers(0, 9, n), random.integers(0, 40, n) / 4, random.integers(0, 2, n)])
    return x, np.round(3 * x[:, 0] + x[:, 1] ** 2 - 9 * x[:, 2] * x[:, 0] + random.normal(size=n), 2)


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "_rid long, x array<double>, _label double").withColumn(FEATURES, array_to_vector("x"))


def predictions(model, df):
    return [r["prediction"] for r in model.transform(df).orderBy("_rid").collect()]


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_a_tree_over_cells_equals_mllibs_over_rows(spark, monkeypatch, classes):
    x, y = drawn()
    if classes:
        y = np.digitize(y, [8] if classes == 2 else [0, 20]).astype(float)
    df = table(spark, x, y)
    monkeypatch.setattr(fo, "NODE_SUMS", 200)  # nodes of a level go in several steps
    cuts = fo.thresholds(df, 3, 64)
    rows = fo.by_label(fo.counted(df, LABEL, cuts)).toPandas()
    cell, place = np.unique(rows["cell"], return_inverse=True)
    n, label = rows["n"].to_numpy(float), rows["y"].to_numpy()
    kinds = [n * (label == c) for c in range(classes)] if classes else [n, n * label, n * label**2]
    sums = np.stack([np.bincount(place, k, len(cell)) for k in kinds])
    growth = fo.Growth(classes, 5, 3, 2, 0.0, 1.0, 42)
    nodes = fo.grow_tree(fo.bins_of(cell, cuts), fo.bin_counts(cuts), sums, growth, np.random.default_rng(1))
    estimator = DecisionTreeClassifier if classes else DecisionTreeRegressor
    model = estimator(featuresCol=FEATURES, labelCol=LABEL, maxDepth=5, maxBins=64, minInstancesPerNode=2).fit(df)
    assert len(nodes.left) == model.numNodes
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)])
    guess, found = fo.prediction_of(nodes.sums.T, classes), []
    for row in range(len(x)):
        node = 0
        while nodes.left[node] >= 0:
            node = (nodes.left if bins[nodes.feature[node], row] <= nodes.bin[node] else nodes.right)[node]
        found.append(guess[node])
    assert found == pytest.approx(predictions(model, df))


@pytest.mark.parametrize("name", ["RandomForestClassifier", "RandomForestRegressor"])
def test_a_forest_grows_from_cells_and_is_as_good_as_mllibs(spark, monkeypatch, name):
    x, y = drawn(2000)
    classes = 2 if name == "RandomForestClassifier" else 0
    y = (y > 8).astype(float) if classes else y
    df = table(spark, x, y)
    estimator = RandomForestClassifier if classes else RandomForestRegressor
    settings = {"numTrees": 12, "maxDepth": 6, "seed": 42, "featureSubsetStrategy": "sqrt" if classes else "all"}
    miss = lambda found: np.mean((np.array(found) - y) ** 2)
    expected = miss(predictions(estimator(featuresCol=FEATURES, labelCol=LABEL, **settings).fit(df), df))

    def not_asked(*_):
        raise AssertionError("rows went to every tree")

    monkeypatch.setattr(estimator, "fit", not_asked)
    monkeypatch.setattr(fo, "DRAWN_ROWS", 100)  # several tasks draw
    context = Context(len(y), classes, 3, SMALL)
    family = registry("classification" if classes else "regression")[name]
    model = family(df, context)
    found = predictions(model, df)
    assert miss(found) < expected * 1.25 + 0.01
    assert found == predictions(family(df, context), df)
    assert model.getNumTrees == 12 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 12
    assert model.getOrDefault("maxDepth") == 6 and model.numFeatures == 3


def test_samples_are_as_large_as_the_table(spark):
    x, y = drawn(3000)
    df = table(spark, x, (y > 8).astype(float))
    model = registry("classification")["RandomForestClassifier"](df, Context(3000, 2, 3, SMALL))
    sizes = [t._call_java("rootNode").impurityStats().count() for t in model.trees]
    assert len(set(sizes)) > 1 and abs(np.mean(sizes) - 3000) < 100


def test_too_many_cells_are_left_to_mllib(spark, monkeypatch):
    x, y = drawn(200)
    monkeypatch.setattr(fo, "MOST_CELLS", 10)
    model = registry("regression")["RandomForestRegressor"](table(spark, x, y), Context(200, 0, 3, SMALL))
    assert model.getNumTrees == 12


def test_features_tried_are_mllibs():
    found = [fo.tried_features(s, c, 20, 10) for s, c in [("all", True), ("auto", True), ("auto", False), ("log2", True), ("0.25", True), ("7", True)]]
    assert found == [10, 4, 4, 4, 3, 7] and fo.tried_features("auto", True, 1, 10) == 10


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("many", [False, True])
def test_held_out_rows_are_predicted_as_by_the_stored_forest(spark, monkeypatch, classes, many):
    x, y = drawn(900)
    if classes:
        y = np.digitize(y, [8] if classes == 2 else [0, 20]).astype(float)
    df = table(spark, x, y)
    if many:  # drawn by several tasks, added up in several pieces
        monkeypatch.setattr(fo, "DRAWN_ROWS", 300)
    monkeypatch.setattr(fo, "VOTES_AT_ONCE", 40)
    name, problem = ("RandomForestClassifier", "classification") if classes else ("RandomForestRegressor", "regression")
    family, context = registry(problem)[name], Context(600, classes, 3, SMALL)
    train, held = df.where("_rid % 3 > 0"), df.where("_rid % 3 = 0")
    model = family(train, context)
    scorer = family.counted(train, held, context)
    found = scorer({}).toPandas()
    assert found["n"].sum() == 300
    expected = model.transform(held).groupBy(LABEL).agg(F.sum("prediction")).orderBy(LABEL).collect()
    total = (found["prediction"] * found["n"]).groupby(found["y"]).sum()
    assert total.index.tolist() == [e[0] for e in expected]
    assert total.to_numpy() == pytest.approx([e[1] for e in expected])
    small = scorer({"numTrees": 3, "maxDepth": 2}).toPandas()
    assert small["prediction"].nunique() < found["prediction"].nunique() or classes


def test_a_search_stores_one_forest_and_scores_as_fits_would(spark, monkeypatch):
    x, y = drawn(900)
    rows = [(int(i), *[float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double")
    trained = training_table(df, "y", "regression", 2, ["k"])
    space = {"numTrees": ("int", 4, 8, 2), "maxDepth": ("int", 2, 6, 1)}
    stored, store = [], fo.stored_forest
    monkeypatch.setattr(fo, "stored_forest", lambda *args: stored.append(1) or store(*args))
    found = tuning.tune(trained, "RandomForestRegressor", 3, SMALL, space)
    assert len(stored) == 1
    preps = fit_preps(trained)
    for r in found.trials.collect():
        data = prepared(trained, preps[r.step])
        family, context = registry("regression")["RandomForestRegressor"], context_for(trained, r.step, 3, SMALL)
        model = family(data.where(f"_fold != {r.step}"), context, json.loads(r.params))
        out = model.transform(data.where(f"_fold = {r.step}"))
        assert out.agg(rmse(F.col(LABEL), F.col("prediction"))).first()[0] == pytest.approx(r.score)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_a_large_forest_stays_on_disk_and_is_the_same(spark, monkeypatch, tmp_path, classes):
    x, y = drawn(900)
    if classes:
        y = np.digitize(y, [8] if classes == 2 else [0, 20]).astype(float)
    df = table(spark, x, y)
    name, problem = ("RandomForestClassifier", "classification") if classes else ("RandomForestRegressor", "regression")
    family, context = registry(problem)[name], Context(900, classes, 3, SMALL)
    small = family(df, context)
    monkeypatch.setattr(fo, "MOST_NODES", 10)
    monkeypatch.setattr(fo, "VOTES_AT_ONCE", 40)
    stored = fo.stored_forest
    monkeypatch.setattr(fo, "stored_forest", lambda *_: pytest.fail("the driver held the forest"))
    large = family(df, context)
    PipelineModel([large]).save(f"{tmp_path}/pipeline")
    again = PipelineModel.load(f"{tmp_path}/pipeline").stages[0]
    expected = small.transform(df)
    for model in (large, again):
        assert model.getOrDefault("maxDepth") == 6 and model.getNumTrees == 12 and model.numFeatures == 3
        found = model.transform(df)
        assert found.columns == expected.columns and dict(found.dtypes) == dict(expected.dtypes)
        assert predictions(model, df) == pytest.approx(predictions(small, df))
        if classes:
            both = [[r["probability"].toArray() for r in d.orderBy("_rid").collect()] for d in (found, expected)]
            assert np.allclose(*both)
    own = [attribution.tree_attribution(df, m, None, "_rid") for m in (large, small)]
    assert own[0].base == pytest.approx(own[1].base)
    monkeypatch.setattr(fo, "stored_forest", stored)
    assert [t.toDebugString.split("\n", 1)[1] for t in large.trees] == [t.toDebugString.split("\n", 1)[1] for t in small.trees]
