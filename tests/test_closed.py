import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from tabloom.operators.prep import FEATURES, FULL
from tabloom.plans import closed
from tabloom.plans.families import HOLDOUT, LABEL, Options
from tabloom.plans.training import FOLD, context_for, fit_preps, fold_score, prepared, train_all, training_table
from tabloom.plans.families import registry


@pytest.fixture(scope="module")
def rows(spark):
    """Missing numbers and categories, and a column that is the same everywhere."""
    return spark.range(260).selectExpr(
        "id",
        "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id * 37 % 101 AS double) END AS a",
        "CASE WHEN id % 11 = 3 THEN double('NaN') ELSE 1e4 + id * 13 % 17 END AS b",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE substr('xyz', cast(id % 3 AS int) + 1, 1) END AS c",
        "4.0 AS same",
        "cast(id * 37 % 101 AS double) * 3 - id % 3 * 20 + id * 7 % 23 AS y",
        "CASE WHEN id * 37 % 101 > 60 THEN 'high' WHEN id % 3 = 0 THEN 'low' ELSE 'mid' END AS k",
    )


@pytest.mark.parametrize("ridge", [False, True])
def test_least_squares_equal_fits_per_fold(rows, ridge):
    table = training_table(rows.drop("k"), "y", "regression", 4, ["id"])
    preps = fit_preps(table)
    found = closed.linear(table, preps, ridge)
    family = HOLDOUT["regression"][0] if ridge else registry("regression")["LinearRegression"]
    for fold in range(4):
        context = context_for(table, fold, len(preps[fold].feature_names), Options())
        data = prepared(table, preps[fold])
        lacking = data.where(F.col(FOLD) != fold).count()
        assert lacking == context.rows
        assert found.scores[fold] == pytest.approx(fold_score(table, family, data, fold, context), rel=1e-5)
    data = prepared(table, preps[FULL])
    other = family(data, context_for(table, FULL, len(preps[FULL].feature_names), Options()))
    both = found.model.transform(data).select("_rid", F.col("prediction").alias("p")).join(other.transform(data), "_rid")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-3
    assert isinstance(other, type(found.model)) and isinstance(found.model.coefficients.size, int)


def test_bayes_equals_fits_per_fold(rows):
    table = training_table(rows.drop("y"), "k", "classification", 3, ["id"])
    preps = fit_preps(table)
    found = closed.bayes(table, preps)
    for fold in range(3):
        data = prepared(table, preps[fold])
        model = NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian").fit(data.where(F.col(FOLD) != fold))
        held = model.transform(data.where(F.col(FOLD) == fold))
        assert found.scores[fold] == pytest.approx(held.agg(F.avg((F.col(LABEL) == F.col("prediction")).cast("double"))).first()[0])
    data = prepared(table, preps[FULL])
    other = NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian").fit(data)
    assert found.model.theta.toArray() == pytest.approx(other.theta.toArray(), abs=1e-9)
    assert found.model.sigma.toArray() == pytest.approx(other.sigma.toArray(), abs=1e-9)
    assert found.model.pi.toArray() == pytest.approx(other.pi.toArray())


def test_training_uses_the_closed_forms(rows, monkeypatch):
    from tabloom.plans import training

    table = training_table(rows.drop("k"), "y", "regression", 3, ["id"])
    monkeypatch.setattr(training, "fold_score", lambda *_: pytest.fail("fitted fold by fold"))
    result = train_all(table, registry("regression", ["LinearRegression"]))
    assert result.fold_scores.count() == 3 and set(result.models) == {"LinearRegression"}
    assert closed.joint_fit("LinearRegression", table, fit_preps(table), widest=2) is None
