import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector

from tabloom.operators import huber, support
from tabloom.operators.kernel import FourierMap, fourier_basis
from tabloom.operators.prep import FEATURES
from tabloom.plans.families import LABEL, Context, Options, registry


def table(spark, classes=2, n=900, repeats=1):
    random = np.random.default_rng(5)
    x = random.normal(size=(n, 2))
    score = np.sin(2 * x[:, 0]) + 0.6 * x[:, 1] + 0.2 * random.normal(size=n)
    y = np.digitize(score, [0.0] if classes == 2 else [-0.5, 0.5]).astype(float)
    x, y = np.repeat(x, repeats, axis=0), np.repeat(y, repeats)
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "_rid long, x array<double>, _label double").withColumn(FEATURES, array_to_vector("x")).repartition(2)


def hinge(z, side, weights, intercept, penalty):
    scale = z.std(axis=0, ddof=1)
    return np.maximum(0, 1 - side * (z @ weights + intercept)).mean() + penalty / 2 * ((weights * scale) ** 2).sum()


def test_sums_over_many_tasks_are_those_of_one(spark, monkeypatch):
    x, y, df = table(spark, repeats=2)
    counted = huber.equal_rows(df, df[LABEL])

    def sums():
        return huber.solved(counted, 8, 0.4, 42, lambda total: total(lambda z, y, n: np.concatenate([[n.sum(), n @ y], n @ z])))

    one = sums()
    monkeypatch.setattr(huber, "ROWS_PER_TASK", 300)
    assert one == pytest.approx(sums()) and one[0] == len(x) and one[1] == y.sum()


@pytest.mark.parametrize("penalty", [0.01, 1e-4])
def test_the_objective_is_mllibs_at_its_best(spark, penalty):
    x, y, df = table(spark)
    counted = huber.equal_rows(df, df[LABEL])
    weights, intercept = support.fit_support(counted, 1.0, 24, 0.4, 42, penalty, 100, 1e-3)
    mapped = FourierMap(inputCol=FEATURES, outputCol="_fourier", size=24, gamma=0.4, seed=42).transform(df)
    model = LinearSVC(featuresCol="_fourier", labelCol=LABEL, regParam=penalty, maxIter=150, tol=1e-6).fit(mapped.cache())
    basis = fourier_basis(2, 24, 0.4, 42)
    z, side = np.sqrt(2 / 24) * np.cos(x @ basis[0] + basis[1]), 2 * y - 1
    expected = hinge(z, side, model.coefficients.toArray(), model.intercept, penalty)
    assert hinge(z, side, weights, intercept, penalty) <= expected * 1.002


@pytest.mark.parametrize("classes", [2, 3])
def test_the_family_stores_no_fourier_features(spark, monkeypatch, classes):
    x, y, df = table(spark, classes)
    monkeypatch.setattr(LinearSVC, "fit", lambda *_: pytest.fail("every pass would read stored Fourier features"))
    model = registry("classification")["KernelSVC"](df, Context(len(y), classes, 2, Options(fourier_features=32)))
    found = model.transform(df).orderBy("_rid").collect()
    assert np.mean(np.array([r["prediction"] for r in found]) == y) > 0.85
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and len(r["probability"]) == classes for r in found)


def test_rows_that_repeat_count_as_often(spark):
    _, y, once = table(spark, n=200)
    _, _, thrice = table(spark, n=200, repeats=3)
    options, found = Options(fourier_features=16), []
    for df in (once, thrice):
        model = registry("classification")["KernelSVC"](df, Context(200, 2, 2, options))  # the same penalty
        found.append([r["prediction"] for r in model.transform(once).orderBy("_rid").collect()])
    assert np.mean(np.array(found[0]) == np.array(found[1])) > 0.98
    assert huber.equal_rows(thrice, thrice[LABEL]).count() == 200
