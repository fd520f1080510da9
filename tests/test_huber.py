import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression

from tabloom.operators import huber
from tabloom.operators.kernel import FourierMap, fourier_basis
from tabloom.operators.prep import FEATURES
from tabloom.plans.families import LABEL, Context, Options, registry


def table(spark, n=800, noise=0.1):
    random = np.random.default_rng(3)
    x = random.normal(size=(n, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] + noise * random.normal(size=n)
    y[::20] += 15 * random.normal(size=len(y[::20]))  # rows that are far off
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "_rid long, x array<double>, _label double").withColumn(FEATURES, array_to_vector("x")).repartition(2)


def test_the_optimum_is_mllibs(spark):
    x, y, df = table(spark)
    weights, intercept, scale = huber.fit_huber(df, df[LABEL], 24, 0.4, 42, 0.01, 100, 1e-9)
    mapped = FourierMap(inputCol=FEATURES, outputCol="_fourier", size=24, gamma=0.4, seed=42).transform(df)
    model = LinearRegression(featuresCol="_fourier", labelCol=LABEL, loss="huber", regParam=0.01, maxIter=500, tol=1e-9).fit(mapped.cache())
    basis = fourier_basis(2, 24, 0.4, 42)
    z = np.sqrt(2 / 24) * np.cos(x @ basis[0] + basis[1])
    assert z @ weights + intercept == pytest.approx(z @ model.coefficients.toArray() + model.intercept, abs=2e-3)
    assert scale == pytest.approx(model.scale, rel=2e-3)


def test_the_family_takes_few_passes_and_no_stored_features(spark, monkeypatch):
    x, y, df = table(spark)
    monkeypatch.setattr(LinearRegression, "fit", lambda *_: pytest.fail("every pass would read stored Fourier features"))
    passes, summed = [], huber.summed
    monkeypatch.setattr(huber, "summed", lambda *a: passes.append(1) or summed(*a))
    model = registry("regression")["KernelHuber"](df, Context(800, 0, 2, Options(fourier_features=32)))
    found = [r["prediction"] for r in model.transform(df).orderBy("_rid").collect()]
    near = np.delete(np.arange(800), np.arange(0, 800, 20))
    assert np.mean((np.array(found) - y)[near] ** 2) < 0.1 * np.var(y[near])
    assert len(passes) < 60
    assert model.stages[1].getOrDefault("loss") == "huber" and model.stages[1].scale > 0
