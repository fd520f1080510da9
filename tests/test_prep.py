import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import features, prep
from tabloom.operators.detection import FeatureSchema, feature_schema


@pytest.fixture(scope="module")
def people(spark):
    rows = [(25.0, 40.0, "north", "x"), (None, 55.0, "south", None), (35.0, None, "north", "y"), (45.0, 80.0, None, "x")]
    return spark.createDataFrame(rows, "age double, income double, city string, segment string")


def matrix(df, fitted):
    rows = fitted.model.transform(df).select(vector_to_array(prep.FEATURES)).collect()
    return np.array([r[0] for r in rows])


def test_no_missing_value_is_left(people):
    fitted = prep.fit_prep(people)
    found = matrix(people, fitted)
    assert found.shape == (4, 6) and np.isfinite(found).all()
    assert fitted.fills == {"age": 35.0, "income": 55.0, "city": "north", "segment": "x"}
    assert found[:, :2].mean(axis=0) == pytest.approx([0, 0]) and found[:, :2].std(axis=0) == pytest.approx([1, 1])
    assert sorted(fitted.feature_names)[:2] == ["categorical__city_north", "categorical__city_south"]


def test_unknown_category_is_all_zero(spark, people):
    fitted = prep.fit_prep(people)
    new = spark.createDataFrame([(30.0, 50.0, "west", "z")], people.schema)
    assert matrix(new, fitted)[0, 2:].tolist() == [0.0] * 4


def test_edge_columns(spark):
    df = spark.createDataFrame([(None, 5.0, float("nan"), True), (None, 5.0, 2.0, False)], "e double, c double, n double, b boolean")
    fitted = prep.fit_prep(df)
    assert fitted.dropped == ["e"] and fitted.fills["n"] == 2.0 and fitted.scales["c"] == (5.0, 1.0)
    assert np.isfinite(matrix(df, fitted)).all()


def test_fold_preps_equal_refits(spark):
    df = spark.range(200).selectExpr(
        "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id * id % 101 AS double) END AS x",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('v', id % 4) END AS s",
        "cast(id % 3 AS int) AS fold",
    )
    schema = FeatureSchema(["x"], ["s"])
    for strategy in ("median", "mean"):
        together = prep.fit_fold_preps(df, schema, "fold", 3, strategy)
        for f in range(3):
            alone = prep.fit_prep(df.where(F.col("fold") != f), schema, strategy)
            assert together[f].fills["x"] == pytest.approx(alone.fills["x"])
            assert together[f].fills["s"] == alone.fills["s"]
            assert together[f].scales["x"] == pytest.approx(alone.scales["x"])
            assert together[f].feature_names == alone.feature_names


def test_quotes_and_dots_in_names_and_values(spark):
    df = spark.createDataFrame([(1.0, "it's"), (2.0, "b\\c"), (None, None)], "`a.b` double, `c d` string")
    assert np.isfinite(matrix(df, prep.fit_prep(df))).all()


def test_too_many_categories_are_refused(spark):
    df = spark.range(50).selectExpr("cast(id AS string) AS s")
    with pytest.raises(ValueError, match="more than 10 categories"):
        prep.fit_prep(df, max_categories=10)


def test_engineering_pipeline(spark, people):
    fitted = prep.fit_prep(people, feature_schema(people))
    data = fitted.model.transform(people).withColumn("label", (F.coalesce("income", F.lit(0.0)) > 50).cast("double"))
    pipeline = features.engineering_pipeline("label", "classification", enable_polynomial_features=True, k=3)
    assert len(pipeline.fit(data).transform(data).first()["_selected"]) == 3
