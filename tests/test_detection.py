import pytest

from tabloom.operators import detection


def test_kinds_follow_the_rule(spark):
    df = spark.createDataFrame([(1, 2.5, "a", True)], "n long, d double, s string, b boolean")
    assert detection.feature_schema(df).numeric == ["n", "d", "b"]
    assert detection.feature_schema(df, rule="eda").categorical == ["s", "b"]


def test_regression_for_any_number(spark):
    df = spark.createDataFrame([(20, "x", 1.0), (30, "y", 2.0)], "age long, city string, price double")
    found = detection.detect_problem(df, "price")
    assert found.problem_type == "regression"
    assert found.features.numeric == ["age"] and found.features.categorical == ["city"]
    assert detection.detect_problem(df, "price", rule="cardinality").problem_type == "classification"
    assert detection.detect_problem(df, "price", task_type="classification").problem_type == "classification"


@pytest.mark.parametrize("value", ["string", "boolean", "date"])
def test_classification_for_the_rest(spark, value):
    column = {"string": "cast(id AS string)", "boolean": "id = 0", "date": "date_add(date'2024-01-01', cast(id AS int))"}
    df = spark.range(2).selectExpr("id AS feature", f"{column[value]} AS target")
    assert detection.detect_problem(df, "target").problem_type == "classification"


def test_errors(spark):
    one = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "feature long, target string")
    with pytest.raises(ValueError, match="was not found"):
        detection.detect_problem(one, "other")
    with pytest.raises(ValueError, match="at least two unique"):
        detection.detect_problem(one, "target")
    with pytest.raises(ValueError, match="at least one feature column"):
        detection.detect_problem(spark.createDataFrame([(1.0,), (2.0,)], "target double"), "target")
    with pytest.raises(ValueError, match="nested"):
        detection.detect_problem(one.selectExpr("array(feature) AS f", "feature AS target"), "target")


def test_nan_is_not_a_value(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "t double, f long")
    assert not detection.target_validity(df, "t").first()["is_valid"]
    found = detection.target_summary(df, "t").first()
    assert (found["non_null_count"], found["unique_values"], found["missing_values"]) == (1, 1, 2)


def test_cardinality_counts_all_distinct_values(spark):
    df = spark.range(500).selectExpr("id % 300 AS many", "cast(id % 19 AS double) / 2 AS few", "cast(null AS double) AS none", "cast(id AS string) AS text")
    found = {r["column"]: (r["distinct_values"], r["problem_type"]) for r in detection.problem_types(df, "cardinality").collect()}
    assert found == {"many": (300, "regression"), "few": (19, "classification"), "none": (0, "classification"), "text": (500, "classification")}
    assert detection.detect_problem(df, "many", rule="cardinality").problem_type == "regression"
    assert detection.detect_problem(df, "few", rule="cardinality").problem_type == "classification"
