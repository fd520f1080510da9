import pytest
from pyspark.sql import functions as F

from tabloom.operators import folds
from tabloom.operators.ordering import numbered, running
from tabloom.operators.rows import sample_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds most rows."""
    return spark.range(3000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('c', id % 10) END AS c").cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def sizes(df, *groups):
    return df.groupBy(*groups, "fold").count()


def test_range_form_equals_window_form(skewed):
    plain = folds.stratified_folds(skewed, ["c"], 5, ["id"])
    ranged = folds.stratified_folds(skewed, ["c"], 5, ["id"], small_rows=1)
    assert same(plain, ranged)
    spread = sizes(plain, "c").groupBy("c").agg((F.max("count") - F.min("count")).alias("gap"))
    assert spread.agg(F.max("gap")).first()[0] <= 1


@pytest.mark.parametrize("small", [1, 10**6])
def test_without_a_key_copies_are_kept_and_balanced(spark, small):
    copies = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS v", "id % 2 AS c").unionAll(
        spark.createDataFrame([(None, 0)] * 7, "v long, c long")
    )
    found = folds.stratified_folds(copies, ["c"], 4, None, small_rows=small)
    assert same(found.drop("fold"), copies)
    spread = sizes(found, "c").groupBy("c").agg((F.max("count") - F.min("count")).alias("gap"))
    assert spread.agg(F.max("gap")).first()[0] <= 1


def test_copies_are_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(folds, "COPIES_PER_CHUNK", 10)
    copies = spark.createDataFrame([(1, "a")] * 95 + [(2, "a")] * 3, "v long, c string")
    found = folds.stratified_folds(copies, ["c"], 5, None, small_rows=1)
    assert same(found.drop("fold"), copies)
    assert sorted(r["count"] for r in sizes(found).collect()) == [19, 19, 20, 20, 20]


def test_effective_folds(spark):
    tiny = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(8)], "id long, t string")
    assert folds.assign_folds(tiny, "t", "classification", 5, ["id"])[1] == 2
    assert folds.assign_folds(tiny, "id", "regression", 20, ["id"])[1] == 8
    assert folds.effective_folds(5, 1) == 2


def test_numbered_and_running_over_ranges(skewed):
    order = [F.col("id") % 7, F.col("id")]
    assert same(numbered(skewed, ["c"], order), numbered(skewed, ["c"], order, small_rows=1))
    descending = [F.col("id").desc()]
    assert same(numbered(skewed, ["c"], descending), numbered(skewed, ["c"], descending, small_rows=1))

    def state(small):
        last = F.when(F.col("id") % 100 == 0, F.col("c"))
        return running(skewed, [F.col("id")], {"total": F.col("id")}, {"last": last}, small)

    assert same(state(10**6), state(1))


def test_numbering_splits_equal_rows(spark):
    equal = spark.range(400).selectExpr("1 AS k")
    found = numbered(equal, ["k"], [F.col("k")], small_rows=1)
    assert sorted(r["position"] for r in found.collect()) == list(range(1, 401))


def test_large_sample_equals_small_form(skewed):
    assert same(sample_rows(skewed, 700, ["id"]), sample_rows(skewed, 700, ["id"], top_rows=1))
    assert sample_rows(skewed, 10**6, ["id"], top_rows=1).count() == 3000


def test_few_distinct_rows_are_expanded_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(folds, "ROWS_PER_TASK", 500, raising=False)
    df = spark.range(6000).select((F.col("id") % 200).alias("x"), (F.col("id") % 2).alias("c"))
    found = folds.stratified_folds(df, ["c"], 3, small_rows=100).withColumn("task", F.spark_partition_id())
    assert found.groupBy("x", "c").count().where("count = 30").count() == 200
    assert {r["count"] for r in found.groupBy("c", "fold").count().collect()} == {1000}
    sizes = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2000
