from datetime import UTC, datetime

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from tabloom import session
from tabloom.plans import monitoring, tracking
from tabloom.plans import scoring
from tabloom.plans.scoring import scored
from tabloom.sources import registry, stores, tables


@pytest.fixture
def pipeline():
    return PipelineModel([SQLTransformer(statement="SELECT *, x * 2 AS prediction FROM __THIS__")])


def test_metrics_follow_events(spark, tmp_path):
    path = str(tmp_path / "events")
    assert monitoring.metrics(spark, path) == {"total_predictions": 0, "error_count": 0, "last_model_used": None}
    monitoring.record_prediction(spark, path, "KNN", 3)
    after = monitoring.record_failure(spark, path, "bad_request: no such column")
    assert after == {"total_predictions": 3, "error_count": 1, "last_model_used": "KNN"}
    events = spark.read.parquet(path)
    assert [tuple(r) for r in monitoring.errors_by_class(events).collect()] == [("bad_request", 1)]
    last = monitoring.running_state(events).orderBy("ts").collect()[-1]
    assert (last["total_predictions"], last["error_count"], last["last_model_used"]) == (3, 1, "KNN")


def test_latest_model(spark, tmp_path, pipeline):
    folder = str(tmp_path / "store")
    assert stores.latest_model(spark, folder) is None
    assert not stores.readiness(spark, folder)["ready"]
    with pytest.raises(FileNotFoundError):
        stores.load_latest(spark, folder)
    stores.save_model(spark, pipeline, folder, {"model_name": "old"}, is_fallback=True)
    assert stores.latest_model(spark, folder)["model_name"] == "old"
    for day in (2, 1):
        stores.save_model(spark, pipeline, folder, {"model_name": f"day{day}"}, now=datetime(2024, 1, day, tzinfo=UTC))
    found = stores.latest_model(spark, folder)
    assert found["version"] == "model_20240102_000000" and found["model_name"] == "day2"


def test_scoring_checks_columns(spark, pipeline):
    records = spark.createDataFrame([(1.0, "kept")], "x double, other string")
    assert scored(records, pipeline, ["x"]).first().asDict() == {"x": 1.0, "other": "kept", "predicted": 2.0}
    with pytest.raises(ValueError, match="lack the feature columns"):
        scored(records, pipeline, ["x", "y"])
    with pytest.raises(ValueError, match="rename"):
        scored(records.withColumnRenamed("other", "prediction"), pipeline, ["x"])


def test_experiment_rows(spark):
    results = spark.createDataFrame([("r", "A", 0.5), ("r", "B", 0.6)], "run_id string, model_name string, mean_score double")
    rows = tracking.experiment_rows(results, {"A": '{"alpha": 1}'}).orderBy("model_name").collect()
    assert [r["parameters"] for r in rows] == ['{"alpha": 1}', "{}"]


CSV = """zero,zero,,flag,n,mixed,text,blank
1,1.5,a,True,1,1,NA,
2,2e3,b,false,NA,x,"q, ""r""\",
3,-.5,c,TRUE,3,2,nan,
"""


def test_csv_refuses_long_rows_and_other_headers(spark, tmp_path):
    (tmp_path / "long.csv").write_text("x,y\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="1 rows have more fields"):
        tables.read_csv(spark, str(tmp_path / "long.csv"))
    (tmp_path / "short.csv").write_text("x,y\n1,2\n6\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "short.csv")).orderBy("x").collect()] == [(1, 2.0), (6, None)]
    for i, head in enumerate(("a,b", "b,a")):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"{i}.csv").write_text(f"{head}\n1,2\n")
    with pytest.raises(ValueError, match="2 different headers"):
        tables.read_csv(spark, str(tmp_path / "many"))


def test_scoring_returns_the_rows_of_the_call(spark, tmp_path, pipeline):
    folder, output = str(tmp_path / "store"), str(tmp_path / "out")
    stores.save_model(spark, pipeline, folder, {"model_name": "m", "feature_columns": []})
    for n in (3, 5):
        assert scoring.score_latest(spark.range(n).withColumnRenamed("id", "x"), folder, output, str(tmp_path / "events")).count() == n
    assert spark.read.parquet(output).count() == 8
    assert monitoring.metrics(spark, str(tmp_path / "events"))["total_predictions"] == 8


def test_csv_names_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {
        "zero": "bigint", "zero.1": "double", "Unnamed: 2": "string", "flag": "boolean", "n": "double",
        "mixed": "string", "text": "string", "blank": "double",
    }
    row = df.collect()[1]
    assert row["n"] is None and row["text"] == 'q, "r"' and row["zero.1"] == 2000.0 and row["flag"] is False


def test_registry(spark, tmp_path):
    from queries.common import CONFIG

    found = registry.entries(registry.read_registry(spark, str(CONFIG)))
    assert found["customer_profile"].default_target is None
    df = spark.createDataFrame([(1, " 7.5 ", "x"), (2, " ", "y")], "o_custkey long, credit string, o_orderdate string")
    rows = registry.apply_entry(df, found["orders_amount"]).collect()
    assert [r.asDict() for r in rows] == [{"credit": 7.5}, {"credit": None}]


def test_written_tables_go_to_the_named_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    session.write_table(spark.range(3), "t")
    assert [p.name for p in tmp_path.iterdir()] == ["tabloom"]
