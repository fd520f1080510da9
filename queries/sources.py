"""Sources, sinks, projections and target checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.common import CONFIG, ORDER_FEATURES_SQL, OPTIONS, order_features, r
from tabloom.operators import detection, folds, rows
from tabloom.plans import tracking
from tabloom.plans.families import parameters_json, registry
from tabloom.plans.training import FULL, context_for, fit_preps, predict, prepared, scoring_pipeline, training_table
from tabloom.session import fresh_path
from tabloom.sources import registry as registries
from tabloom.sources import stores, tables
from tabloom.sources.tables import load


def csv_scan_infer(spark, sf):
    source = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS maybe_cust",
        "o_orderstatus", "o_totalprice", "o_totalprice > 250000 AS is_large",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE o_orderpriority END AS priority",
    )
    path = fresh_path(spark, "csv")
    source.write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


CSV_SCAN = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END::DOUBLE AS maybe_cust,
  o_orderstatus, o_totalprice, o_totalprice > 250000 AS is_large,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"""


def csv_scan_types(spark, sf):
    return spark.createDataFrame(csv_scan_infer(spark, sf).dtypes, "column string, type string")


def sample_seeded(spark, sf):
    return rows.sample_rows(load(spark, sf, "orders"), 1200, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


SAMPLE = """SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY md5(concat_ws('|', '42', o_orderkey::VARCHAR)), o_orderkey LIMIT 1200"""

CREDIT = (
    "CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN 'unknown' "
    "ELSE concat(' ', cast(o_custkey AS {text}), '.5 ') END"
)


def _credit(spark, sf):
    return load(spark, sf, "orders").withColumn("credit", F.expr(CREDIT.format(text="string")))


def registry_apply(spark, sf):
    entry = registries.entries(registries.read_registry(spark, str(CONFIG)))["orders_amount"]
    return registries.apply_entry(_credit(spark, sf), entry)


REGISTRY = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
  try_cast(trim({CREDIT.format(text='varchar')}) AS DOUBLE) AS credit FROM orders"""


def coerce_numeric(spark, sf):
    return rows.coerce_numeric(_credit(spark, sf), "credit").select("o_orderkey", "credit")


COERCE = f"SELECT o_orderkey, try_cast(trim({CREDIT.format(text='varchar')}) AS DOUBLE) AS credit FROM orders"


def report_sink(spark, sf):
    report = detection.value_counts(order_features(spark, sf), ["priority", "o_orderstatus"])
    path = stores.write_report(report, fresh_path(spark, "report"))
    return spark.read.schema("column string, value string, n bigint").option("header", True).csv(path)


REPORT = f"""SELECT 'priority' AS "column", priority AS value, count(*) AS n FROM {ORDER_FEATURES_SQL} GROUP BY 2
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM {ORDER_FEATURES_SQL} GROUP BY 2"""


def _experiment_results(spark, sf):
    names = "element_at(array('LinearRegression', 'KNNRegressor', 'KernelHuber'), cast(l_partkey % 3 AS int) + 1)"
    return (
        load(spark, sf, "lineitem")
        .groupBy(
            F.expr("concat('run_', l_suppkey)").alias("run_id"), F.expr(names).alias("model_name")
        )
        .agg(F.avg(F.col("l_extendedprice") / F.lit(123457.0)).alias("mean_score"))
    )


PARAMETERS = {"LinearRegression": '{"regParam": 0.5}', "KNNRegressor": '{"neighbours": 5}'}


def experiments_append(spark, sf):
    path = fresh_path(spark, "experiments")
    found = tracking.experiment_rows(_experiment_results(spark, sf), PARAMETERS)
    stores.append_table(found, path)
    stores.append_table(found.withColumn("run_id", F.concat(F.col("run_id"), F.lit("_again"))), path)
    return tracking.experiments(spark, path).withColumn("score", r("score", 8))


_RUNS = """(SELECT concat('run_', l_suppkey) AS run_id,
  ['LinearRegression', 'KNNRegressor', 'KernelHuber'][l_partkey % 3 + 1] AS model_name,
  round(avg(l_extendedprice / 123457::DOUBLE), 8) + 0.0 AS score FROM lineitem GROUP BY 1, 2)"""
_PARAMETERS = """CASE model_name WHEN 'LinearRegression' THEN '{"regParam": 0.5}'
  WHEN 'KNNRegressor' THEN '{"neighbours": 5}' ELSE '{}' END"""
EXPERIMENTS = f"""SELECT run_id, model_name, {_PARAMETERS} AS parameters, score FROM {_RUNS}
  UNION ALL SELECT run_id || '_again', model_name, {_PARAMETERS}, score FROM {_RUNS}"""


def experiment_params(spark, sf):
    found = tracking.experiment_rows(_experiment_results(spark, sf), PARAMETERS)
    return found.select(
        "run_id",
        "model_name",
        tracking.parameter("parameters", "regParam").cast("double").alias("reg_param"),
        tracking.parameter("parameters", "neighbours").cast("bigint").alias("neighbours"),
    )


EXPERIMENT_PARAMS = f"""SELECT run_id, model_name, CASE WHEN model_name = 'LinearRegression' THEN 0.5::DOUBLE END AS reg_param,
  CASE WHEN model_name = 'KNNRegressor' THEN 5::BIGINT END AS neighbours FROM {_RUNS}"""


def model_roundtrip(spark, sf):
    """A saved and reloaded pipeline predicts the same for every row."""
    from pyspark.ml import PipelineModel

    table = training_table(order_features(spark, sf), "y", "regression", 2, ["o_orderkey"], ["amount", "priority"])
    prep = fit_preps(table)[FULL]
    family = registry("regression", ["LinearRegression"])["LinearRegression"]
    model = family(prepared(table, prep), context_for(table, FULL, len(prep.feature_names), OPTIONS))
    pipeline = scoring_pipeline(table, prep, model)
    folder = fresh_path(spark, "models")
    row = stores.save_model(
        spark, pipeline, folder, {"model_name": "LinearRegression", "feature_columns": table.feature_columns}
    )
    again, metadata = stores.load_latest(spark, folder)
    assert metadata["path"] == row["path"] and isinstance(again, PipelineModel)
    before = predict(table, pipeline).select("_rid", F.col("predicted").alias("before"))
    after = predict(table, again).select("_rid", F.col("predicted").alias("after"))
    assert "regParam" in parameters_json(model)
    return before.join(after, "_rid").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("before") == F.col("after")).alias("equal_predictions")
    )


MODEL_ROUNDTRIP = "SELECT count(*) AS row_count, count(*) AS equal_predictions FROM orders"
CSV_TYPES = """SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('maybe_cust', 'double'), ('o_orderstatus', 'string'),
  ('o_totalprice', 'double'), ('is_large', 'boolean'), ('priority', 'string')) AS t("column", type)"""


def latest_model(spark, sf):
    store = load(spark, sf, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderstatus") == "F", F.lit(stores.FALLBACK))
        .otherwise(F.concat(F.lit("model_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss")))
        .alias("version"),
        F.concat(F.lit("store/"), F.col("o_orderkey")).alias("path"),
        (F.col("o_orderstatus") == "F").alias("is_fallback"),
    )
    return stores.latest_models(store, ["o_custkey"])


LATEST = """SELECT o_custkey, version, path, is_fallback FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY is_fallback,
      CASE WHEN NOT is_fallback THEN version END DESC NULLS LAST, path DESC) AS place
  FROM (SELECT o_custkey,
      CASE WHEN o_orderstatus = 'F' THEN 'best_model'
           ELSE 'model_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') END AS version,
      'store/' || o_orderkey AS path, o_orderstatus = 'F' AS is_fallback FROM orders)) WHERE place = 1"""


def split_features(spark, sf):
    features, target = detection.split_features(load(spark, sf, "customer"), "c_acctbal")
    assert target.columns == ["c_acctbal"]
    return features


SPLIT = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def target_validity(spark, sf):
    source = order_features(spark, sf).selectExpr("*", "'same' AS constant", "cast(null AS double) AS nothing")
    checked = [detection.target_validity(source, c) for c in ("o_orderstatus", "amount", "constant", "nothing")]
    return reduce(DataFrame.unionByName, checked)


VALIDITY = f"""SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) >= 2 AS is_valid FROM {ORDER_FEATURES_SQL}
  UNION ALL SELECT 'amount', count(DISTINCT amount) >= 2 FROM {ORDER_FEATURES_SQL}
  UNION ALL SELECT 'constant', count(DISTINCT 'same') >= 2 FROM orders
  UNION ALL SELECT 'nothing', false"""

KIND_COLUMNS = ("o_orderkey", "o_custkey", "amount", "priority", "o_orderstatus", "is_large")


def _kinds(spark, sf):
    return order_features(spark, sf).withColumn("is_large", F.col("y") > 150000).select(*KIND_COLUMNS, "y")


def _kind_sql(bool_kind: str) -> str:
    source = f"(SELECT *, y > 150000 AS is_large FROM {ORDER_FEATURES_SQL})"
    numeric = {"o_orderkey", "o_custkey", "amount"} | ({"is_large"} if bool_kind == "numeric" else set())
    return " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", '{"numeric" if c in numeric else "categorical"}' AS kind,
        count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM {source}"""
        for i, c in enumerate(KIND_COLUMNS)
    )


def feature_types(spark, sf):
    return detection.feature_types(_kinds(spark, sf), "y")


def feature_types_eda(spark, sf):
    return detection.feature_types(_kinds(spark, sf), "y", rule="eda")


PROBLEM_COLUMNS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def detect_problem(spark, sf):
    source = load(spark, sf, "lineitem").select(*PROBLEM_COLUMNS)
    assert detection.detect_problem(source, "l_returnflag").problem_type == "classification"
    return detection.problem_types(source)


def detect_problem_cardinality(spark, sf):
    return detection.problem_types(load(spark, sf, "lineitem").select(*PROBLEM_COLUMNS), "cardinality")


def _problem_sql(cardinality: bool) -> str:
    def kind(c):
        by_type = "classification" if c in ("l_returnflag", "l_linestatus") else "regression"
        rule = f"CASE WHEN count(DISTINCT {c}) < 20 THEN 'classification' ELSE '{by_type}' END"
        return rule if cardinality else f"'{by_type}'"

    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, {kind(c)} AS problem_type FROM lineitem"""
        for c in PROBLEM_COLUMNS
    )


def map_codes(spark, sf):
    names = {1: "first", 2: "second", 3: "third", 4: "fourth"}
    mapped = rows.map_codes(load(spark, sf, "lineitem"), "l_linenumber", names, "place")
    return mapped.select("l_orderkey", "l_linenumber", "place")


MAP_CODES = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second'
  WHEN 3 THEN 'third' WHEN 4 THEN 'fourth' END AS place FROM lineitem"""


def preview_rows(spark, sf):
    return rows.preview(load(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


PREVIEW = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20"


def stratified_folds(spark, sf):
    found = folds.stratified_folds(load(spark, sf, "orders"), ["o_orderstatus"], 5, ["o_orderkey"])
    return found.select("o_orderkey", "o_orderstatus", "fold")


STRATIFIED = """SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5(concat_ws('|', '42', o_orderkey::VARCHAR)), o_orderkey) - 1) % 5 AS fold FROM orders"""


def kfold(spark, sf):
    return folds.hash_folds(load(spark, sf, "orders"), 5, ["o_orderkey"]).select("o_orderkey", "fold")


HASH_SQL = "cast('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 8) AS BIGINT)"
KFOLD = f"SELECT o_orderkey, {HASH_SQL} % 5 AS fold FROM orders"


def train_test_split(spark, sf):
    return folds.train_test_split(load(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


SPLIT_TEST = f"SELECT o_orderkey, {HASH_SQL} < {int(0.2 * 2**32)} AS is_test FROM orders"

QUERIES = {
    "csv_scan_infer": csv_scan_infer,
    "csv_scan_types": csv_scan_types,
    "sample_seeded": sample_seeded,
    "registry_apply": registry_apply,
    "coerce_numeric": coerce_numeric,
    "report_sink": report_sink,
    "experiments_append": experiments_append,
    "experiment_params": experiment_params,
    "model_roundtrip": model_roundtrip,
    "latest_model": latest_model,
    "split_features": split_features,
    "target_validity": target_validity,
    "feature_types": feature_types,
    "feature_types_eda": feature_types_eda,
    "detect_problem": detect_problem,
    "detect_problem_cardinality": detect_problem_cardinality,
    "map_codes": map_codes,
    "preview_rows": preview_rows,
    "stratified_folds": stratified_folds,
    "kfold": kfold,
    "train_test_split": train_test_split,
}
ORACLES = {
    "csv_scan_infer": CSV_SCAN,
    "csv_scan_types": CSV_TYPES,
    "model_roundtrip": MODEL_ROUNDTRIP,
    "sample_seeded": SAMPLE,
    "registry_apply": REGISTRY,
    "coerce_numeric": COERCE,
    "report_sink": REPORT,
    "experiments_append": EXPERIMENTS,
    "experiment_params": EXPERIMENT_PARAMS,
    "latest_model": LATEST,
    "split_features": SPLIT,
    "target_validity": VALIDITY,
    "feature_types": _kind_sql("numeric"),
    "feature_types_eda": _kind_sql("categorical"),
    "detect_problem": _problem_sql(False),
    "detect_problem_cardinality": _problem_sql(True),
    "map_codes": MAP_CODES,
    "preview_rows": PREVIEW,
    "stratified_folds": STRATIFIED,
    "kfold": KFOLD,
    "train_test_split": SPLIT_TEST,
}
