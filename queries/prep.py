"""Feature preparation and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import MIXED_SQL, ORDER_FEATURES_SQL, mixed, order_features, r, rounded
from tabloom.operators import features, prep
from tabloom.operators.detection import FeatureSchema
from tabloom.plans.training import encode_labels, label_values
from tabloom.sources.tables import load

NUMBERS = FeatureSchema(["quantity", "l_discount"], [])


def impute_median(spark, sf):
    source = mixed(spark, sf).select("quantity", "l_discount")
    return prep.impute(source, prep.fit_prep(source, NUMBERS))


def _impute_sql(fill: str) -> str:
    filled = f"coalesce(quantity, (SELECT {fill} FROM {MIXED_SQL}))"
    return f"SELECT round({filled}, 6) + 0.0 AS quantity, l_discount FROM {MIXED_SQL}"


def impute_mean(spark, sf):
    source = mixed(spark, sf).select("quantity", "l_discount")
    return rounded(prep.impute(source, prep.fit_prep(source, NUMBERS, "mean")), 6, "quantity")


def impute_mode(spark, sf):
    source = mixed(spark, sf).select("flag", "l_linestatus")
    return prep.impute(source, prep.fit_prep(source, FeatureSchema([], ["flag", "l_linestatus"])))


IMPUTE_MODE = f"""SELECT coalesce(flag, (SELECT flag FROM {MIXED_SQL} WHERE flag IS NOT NULL GROUP BY flag
  ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, l_linestatus FROM {MIXED_SQL}"""


def standard_scale(spark, sf):
    source = mixed(spark, sf).select("quantity", "l_discount")
    return rounded(prep.scale(source, prep.fit_prep(source, NUMBERS)), 6, "quantity", "l_discount")


SCALE = f"""SELECT round((q - avg(q) OVER ()) / coalesce(nullif(stddev_pop(q) OVER (), 0), 1), 6) + 0.0 AS quantity,
  round((l_discount - avg(l_discount) OVER ()) / coalesce(nullif(stddev_pop(l_discount) OVER (), 0), 1), 6) + 0.0 AS l_discount
  FROM (SELECT coalesce(quantity, (SELECT quantile_cont(quantity, 0.5::DOUBLE) FROM {MIXED_SQL})) AS q, l_discount FROM {MIXED_SQL})"""

_MODE = f"""(SELECT priority FROM {ORDER_FEATURES_SQL} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_LABELS = f"""(SELECT priority AS label, row_number() OVER (ORDER BY priority) - 1 AS place FROM
  (SELECT DISTINCT priority FROM {ORDER_FEATURES_SQL} WHERE priority IS NOT NULL))"""


def one_hot(spark, sf):
    source = order_features(spark, sf).select("o_orderkey", "priority")
    fitted = prep.fit_prep(source, FeatureSchema([], ["priority"]))
    return prep.matrix_rows(source, fitted, ["o_orderkey"]).withColumn("position", F.col("position").cast("bigint"))


ONE_HOT = f"""SELECT o_orderkey, place AS position, (coalesce(priority, {_MODE}) = label)::INT::DOUBLE AS value
  FROM {ORDER_FEATURES_SQL}, {_LABELS}"""


def preprocess_matrix(spark, sf):
    source = order_features(spark, sf).select("o_orderkey", "amount", "priority")
    fitted = prep.fit_prep(source, FeatureSchema(["amount"], ["priority"]))
    names = features_lookup(fitted.feature_names)
    rows = prep.matrix_rows(source, fitted, ["o_orderkey"])
    return rows.select("o_orderkey", names[F.col("position")].alias("feature"), r("value").alias("value"))


def features_lookup(names):
    return F.array(*[F.lit(n) for n in names])


_AMOUNT = f"""(SELECT o_orderkey, priority, coalesce(amount, (SELECT quantile_cont(amount, 0.5::DOUBLE)
  FROM {ORDER_FEATURES_SQL})) AS amount FROM {ORDER_FEATURES_SQL})"""
MATRIX = f"""SELECT o_orderkey, 'numeric__amount' AS feature,
    round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 6) + 0.0 AS value FROM {_AMOUNT}
  UNION ALL SELECT o_orderkey, 'categorical__priority_' || label, (coalesce(priority, {_MODE}) = label)::INT::DOUBLE
  FROM {_AMOUNT}, {_LABELS}"""


def preprocess_unseen(spark, sf):
    """Fitted without one category; its rows become zeros."""
    source = order_features(spark, sf).select("o_orderkey", "amount", "priority")
    known = source.where("priority IS NULL OR priority <> '5-LOW'")
    fitted = prep.fit_prep(known, FeatureSchema(["amount"], ["priority"]))
    names = features_lookup(fitted.feature_names)
    rows = prep.matrix_rows(source, fitted, ["o_orderkey"])
    return rows.select("o_orderkey", names[F.col("position")].alias("feature"), r("value").alias("value"))


_KNOWN = f"(SELECT * FROM {ORDER_FEATURES_SQL} WHERE priority IS NULL OR priority <> '5-LOW')"
_KNOWN_FILL = f"(SELECT quantile_cont(amount, 0.5::DOUBLE) FROM {_KNOWN})"
_KNOWN_STATS = f"(SELECT avg(a) AS m, stddev_pop(a) AS s FROM (SELECT coalesce(amount, {_KNOWN_FILL}) AS a FROM {_KNOWN}))"
_KNOWN_MODE = f"(SELECT priority FROM {_KNOWN} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_KNOWN_LABELS = f"(SELECT DISTINCT priority AS label FROM {_KNOWN} WHERE priority IS NOT NULL)"
UNSEEN = f"""SELECT o_orderkey, 'numeric__amount' AS feature,
    round((coalesce(amount, {_KNOWN_FILL}) - m) / s, 6) + 0.0 AS value FROM {ORDER_FEATURES_SQL}, {_KNOWN_STATS}
  UNION ALL SELECT o_orderkey, 'categorical__priority_' || label,
    (coalesce(priority, {_KNOWN_MODE}) = label)::INT::DOUBLE FROM {ORDER_FEATURES_SQL}, {_KNOWN_LABELS}"""


def label_encode(spark, sf):
    source = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    encoded = encode_labels(source, "o_orderpriority", label_values(source, "o_orderpriority"), "label")
    return encoded.withColumn("label", F.col("label").cast("bigint"))


ENCODE = """SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders"""


def label_roundtrip(spark, sf):
    from pyspark.ml.feature import IndexToString

    source = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    labels = label_values(source, "o_orderpriority")
    encoded = encode_labels(source, "o_orderpriority", labels, "label")
    return IndexToString(inputCol="label", outputCol="decoded", labels=labels).transform(encoded).select(
        "o_orderkey", "decoded"
    )


ROUNDTRIP = "SELECT o_orderkey, o_orderpriority AS decoded FROM orders"
FILTERED = ("quantity", "l_extendedprice", "l_discount", "l_tax", "constant")


def variance_filter(spark, sf):
    source = mixed(spark, sf).selectExpr("*", "7.0D AS constant")
    return rounded(features.variance_filter(source, FILTERED, 0.001), 6, "variance")


VARIANCE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(var_samp({'7.0::DOUBLE' if c == 'constant' else c}), 6) + 0.0 AS variance,
    var_samp({'7.0::DOUBLE' if c == 'constant' else c}) > 0.001 AS kept FROM {MIXED_SQL}"""
    for c in FILTERED
)
SELECTED = ("quantity", "l_discount", "l_tax", "l_extendedprice")


def select_features(spark, sf):
    """Regression and classification at once, by F statistic."""
    source = mixed(spark, sf).selectExpr("*", "quantity * 3 - l_discount * 40 AS y")
    by_number = features.select_features(source, SELECTED, "y", "regression", 4)
    by_class = features.select_features(source, SELECTED, "flag", "classification", 4)
    both = by_number.withColumn("target", F.lit("y")).unionByName(by_class.withColumn("target", F.lit("flag")))
    return rounded(both, 4, "f_value")


_F_NUMBER = " UNION ALL ".join(
    f"""SELECT 'y' AS target, '{c}' AS feature, round(r2 / (1 - r2) * (n - 2), 4) + 0.0 AS f_value FROM (
      SELECT power(covar_pop({c}, y), 2) / (var_pop({c}) * var_pop(y)) AS r2, count(*) AS n
      FROM (SELECT *, quantity * 3 - l_discount * 40 AS y FROM {MIXED_SQL}) WHERE y IS NOT NULL)"""
    for c in SELECTED
)
_F_CLASS = " UNION ALL ".join(
    f"""SELECT 'flag', '{c}', round((between_ss / (k - 1)) / (within_ss / (n - k)), 4) + 0.0 FROM (
      SELECT sum(n * power(m - grand, 2)) AS between_ss, sum(n * v) AS within_ss, count(*) AS k, sum(n) AS n FROM (
        SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM {MIXED_SQL} WHERE flag IS NOT NULL GROUP BY flag),
        (SELECT avg({c}) AS grand FROM {MIXED_SQL} WHERE flag IS NOT NULL))"""
    for c in SELECTED
)


def polynomial_features(spark, sf):
    source = mixed(spark, sf).select("quantity", "l_discount")
    return features.polynomial_features(source, ["quantity", "l_discount"])


POLYNOMIAL = f"""SELECT quantity, l_discount, quantity * quantity AS "numeric__quantity^2",
  quantity * l_discount AS "numeric__quantity numeric__l_discount", l_discount * l_discount AS "numeric__l_discount^2" FROM {MIXED_SQL}"""

QUERIES = {
    f.__name__: f
    for f in (
        impute_median, impute_mean, impute_mode, standard_scale, one_hot, preprocess_matrix, preprocess_unseen,
        label_encode, label_roundtrip, variance_filter, select_features, polynomial_features,
    )
}
ORACLES = {
    "impute_median": _impute_sql("quantile_cont(quantity, 0.5::DOUBLE)"),
    "impute_mean": _impute_sql("avg(quantity)"),
    "impute_mode": IMPUTE_MODE,
    "standard_scale": SCALE,
    "one_hot": ONE_HOT,
    "preprocess_matrix": MATRIX,
    "preprocess_unseen": UNSEEN,
    "label_encode": ENCODE,
    "label_roundtrip": ROUNDTRIP,
    "variance_filter": VARIANCE,
    "select_features": f"{_F_NUMBER} UNION ALL {_F_CLASS}",
    "polynomial_features": POLYNOMIAL,
}
