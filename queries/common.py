"""Tables the registered queries start from, in both dialects."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans.families import Options
from tabloom.sources.tables import load

CONFIG = Path(__file__).resolve().parent.parent / "config" / "datasets.json"
# the sizes of a full run
OPTIONS = Options()

MIXED_COLUMNS = ("quantity", "l_extendedprice", "l_discount", "l_tax", "flag", "l_linestatus")
MIXED_SQL = """(SELECT
    CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
    l_extendedprice, l_discount, l_tax,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag,
    l_linestatus
  FROM lineitem)"""


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with missing numbers and missing categories."""
    return load(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag",
        "l_linestatus",
    )


ORDER_FEATURES_SQL = """(SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    o_orderstatus,
    o_totalprice * 0.5 + o_custkey * 10 AS y
  FROM orders)"""


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """Orders (unique key) with missing features and a target with signal."""
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "o_orderstatus",
        "o_totalprice * 0.5 + o_custkey * 10 AS y",
    )


def regression_items(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_quantity * 100 * (1 - l_discount) + 50 * l_tax AS y",
    )


def class_items(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "CASE WHEN l_quantity * (1 - l_discount) > 24 THEN 'high' ELSE 'low' END AS size_class",
    )


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
