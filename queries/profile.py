"""Profiling aggregates."""

from __future__ import annotations

from queries.common import MIXED_COLUMNS, MIXED_SQL, mixed, rounded
from tabloom.operators import detection, profiling
from tabloom.sources.tables import load

NUMERIC = ("quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORIES = ("flag", "l_linestatus")


def dataset_summary(spark, sf):
    return profiling.dataset_summary(mixed(spark, sf), "quantity")


SUMMARY = f"""SELECT count(*) AS row_count, 6::BIGINT AS column_count, 3::BIGINT AS numeric_features,
  2::BIGINT AS categorical_features FROM {MIXED_SQL}"""


def describe_all(spark, sf):
    return rounded(profiling.describe_all(mixed(spark, sf)), 5, "mean", "std", "min", "p25", "p50", "p75", "max")


def _describe_sql() -> str:
    parts = []
    for i, c in enumerate(MIXED_COLUMNS):
        if c in NUMERIC:
            quantiles = ", ".join(
                f"round(quantile_cont({c}, {p}::DOUBLE), 5) + 0.0 AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            )
            parts.append(
                f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", count({c}) AS "count", NULL::BIGINT AS "unique",
                NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({c}), 5) + 0.0 AS mean,
                round(stddev_samp({c}), 5) + 0.0 AS std, round(min({c}), 5) + 0.0 AS "min", {quantiles},
                round(max({c}), 5) + 0.0 AS "max" FROM {MIXED_SQL}"""
            )
        else:
            nulls = ", ".join(f'NULL::DOUBLE AS "{n}"' for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
            parts.append(
                f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", sum(n)::BIGINT AS "count", count(*) AS "unique",
                arg_min(v, (-n, v)) AS top, max(n) AS freq, {nulls}
                FROM (SELECT {c} AS v, count(*) AS n FROM {MIXED_SQL} WHERE {c} IS NOT NULL GROUP BY 1)"""
            )
    return " UNION ALL ".join(parts)


def missing_by_column(spark, sf):
    return profiling.missing_by_column(mixed(spark, sf))


MISSING = f"""SELECT * FROM (SELECT 'quantity' AS "column", count(*) - count(quantity) AS missing_values FROM {MIXED_SQL}
  UNION ALL SELECT 'flag', count(*) - count(flag) FROM {MIXED_SQL}) WHERE missing_values > 0"""


def missing_cells(spark, sf):
    return profiling.missing_cells(mixed(spark, sf))


CELLS = f"SELECT 2 * count(*) - count(quantity) - count(flag) AS missing_cells FROM {MIXED_SQL}"


def duplicate_rows(spark, sf):
    return profiling.duplicate_rows(mixed(spark, sf))


DUPLICATES = f"""SELECT sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM {MIXED_SQL}
  GROUP BY {', '.join(MIXED_COLUMNS)})"""


def target_summary(spark, sf):
    return detection.target_summary(mixed(spark, sf), "quantity")


TARGET = f"""SELECT 'quantity' AS "column", 'double' AS dtype, count(quantity) AS non_null_count,
  count(DISTINCT quantity) AS unique_values, count(*) - count(quantity) AS missing_values FROM {MIXED_SQL}"""


def target_histogram(spark, sf):
    return rounded(profiling.histogram(mixed(spark, sf), "l_extendedprice", 30), 6, "bin_start")


def _histogram_sql(column: str, bins: int, feature: bool) -> str:
    name = f"'{column}' AS feature, " if feature else ""
    return f"""SELECT {name}bin, round(lo + bin * ((hi - lo) / {bins}), 6) + 0.0 AS bin_start, count(*) AS n FROM (
      SELECT lo, hi, least(floor(({column} - lo) / ((hi - lo) / {bins}::DOUBLE)), {bins - 1})::BIGINT AS bin
      FROM {MIXED_SQL}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {MIXED_SQL}) WHERE {column} IS NOT NULL)
      GROUP BY bin, lo, hi"""


def numeric_histograms(spark, sf):
    return rounded(profiling.numeric_histograms(mixed(spark, sf), "l_tax"), 6, "bin_start")


def class_balance(spark, sf):
    return profiling.class_balance(mixed(spark, sf), "flag")


BALANCE = f"SELECT coalesce(flag, 'nan') AS target_value, count(*) AS n FROM {MIXED_SQL} GROUP BY 1"


def correlation_matrix(spark, sf):
    source = mixed(spark, sf).selectExpr(*NUMERIC, "2.5D AS constant")
    return rounded(profiling.correlation_matrix(source, [*NUMERIC, "constant"]), 6, "correlation")


def _correlation(a: str, b: str) -> str:
    source = f"(SELECT {a} AS a, {b} AS b FROM {MIXED_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT '{a.split('::')[0] if a != '2.5::DOUBLE' else 'constant'}' AS feature,
      '{b if b != '2.5::DOUBLE' else 'constant'}' AS other,
      round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 6) + 0.0 AS correlation FROM {source}"""


_ALL = (*NUMERIC, "2.5::DOUBLE")
CORRELATIONS = " UNION ALL ".join(_correlation(a, b) for a in _ALL for b in _ALL)


def target_correlation_topk(spark, sf):
    found = profiling.target_correlation_topk(_correlated(spark, sf), "y")
    return rounded(found, 6, "absolute_correlation")


def _correlated(spark, sf):
    return mixed(spark, sf).selectExpr("*", "quantity * 3 - l_discount * 40 AS y")


_Y = f"(SELECT *, quantity * 3 - l_discount * 40 AS y FROM {MIXED_SQL})"
TARGET_CORRELATION = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(abs(covar_pop({c}, y) / nullif(sqrt(var_pop({c}) * var_pop(y)), 0)), 6) + 0.0
    AS absolute_correlation FROM {_Y} WHERE y IS NOT NULL"""
    for c in NUMERIC
)


def top_categories(spark, sf):
    source = load(spark, sf, "orders").selectExpr(
        "o_totalprice", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "concat('C', o_custkey) AS customer",
    )
    return profiling.top_categories(source, "o_totalprice")


TOP = """SELECT "column", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
  FROM (SELECT 'priority' AS "column", coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, 'nan') AS value,
      count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'customer', 'C' || o_custkey, count(*) FROM orders GROUP BY 2)) WHERE rank <= 15"""


def min_class_count(spark, sf):
    return detection.min_class_count(mixed(spark, sf), "flag")


MIN_CLASS = f"""SELECT count(*) AS classes, min(n) AS min_class_count FROM
  (SELECT flag, count(*) AS n FROM {MIXED_SQL} WHERE flag IS NOT NULL GROUP BY 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        dataset_summary, describe_all, missing_by_column, missing_cells, duplicate_rows, target_summary,
        target_histogram, numeric_histograms, class_balance, correlation_matrix, target_correlation_topk,
        top_categories, min_class_count,
    )
}
ORACLES = {
    "dataset_summary": SUMMARY,
    "describe_all": _describe_sql(),
    "missing_by_column": MISSING,
    "missing_cells": CELLS,
    "duplicate_rows": DUPLICATES,
    "target_summary": TARGET,
    "target_histogram": _histogram_sql("l_extendedprice", 30, False),
    "numeric_histograms": " UNION ALL ".join(
        _histogram_sql(c, 25, True) for c in ("quantity", "l_extendedprice", "l_discount")
    ),
    "class_balance": BALANCE,
    "correlation_matrix": CORRELATIONS,
    "target_correlation_topk": TARGET_CORRELATION,
    "top_categories": TOP,
    "min_class_count": MIN_CLASS,
}
