"""Data profile: counts, descriptions, histograms, correlations, top categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.arrays import added, task_group
from tabloom.functions.columns import as_double, as_text, col, missing_to_null, rows_from_columns, text_values
from tabloom.functions.quantiles import chunked_agg, exact_quantiles
from tabloom.operators.detection import feature_schema, require_column, value_counts, wide_counts

FLAT = 1e-13  # variance of a constant, in units of its column's variance
QUARTILES = (0.25, 0.5, 0.75)
DESCRIBE_COLUMNS = (
    "position bigint, column string, `count` bigint, `unique` bigint, top string, freq bigint, "
    "mean double, std double, `min` double, p25 double, p50 double, p75 double, `max` double"
)


def dataset_summary(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns, numeric and categorical feature counts (target excluded)."""
    schema = feature_schema(df, target, rule="eda")
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(len(schema.numeric)).cast("bigint").alias("numeric_features"),
        F.lit(len(schema.categorical)).cast("bigint").alias("categorical_features"),
    )


def describe_all(df: DataFrame, exact: bool = True) -> DataFrame:
    """Summary of every column, numeric and categorical, one row each.

    Numeric moments come from one aggregate, quartiles from exact order
    statistics (``exact=False``: from a mergeable sketch in the same pass), and
    unique/top/freq from one combined frequency count. What reaches the driver
    is one short row per column.
    """
    schema = feature_schema(df, rule="eda")
    stats: dict[str, tuple] = {}
    if schema.numeric:
        moments = chunked_agg(df, _moments(schema.numeric, exact))
        if exact:
            quartiles = exact_quantiles(df, {c: as_double(c) for c in schema.numeric}, QUARTILES)
        else:
            quartiles = {c: moments[c, "q"] or [None] * 3 for c in schema.numeric}
        for c in schema.numeric:
            m = {k: moments[c, k] for k in ("count", "mean", "std", "min", "max")}
            stats[c] = (m["count"], None, None, None, m["mean"], m["std"], m["min"], *quartiles[c], m["max"])
    if schema.categorical:
        for row in _category_stats(df, schema.categorical).collect():
            stats[row["column"]] = (row["n"], row["uniques"], row["top"], row["freq"], *[None] * 7)
    empty = (0, *[None] * 10)
    rows = [(i, c, *stats.get(c, empty)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_COLUMNS)


def _moments(columns: list[str], exact: bool) -> dict:
    expressions = {}
    for c in columns:
        x = as_double(c)
        expressions[c, "count"] = F.count(x)
        expressions[c, "mean"] = F.avg(x)
        expressions[c, "std"] = F.stddev_samp(x)
        expressions[c, "min"] = F.min(x)
        expressions[c, "max"] = F.max(x)
        if not exact:
            expressions[c, "q"] = F.percentile_approx(x, list(QUARTILES), 10_000)
    return expressions


def _category_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("uniques"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns that have missing cells, most missing first."""
    return (
        wide_counts(df)
        .where("missing_values > 0")
        .orderBy(F.desc("missing_values"), "position")
        .select("column", "missing_values")
    )


def missing_cells(df: DataFrame) -> DataFrame:
    return wide_counts(df).agg(F.sum("missing_values").alias("missing_cells"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column, nulls being equal."""
    groups = missing_to_null(df).groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram, the maximum in the last bin; empty bins left out."""
    return _binned(df, [column], bins).drop("feature")


def numeric_histograms(df: DataFrame, target: str, features: int = 6, bins: int = 25) -> DataFrame:
    """Histograms of the first numeric features, in long form."""
    chosen = feature_schema(df, target, rule="eda").numeric[:features]
    if not chosen:
        raise ValueError("None of the features is numeric, so there is nothing to bin.")
    return _binned(df, chosen, bins)


def _binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """The limits are one row of constants, so binning is a projection and the
    only thing shuffled is a count per bin."""
    limits = chunked_agg(
        df, {(c, end): f(as_double(c)) for c in columns for end, f in (("lo", F.min), ("hi", F.max))}
    )
    slots, starts = [], []
    for c in columns:
        lo, hi = limits[c, "lo"], limits[c, "hi"]
        if lo is None:  # nothing but missing values
            lo = hi = 0.0
        width = (hi - lo) / float(bins)
        slot = F.least(F.floor((as_double(c) - F.lit(lo)) / F.lit(width or 1.0)), F.lit(bins - 1))
        # least() skips nulls, so a missing value must be kept out of it
        slots.append(F.when(as_double(c).isNotNull(), slot.cast("bigint")).alias(c))
        starts += [F.lit(c), F.struct(F.lit(lo).alias("lo"), F.lit(width).alias("width"))]
    start = F.create_map(*starts)[F.col("feature")]
    counts = (
        df.select(*slots)
        .unpivot([], [col(c) for c in columns], "feature", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )
    return counts.select("feature", "bin", (start["lo"] + F.col("bin") * start["width"]).alias("bin_start"), "n")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, a missing label counted as the text ``nan``."""
    require_column(df, target)
    value = F.coalesce(as_text(df, target), F.lit("nan"))
    return (
        df.groupBy(value.alias("target_value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "target_value")
    )


def _pair_correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are present; null on a constant."""
    x, y = as_double(a), as_double(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form, both triangles.

    One pass for any number of columns. With values centred and missing ones
    zero, sums over the rows where both columns are present are products of the
    value, square and presence matrices, which each task adds up over its rows.
    A task sends an array for each column, and arrays are added in two levels.
    """
    if len(columns) < 2:
        raise ValueError("Correlations take two numeric columns or more.")
    d = len(columns)
    found = chunked_agg(df, {(c, f): g(as_double(c)) for c in columns for f, g in (("m", F.avg), ("s", F.stddev_pop))})
    centre = np.array([found[c, "m"] or 0.0 for c in columns])
    spread = np.array([found[c, "s"] or 1.0 for c in columns])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            present = (~np.isnan(x)).astype(float)
            x = np.nan_to_num((x - centre) / spread, nan=0.0)
            total += [present.T @ present, x.T @ present, (x * x).T @ present, x.T @ x]
        n, s, q, p = total
        # of each column what its correlations take: rows, sums and squares of both, products
        rows = np.concatenate([n, s, q, p, s.T, q.T], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([task_group()] * d, pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], ["a", "task", "row"]
        )

    narrow = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = added(narrow.mapInArrow(products, "a int, task int, row array<double>"), ["a"])
    parts = F.arrays_zip(*[F.slice("row", i * d + 1, d).alias(c) for i, c in enumerate(("n", "s", "q", "p", "s2", "q2"))])
    sums = sums.select("a", F.posexplode(parts).alias("b", "v")).select("a", "b", "v.*")
    n = F.nullif(F.col("n"), F.lit(0.0))
    variances = [F.col(q) / n - F.pow(F.col(m) / n, F.lit(2.0)) for q, m in (("q", "s"), ("q2", "s2"))]
    constant = (variances[0] <= FLAT) | (variances[1] <= FLAT)
    covariance = F.col("p") / n - F.col("s") / n * F.col("s2") / n
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        names[F.col("a")].alias("feature"), names[F.col("b")].alias("other"),
        F.when(~constant, covariance / F.sqrt(variances[0] * variances[1])).alias("correlation"),
    )


def target_correlation_topk(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Numeric features by absolute correlation with the target."""
    features = feature_schema(df, target, rule="eda").numeric
    stats = df.agg(
        *[F.abs(_pair_correlation(c, target)).alias(f"r{i}") for i, c in enumerate(features)]
    )
    entries = [(F.lit(c), F.col(f"r{i}")) for i, c in enumerate(features)]
    return (
        rows_from_columns(stats, entries, ("feature", "absolute_correlation"))
        .orderBy(F.desc_nulls_last("absolute_correlation"), "feature")
        .limit(k)
    )


def top_categories(df: DataFrame, target: str | None, features: int = 4, k: int = 15) -> DataFrame:
    """Most frequent values of the first categorical features, null included."""
    chosen = feature_schema(df, target, rule="eda").categorical[:features]
    if not chosen:
        raise ValueError("None of the features is categorical.")
    texts = text_values(df, chosen).withColumn("value", F.coalesce("value", F.lit("nan")))
    counts = texts.groupBy("column", "value").agg(F.count("*").alias("n"))
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("rank", F.row_number().over(window).cast("bigint"))
        .where(F.col("rank") <= k)
        .select("column", "value", "n", "rank")
    )


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def profile(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """Every table of the data profile, by name."""
    require_column(df, target)
    df = missing_to_null(df)
    schema = feature_schema(df, target, rule="eda")
    report = {
        "summary": dataset_summary(df, target),
        "preview": df.limit(20),
        "describe": describe_all(df),
        "missing": missing_by_column(df),
        "missing_cells": missing_cells(df),
        "duplicates": duplicate_rows(df),
        "target": histogram(df, target) if is_numeric(df, target) else class_balance(df, target),
    }
    if schema.numeric:
        report["histograms"] = numeric_histograms(df, target)
    if len(schema.numeric) >= 2:
        columns = schema.numeric + ([target] if is_numeric(df, target) else [])
        report["correlations"] = correlation_matrix(df, columns)
        if is_numeric(df, target):
            report["target_correlations"] = target_correlation_topk(df, target)
    if schema.categorical:
        report["top_categories"] = top_categories(df, target)
    return report
