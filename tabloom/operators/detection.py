"""Feature kinds, target checks and problem type."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import FLOATING, as_double, as_text, col, rows_from_columns, text_values

NUMERIC = "numeric"
CATEGORICAL = "categorical"
REGRESSION = "regression"
CLASSIFICATION = "classification"
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
# a numeric target with fewer distinct values is a class label under the cardinality rule
CLASS_LIMIT = 20


@dataclass(frozen=True)
class FeatureSchema:
    numeric: list[str]
    categorical: list[str]


@dataclass(frozen=True)
class Detection:
    problem_type: str
    features: FeatureSchema


def kind_of(data_type: T.DataType, rule: str = "training") -> str:
    """``numeric`` or ``categorical``.

    Booleans count as numbers for training and as categories in the profile.
    """
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, T.BooleanType) and rule == "training":
        return NUMERIC
    return CATEGORICAL


def feature_schema(df: DataFrame, target: str | None = None, rule: str = "training") -> FeatureSchema:
    """Partition the columns by kind, keeping their order. Reads no data."""
    fields = [f for f in df.schema.fields if f.name != target]
    nested = [f.name for f in fields if isinstance(f.dataType, NESTED)]
    if nested:
        raise ValueError(f"Columns {nested} are nested; flatten or drop them first.")
    numeric = [f.name for f in fields if kind_of(f.dataType, rule) == NUMERIC]
    return FeatureSchema(numeric, [f.name for f in fields if f.name not in numeric])


def require_column(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"'{target}' was not found among the columns.")


def split_features(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The feature columns and the target column."""
    require_column(df, target)
    return df.drop(target), df.select(col(target))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` for several columns in one shuffle.

    Counts are combined before the shuffle, so a value that fills a third of
    the rows arrives as one row per task.
    """
    return text_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def feature_types(df: DataFrame, target: str | None = None, rule: str = "training") -> DataFrame:
    """One row per feature: ``position, column, kind, non_null, distinct_values``."""
    schema = feature_schema(df, target, rule)
    columns = [c for c in df.columns if c != target]
    listed = df.sparkSession.createDataFrame(
        [(i, c, NUMERIC if c in schema.numeric else CATEGORICAL) for i, c in enumerate(columns)],
        "position bigint, column string, kind string",
    )
    stats = (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.sum("n").alias("non_null"), F.count("*").alias("distinct_values"))
    )
    return listed.join(stats, "column", "left").select(
        "position",
        "column",
        "kind",
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
    )


def target_validity(df: DataFrame, target: str) -> DataFrame:
    """One row ``column, is_valid``: valid if two distinct non-null values exist.

    Two distinct values exist exactly when the smallest and the largest differ,
    so no distinct and no shuffle is needed.
    """
    require_column(df, target)
    value = as_double(target) if isinstance(df.schema[target].dataType, FLOATING) else col(target)
    return df.agg(F.coalesce(F.min(value) < F.max(value), F.lit(False)).alias("is_valid")).select(
        F.lit(target).alias("column"), "is_valid"
    )


def problem_type_of(data_type: T.DataType) -> str:
    """Any numeric target is regression, whatever its cardinality."""
    return REGRESSION if isinstance(data_type, T.NumericType) else CLASSIFICATION


def few_values(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Distinct values per column, counted up to ``limit``: ``column, distinct_values``.

    A task holds and sends ``limit`` values of a column at most, whatever the
    column holds, and looks at it no more once it has them.
    """
    values = [as_double(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, FLOATING) else col(c) for c in columns]
    narrow = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set] = [set() for _ in columns]
        for batch in batches:
            for i, own in enumerate(held):
                if len(own) < limit:
                    found = pc.drop_null(pc.unique(batch.column(i)))
                    own.update(found.slice(0, 2 * limit).to_pylist())  # enough to fill it up, whatever it holds
        pairs = [(i, str(v)) for i, own in enumerate(held) for v in sorted(own, key=str)[:limit]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.string())], ["position", "value"])

    found = narrow.mapInArrow(bounded, "position int, value string").distinct().groupBy("position").agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column string")
    return listed.join(found, "position", "left").select("column", F.least(F.coalesce("n", F.lit(0)), F.lit(limit)).cast("bigint").alias("distinct_values"))


def problem_types(df: DataFrame, rule: str = "dtype") -> DataFrame:
    """The problem each column would pose as a target: ``column, distinct_values, problem_type``.

    ``rule="dtype"`` looks at the type only; ``rule="cardinality"`` also calls
    a number with fewer than 20 distinct values a class label, and lists columns
    without any value. Distinct values are counted in full under both rules.
    """
    columns = [c for c in df.columns if not isinstance(df.schema[c].dataType, NESTED)]
    by_type = F.create_map(
        *[F.lit(x) for c in columns for x in (c, problem_type_of(df.schema[c].dataType))]
    )
    problem = by_type[F.col("column")]
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    stats = counts.groupBy("column").agg(F.count("*").alias("distinct_values"))
    if rule == "cardinality":
        listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        stats = listed.join(stats, "column", "left").select("column", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))
        problem = F.when(F.col("distinct_values") < CLASS_LIMIT, F.lit(CLASSIFICATION)).otherwise(problem)
    return stats.select("column", "distinct_values", problem.alias("problem_type"))


def detect_problem(
    df: DataFrame, target: str, rule: str = "dtype", task_type: str | None = None
) -> Detection:
    """Check the target, then return the problem type and the feature groups."""
    require_column(df, target)
    if isinstance(df.schema[target].dataType, NESTED):
        raise ValueError(f"Target column '{target}' is nested.")
    if not target_validity(df, target).first()["is_valid"]:
        raise ValueError(
            f"'{target}' needs at least two unique values besides null."
        )
    if len(df.columns) < 2:
        raise ValueError("There must be at least one feature column beside the target.")
    problem = task_type or problem_type_of(df.schema[target].dataType)
    if task_type is None and rule == "cardinality":
        # whether there are fewer than the limit needs no full count
        few = few_values(df, [target], CLASS_LIMIT).first()["distinct_values"] < CLASS_LIMIT
        problem = CLASSIFICATION if few else problem
    return Detection(problem, feature_schema(df, target))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """``column, dtype, non_null_count, unique_values, missing_values``."""
    require_column(df, target)
    text = as_text(df, target)
    return (
        df.select(text.alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_count"),
            F.count("value").alias("unique_values"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_values"),
        )
        .select(
            F.lit(target).alias("column"),
            F.lit(df.schema[target].dataType.simpleString()).alias("dtype"),
            "non_null_count",
            "unique_values",
            "missing_values",
        )
    )


def min_class_count(df: DataFrame, target: str) -> DataFrame:
    """Size of the smallest class, which bounds the number of folds."""
    return (
        df.where(col(target).isNotNull())
        .groupBy(col(target))
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("classes"), F.min("n").alias("min_class_count"))
    )


def wide_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column from one aggregate, one row per column."""
    stats = df.agg(
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    entries = [
        (F.lit(i).cast("bigint"), F.lit(c), F.col(f"m{i}")) for i, c in enumerate(df.columns)
    ]
    return rows_from_columns(stats, entries, ("position", "column", "missing_values"))


def _missing(df: DataFrame, name: str):
    missing = col(name).isNull()
    if isinstance(df.schema[name].dataType, FLOATING):
        missing = missing | F.isnan(col(name))
    return missing
