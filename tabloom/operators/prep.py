"""Feature preparation: impute, scale, one-hot, assemble.

Fitting never touches a row in Python. For k folds and the full table together
it takes three passes: moments per fold, order statistics, value counts. The
statistics of "all folds but f" are merged on the driver from one short row per
fold. The fitted result is an ordinary ``PipelineModel`` with literal
constants, so it can be saved, and it scores batches and streams alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_double, col, quoted, text_values
from tabloom.functions.quantiles import NOTHING, quantiles_without
from tabloom.operators.detection import FeatureSchema, feature_schema

FULL = -1
FEATURES = "_features"
MAX_CATEGORIES = 100_000


@dataclass
class Prep:
    """A fitted preparation and the names of the features it makes."""

    model: PipelineModel
    feature_names: list[str]
    fills: dict[str, float | str]
    scales: dict[str, tuple[float, float]]
    dropped: list[str] = field(default_factory=list)
    categories: dict[str, tuple[str, list[str]]] = field(default_factory=dict)


def fit_prep(
    df: DataFrame,
    schema: FeatureSchema | None = None,
    numeric_strategy: str = "median",
    categorical_strategy: str = "most_frequent",
    max_categories: int = MAX_CATEGORIES,
) -> Prep:
    """Fit on the whole table."""
    schema = schema or feature_schema(df)
    return fit_fold_preps(df, schema, None, 0, numeric_strategy, categorical_strategy, max_categories)[FULL]


def fit_fold_preps(
    df: DataFrame,
    schema: FeatureSchema,
    fold: str | None,
    k: int,
    numeric_strategy: str = "median",
    categorical_strategy: str = "most_frequent",
    max_categories: int = MAX_CATEGORIES,
) -> dict[int, Prep]:
    """One preparation per held-out fold, and one (``FULL``) for all rows."""
    if numeric_strategy not in ("median", "mean", "most_frequent"):
        raise ValueError(f"Unsupported imputation strategy: {numeric_strategy}")
    if categorical_strategy != "most_frequent":
        raise ValueError(f"Unsupported imputation strategy: {categorical_strategy}")
    parts = [FULL, *range(k)]
    moments = _fold_moments(df, schema.numeric, fold)
    fills = _numeric_fills(df, schema.numeric, fold, parts, moments, numeric_strategy)
    categories = _fold_categories(df, schema.categorical, fold, parts, max_categories)
    preps = {}
    for part in parts:
        numeric = {c: fills[part][c] for c in schema.numeric if fills[part][c] is not None}
        scales = {c: _merged_scale(moments, c, part, fill) for c, fill in numeric.items()}
        known = {c: v for c, v in categories[part].items() if v[1]}
        dropped = [c for c in schema.numeric if c not in numeric]
        dropped += [c for c in schema.categorical if c not in known]
        preps[part] = build_prep(numeric, scales, known, dropped)
    return preps


def build_prep(
    numeric: Mapping[str, float],
    scales: Mapping[str, tuple[float, float]],
    categories: Mapping[str, tuple[str, Sequence[str]]],
    dropped: Sequence[str] = (),
) -> Prep:
    """Assemble the stages from constants; an empty group has no stage."""
    select, inputs, names = ["*"], [], []
    for i, (c, fill) in enumerate(numeric.items()):
        mean, std = scales[c]
        value = f"coalesce(nanvl(cast({quoted(c)} AS double), cast(null AS double)), {_literal(fill)})"
        select.append(f"({value} - {_literal(mean)}) / {_literal(std)} AS _num{i}")
        inputs.append(f"_num{i}")
        names.append(f"numeric__{c}")
    for i, (c, (mode, labels)) in enumerate(categories.items()):
        select.append(f"coalesce(cast({quoted(c)} AS string), {_text(mode)}) AS _cat{i}")
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(select)} FROM __THIS__")]
    helpers = [f"_num{i}" for i in range(len(numeric))] + [f"_cat{i}" for i in range(len(categories))]
    if categories:
        raw = [f"_cat{i}" for i in range(len(categories))]
        index = [f"_idx{i}" for i in range(len(categories))]
        hot = [f"_hot{i}" for i in range(len(categories))]
        # unseen values go to the extra last index, which the encoder leaves out
        for i, (_, labels) in enumerate(categories.values()):
            stages.append(
                StringIndexerModel.from_labels(
                    list(labels), inputCol=raw[i], outputCol=index[i], handleInvalid="keep"
                )
            )
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
        inputs += hot
        helpers += index + hot
        names += [f"categorical__{c}_{v}" for c, (_, labels) in categories.items() for v in labels]
    if not inputs:
        raise ValueError("No usable feature columns: every column is empty.")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(helpers)}) FROM __THIS__"))
    known = {c: (mode, list(labels)) for c, (mode, labels) in categories.items()}
    return Prep(_with_encoder(stages, numeric, categories), names, _fills(numeric, categories), dict(scales), list(dropped), known)


def impute(df: DataFrame, prep: Prep) -> DataFrame:
    """Fill missing values in place; columns that are all missing are dropped."""
    filled = {
        c: F.coalesce(as_double(c) if isinstance(fill, float) else col(c).cast("string"), F.lit(fill))
        for c, fill in prep.fills.items()
    }
    return df.drop(*prep.dropped).withColumns(filled)


def scale(df: DataFrame, prep: Prep) -> DataFrame:
    """Fill, then centre and scale the numeric columns in place."""
    scaled = {c: (col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in prep.scales.items()}
    return impute(df, prep).withColumns(scaled)


def matrix_rows(df: DataFrame, prep: Prep, key: Sequence[str]) -> DataFrame:
    """The feature matrix in long form: ``key..., position, value``."""
    vector = vector_to_array(F.col(FEATURES))
    return prep.model.transform(df).select(*[col(k) for k in key], F.posexplode(vector).alias("position", "value"))


def _with_encoder(stages, numeric, categories) -> PipelineModel:
    """Fit the encoder on an empty table: its sizes come from column metadata."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    fields = [T.StructField(c, T.DoubleType()) for c in numeric]
    fields += [T.StructField(c, T.StringType()) for c in categories]
    empty = spark.createDataFrame([], T.StructType(fields))
    fitted = []
    for stage in stages:
        if isinstance(stage, OneHotEncoder):
            stage = stage.fit(empty)
        empty = stage.transform(empty)
        fitted.append(stage)
    return PipelineModel(fitted)


def _fills(numeric, categories):
    return dict(numeric) | {c: mode for c, (mode, _) in categories.items()}


def _literal(value: float) -> str:
    return f"double('{float(value)!r}')"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold_moments(df: DataFrame, numeric: Sequence[str], fold: str | None) -> dict:
    """``{column: {fold: (rows, present, mean, var_pop)}}`` in one pass."""
    if not numeric:
        return {}
    group = col(fold) if fold else F.lit(0)
    expressions = [F.count("*").alias("n")]
    for i, c in enumerate(numeric):
        x = as_double(c)
        expressions += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    rows = df.groupBy(group.cast("int").alias("part")).agg(*expressions).collect()
    return {
        c: {r["part"]: (r["n"], r[f"n{i}"], r[f"m{i}"] or 0.0, r[f"v{i}"] or 0.0) for r in rows}
        for i, c in enumerate(numeric)
    }


def _merge(blocks: Sequence[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Combine (count, mean, sum of squared deviations) blocks."""
    n, mean, spread = 0, 0.0, 0.0
    for size, m, s in blocks:
        if size:
            total = n + size
            delta = m - mean
            spread += s + delta * delta * n * size / total
            mean += delta * size / total
            n = total
    return n, mean, spread


def _merged_scale(moments: dict, column: str, held_out: int, fill: float) -> tuple[float, float]:
    """Mean and population deviation after imputation; a constant scales by 1."""
    blocks = []
    for part, (rows, present, mean, variance) in moments[column].items():
        if part != held_out or held_out == FULL:
            blocks += [(present, mean, variance * present), (rows - present, float(fill), 0.0)]
    n, mean, spread = _merge(blocks)
    std = math.sqrt(max(spread, 0.0) / n) if n else 0.0
    return mean, std if std > 0.0 else 1.0


def _numeric_fills(df, numeric, fold, parts, moments, strategy) -> dict[int, dict[str, float | None]]:
    if strategy == "mean":
        fills: dict[int, dict[str, float | None]] = {}
        for part in parts:
            fills[part] = {}
            for c in numeric:
                blocks = [(p, m, 0.0) for f, (_, p, m, _) in moments[c].items() if part == FULL or f != part]
                n, mean, _ = _merge(blocks)
                fills[part][c] = mean if n else None
        return fills
    if strategy == "most_frequent":
        modes = _fold_categories(df, numeric, fold, parts, None)
        return {p: {c: float(modes[p][c][0]) if c in modes[p] else None for c in numeric} for p in parts}
    known = {NOTHING if part == FULL else part: part for part in parts}
    medians = quantiles_without(df, {c: as_double(c) for c in numeric}, [0.5], col(fold) if fold else None, list(known))
    return {part: {c: medians[key, c][0] for c in numeric} for key, part in known.items()}


def _fold_categories(df, columns, fold, parts, max_categories):
    """Mode and sorted labels per part: ``{part: {column: (mode, labels)}}``.

    One shuffle of combined counts serves every fold. Only labels that a model
    could hold are collected; a wider column is refused, not cut.
    """
    found: dict[int, dict] = {part: {} for part in parts}
    if not columns:
        return found
    keep = [fold] if fold else []
    long = text_values(df, columns, keep).where(F.col("value").isNotNull())
    per_part = [
        F.count_if(F.lit(True) if part == FULL else col(fold) != part).alias(f"p{i}")
        for i, part in enumerate(parts)
    ]
    counts = long.groupBy("column", "value").agg(*per_part)
    if max_categories is not None:
        counts = counts.persist()
        sizes = counts.groupBy("column").agg(F.count("*").alias("n")).collect()
        wide = [r["column"] for r in sizes if r["n"] > max_categories]
        if wide:
            counts.unpersist()
            raise ValueError(
                f"Columns {wide} have more than {max_categories} categories; drop them or raise max_categories."
            )
    wanted = []
    for i in range(len(parts)):
        seen = F.when(F.col(f"p{i}") > 0, F.struct(-F.col(f"p{i}"), _value_order(df, columns)))
        wanted.append(F.min_by("value", seen).alias(f"mode{i}"))
        if max_categories is not None:
            wanted.append(F.sort_array(F.collect_list(F.when(F.col(f"p{i}") > 0, F.col("value")))).alias(f"labels{i}"))
    for row in counts.groupBy("column").agg(*wanted).collect():
        for i, part in enumerate(parts):
            if row[f"mode{i}"] is not None:
                found[part][row["column"]] = (row[f"mode{i}"], row[f"labels{i}"] if max_categories is not None else [])
    if max_categories is not None:
        counts.unpersist()
    return found


def _value_order(df, columns):
    """Ties go to the smallest value: as a number for numbers, as text otherwise."""
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in columns)
    return F.col("value").cast("double") if numeric else F.col("value")
