"""Reading tables: Parquet, and CSV with inferred types."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col

# Text that means "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def header_names(line: str, separator: str = ",") -> list[str]:
    """Column names of a header line: repeats get ``.1``, empties ``Unnamed: i``."""
    raw = next(csv.reader([line], delimiter=separator))
    names: list[str] = []
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        candidate, copy = name, 0
        while candidate in names:
            copy += 1
            candidate = f"{name}.{copy}"
        names.append(candidate)
    return names


def read_csv(
    spark: SparkSession, path: str, separator: str = ",", na_tokens: Sequence[str] = NA_TOKENS, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; types from one aggregate over all columns and rows.

    Whole numbers become bigint, or double if any are missing; other numbers
    double; complete true/false columns boolean; the rest text. Rows with fewer
    fields than the header end in nulls; rows with more are refused, and so are
    files whose header differs from that of the others.
    """
    names = _common_header(spark, path, separator)
    spare = next(n for n in (f"_spare{i}" for i in range(len(names) + 1)) if n not in names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, spare]])
    text = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", separator)
        .option("escape", '"')
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .csv(path)
    )
    clean = text.select(*[F.when(~col(n).isin(*na_tokens), col(n)).alias(n) for n in names], spare)
    kinds, excess = _infer(clean, names, F.count(spare))
    if excess:
        raise ValueError(f"{excess} rows have more fields than the header has names.")
    return clean.select(*[cast_as(n, kind) for n, kind in kinds.items()])


def _common_header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """Column names of the first line that every file at ``path`` begins with."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    begins = lines.where("b = 0").withColumn("at", F.monotonically_increasing_id())
    heads = begins.groupBy("f").agg(F.min_by("value", "at").alias("head")).agg(F.count_distinct("head").alias("n"), F.min("head").alias("head"))
    found = heads.first()
    if not found.n:
        raise ValueError("The file has no header line.")
    if found.n > 1:
        raise ValueError(f"The files at {path} have {found.n} different headers.")
    return header_names(found["head"].lstrip("﻿").rstrip("\r"), separator)


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type of each text column, from one aggregate."""
    return _infer(text, text.columns, F.lit(0))[0]


def _infer(text: DataFrame, names: Sequence[str], excess: Column) -> tuple[dict[str, str], int]:
    checks = [F.count("*").alias("rows"), excess.alias("excess")]
    for i, name in enumerate(names):
        value = col(name)
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(INTEGER) & F.trim(value).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(value.rlike(NUMBER) | value.rlike(INFINITY)).alias(f"d{i}"),
            F.count_if(value.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"b{i}"),
        ]
    found = text.agg(*checks).first()
    kinds = {}
    for i, name in enumerate(names):
        present = found[f"n{i}"]
        if present == 0:
            kinds[name] = "double"
        elif found[f"i{i}"] == present:
            kinds[name] = "bigint" if present == found["rows"] else "double"
        elif found[f"d{i}"] == present:
            kinds[name] = "double"
        elif found[f"b{i}"] == present == found["rows"]:
            kinds[name] = "boolean"
        else:
            kinds[name] = "string"
    return kinds, found["excess"]


def cast_as(name: str, kind: str) -> Column:
    if kind == "string":
        return col(name)
    if kind == "boolean":
        return col(name).isin(*TRUE_TOKENS).alias(name)
    return F.trim(col(name)).try_cast(kind).alias(name)
