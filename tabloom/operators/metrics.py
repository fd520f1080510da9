"""Evaluation metrics as single aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.operators.detection import CLASSIFICATION


def accuracy(actual: Column, predicted: Column) -> Column:
    return F.avg(F.coalesce((actual == predicted).cast("double"), F.lit(0.0)))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0))))


def score(problem_type: str, actual: Column, predicted: Column) -> Column:
    return accuracy(actual, predicted) if problem_type == CLASSIFICATION else rmse(actual, predicted)


def counted_score(problem_type: str, actual: Column, predicted: Column, n: Column) -> Column:
    """The score of rows that stand for ``n`` rows each."""
    if problem_type == CLASSIFICATION:
        return F.sum(F.coalesce((actual == predicted).cast("double"), F.lit(0.0)) * n) / F.sum(n)
    return F.sqrt(F.sum(F.pow(actual - predicted, F.lit(2.0)) * n) / F.sum(n))


def metric_name(problem_type: str) -> str:
    return "Accuracy" if problem_type == CLASSIFICATION else "RMSE"


def evaluate(df: DataFrame, problem_type: str, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """``accuracy``, or ``r2, mae, rmse``; optionally per group.

    One pass: the total spread comes from the variance, not from a second scan.
    Regression metrics are over rows that have both values.
    """
    y, p = col(actual), col(predicted)
    if problem_type == CLASSIFICATION:
        metrics = [accuracy(y, p).alias("accuracy")]
    else:
        total = F.nullif(F.var_pop(F.when(p.isNotNull(), y)), F.lit(0.0))
        metrics = [
            (F.lit(1.0) - F.avg(F.pow(y - p, F.lit(2.0))) / total).alias("r2"),
            F.avg(F.abs(y - p)).alias("mae"),
            rmse(y, p).alias("rmse"),
        ]
    return df.groupBy(*[col(g) for g in groups]).agg(*metrics)


def fold_scores(df: DataFrame, problem_type: str, actual: str, predicted: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(col(fold)).agg(score(problem_type, col(actual), col(predicted)).alias("score"))


def cv_summary(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.groupBy(*[col(g) for g in groups]).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, zeros: bool = True) -> DataFrame:
    """Counts over the labels seen in the actual values.

    Predictions outside those labels are ignored. With ``zeros`` every pair of
    labels has a row; without, only pairs that occur, which is the form for very
    many classes. Rows are only counted.
    """
    counts = (
        df.where(col(actual).isNotNull())
        .groupBy(col(actual).alias("actual"), col(predicted).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )
    found = df.where(col(actual).isNotNull()).select(col(actual).alias("label")).distinct()
    if not zeros:
        return counts.join(found, F.col("predicted") == F.col("label")).select("actual", "predicted", "n")
    labels = found.agg(F.sort_array(F.collect_set("label")).alias("labels"))  # one entry per class
    rows = labels.select(F.explode("labels").alias("actual"), "labels")
    grid = rows.select("actual", F.explode("labels").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``actual, predicted, residual`` per row."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    return df.select(y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def residual_bins(df: DataFrame, actual: str, predicted: str, bins: int = 50) -> DataFrame:
    """Residual plot data of bounded size: residual range per slice of predictions."""
    table = residuals(df, actual, predicted).where(F.col("predicted").isNotNull())
    low, high = table.agg(F.min("predicted"), F.max("predicted")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((F.col("predicted") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return table.groupBy(slot.cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("predicted").alias("predicted"),
        F.avg("residual").alias("mean_residual"),
        F.min("residual").alias("min_residual"),
        F.max("residual").alias("max_residual"),
    )
