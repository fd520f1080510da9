"""Feature engineering: variance filter, univariate selection, polynomials."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, UnivariateFeatureSelector, VarianceThresholdSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_double, col, rows_from_columns
from tabloom.operators.detection import REGRESSION
from tabloom.operators.prep import FEATURES


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """``feature, variance, kept`` for every column, from one aggregate."""
    stats = df.agg(*[F.var_samp(as_double(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    entries = [
        (F.lit(c), F.col(f"v{i}"), F.coalesce(F.col(f"v{i}") > threshold, F.lit(False)))
        for i, c in enumerate(columns)
    ]
    return rows_from_columns(stats, entries, ("feature", "variance", "kept"))


def feature_scores(df: DataFrame, features: Sequence[str], target: str, problem_type: str) -> DataFrame:
    """``feature, f_value``: univariate F statistic of every numeric feature.

    Regression: from the squared correlation. Classification: one-way analysis
    of variance from count, mean and variance per class, so that only one
    combined row per class is shuffled.
    """
    if problem_type == REGRESSION:
        return _regression_f(df, features, target)
    return _anova_f(df, features, target)


def _regression_f(df, features, target):
    expressions, entries = [], []
    for i, c in enumerate(features):
        x, y = as_double(c), as_double(target)
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        spread = F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))
        expressions += [F.pow(F.covar_pop(x, y), F.lit(2.0)) / spread, F.count_if(both)]
        r2, n = F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")
        entries.append((F.lit(c), r2 / F.nullif(F.lit(1.0) - r2, F.lit(0.0)) * (n - 2)))
    stats = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(expressions)])
    return rows_from_columns(stats, entries, ("feature", "f_value"))


def _anova_f(df, features, target):
    per_class = []
    for i, c in enumerate(features):
        x = as_double(c)
        per_class += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    classes = df.where(col(target).isNotNull()).groupBy(col(target)).agg(*per_class)
    totals, entries = [], []
    for i, c in enumerate(features):
        n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
        # spread of the class means, weighted by class size, around their own mean
        totals += [
            F.sum(n).alias(f"n{i}"),
            F.count_if(n > 0).alias(f"k{i}"),
            F.sum(n * v).alias(f"within{i}"),
            (F.sum(n * m * m) - F.pow(F.sum(n * m), F.lit(2.0)) / F.nullif(F.sum(n), F.lit(0))).alias(f"between{i}"),
        ]
        between = F.col(f"between{i}") / F.nullif(F.col(f"k{i}") - 1, F.lit(0))
        within = F.col(f"within{i}") / F.nullif(F.col(f"n{i}") - F.col(f"k{i}"), F.lit(0))
        entries.append((F.lit(c), between / F.nullif(within, F.lit(0.0))))
    return rows_from_columns(classes.agg(*totals), entries, ("feature", "f_value"))


def select_features(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str, k: int = 10
) -> DataFrame:
    """The ``k`` most informative features by F statistic."""
    scores = feature_scores(df, features, target, problem_type)
    return scores.orderBy(F.desc_nulls_last("f_value"), "feature").limit(k)


def polynomial_features(df: DataFrame, columns: Sequence[str], prefix: str = "numeric__") -> DataFrame:
    """Squares and pairwise products as plain projections."""
    products = []
    for a, b in combinations_with_replacement(columns, 2):
        name = f"{prefix}{a}^2" if a == b else f"{prefix}{a} {prefix}{b}"
        products.append((as_double(a) * as_double(b)).alias(name))
    return df.select("*", *products)


def engineering_pipeline(
    label: str,
    problem_type: str,
    enable_feature_selection: bool = True,
    enable_variance_filter: bool = True,
    enable_polynomial_features: bool = False,
    k: int = 50,
) -> Pipeline:
    """The same steps over an assembled vector, as a pipeline."""
    stages, current = [], FEATURES
    if enable_polynomial_features:
        stages.append(PolynomialExpansion(degree=2, inputCol=current, outputCol="_poly"))
        current = "_poly"
    if enable_variance_filter:
        stages.append(VarianceThresholdSelector(featuresCol=current, outputCol="_varied", varianceThreshold=0.0))
        current = "_varied"
    if enable_feature_selection:
        selector = UnivariateFeatureSelector(
            featuresCol=current, labelCol=label, outputCol="_selected", selectionMode="numTopFeatures"
        )
        selector.setFeatureType("continuous").setSelectionThreshold(k)
        selector.setLabelType("continuous" if problem_type == REGRESSION else "categorical")
        stages.append(selector)
    return Pipeline(stages=stages)
