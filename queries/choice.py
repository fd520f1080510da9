"""Comparing and selecting models for many runs at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import rounded
from tabloom.operators import selection
from tabloom.sources.tables import load

NAMES = (
    "RandomForestRegressor", "LinearRegression", "KNNRegressor", "SVR", "LightGBMRegressor", "XGBoostRegressor", "Custom",
)


def run_results(spark, sf):
    """One run per supplier, seven models, five folds each."""
    names = F.array(*[F.lit(n) for n in NAMES])
    scores = (
        load(spark, sf, "lineitem")
        .groupBy(
            F.expr("concat('run_', l_suppkey)").alias("run_id"),
            F.expr("l_partkey % 7").alias("position"),
            F.expr("l_orderkey % 5").alias("fold"),
            F.expr("CASE WHEN l_suppkey % 3 = 0 THEN 'RMSE' WHEN l_suppkey % 3 = 1 THEN 'Accuracy' END").alias("metric_name"),
        )
        .agg(F.avg(F.col("l_extendedprice") / F.lit(123457.0)).alias("score"))
    )
    return scores.groupBy("run_id", "position", "metric_name").agg(
        names[F.col("position").cast("int")].alias("model_name"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.count("*").cast("double").alias("train_time"),
    )


RESULTS = f"""results AS MATERIALIZED (SELECT run_id, position, metric_name, ({list(NAMES)})[position + 1] AS model_name,
    avg(score) AS mean_score, stddev_pop(score) AS std_score, count(*)::DOUBLE AS train_time
  FROM (SELECT concat('run_', l_suppkey) AS run_id, l_partkey % 7 AS position, l_orderkey % 5 AS fold,
      CASE WHEN l_suppkey % 3 = 0 THEN 'RMSE' WHEN l_suppkey % 3 = 1 THEN 'Accuracy' END AS metric_name,
      avg(l_extendedprice / 123457::DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
_RANKS = " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in selection.SIMPLICITY.items())
ADJUSTED = f"""adjusted AS MATERIALIZED (SELECT *, coalesce(metric_name, '') LIKE '%RMSE%' AS lower_is_better,
    CASE model_name {_RANKS} ELSE 999 END AS simplicity_rank,
    CASE WHEN coalesce(metric_name, '') LIKE '%RMSE%' THEN mean_score + std_score ELSE mean_score - std_score END AS adjusted_score
  FROM results), ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
    CASE WHEN lower_is_better THEN adjusted_score ELSE -adjusted_score END, position) AS rank FROM adjusted)"""
PICKED = """picked AS (SELECT a.run_id, a.lower_is_better, a.model_name AS a_name, b.model_name AS b_name,
    a.adjusted_score, a.mean_score AS a_mean, b.mean_score AS b_mean, a.std_score AS a_std, a.simplicity_rank AS a_rank,
    abs(a.mean_score - b.mean_score) / greatest(abs(a.mean_score), 1e-12) AS gap_ratio,
    coalesce(abs(a.mean_score - b.mean_score) / greatest(abs(a.mean_score), 1e-12) < 0.01
      AND b.simplicity_rank < a.simplicity_rank, false) AS simpler_wins
  FROM ranked AS a LEFT JOIN ranked AS b ON a.run_id = b.run_id AND b.rank = 2 WHERE a.rank = 1)"""


def adjusted_ranking(spark, sf):
    found = selection.adjusted_ranking(run_results(spark, sf)).select(
        "run_id", "model_name", "mean_score", "std_score", "adjusted_score", "simplicity_rank", "rank"
    )
    return rounded(found, 8, "mean_score", "std_score", "adjusted_score")


ADJUSTED_RANKING = f"""WITH {RESULTS}, {ADJUSTED} SELECT run_id, model_name, round(mean_score, 8) + 0.0 AS mean_score,
  round(std_score, 8) + 0.0 AS std_score, round(adjusted_score, 8) + 0.0 AS adjusted_score, simplicity_rank, rank FROM ranked"""


def select_best(spark, sf):
    found = selection.select_best(run_results(spark, sf)).drop("reasoning")
    return rounded(found, 8, "best_score", "gap_ratio")


SELECT_BEST = f"""WITH {RESULTS}, {ADJUSTED}, {PICKED} SELECT run_id, CASE WHEN simpler_wins THEN b_name ELSE a_name END AS best_model,
  round(CASE WHEN simpler_wins THEN b_mean ELSE a_mean END, 8) + 0.0 AS best_score, b_name AS runner_up,
  round(gap_ratio, 8) + 0.0 AS gap_ratio, simpler_wins FROM picked"""


def selection_reasoning(spark, sf):
    return selection.select_best(run_results(spark, sf)).select("run_id", "reasoning")


REASONING = f"""WITH {RESULTS}, {ADJUSTED}, {PICKED} SELECT run_id, concat_ws(' ',
  'Started with the strongest adjusted score after penalizing variance: ' || a_name || '.',
  format('Adjusted score = {{:.4f}}, mean score = {{:.4f}}, std = {{:.4f}}.', adjusted_score, a_mean, a_std),
  CASE WHEN b_name IS NULL THEN NULL
    WHEN simpler_wins THEN 'The score gap versus ' || b_name || ' is below 1%, so the simpler model was preferred.'
    WHEN lower_is_better THEN a_name || ' kept the lower penalized RMSE over ' || b_name || '.'
    ELSE a_name || ' kept the lead after variance penalty over ' || b_name || '.' END,
  CASE WHEN NOT simpler_wins THEN 'Simplicity rank for the selected model is ' || a_rank || '.' END) AS reasoning FROM picked"""


def model_comparison(spark, sf):
    results = run_results(spark, sf)
    found = selection.model_comparison(results, selection.select_best(results))
    return rounded(found, 8, "mean_score", "std_score")


COMPARISON = f"""WITH {RESULTS}, {ADJUSTED}, {PICKED} SELECT r.run_id, model_name, round(mean_score, 8) + 0.0 AS mean_score,
  round(std_score, 8) + 0.0 AS std_score, train_time, upper(coalesce(metric_name, 'Score')) AS metric_name,
  model_name = CASE WHEN simpler_wins THEN b_name ELSE a_name END AS is_best,
  row_number() OVER (PARTITION BY r.run_id ORDER BY CASE WHEN r.lower_is_better THEN mean_score ELSE -mean_score END, position) AS rank,
  CASE WHEN model_name = CASE WHEN simpler_wins THEN b_name ELSE a_name END THEN 'Best Model' ELSE 'Other Models' END AS highlight
  FROM adjusted AS r JOIN picked AS p ON r.run_id = p.run_id"""

QUERIES = {f.__name__: f for f in (adjusted_ranking, select_best, selection_reasoning, model_comparison)}
ORACLES = {
    "adjusted_ranking": ADJUSTED_RANKING,
    "select_best": SELECT_BEST,
    "selection_reasoning": REASONING,
    "model_comparison": COMPARISON,
}
