"""Batch scoring with the latest saved model."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector  # noqa: F401 - registers the vector type
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import missing_to_null
from tabloom.plans.monitoring import record_failure, record_prediction
from tabloom.sources.stores import load_latest

INTERNAL = (
    "_features", "_fourier", "_platt_prediction", "_platt_raw", "rawPrediction", "probability", "prediction",
)


def scored(records: DataFrame, pipeline: PipelineModel, feature_columns: Sequence[str]) -> DataFrame:
    """Records with ``predicted``; checks that the model's features are there."""
    missing = [c for c in feature_columns if c not in records.columns]
    if missing:
        raise ValueError(f"Prediction failed: records lack the feature columns {missing}.")
    taken = [c for c in ("prediction", "predicted", "probability", "rawPrediction") if c in records.columns]
    if taken:
        raise ValueError(f"Prediction failed: rename the columns {taken} of the records.")
    out = pipeline.transform(missing_to_null(records))
    if "predicted" not in out.columns:
        out = out.withColumn("predicted", F.col("prediction"))
    return out.drop(*INTERNAL)


def score_latest(records: DataFrame, folder: str, output: str, events: str | None = None) -> DataFrame:
    """Score with the newest model and write the result; returns the rows of this call.

    Each call writes ``output/run=<id>``, so ``output`` read as one table holds
    all calls. The records are counted in what was written.
    """
    spark = records.sparkSession
    written = f"{output}/run={uuid.uuid4().hex[:12]}"
    try:
        pipeline, metadata = load_latest(spark, folder)
        result = scored(records, pipeline, metadata["feature_columns"])
        result.write.parquet(written)
    except Exception as error:
        if events:
            record_failure(spark, events, f"batch_prediction_failure: {error}")
        raise
    found = spark.read.schema(result.schema).parquet(written)
    if events:
        record_prediction(spark, events, metadata["model_name"], found.count())
    return found
