"""Continuous scoring with a saved pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.scoring import scored


def start(
    records: DataFrame, pipeline: PipelineModel, feature_columns: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Score every new record once and append it to ``path``."""
    return (
        scored(records, pipeline, feature_columns)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
