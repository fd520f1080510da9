"""Monitoring totals kept up to date by a stream.

Each batch of the stream writes its own totals per window and model, one small
row each, and the totals are the sums over all batches. No window is ever closed,
so an event counts however late it comes. A batch that is replayed after a
failure overwrites its own folder, so nothing is counted twice. A compaction folds
all batches but the last, which alone can be replayed, into one snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.sources import snapshots

WINDOWS = (
    "window_start timestamp, model string, ok boolean, predictions bigint, events bigint, "
    "last_ts timestamp, last_id bigint"
)


def window_totals(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling windows over events with ``ts, event_id, model, ok, predictions``."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(F.window("ts", width), "model", "ok")
        .agg(
            F.sum("predictions").alias("predictions"),
            F.count("*").alias("events"),
            F.max(F.struct("ts", "event_id")).alias("last"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "model", "ok", "predictions", "events",
            F.col("last.ts").alias("last_ts"),
            F.col("last.event_id").alias("last_id"),
        )
    )


def start(events: DataFrame, path: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Process what is there, writing the totals of each batch, late events included."""

    def write(batch: DataFrame, number: int) -> None:
        window_totals(batch, width).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        events.writeStream
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _merged(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("window_start", "model", "ok").agg(
        F.sum("predictions").alias("predictions"),
        F.sum("events").alias("events"),
        F.max(F.struct("last_ts", "last_id")).alias("last"),
    )
    return found.select("window_start", "model", "ok", "predictions", "events", "last.last_ts", "last.last_id")


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in snapshots.names_under(spark, path, "batch="))


def _rows(spark: SparkSession, path: str, folder: str | None, batches: list[int]) -> DataFrame:
    parts = [f"{folder}/windows"] if folder else []
    parts += [f"{path}/batch={n}" for n in batches]
    return spark.read.schema(WINDOWS).parquet(*parts) if parts else spark.createDataFrame([], WINDOWS)


def current_windows(spark: SparkSession, path: str) -> DataFrame:
    """The totals of every window and model: the snapshot, and the batches after it."""
    folder, upto, _ = snapshots.latest(spark, path)
    return _merged(_rows(spark, path, folder, [n for n in _batches(spark, path) if n > upto]))


def compact(spark: SparkSession, path: str) -> None:
    """Fold all batches but the last into a new snapshot, then remove their folders."""
    folder, upto, _ = snapshots.latest(spark, path)
    batches = _batches(spark, path)
    fold = [n for n in batches[:-1] if n > upto]
    if fold:
        snapshots.commit(spark, path, {"windows": _merged(_rows(spark, path, folder, fold))}, max(fold))
    for n in batches[:-1]:
        snapshots.remove(spark, f"{path}/batch={n}")


def totals_from_windows(windows: DataFrame) -> DataFrame:
    """``total_predictions, error_count, last_model_used`` over all windows."""
    served = F.when(F.col("ok"), F.struct("last_ts", "last_id"))
    return windows.agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("predictions"))), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("events"))), F.lit(0)).alias("error_count"),
        F.max_by("model", served).alias("last_model_used"),
    )
