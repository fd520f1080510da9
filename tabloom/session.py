"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
ROWS_PER_PART = 2_000_000


def local_session(cores: int | str = "*", app: str = "tabloom", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster the session comes from ``spark-submit`` and nothing here
    overrides its settings.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without that setting gets a temporary folder;
    on a cluster a missing setting is an error, because a folder on one machine
    is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tabloom-")
    return _local_dirs[app]


def checkpoint_folder(spark: SparkSession) -> None:
    """Give checkpoints a folder under the shared one, unless the session has one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_dir(spark)}/tabloom/checkpoints")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tabloom/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint does, survives the loss of executors,
    and unlike a checkpoint keeps column pruning and filter pushdown for the
    jobs that follow.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_within(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows.

    A plain count combines within each task (and reads only footers of a
    Parquet table); counting a ``limit`` would send every task's rows to one.
    """
    return df.count() <= rows


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a table of ``rows`` rows: the setting, or more if needed."""
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, setting, -(-rows // ROWS_PER_PART))


def run_jobs(calls: Iterable[Callable[[], Any]], parallelism: int = 4) -> list[Any]:
    """Submit independent Spark jobs from driver threads, results in order."""
    calls = list(calls)
    if parallelism <= 1 or len(calls) <= 1:
        return [call() for call in calls]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(calls))) as pool:
        inherit = inheritable_thread_target(SparkSession.getActiveSession())
        futures = [pool.submit(inherit(call)) for call in calls]
        return [future.result() for future in futures]
