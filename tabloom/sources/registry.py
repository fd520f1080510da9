"""Dataset registry: which columns to drop or convert, and the default target."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.operators.rows import numeric_or_null

SCHEMA = (
    "version bigint, root_collections map<string,string>, datasets array<struct<id:string, name:string, "
    "path:string, `group`:string, role:string, task_type:string, default_target:string, "
    "drop_columns:array<string>, drop_or_convert_columns:map<string,string>, notes:array<string>>>"
)
CONVERT = "convert_to_numeric"
DROP = "drop"


@dataclass(frozen=True)
class Entry:
    id: str
    name: str
    path: str
    task_type: str = "unspecified"
    default_target: str | None = None
    drop_columns: tuple[str, ...] = ()
    drop_or_convert_columns: dict[str, str] = field(default_factory=dict)
    group: str | None = None
    role: str | None = None
    notes: tuple[str, ...] = ()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per data set."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return whole.select(F.explode("datasets").alias("d")).select("d.*")


def entries(registry: DataFrame) -> dict[str, Entry]:
    return {
        r["id"]: Entry(
            r["id"], r["name"], r["path"], r["task_type"] or "unspecified", r["default_target"],
            tuple(r["drop_columns"] or ()), dict(r["drop_or_convert_columns"] or {}),
            r["group"], r["role"], tuple(r["notes"] or ()),
        )
        for r in registry.collect()
    }


def apply_entry(df: DataFrame, entry: Entry) -> DataFrame:
    """Drop and convert the columns an entry names; unknown names are ignored."""
    dropped = set(entry.drop_columns)
    dropped |= {c for c, action in entry.drop_or_convert_columns.items() if action == DROP}
    converted = {c for c, action in entry.drop_or_convert_columns.items() if action == CONVERT}
    columns = []
    for name in df.columns:
        if name not in dropped:
            columns.append(numeric_or_null(col(name)).alias(name) if name in converted else col(name))
    return df.select(*columns)
