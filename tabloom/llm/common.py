"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# text that one step of a task works on; more rows only make more steps
STEP_BYTES = 8 << 20


def col(name: str) -> Column:
    """A column by its whole name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these for helper columns, none of which ``df`` has, case ignored."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those with one of these names, case ignored."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(col(name), F.lit(""))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column`` each; one row at least."""
    if not batch.num_rows:
        return
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    first, base = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(ends.searchsorted(base + limit, "right")))
        yield batch.slice(first, last - first)
        first, base = last, int(ends[last - 1])


def utf8(array: pa.Array) -> pa.Array:
    """Plain strings without nulls, offsets from zero."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")
