"""Arrow list columns as matrices and back, without a Python object per row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# partial sums that one task adds up
FAN = 512


def to_matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    if not len(lists):
        return np.empty((0, 0))
    flat = np.asarray(lists.flatten(), dtype=float)
    return flat.reshape(len(lists), -1)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def task_group() -> int:
    """The number of the group of tasks that the running one belongs to, for ``added``."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() // FAN


def added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the arrays ``row`` by ``keys`` (whole numbers), in two levels: first over the tasks of a group (``task``)."""
    names = list(keys)

    def add(table: pa.Table) -> pa.Table:
        held = table["row"].combine_chunks()
        whole = held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1).sum(0)
        return pa.Table.from_arrays([*[table[k].slice(0, 1) for k in names], pa.array([whole.tolist()], pa.list_(pa.float64()))], names=[*names, "row"])

    schema = ", ".join(f"{k} int" for k in names) + ", row array<double>"
    return parts.groupBy(*names, "task").applyInArrow(add, schema).groupBy(*names).applyInArrow(add, schema)
