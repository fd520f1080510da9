"""Rows counted by the bins of their features: trees see nothing else of a row but its label.

The number of cells follows from the bins and the features, not from the rows. A
cell is one number, the bins of a row as digits of a mixed base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.arrays import to_matrix
from tabloom.operators.prep import FEATURES

LARGEST_CELL = 2**62


def bin_counts(cuts: list[np.ndarray]) -> list[int]:
    return [len(c) + 1 for c in cuts]


def numberable(cuts: list[np.ndarray]) -> bool:
    """Whether a long can tell all cells."""
    return math.prod(bin_counts(cuts)) < LARGEST_CELL


def cells_at(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The cell of each row."""
    cell = np.zeros(len(x), np.int64)
    for i, size in enumerate(bin_counts(cuts)):
        cell = cell * size + np.searchsorted(cuts[i], x[:, i], "left")
    return cell


def binned(df: DataFrame, label: str, cuts: list[np.ndarray], key: Column) -> DataFrame:
    """``cell, y, key`` of each row."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells_at(to_matrix(batch.column("x")), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y"), batch.column("key")], ["cell", "y", "key"])

    rows = df.select(vector_to_array(F.col(FEATURES)).alias("x"), F.col(label).cast("double").alias("y"), key.cast("long").alias("key"))
    return rows.mapInArrow(number, "cell long, y double, key long")


def counted(df: DataFrame, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """``cell, y, n``: rows by cell and label, added up within batches only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = to_matrix(batch.column("x")), np.asarray(batch.column("y"), float)
            cell = cells_at(x, cuts)
            order = np.lexsort((y, cell))
            cell, y = cell[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (y[1:] != y[:-1])]))
            n = np.diff(np.append(first, len(y)))
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(y[first]), pa.array(n, pa.int64())], ["cell", "y", "n"])

    rows = df.select(vector_to_array(F.col(FEATURES)).alias("x"), F.col(label).cast("double").alias("y"))
    return rows.mapInArrow(count, "cell long, y double, n long")


def by_label(pieces: DataFrame) -> DataFrame:
    """``cell, y, n`` with a row per cell and label."""
    return pieces.groupBy("cell", "y").agg(F.sum("n").alias("n"))


def by_mean(pieces: DataFrame) -> DataFrame:
    """``cell, y, n`` with a row per cell and the mean of its labels."""
    total = F.sum("n")
    return pieces.groupBy("cell").agg((F.sum(F.col("y") * F.col("n")) / total).alias("y"), total.alias("n"))


def bins_of(cell: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Features x cells."""
    bins = np.empty((len(cuts), len(cell)), np.uint8)
    for i, size in reversed(list(enumerate(bin_counts(cuts)))):
        cell, digit = np.divmod(cell, size)
        bins[i] = digit
    return bins
