"""Robust linear regression (Huber's loss with a scale) over random Fourier features, by Newton steps.

The loss is that of MLlib's ``LinearRegression(loss="huber")``, convex in the weights,
the intercept and the scale together; its penalty is on the weights of scaled features.
A pass over the rows draws their Fourier features anew, a batch at a time, and sums what a
Newton step needs: the products of all pairs of features over the rows whose
residual is small, a matrix whose size follows the features, not the rows; a second pass
compares how far to go. No row of Fourier features is ever stored. Rows of the same features
and label are counted once; rows that all differ are as many as before.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.arrays import added, task_group, to_matrix
from tabloom.operators.kernel import fourier_basis
from tabloom.operators.prep import FEATURES
from tabloom.session import fresh_path, write_table

# beyond it residuals count by their size, not its square (MLlib's default)
EPSILON = 1.35
# pairs of features are held by every task and the driver
WIDEST = 1024
# a step shrinks the scale to this share at least
SHRINK = 0.1
# different rows that a task takes
ROWS_PER_TASK = 50_000
ROWS_PER_STEP = 8_192
# features of so many rows stay in a processor's cache
ROWS_AT_ONCE = 512
# parts of a step that are compared, in one pass without pairs
SHARES = (1.0, 0.8, 0.6, 0.45, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 1e-3, 1e-4)


def equal_rows(df: DataFrame, label: Column) -> DataFrame:
    """``x, y, n``: how many rows have the same features and label, split by the number of such rows and kept."""
    rows = df.select(vector_to_array(F.col(FEATURES)).alias("x"), label.cast("double").alias("y"))
    found = write_table(rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n")), "equal-rows")
    return found.repartition(max(1, -(-found.count() // ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)


def summed(counted: DataFrame, size: int, gamma: float, seed: int, work) -> np.ndarray:
    """The sum over ``equal_rows`` of ``work(fourier features, label, rows)``, an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, total = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch.column("x"))
            if basis is None:
                basis = fourier_basis(x.shape[1], size, gamma, seed)
            y, n = (np.asarray(batch.column(c), float) for c in ("y", "n"))
            for first in range(0, len(x), ROWS_AT_ONCE):
                z = x[first : first + ROWS_AT_ONCE] @ basis[0]
                z += basis[1]
                np.cos(z, out=z)
                z *= np.sqrt(2.0 / size)
                own = work(z, y[first : first + ROWS_AT_ONCE], n[first : first + ROWS_AT_ONCE])
                total = own if total is None else total + own
        if total is not None:
            columns = [pa.array([0], pa.int32()), pa.array([task_group()], pa.int32()), pa.array([total], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "task", "row"])

    parts = counted.select("x", "y", "n").mapInArrow(run, "key int, task int, row array<double>")
    return np.array(added(parts, ["key"]).first()["row"])


def solved(counted: DataFrame, size: int, gamma: float, seed: int, solve) -> np.ndarray:
    """``solve(total)``, where ``total(work)`` is the sum of ``work`` over ``equal_rows``: a job over all tasks, or, for few different rows, all passes in one task."""
    if counted.count() > ROWS_PER_TASK:
        return solve(lambda work: summed(counted, size, gamma, seed, work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows])
        x = to_matrix(held["x"].combine_chunks())
        y, n = (held[c].to_numpy() for c in ("y", "n"))
        basis = fourier_basis(x.shape[1], size, gamma, seed)
        z = np.sqrt(2.0 / size) * np.cos(x @ basis[0] + basis[1])
        starts = range(0, len(z), ROWS_PER_STEP)
        found = solve(lambda work: sum(work(*(c[a : a + ROWS_PER_STEP] for c in (z, y, n))) for a in starts))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], ["row"])

    return np.array(counted.select("x", "y", "n").coalesce(1).mapInArrow(run, "row array<double>").first()["row"])


def scaling(total, size: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and by what each Fourier feature is multiplied to have a deviation of one (steady features: zero)."""
    moments = total(lambda z, y, n: np.concatenate([[n.sum()], n @ z, n @ z**2]))
    rows, mean, square = int(moments[0]), moments[1 : size + 1] / moments[0], moments[size + 1 :] / moments[0]
    spread = np.sqrt(np.maximum(square - mean**2, 0.0) * rows / max(1, rows - 1))
    steady = spread <= 1e-12
    return rows, np.where(steady, 0.0, 1.0 / np.where(steady, 1.0, spread))


def parts_of(z: np.ndarray, y: np.ndarray, n: np.ndarray, scaled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Loss, and over near rows the products of (features, 1, residual), over far rows the signed sums of (features, 1), and how many are far."""
    z = np.column_stack([z * scaled, np.ones(len(z))])
    sigma = at[-1]
    residual = y - z @ at[:-1]
    far = np.abs(residual) > EPSILON * sigma
    near = np.column_stack([z[~far], residual[~far]])
    sign = n[far] * np.sign(residual[far])
    loss = 0.5 * (sigma * n.sum() + n[~far] @ near[:, -1] ** 2 / sigma + n[far] @ (2 * EPSILON * np.abs(residual[far]) - sigma * EPSILON**2))
    return np.concatenate([[loss, n[far].sum()], sign @ z[far], ((near * n[~far, None]).T @ near).ravel()])


def losses_of(z: np.ndarray, y: np.ndarray, n: np.ndarray, scaled: np.ndarray, at: np.ndarray, step: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """The loss at some points on the way from ``at`` along ``step``."""
    z = z * scaled
    start, way = y - z @ at[:-2] - at[-2], z @ step[:-2] + step[-2]
    found = []
    for point in points:
        sigma, share = point[-1], float((point - at) @ step / (step @ step))
        size = np.abs(start - share * way)
        found.append(0.5 * n @ np.where(size > EPSILON * sigma, sigma + 2 * EPSILON * size - sigma * EPSILON**2, sigma + size**2 / sigma))
    return np.array(found)


def newton(sums: np.ndarray, at: np.ndarray, rows: int, penalty: float) -> tuple[float, np.ndarray, float]:
    """Objective, Newton step, and the fall of the objective that it promises."""
    width, sigma = len(at), at[-1]
    far, signs, products = sums[1], sums[2 : 1 + width], sums[1 + width :].reshape(width, width)
    ridge = np.append(np.full(width - 2, penalty), 0.0)  # not on the intercept
    gradient = np.empty(width)
    gradient[:-1] = -(products[:-1, -1] / sigma + EPSILON * signs) / rows + ridge * at[:-1]
    gradient[-1] = 0.5 * (1.0 - (products[-1, -1] / sigma**2 + far * EPSILON**2) / rows)
    hessian = products / rows / sigma
    hessian[-1] /= sigma
    hessian[:, -1] /= sigma
    hessian[np.arange(width - 1), np.arange(width - 1)] += ridge
    # features may hardly differ, and all rows may be far
    hessian[np.arange(width), np.arange(width)] += 1e-12 * np.trace(hessian) / width + 1e-300
    step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    objective = sums[0] / rows + 0.5 * float(ridge @ at[:-1] ** 2)
    return objective, step, float(-gradient @ step) / 2


def fit_huber(df: DataFrame, label: Column, size: int, gamma: float, seed: int, penalty: float, iterations: int, tolerance: float) -> tuple[np.ndarray, float, float]:
    """Weights of the Fourier features, intercept and scale; ends where a step promises less than ``tolerance`` of the objective."""
    counted = equal_rows(df, label)
    found = solved(counted, size, gamma, seed, lambda total: descend(total, size, penalty, iterations, tolerance))
    counted.unpersist()
    return found[:size], float(found[size]), float(found[-1])


def descend(total, size: int, penalty: float, iterations: int, tolerance: float) -> np.ndarray:
    """Weights, intercept and scale; ``total`` sums over all rows."""
    rows, scaled = scaling(total, size)
    at = np.append(np.zeros(size + 1), 1.0)

    def look(point: np.ndarray) -> tuple[float, np.ndarray, float]:
        sums = total(lambda z, y, n: parts_of(z, y, n, scaled, point))
        return newton(sums, point, rows, penalty)

    objective, step, promise = look(at)
    whole = False  # the last step was taken whole
    for _ in range(iterations):
        if promise <= tolerance * abs(objective):
            break
        longest = min(1.0, (1 - SHRINK) * at[-1] / -step[-1]) if step[-1] < 0 else 1.0
        if whole and longest == 1.0:
            found = look(at + step)
            if found[0] < objective:
                at, (objective, step, promise) = at + step, found
                continue
        here, points = at, [at + longest * share * step for share in SHARES]
        losses = total(lambda z, y, n: losses_of(z, y, n, scaled, here, step, points))
        reached = losses / rows + [0.5 * penalty * float((p[:size] ** 2).sum()) for p in points]
        best = int(np.argmin(reached))
        if not reached[best] < objective:
            break
        at, whole = points[best], best == 0
        objective, step, promise = look(at)
    return np.concatenate([at[:size] * scaled, at[size:]])


def stored_linear(spark: SparkSession, weights: np.ndarray, intercept: float, scale: float, params: dict) -> LinearRegressionModel:
    """An MLlib model with these weights."""
    kind = "org.apache.spark.ml.regression.LinearRegressionModel"
    return stored(spark, LinearRegressionModel, kind, weights, intercept, params, scale=scale)


def stored(spark: SparkSession, model, kind: str, weights: np.ndarray, intercept: float, params: dict, **extra: float):
    """A linear model of MLlib's class ``kind``, by its stored form; ``extra`` numbers are stored beside the weights."""
    path, uid = fresh_path(spark, "linear"), f"{model.__name__.removesuffix('Model')}_{uuid.uuid4().hex[:12]}"
    about = {
        "class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
        "uid": uid, "paramMap": params, "defaultParamMap": {},
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    named = [("coefficients", VectorUDT()), ("intercept", T.DoubleType()), *[(name, T.DoubleType()) for name in extra]]
    schema = T.StructType([T.StructField(name, kind_of) for name, kind_of in named])
    spark.createDataFrame([(Vectors.dense(weights), intercept, *extra.values())], schema).coalesce(1).write.parquet(f"{path}/data")
    return model.load(path)
