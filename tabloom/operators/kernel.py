"""Random Fourier features: a projection that lets linear models act like an
RBF kernel machine (Rahimi and Recht, NIPS 2007)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.arrays import to_lists, to_matrix


def fourier_basis(width: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(seed)
    weights = random.normal(0.0, np.sqrt(2.0 * gamma), (width, size))
    return weights, random.uniform(0.0, 2.0 * np.pi, size)


class FourierMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``sqrt(2/size) * cos(x W + b)`` with a basis drawn from the seed.

    Map-only, one matrix product per Arrow batch; nothing is broadcast, since
    every task can draw the same basis.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, gamma=1.0, seed=42):
        super().__init__()
        self._setDefault(size=256, gamma=1.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))

        @F.arrow_udf("array<double>")
        def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            basis = None
            for vectors in batches:
                x = to_matrix(vectors)
                if basis is None and len(x):
                    basis = fourier_basis(x.shape[1], size, gamma, seed)
                yield to_lists(np.sqrt(2.0 / size) * np.cos(x @ basis[0] + basis[1]) if len(x) else x)

        projected = project(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(projected))


def scaled_gamma(df: DataFrame, features: str) -> float:
    """1 / (number of features x variance of all feature values)."""
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    mean, n = row["mean"].toArray(), row["count"]
    variance = row["variance"].toArray() * ((n - 1) / n if n else 0.0)
    overall = float(np.mean(variance + mean**2) - np.mean(mean) ** 2)
    return 1.0 / (len(mean) * overall) if overall > 0.0 else 1.0
