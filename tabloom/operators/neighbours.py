"""Nearest-neighbour models as pipeline stages."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.knn import majority, mean_value, nearest, vector_array, vote_shares


class _NeighbourParams(Params):
    neighbours = Param(Params._dummy(), "neighbours", "how many neighbours vote", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "vector column", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)
    row_id = Param(Params._dummy(), "row_id", "unique bigint per row, breaks ties", TypeConverters.toString)

    def _init_params(self, **values):
        self._setDefault(neighbours=5, classes=0, features="_features", label="_label", row_id="_rid")
        self._set(**values)


class Neighbours(Estimator, _NeighbourParams):
    def __init__(self, **values):
        super().__init__()
        self._init_params(**values)

    def _fit(self, dataset: DataFrame) -> "NeighboursModel":
        references = dataset.select(
            F.col(self.getOrDefault(self.row_id)).cast("bigint").alias("ref"),
            vector_array(self.getOrDefault(self.features)).alias("vector"),
            F.col(self.getOrDefault(self.label)).cast("double").alias("value"),
        )
        model = NeighboursModel(references)
        return self._copyValues(model)


class NeighboursModel(Model, _NeighbourParams, MLWritable, MLReadable):
    """Holds the references as a DataFrame; they are stored next to the model."""

    def __init__(self, references: DataFrame | None = None):
        super().__init__()
        self._init_params()
        self.references = references

    def _transform(self, dataset: DataFrame) -> DataFrame:
        k, classes = self.getOrDefault(self.neighbours), self.getOrDefault(self.classes)
        queries = dataset.withColumn("vector", vector_array(self.getOrDefault(self.features)))
        found = nearest(queries, self.references, k).drop("vector")
        near = F.col("neighbours")
        if classes:
            found = found.withColumn("prediction", majority(near))
            found = found.withColumn("probability", array_to_vector(vote_shares(near, classes)))
        else:
            found = found.withColumn("prediction", mean_value(near))
        return found.drop("neighbours")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: NeighboursModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.references.write.parquet(path + "/references")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NeighboursModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        spark = SparkSession.getActiveSession()
        model = self.cls(spark.read.parquet(path + "/references"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
