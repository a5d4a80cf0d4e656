"""Fit-once probability models: one shared classifier for every learned decision.

The classifier is Spark ML's gradient-boosted trees on standardised features with balanced
class weights, grown by ``boosting``. It grows level-wise and has no leaf cap, so its scores are not numerically
those of a leaf-wise library; everything downstream only needs a score column.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import KEYS
from ..functions.indicators import FEATURES, features_known, with_features
from ..session import cut_lineage
from .boosting import Rows, spark_model
from .folds import number_bars
from .labels import resolved_before

# The budget every learned decision shares, and the small one of two ablations.
BUDGET = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 30, "seed": 42}
SMALL_BUDGET = {**BUDGET, "maxIter": 50, "maxDepth": 3}

# Rows of a partition of the binned rows: a small table is not split further, a large one has as many partitions as
# there are cores, and more only where one of them would be hard to keep in memory.
ROWS_PER_PARTITION, MOST_ROWS = 50_000, 500_000


def boosting_partitions(rows: int, cores: int) -> int:
    """Each level of each tree is a job, so the number of partitions must not grow with the rows alone."""
    return max(1, min(math.ceil(rows / ROWS_PER_PARTITION), cores), math.ceil(rows / MOST_ROWS))


class TrainingData:
    """Bars with features over each instrument's full history, written once for all fits."""

    def __init__(self, bars: DataFrame):
        self.bars = bars
        self._frame: DataFrame | None = None

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = cut_lineage(number_bars(with_features(self.bars, KEYS)))
        return self._frame

    def where(self, condition: Column) -> "TrainingData":
        """The part of the data that a condition on its keys keeps; the features are those already written."""
        part = TrainingData(self.bars.where(condition))
        part._frame = self.frame.where(condition)
        return part


def pooled(frame: DataFrame, split, horizon: int, label: str = "label") -> DataFrame:
    """Training rows of all instruments: features known, label resolved before the freeze."""
    df = frame.withColumn("_ok", resolved_before(split, horizon, KEYS))
    return df.where(F.col("_ok") & features_known() & F.col(label).isNotNull()).select(
        *FEATURES, F.col(label).cast("double").alias("label"))


def class_weights(train: DataFrame) -> tuple[tuple[float, float], int]:
    """Weights of labels 0 and 1 that give both classes half of the total; also the number of rows."""
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    if not counts:
        raise ValueError("no eligible training rows before the freeze")
    if len(counts) < 2:
        raise ValueError("training labels contain a single class: cannot fit a classifier")
    n = sum(counts.values())
    return (n / (2 * counts[0]), n / (2 * counts[1])), n


class ProbModel:
    """Standardised boosted-tree probability of label 1, frozen after one fit."""

    def __init__(self, **overrides):
        self.params = {**BUDGET, **overrides}
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame) -> "ProbModel":
        """Rows are scaled and binned once and stay on the executors as a few bytes each; every level of a tree is one pass over those."""
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        rows = None
        try:
            weights, n = class_weights(train)
            before = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_raw", handleInvalid="keep"),
                                      StandardScaler(inputCol="_raw", outputCol="_std", withMean=True)]).fit(train)
            trees = GBTClassifier(featuresCol="_std", labelCol="label", weightCol="weight", predictionCol="_pred", **self.params)
            trees.setProbabilityCol("_prob").setRawPredictionCol("_margin")
            scaler = before.stages[-1]
            dev = scaler.std.toArray()
            scale = np.divide(1.0, dev, out=np.zeros_like(dev), where=dev != 0)
            rows = Rows(train, FEATURES, scaler.mean.toArray(), scale, weights, boosting_partitions(n, train.sparkSession.sparkContext.defaultParallelism))
            rows.blocks.count()
            train.unpersist()  # what is kept from here on is a few bytes a row
            made = rows.boosted(trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getMinInstancesPerNode())
            model = trees._copyValues(spark_model(train.sparkSession, made, rows.thresholds, trees.uid))
            self.model = PipelineModel(stages=[*before.stages, model])
        finally:
            if rows is not None:
                rows.release()
            train.unpersist()
        return self

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Add the probability; NULL where any feature is missing. A projection, no shuffle."""
        if self.model is None:
            raise RuntimeError("fit the model before scoring with it")
        kept = df.columns
        scored = self.model.transform(df)
        p = F.when(features_known(), vector_to_array("_prob")[1])
        return scored.select(*kept, p.alias(out))

