"""Models that outlive a run, kept under an address that follows from what they were fitted on.

The address of a model is a digest of its training rows and its budget. Rows are digested by an aggregate that does not depend on
their order, so the same bars, freeze and control find the same model again, and a changed bar moves only the models of
pools that hold it. A model is there once its mark is, which is written last: a driver lost while it saves leaves
nothing that a later one would load.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_COMPLETE"


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table as a bag of rows: their number and two sums of hashes of all columns, in the order of names."""
    cols = sorted(rows.columns)
    one = F.xxhash64(*cols).cast("decimal(38,0)")
    other = F.xxhash64(F.lit("other"), *cols[::-1]).cast("decimal(38,0)")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("a"), F.sum(other).alias("b")).first()
    return f"{','.join(cols)}:{r['n']}:{r['a']}:{r['b']}"


class ModelStore:
    """A folder of fitted models that all executors and later runs share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def address(self, rows: DataFrame, params: Mapping) -> str:
        """Where a model of these rows and this budget is kept."""
        what = json.dumps([fingerprint(rows), sorted(params.items())])
        return f"{self.folder}/{hashlib.sha256(what.encode()).hexdigest()}"

    def load(self, address: str) -> PipelineModel | None:
        """The model at an address, or None where no run has completed one."""
        return PipelineModel.load(f"{address}/model") if self._fs(address).exists(self._path(f"{address}/{MARK}")) else None

    def save(self, address: str, model: PipelineModel) -> None:
        """Keeps a model. Of two runs that save at once, both write the same model."""
        model.write().overwrite().save(f"{address}/model")
        self._fs(address).create(self._path(f"{address}/{MARK}"), True).close()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
