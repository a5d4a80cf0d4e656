"""Session settings the engine expects; a cluster sets its own sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


LOCAL = "swaplens.run.dir"  # where a session on one machine keeps its tables


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("swaplens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once, as Parquet in the run's folder, and continue from it.

    Used where many plans start from one costly table. It survives the loss of executors and
    keeps column pruning and statistics for its readers. ``release`` removes what a run wrote.
    """
    path = f"{run_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one that ``spark.checkpoint.dir`` names.

    Only a session on one machine may leave that unset; it gets a temporary folder. On a cluster a
    local folder would be another one on each executor, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(LOCAL, None)
    if base is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(LOCAL, base)
    return f"{base.rstrip('/')}/swaplens-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove the tables that this application's ``cut_lineage`` has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
