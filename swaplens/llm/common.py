"""What the corpus operators share: tables written between steps, blocks of bounded size, components of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only on a local master where nothing is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("swaplens.work.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("swaplens.work.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """What this application writes between steps lies below it."""
    return f"{work_folder(spark)}/corpus-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove the tables between steps, when the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under names of its own, so that further columns cannot clash."""
    return docs.select(
        docs[id_col].cast("long").alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *(docs[m] for m in more)
    )


def numbered(df: DataFrame, order: list[Column], label: str, weight: Column | None = None) -> DataFrame:
    """`df` in global order with `before`: the rows (or the summed weight) that come before each row.

    Rows are dealt by range, numbered inside each range and shifted by the totals of earlier ranges, so no task
    sees more than one range. Ties in `order` share nothing: they are dealt and numbered like other rows.
    """
    weight = F.lit(1) if weight is None else weight
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    return shifted(parts, weight).drop("_part", "_at")


def shifted(parts: DataFrame, weight: Column) -> DataFrame:
    """Running totals over rows written with `_part` (their range) and `_at` (their place in it)."""
    from pyspark.sql import Window

    totals = parts.groupBy("_part").agg(F.sum(weight).alias("_total"))  # one row per range: as many as tasks wrote
    earlier = totals.select(
        "_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(earlier, "_part").withColumn("before", (F.col("_own") + F.col("_base")).cast("long")).drop("_own", "_base")


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node in `links` (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star passes until nothing moves. A star's centre is found by an aggregate with
    map-side combine and joined back, so that a node with very many links never has them gathered in one place.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("b", "m").union(down.select("a", "m")).toDF("a", "b").filter("a <> b").distinct()
        edges = written(small, label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
