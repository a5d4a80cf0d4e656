"""Committed tables: rewritten at their own path, whole after failures, refused on conflicts."""
import pytest
from pyspark.sql import functions as F

from swaplens.sources import files, snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, bytes long")


def test_rewrite_at_its_own_path(spark, manifest, tmp_path):
    path = str(tmp_path / "manifest")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    assert snapshots.commit(manifest, path) == 1
    before = snapshots.current(spark, path)
    new = spark.createDataFrame([("b", 20), ("d", 4)], "file string, bytes long")
    assert snapshots.rewrite(spark, path, lambda old: files.upsert_manifest(old, new)) == 2
    assert rows(snapshots.current(spark, path)) == [("a", 1), ("b", 20), ("c", 3), ("d", 4)]
    assert rows(before) == [("a", 1), ("b", 2), ("c", 3)]  # a reader keeps the table that it opened
    assert snapshots.rewrite(spark, path, lambda old: old.where("file <> 'a'")) == 3
    assert snapshots.expire(spark, path, keep=1) == 2
    assert rows(snapshots.current(spark, path)) == [("b", 20), ("c", 3), ("d", 4)]
    assert len(list((tmp_path / "manifest").glob("data-*"))) == 1


def test_failures_leave_the_last_table(spark, manifest, tmp_path):
    path = str(tmp_path / "manifest")
    snapshots.commit(manifest, path)
    broken = manifest.repartition(3, "file").withColumn("bytes", F.when(F.col("file") == "c", F.raise_error("lost").cast("long")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(broken, path)  # the job fails half way
    (tmp_path / "manifest" / "commits" / "000000000002").write_text("data-cut")  # and a driver is lost while it commits
    assert rows(snapshots.current(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]
    assert snapshots.commit(manifest.where("bytes > 1"), path) == 3
    assert rows(snapshots.current(spark, path)) == [("b", 2), ("c", 3)]


def test_a_slower_writer_is_refused(spark, manifest, tmp_path):
    path = str(tmp_path / "manifest")
    snapshots.commit(manifest, path)

    def slow(old):
        snapshots.commit(manifest.where("bytes = 1"), path)  # another writer, meanwhile
        return old.where("bytes = 2")

    with pytest.raises(snapshots.Conflict):
        snapshots.rewrite(spark, path, slow)
    assert rows(snapshots.current(spark, path)) == [("a", 1)]


def test_partitions_and_empty_tables(spark, manifest, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(manifest.withColumn("market", F.lit("m")), path, ["market"])
    assert snapshots.current(spark, path).where("market = 'm'").count() == 3
    snapshots.commit(manifest.limit(0), path)
    assert snapshots.current(spark, path).columns == ["file", "bytes"] and snapshots.current(spark, path).count() == 0
