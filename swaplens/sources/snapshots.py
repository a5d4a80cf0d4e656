"""Tables that are replaced as a whole or not at all: each write is a new folder, and one small file makes it the current one.

A folder of a table holds ``data-<id>`` folders and ``commits/<number>`` files that name one of them each. Readers take the highest
number that is complete, so a job that fails, a lost driver or a rerun leaves the last table as it was, and a table can be
rewritten from itself at its own path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

END = "\n"  # a commit without it was cut off and does not count


class Conflict(Exception):
    """Another writer has committed since the table was read."""


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a constructor of its paths."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), new


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Complete commits, by number: the folder each one names. One name per write, never one per file of data."""
    fs, new = _files(spark, path)
    folder = new(f"{path}/commits")
    out = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readNBytes(200)).decode()
        finally:
            stream.close()
        if name.isdigit() and text.endswith(END):
            out[int(name)] = text.strip()
    return out


def commit(df: DataFrame, path: str, partition_by: Sequence[str] = (), after: int | None = None) -> int:
    """Write ``df`` and make it current; the number of the commit.

    With ``after`` the write only counts if that commit is still the last one (0: none), else ``Conflict`` is raised and the
    table stays. Two writers cannot take the same number, as its file is created only where there is none.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    fs, new = _files(spark, path)
    last = max(commits(spark, path), default=0)
    if after is not None and last != after:
        raise Conflict(f"{path}: commit {last} came after {after}")
    number = last + 1
    while fs.exists(new(f"{path}/commits/{number:012d}")):
        number += 1  # cut off: its number stays unused
    try:
        stream = fs.create(new(f"{path}/commits/{number:012d}"), False)
    except Exception as taken:
        raise Conflict(f"{path}: commit {number} is there") from taken
    try:
        stream.write(bytearray(f"{folder}{END}".encode()))
    finally:
        stream.close()
    return number


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last complete commit. It stays readable when others are committed after it."""
    done = commits(spark, path)
    if not done:
        raise FileNotFoundError(f"no committed table under {path}")
    return spark.read.parquet(f"{path}/{done[max(done)]}")


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], partition_by: Sequence[str] = ()) -> int:
    """Replace the current table by ``change`` of it; ``Conflict`` if another writer was faster."""
    last = max(commits(spark, path), default=0)
    return commit(change(current(spark, path)), path, partition_by, after=last)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove what only commits before the last ``keep`` name; how many tables went. Readers of those must have ended."""
    fs, new = _files(spark, path)
    done = commits(spark, path)
    old = sorted(done)[: max(0, len(done) - max(1, keep))]
    for number in old:
        fs.delete(new(f"{path}/commits/{number:012d}"), False)  # first, so that no commit names a folder that is gone
        fs.delete(new(f"{path}/{done[number]}"), True)
    return len(old)
