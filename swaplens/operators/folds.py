"""Positional index and equal chronological folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, by_time, whole


def number_bars(bars: DataFrame, keys: Sequence[str] = KEYS, out: str = "pos") -> DataFrame:
    """Add the zero-based position of a bar in its instrument's history."""
    return bars.withColumn(out, F.row_number().over(by_time(keys)) - 1)


def chunk(bars: DataFrame, n_splits: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``fold``, the fold-local ``idx``, the fold's last index ``last_idx`` and ``pos``.

    Every instrument is cut into ``n_splits`` equal chunks in time; the remainder at the end
    of the history belongs to no fold and is dropped.
    """
    df = number_bars(bars, keys).withColumn("_n", F.count(F.lit(1)).over(whole(keys)))
    df = df.withColumn("_size", F.floor(F.col("_n") / n_splits).cast("int"))
    df = df.where(F.col("pos") < F.col("_size") * n_splits)
    return df.withColumns({
        "fold": F.floor(F.col("pos") / F.col("_size")).cast("int"),
        "idx": (F.col("pos") % F.col("_size")).cast("int"),
        "last_idx": F.col("_size") - 1,
    }).drop("_n", "_size")


def as_one_fold(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole history as a single fold, for scans that are not walk-forward."""
    df = number_bars(bars, keys)
    return df.withColumns({"fold": F.lit(0), "idx": F.col("pos"),
                           "last_idx": (F.count(F.lit(1)).over(whole(keys)) - 1).cast("int")})
