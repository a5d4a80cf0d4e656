"""Market regimes and crisis windows."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_time, compound, is_true, last_n, rolling, running
from .metrics import mtm_sharpe

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _with_expanding_median(df: DataFrame, col: str, keys: Sequence[str], min_rows: int, out: str) -> DataFrame:
    """Median of all values so far, per key (one index series, at most one row per calendar day)."""
    types = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        return frame.assign(**{out: frame[col].expanding(min_periods=min_rows).median()})

    res = df.groupBy(*keys).applyInPandas(run, types)
    return res.withColumn(out, F.when(F.isnan(out), None).otherwise(F.col(out)))


def regime_labels(index: DataFrame, keys: Sequence[str] = ("market",), sma_days: int = 200, vol_days: int = 20,
                  min_history: int = 250) -> DataFrame:
    """Labels known the day before: trend against the moving average, volatility against its median.

    Before the averages exist a comparison is false, so the warm-up reads bear / low_vol; only
    the first day has no label.
    """
    w = by_time(keys)
    df = index.withColumn("_level", F.product(1.0 + F.col("ret")).over(running(keys)))
    df = df.withColumns({
        "_bull": is_true(F.col("_level") > rolling(F.avg, F.col("_level"), last_n(keys, sma_days), sma_days)),
        "_rv": rolling(F.stddev_samp, F.col("ret"), last_n(keys, vol_days), vol_days)})
    df = _with_expanding_median(df, "_rv", keys, min_history, "_med")
    df = df.withColumn("_high", is_true(F.col("_rv") > F.col("_med")))
    bull, high = F.lag("_bull").over(w), F.lag("_high").over(w)
    return df.select(*keys, "date", F.when(bull, "bull").when(~bull, "bear").alias("trend"),
                     F.when(high, "high_vol").when(~high, "low_vol").alias("vol"))


def regime_sharpes(paired: DataFrame, labels: DataFrame, keys: Sequence[str], label_keys: Sequence[str] = (),
                   min_days: int = 60) -> DataFrame:
    """Sharpe of variant and control inside each regime with enough days."""
    df = paired.join(labels, [*label_keys, "date"])
    df = df.select(*keys, "v_ret", "b_ret", F.expr("stack(2, 'trend', trend, 'vol', vol) AS (dimension, regime)"))
    out = df.where(F.col("regime").isNotNull()).groupBy(*keys, "dimension", "regime").agg(
        F.count(F.lit(1)).alias("days"), mtm_sharpe(F.col("v_ret")).alias("v_sharpe"),
        mtm_sharpe(F.col("b_ret")).alias("b_sharpe"))
    return out.where(F.col("days") >= min_days).withColumn("delta_sharpe", F.col("v_sharpe") - F.col("b_sharpe"))


def crisis_performance(paired: DataFrame, crises: DataFrame, keys: Sequence[str], min_days: int = 20) -> DataFrame:
    """Return and drawdown of both series inside named date ranges (both ends included).

    ``crises`` (``crisis, start, end``) is part of the study configuration: a handful of rows, which become
    literals, so that each day names the ranges it is in and nothing is joined.
    """
    ranges = [F.struct(F.lit(c["crisis"]).alias("crisis"), F.lit(c["start"]).cast("date").alias("start"), F.lit(c["end"]).cast("date").alias("end"))
              for c in crises.select("crisis", "start", "end").collect()]
    if not ranges:
        ranges = [F.struct(F.lit("").alias("crisis"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))]
    inside = F.filter(F.array(*ranges), lambda c: (F.col("date") >= c["start"]) & (F.col("date") <= c["end"]))
    df = paired.withColumn("_in", F.explode(inside)).select(*keys, F.col("_in.crisis").alias("crisis"), "date", "v_ret", "b_ret")
    k = [*keys, "crisis"]
    w = running(k)
    df = df.withColumns({f"{s}_eq": F.product(1.0 + F.col(f"{s}_ret")).over(w) for s in "vb"})
    df = df.withColumns({f"{s}_dd": F.col(f"{s}_eq") / F.max(f"{s}_eq").over(w) - 1.0 for s in "vb"})
    out = df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("days"), compound(F.col("v_ret")).alias("v_return"),
        compound(F.col("b_ret")).alias("b_return"), F.min("v_dd").alias("v_max_drawdown"),
        F.min("b_dd").alias("b_max_drawdown"))
    return out.where(F.col("days") >= min_days)
