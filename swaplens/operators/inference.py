"""Paired comparison, bootstrap confidence intervals and multiple-testing control.

Each bootstrap group is one pair of daily series (at most one row per calendar day) and one
range of replicates, computed inside one Arrow group call with numpy. Draws are pure functions of
replicate and slot, so the ranges of one pair run in parallel too; groups are dealt by all of
their keys and their differences meet again in one aggregate.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.indicators import TRADING_DAYS as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(draws)


def paired_series(variant: DataFrame, control: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Both series on the union of their dates, 0 where one has no row.

    A union with a sum per (key, date) instead of a full join: it aggregates before the
    shuffle and has no null-key handling.
    """
    v = variant.select(*keys, "date", *[F.col(c).alias(f"v_{c}") for c in cols],
                       *[F.lit(0.0).alias(f"b_{c}") for c in cols])
    b = control.select(*keys, "date", *[F.lit(0.0).alias(f"v_{c}") for c in cols],
                       *[F.col(c).alias(f"b_{c}") for c in cols])
    return v.unionByName(b).groupBy(*keys, "date").agg(
        *[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in "vb" for c in cols])


def _ratio(mean, sd):
    return np.divide(mean, sd, out=np.zeros_like(mean), where=sd > 0)


def _sharpe_from_sums(s1, s2, n):
    mean = s1 / n
    return _ratio(mean, np.sqrt(np.maximum(s2 - n * mean * mean, 0) / (n - 1)))


def _point(x):
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / sd) if sd > 0 else 0.0


def _block_sums(x, length):
    """Sums of x over ``length`` days from every start, wrapping around."""
    c = np.concatenate([[0.0], np.cumsum(np.concatenate([x, x[:length]]))])
    return c[length:length + len(x)] - c[:len(x)]


def block_differences(a, b, block, reps, seed, first=0):
    """Annualised Sharpe differences of circular-block replicates; the same days for both series.

    A replicate is ``ceil(T / block)`` blocks cut to T days, so it needs sums of whole blocks
    and, for the last one, of the remaining days only.
    """
    n = len(a)
    k = -(-n // block)
    rest = n - (k - 1) * block
    starts = draws.draw_np(np.arange(first, first + reps)[:, None], np.arange(k)[None, :], seed, n)
    out = []
    for x in (a, b):
        s1, s2 = 0.0, 0.0
        for power, y in ((1, x), (2, x * x)):
            total = _block_sums(y, block)[starts[:, :-1]].sum(axis=1) + _block_sums(y, rest)[starts[:, -1]]
            if power == 1:
                s1 = total
            else:
                s2 = total
        out.append(_sharpe_from_sums(s1, s2, n) * np.sqrt(P))
    return out[0] - out[1]


def day_differences(a, b, reps, seed, paired, first=0):
    """Per-day Sharpe differences of i.i.d. replicates, with shared or separate draws."""
    diffs = np.empty(reps)
    step = max(1, 2_000_000 // max(len(a), len(b)))
    for lo in range(0, reps, step):
        rep = np.arange(first + lo, first + min(lo + step, reps))[:, None]
        parts = []
        for x, s in ((a, seed), (b, seed if paired else seed + 1)):
            y = x[draws.draw_np(rep, np.arange(len(x))[None, :], s, len(x))]
            parts.append(_ratio(y.mean(axis=1), y.std(axis=1, ddof=1)))
        diffs[lo:lo + len(rep)] = parts[0] - parts[1]
    return diffs


RANGE = 500  # replicates one group call computes


def _with_keys(keys: Sequence[str], df: DataFrame, extra: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys] + [extra])


def _differences(df: DataFrame, keys: Sequence[str], reps: int, compute) -> DataFrame:
    """Rows (keys, point, d): ``compute(a, b, first, n)`` on each range of replicates of each pair.

    Dealt by the full key and the range into the configured number of partitions: the work is in the
    replicates, not in the bytes by which small partitions would be merged.
    """
    names = [*keys, "_first"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(max(reps - 1, 0)), F.lit(RANGE)))).repartition(parts, *names)

    def run(key, table):
        table = table.sort_by("date")
        first = key[-1].as_py()
        point, d = compute(*(table.column(c).to_numpy().astype(float) for c in ("a", "b")), first, min(RANGE, reps - first))
        row = [pa.array([k.as_py()], k.type) for k in key[:-1]]
        row += [pa.array([point], pa.float64()), pa.array([d], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(row, names=[*keys, "point", "d"])

    return ranges.groupBy(*names).applyInArrow(run, _with_keys(keys, df, "point double, d array<double>"))


def _interval(differences: DataFrame, keys: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Percentiles of all differences of a key, and the share on either side of zero; NULL without any."""
    each = differences.select(*keys, "point", F.explode_outer("d").alias("d"))
    out = each.groupBy(*keys).agg(F.max("point").alias("delta_sharpe"), F.percentile("d", F.array(F.lit(lo), F.lit(hi))).alias("_q"),
                                  F.avg((F.col("d") <= 0).cast("double")).alias("_le"), F.avg((F.col("d") >= 0).cast("double")).alias("_ge"))
    p = F.when(F.col("_le").isNotNull(), F.least(F.lit(1.0), 2 * F.least("_le", "_ge")))
    return out.select(*keys, "delta_sharpe", F.get("_q", F.lit(0)).alias("ci_lo"), F.get("_q", F.lit(1)).alias("ci_hi"), p.alias("p_value"))


def block_bootstrap(paired: DataFrame, keys: Sequence[str], block: int = 20, reps: int = 2000, seed: int = 0,
                    alpha: float = 0.05, a: str = "v_ret", b: str = "b_ret") -> DataFrame:
    """Sharpe difference per key with a percentile interval and a two-sided p-value.

    Interval and p-value are NULL for a series shorter than two blocks.
    """
    def compute(x, y, first, n):
        point = float((_point(x) - _point(y)) * np.sqrt(P))
        return point, None if len(x) < 2 * block else block_differences(x, y, block, n, seed, first).tolist()

    df = paired.select(*keys, "date", F.col(a).alias("a"), F.col(b).alias("b"))
    return _interval(_differences(df, keys, reps, compute), keys, alpha / 2, 1 - alpha / 2)


def day_bootstrap(variant: DataFrame, control: DataFrame, keys: Sequence[str], reps: int = 2000, ci: float = 0.95,
                  seed: int = 0, paired: bool = False) -> DataFrame:
    """Interval of the per-day Sharpe difference from i.i.d. resampling of days.

    Unpaired, each series is resampled over its own days; paired, both use the same draws on
    the union of their days with 0 where one has none. NULL when a series has fewer than two
    days.
    """
    v = variant.select(*keys, "date", F.col("ret").alias("a"), F.lit(None).cast("double").alias("b"))
    b = control.select(*keys, "date", F.lit(None).cast("double").alias("a"), F.col("ret").alias("b"))
    both = v.unionByName(b).groupBy(*keys, "date").agg(F.max("a").alias("a"), F.max("b").alias("b"))

    def compute(x, y, first, n):
        enough = (~np.isnan(x)).sum() > 1 and (~np.isnan(y)).sum() > 1
        x, y = (np.nan_to_num(x), np.nan_to_num(y)) if paired else (x[~np.isnan(x)], y[~np.isnan(y)])
        return 0.0, day_differences(x, y, n, seed, paired, first).tolist() if enough else None

    return _interval(_differences(both, keys, reps, compute), keys, (1 - ci) / 2, 1 - (1 - ci) / 2).select(*keys, "ci_lo", "ci_hi")


def excludes_zero(lo: str = "ci_lo", hi: str = "ci_hi") -> Column:
    return F.coalesce((F.col(lo) > 0) | (F.col(hi) < 0), F.lit(False))


def with_adjusted(tests: DataFrame, p: str = "p_value", family: Sequence[str] = ("family",), alpha: float = 0.05,
                  order: Sequence[str] = ()) -> DataFrame:
    """Add Benjamini-Hochberg ``q_bh``, Holm ``p_holm`` and ``significant`` within each family.

    A missing p-value stays missing and does not count. A family holds one row per test of a
    study, a number fixed by its design.
    """
    known = F.col(p).isNotNull()
    part = Window.partitionBy(*family, known)
    ranked = part.orderBy(p, *order)
    df = tests.withColumns({"_m": F.count(F.lit(1)).over(part), "_k": F.row_number().over(ranked)})
    step_up = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(part.orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    step_down = F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(
        part.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"q_bh": F.when(known, F.least(step_up, F.lit(1.0))),
                         "p_holm": F.when(known, F.least(step_down, F.lit(1.0)))}).drop("_m", "_k")
    return df.withColumn("significant", F.coalesce(F.col("q_bh") < alpha, F.lit(False)))
