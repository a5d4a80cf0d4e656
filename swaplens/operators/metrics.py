"""Return, risk, tail and trade statistics, one aggregation per group of daily returns.

Every group is one portfolio or one realised series, with at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_true, ratio, running
from ..functions.distribution import deflated_sharpe
from ..functions.indicators import TRADING_DAYS as P

RISK_FREE = 0.06


def mtm_sharpe(r: Column) -> Column:
    """Annualised Sharpe aggregate, sample deviation, no risk-free rate; 0 without variation."""
    sd = F.stddev_samp(r)
    return F.when(sd > 0, F.sqrt(F.lit(float(P))) * F.avg(r) / sd).otherwise(0.0)


def realized_sharpe(r: Column, periods: int = P, rf: float = RISK_FREE) -> Column:
    """Annualised excess Sharpe aggregate with the population deviation; 0 below two days."""
    sd = F.stddev_pop(r)
    return F.when((F.count(r) < 2) | is_true(sd == 0), 0.0).otherwise(
        F.sqrt(F.lit(float(periods))) * (F.avg(r) - rf / periods) / sd)


def portfolio_metrics(pf: DataFrame, keys: Sequence[str], n_trials: int = 1, ret: str = "ret",
                      turnover: str = "turnover", exposure: str = "exposure", prefix: str = "") -> DataFrame:
    """All portfolio statistics per key. A flat or one-day series only has ``days``.

    Drawdown needs the running peak, so equity is built over the key's ordered days first;
    the aggregation then reuses that partitioning. The values of a key (at most one per
    calendar day) are also collected for the mean of the worst tail.
    """
    r = F.col(ret)
    df = pf.select(*keys, "date", r.alias("r"), F.col(turnover).alias("t"), F.col(exposure).alias("e"))
    w = running(keys)
    df = df.withColumn("eq", F.product(1.0 + F.col("r")).over(w))
    df = df.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1.0)
    r = F.col("r")
    down = F.when(r < 0, r)
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.bool_or(r != 0).alias("moves"), F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"), F.product(1.0 + r).alias("end"), F.min("dd").alias("max_drawdown"),
        F.count(down).alias("n_down"), F.stddev_samp(down).alias("sd_down"), F.percentile(r, F.lit(0.05)).alias("q05"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"), F.avg("t").alias("t"),
        F.avg("e").alias("exposure"), F.collect_list(r).alias("rs"))
    year, root = F.lit(float(P)), F.sqrt(F.lit(float(P)))
    cagr = F.when(F.col("end") > 0, F.pow("end", year / F.col("days")) - 1.0).otherwise(-1.0)
    tail = F.expr("filter(rs, x -> x <= q05)")
    total = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x)
    values = {
        "ann_return": cagr, "ann_vol": F.col("sd") * root,
        "sharpe": F.when(F.col("sd") > 0, root * F.col("mean") / F.col("sd")).otherwise(0.0),
        "sortino": F.when(F.col("n_down") > 1, ratio(root * F.col("mean"), F.col("sd_down"))).otherwise(0.0),
        "max_drawdown": F.col("max_drawdown"),
        "calmar": F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")).otherwise(0.0),
        "var95": -F.col("q05"), "cvar95": -ratio(total, F.size(tail)), "skew": F.col("skew"),
        "excess_kurtosis": F.col("excess_kurtosis"), "turnover": F.col("t") * year, "exposure": F.col("exposure"),
        "deflated_sharpe": deflated_sharpe(F.col("mean"), F.col("sd"), F.col("skew"), F.col("excess_kurtosis") + 3.0,
                                           F.col("days"), n_trials),
    }
    live = (F.col("days") >= 2) & F.col("moves")
    return a.select(*keys, F.col("days").alias(f"{prefix}days"),
                    *[F.when(live, v).alias(f"{prefix}{k}") for k, v in values.items()])


def trade_metrics(trades: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Count, hit rate, holding time, mean return and profit factor of a set of trades."""
    r = F.col("ret")
    wins, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    out = {
        "n_trades": F.count(F.lit(1)), "win_rate": F.avg((r > 0).cast("double")),
        "avg_hold_days": F.avg(F.datediff("exit_time", "entry_time")), "mean_trade_bps": F.avg(r) * 1e4,
        "profit_factor": F.when(losses > 0, wins / losses).otherwise(F.lit(float("inf"))),
    }
    return trades.groupBy(*keys).agg(*[v.alias(f"{prefix}{k}") for k, v in out.items()])


def realized_summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trade count, Sharpe, mean return, total return and drawdown of the realised daily series."""
    from .valuation import realized_daily

    daily = realized_daily(trades, keys)
    w = running(keys)
    daily = daily.withColumn("eq", F.product(1.0 + F.col("ret")).over(w))
    daily = daily.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1.0)
    r = F.col("ret")
    series = daily.groupBy(*keys).agg(
        realized_sharpe(r).alias("sharpe"), (F.product(1.0 + r) - 1.0).alias("total_return"),
        F.min("dd").alias("max_drawdown"), F.count(F.lit(1)).alias("days"), F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"), F.skewness(r).alias("_skew"), (F.kurtosis(r) + 3.0).alias("_kurt"))
    counts = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), (F.avg("ret") * 1e4).alias("mean_trade_bps"))
    return counts.join(series, list(keys))


def with_deflated_sharpe(summary: DataFrame, best: int | Column = 1) -> DataFrame:
    """Add the deflated Sharpe ratio to a realised summary; ``best`` as in ``deflated_sharpe``."""
    return summary.withColumn("deflated_sharpe", deflated_sharpe(
        F.col("_mean"), F.col("_sd"), F.col("_skew"), F.col("_kurt"), F.col("days"), best)).drop(
        "_mean", "_sd", "_skew", "_kurt")


def selection_decay(trades: DataFrame, keys: Sequence[str] = ("strategy", "market")) -> DataFrame:
    """In-sample mean of the chosen parameters next to what they earned out of sample."""
    return trades.groupBy(*keys).agg(
        (F.avg("is_mean_ret") * 1e4).alias("is_mean_trade_bps"), (F.avg("ret") * 1e4).alias("oos_mean_trade_bps"),
        F.count(F.lit(1)).alias("n_trades"))


def weighted_decay(decay: DataFrame) -> DataFrame:
    """Trade-weighted decay per strategy over its markets."""
    n = F.col("n_trades")
    return decay.groupBy("strategy").agg(
        (F.sum(F.col("is_mean_trade_bps") * n) / F.sum(n)).alias("is_mean_trade_bps"),
        (F.sum(F.col("oos_mean_trade_bps") * n) / F.sum(n)).alias("oos_mean_trade_bps"), F.sum(n).alias("n_trades"))
