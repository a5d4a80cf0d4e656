"""Window-function indicators.

Each ``with_*`` adds columns to a bars DataFrame. ``keys`` is the window partition: the
instrument for full-history values, instrument plus fold for values that restart with each
walk-forward chunk. All windows of a chain share one partitioning and one sort order, so the
physical plan has a single exchange below a stack of window operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as rec
from .columns import KEYS, by_time, last_n, pct_change, prior_n, ratio, rolling, running

FEATURES = ("adx", "atr_norm_mom", "hist_vol", "ret_zscore", "backward_r2", "rsi", "macd_hist", "kama_slope")
FEATURE_FILTERS = (rec.ema(20), rec.rsi(14), rec.macd_hist(), rec.kama())
TRADING_DAYS = 252


def true_range(keys: Sequence[str] = KEYS) -> Column:
    """High-low range extended to the previous close; the first bar has no previous close."""
    prev = F.lag("close").over(by_time(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def with_true_range(df: DataFrame, keys: Sequence[str] = KEYS, out: str = "true_range") -> DataFrame:
    return df.withColumn(out, true_range(keys))


def with_atr(df: DataFrame, keys: Sequence[str] = KEYS, length: int = 14, out: str = "atr") -> DataFrame:
    """Simple mean of the true range, NULL for the first ``length - 1`` bars."""
    return (df.withColumn("_tr", true_range(keys))
            .withColumn(out, rolling(F.avg, F.col("_tr"), last_n(keys, length), length)).drop("_tr"))


def with_adx(df: DataFrame, keys: Sequence[str] = KEYS, length: int = 14, out: str = "adx") -> DataFrame:
    """Average directional index with simple smoothing that needs one value only."""
    w, frame = by_time(keys), last_n(keys, length)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = df.withColumns({"_up": up, "_down": down, "_tr": true_range(keys)})
    rise = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    fall = F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    df = df.withColumns({"_rise": rise, "_fall": fall})
    df = df.withColumns({c: F.avg(c).over(frame) for c in ("_tr", "_rise", "_fall")})
    plus, minus = 100.0 * ratio(F.col("_rise"), F.col("_tr")), 100.0 * ratio(F.col("_fall"), F.col("_tr"))
    df = df.withColumns({"_plus": plus, "_minus": minus})
    df = df.withColumn("_dx", ratio(100.0 * F.abs(F.col("_plus") - F.col("_minus")), F.col("_plus") + F.col("_minus")))
    return (df.withColumn(out, F.avg("_dx").over(frame))
            .drop("_up", "_down", "_tr", "_rise", "_fall", "_plus", "_minus", "_dx"))


def sma(x: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    return rolling(F.avg, x, last_n(keys, n), n)


def channel_high(n: int, keys: Sequence[str] = KEYS) -> Column:
    """Highest high of the ``n`` bars before this one."""
    return rolling(F.max, F.col("high"), prior_n(keys, n), n)


def channel_low(n: int, keys: Sequence[str] = KEYS) -> Column:
    return rolling(F.min, F.col("low"), prior_n(keys, n), n)


def with_historical_volatility(df: DataFrame, keys: Sequence[str] = KEYS, length: int = 20, price: str = "close",
                               out: str = "hist_vol") -> DataFrame:
    df = df.withColumn("_ret", pct_change(F.col(price), keys))
    vol = rolling(F.stddev_samp, F.col("_ret"), last_n(keys, length), length)
    return df.withColumn(out, vol * F.sqrt(F.lit(float(TRADING_DAYS)))).drop("_ret")


def with_zscore(df: DataFrame, x: Column, keys: Sequence[str] = KEYS, window: int = 20, min_rows: int = 10,
                out: str = "zscore") -> DataFrame:
    """Distance of the latest value from its trailing mean in population deviations."""
    frame = last_n(keys, window)
    df = df.withColumn("_x", x)
    mean, dev = rolling(F.avg, F.col("_x"), frame, min_rows), rolling(F.stddev_pop, F.col("_x"), frame, min_rows)
    return df.withColumn(out, (F.col("_x") - mean) / (dev + 1e-8)).drop("_x")


def with_trend_r2(df: DataFrame, keys: Sequence[str] = KEYS, window: int = 20, price: str = "close",
                  out: str = "backward_r2") -> DataFrame:
    """R-squared of a straight line through the ``window`` closes before this bar.

    ``regr_r2`` gives 1 for a flat window, which is the wanted value here.
    """
    frame = prior_n(keys, window)
    df = df.withColumn("_t", F.row_number().over(by_time(keys)).cast("double"))
    r2 = F.when(F.count(price).over(frame) >= window, F.regr_r2(F.col(price), F.col("_t")).over(frame))
    return df.withColumn(out, r2).drop("_t")


def with_equity(df: DataFrame, ret: str, keys: Sequence[str], order: str = "date", equity: str = "equity",
                drawdown: str = "drawdown") -> DataFrame:
    """Compounded equity, and its relative distance from the running peak."""
    frame = running(keys, order)
    df = df.withColumn(equity, F.product(1.0 + F.col(ret)).over(frame))
    return df.withColumn(drawdown, ratio(F.col(equity), F.max(equity).over(frame)) - 1.0)


def window_features(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``atr`` and the features that windows give; no row leaves the JVM for them."""
    df = with_adx(with_atr(df, keys), keys)
    df = with_historical_volatility(df, keys)
    df = with_zscore(df, pct_change(F.col("close"), keys), keys, out="ret_zscore")
    return with_trend_r2(df, keys)


def feature_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The shared eight features on a frame that already has the recursive filter columns.

    Also leaves ``atr``, which every exit and label needs.
    """
    return window_features(df, keys).withColumns({
        "atr_norm_mom": ratio(F.col("close") - F.col("ema_20"), F.col("atr")),
        "rsi": F.col("rsi_14"),
        "kama_slope": F.col("kama") - F.lag("kama").over(by_time(keys)),
    })


def with_features(df: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[rec.Filter] = ()) -> DataFrame:
    """Bars plus ``atr`` and the eight features; row t depends on rows up to t only."""
    wanted = {f.out for f in extra}
    spare = [c for c in ("ema_20", "rsi_14", "kama") if c not in wanted]
    return feature_columns(rec.with_filters(df, [*FEATURE_FILTERS, *extra], keys), keys).drop(*spare)


def without_recursion(df: DataFrame, keys: Sequence[str] = KEYS, extra: Sequence[rec.Filter] = ()) -> DataFrame:
    """``with_features`` without the features that need a recursive filter; only the filters ``extra`` are computed."""
    return window_features(rec.with_filters(df, extra, keys), keys)


def features_known() -> Column:
    known = F.lit(True)
    for c in FEATURES:
        known = known & F.col(c).isNotNull()
    return known
