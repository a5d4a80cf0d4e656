"""Entry-signal rules and gates.

A rule adds one column of +1 / -1 / 0. It names the recursive filters it needs for a set of
parameters, so that all filters of a grid are computed in one pass before the rule runs. A
user's own rule is another ``SignalRule``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as rec
from ..functions.columns import KEYS, by_time, is_true, pct_change
from ..functions.indicators import channel_high, channel_low, sma

Build = Callable[..., DataFrame]


@dataclass(frozen=True)
class SignalRule:
    """``build(df, keys, out, **params)`` adds the signal column ``out``.

    ``defaults`` are the parameters of a run without a grid; ``grid`` lists the values a
    walk-forward run chooses from.
    """

    name: str
    build: Build
    defaults: Mapping[str, float] = field(default_factory=dict)
    grid: Mapping[str, Sequence[float]] = field(default_factory=dict)
    needs: Callable[..., Sequence[rec.Filter]] = lambda **_: ()

    def combos(self) -> list[dict]:
        return combos(self.grid)

    def add(self, df: DataFrame, keys: Sequence[str], out: str = "signal", **params) -> DataFrame:
        return self.build(df, keys, out, **{**self.defaults, **params})

    def filters(self, **params) -> Sequence[rec.Filter]:
        return self.needs(**{**self.defaults, **params})


def combos(grid: Mapping[str, Sequence[float]]) -> list[dict]:
    """Cartesian product of a parameter grid; one empty choice for an empty grid."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def crossover(df: DataFrame, fast: Column, slow: Column, keys: Sequence[str] = KEYS, out: str = "signal") -> DataFrame:
    """+1 on the bar where ``fast`` moves above ``slow``, -1 where it moves below."""
    w = by_time(keys)
    df = df.withColumns({"_fast": fast, "_slow": slow})
    was_fast, was_slow = F.lag("_fast").over(w), F.lag("_slow").over(w)
    up = (F.col("_fast") > F.col("_slow")) & (was_fast <= was_slow)
    down = (F.col("_fast") < F.col("_slow")) & (was_fast >= was_slow)
    return df.withColumn(out, F.when(up, 1).when(down, -1).otherwise(0)).drop("_fast", "_slow")


def _jma_cross(df, keys, out, fast, slow):
    return crossover(df, F.col(rec.jma(fast).out), F.col(rec.jma(slow).out), keys, out)


def _sma_cross(df, keys, out, fast, slow):
    return crossover(df, sma(F.col("close"), fast, keys), sma(F.col("close"), slow, keys), keys, out)


def _donchian(df, keys, out, lookback):
    above = is_true(F.col("close") > channel_high(lookback, keys))
    below = is_true(F.col("close") < channel_low(lookback, keys))
    return df.withColumn(out, above.cast("int") - below.cast("int"))


def _ts_momentum(df, keys, out, lookback):
    df = df.withColumn("_side", F.signum(pct_change(F.col("close"), keys, lookback)))
    before = F.lag("_side").over(by_time(keys))
    flip = (F.col("_side") != before) & (F.col("_side") != 0)
    return df.withColumn(out, F.when(flip, F.col("_side")).otherwise(0).cast("int")).drop("_side")


def _rsi_reversion(df, keys, out, entry, trend=200, length=2):
    strength, mean, close = F.col(rec.rsi(length).out), sma(F.col("close"), trend, keys), F.col("close")
    dip = is_true((strength < entry) & (close > mean))
    rally = is_true((strength > 100 - entry) & (close < mean))
    return df.withColumn(out, dip.cast("int") - rally.cast("int"))


JMA_CROSS = SignalRule("jma_cross", _jma_cross, {"fast": 7, "slow": 21}, {"fast": [5, 7, 9], "slow": [21, 28]},
                       lambda fast, slow: (rec.jma(fast), rec.jma(slow)))
SMA_CROSS = SignalRule("sma_cross", _sma_cross, {"fast": 50, "slow": 200}, {"fast": [20, 50], "slow": [100, 200]})
DONCHIAN = SignalRule("donchian", _donchian, {"lookback": 20}, {"lookback": [20, 55]})
TS_MOMENTUM = SignalRule("ts_momentum", _ts_momentum, {"lookback": 252}, {"lookback": [126, 252]})
RSI_REVERSION = SignalRule("rsi2", _rsi_reversion, {"entry": 10, "trend": 200, "length": 2}, {"entry": [5, 10]},
                           lambda entry, trend, length: (rec.rsi(length),))
RULES = {r.name: r for r in (JMA_CROSS, SMA_CROSS, DONCHIAN, TS_MOMENTUM, RSI_REVERSION)}


def column_rule(name: str, signal: Callable[..., Column], defaults: Mapping[str, float] | None = None,
                grid: Mapping[str, Sequence[float]] | None = None,
                needs: Callable[..., Sequence[rec.Filter]] = lambda **_: ()) -> SignalRule:
    """A rule from a function that returns the signal as one column expression."""
    return SignalRule(name, lambda df, keys, out, **p: df.withColumn(out, signal(keys, **p).cast("int")),
                      defaults or {}, grid or {}, needs)


def pandas_rule(name: str, fn: Callable, defaults: Mapping[str, float] | None = None,
                grid: Mapping[str, Sequence[float]] | None = None) -> SignalRule:
    """A rule from a pandas function ``fn(frame, **params) -> Series``, run per group.

    A way in for existing pandas code; the group is one instrument (or fold) of daily bars.
    """

    def build(df, keys, out, **params):
        def run(frame):
            frame = frame.sort_values("date").reset_index(drop=True)
            return frame.assign(**{out: fn(frame, **params)})

        schema = df.withColumn(out, F.lit(0)).schema
        return df.groupBy(*keys).applyInPandas(run, schema)

    return SignalRule(name, build, defaults or {}, grid or {})


def adx_gate(threshold: float = 25.0) -> Column:
    """Trade only when the directional index is at or above ``threshold``."""
    return is_true(F.col("adx") >= threshold)


def gated(signal: Column, gate: Column | None, lag: int, keys: Sequence[str]) -> Column:
    """Gate first, then delay: the signal and its gate move together."""
    value = signal if gate is None else F.when(is_true(gate), signal).otherwise(0)
    return F.lag(value, lag, 0).over(by_time(keys)) if lag else value
