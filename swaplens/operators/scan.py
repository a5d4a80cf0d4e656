"""Trade extraction: one open position at a time over the ordered bars of a fold.

The bars of one fold (at most one per calendar day) are packed into an array and folded by a
small state machine with the SQL higher-order function ``aggregate``. It runs inside the JVM
and appends to its output only when a trade closes. All exit settings and all signal columns
of a run are evaluated on the same packed row, so bars are shuffled once however many
parameter combinations are tried.

Prices are compared in signed coordinates (price times direction), which makes the long and
the short case one expression: a stop is hit when the signed close is at or below the signed
stop, a target when it is at or above the signed target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FOLD_KEYS
from . import states
from .states import PythonExit


@dataclass(frozen=True)
class UserExit:
    """An exit of one's own: a number carried from bar to bar and a condition to leave at the close.

    SQL over ``v``, which holds ``close``, ``atr``, ``side`` (1 or -1), ``entry`` (price), ``held``
    (bars since the entry) and ``state``. ``initial`` gives the state on the entry bar, ``update``
    that of each later bar, on which ``leave`` is then asked. ``reason`` marks the trades it closes.
    """

    reason: str
    leave: str
    initial: str = "0D"
    update: str = "v.state"


@dataclass(frozen=True)
class ExitRule:
    """Exit setting of one run. Missing parts are simply not in force.

    ``sl``      initial stop, in ATR multiples from the entry close
    ``tp``      fixed target in ATR multiples
    ``trail``   distance of the trailing stop from the close, in ATR multiples
    ``hold``    leave when the probability of holding is below this value
    ``at_stop`` fill a breached stop at the stop level instead of the breaching close
    ``user``    an exit of one's own, asked after the others
    """

    sl: float | None
    tp: float | None = None
    trail: float | None = None
    hold: float | None = None
    at_stop: bool = True
    user: UserExit | PythonExit | None = None


def holding_time(bars: int = 10, sl_mult: float | None = None, fill: str = "stop") -> ExitRule:
    """Leave after a number of bars; an example of an exit of one's own."""
    return ExitRule(sl_mult, at_stop=fill == "stop", user=UserExit("time", f"v.held >= {int(bars)}"))


def bracket(sl_mult: float = 1.5, tp_mult: float = 3.0, fill: str = "stop") -> ExitRule:
    return ExitRule(sl_mult, tp=tp_mult, at_stop=fill == "stop")


def trailing(sl_mult: float = 1.5, trail_mult: float = 2.0, fill: str = "stop") -> ExitRule:
    return ExitRule(sl_mult, trail=trail_mult, at_stop=fill == "stop")


def learned(sl_mult: float = 3.0, threshold: float = 0.5, fill: str = "stop") -> ExitRule:
    return ExitRule(sl_mult, hold=threshold, at_stop=fill == "stop")


EXITS = {"bracket": bracket, "trailing": trailing, "learned": learned, "holding_time": holding_time}


def python_holding_time(bars: int = 10, sl_mult: float | None = None, fill: str = "stop") -> ExitRule:
    """The same, as an exit in Python."""
    return ExitRule(sl_mult, at_stop=fill == "stop", user=_held(int(bars)))


@lru_cache
def _held(bars: int) -> PythonExit:
    """One object for equal settings, so that runs which share it share their states."""
    return PythonExit("time", lambda v: v.held >= bars)


@dataclass(frozen=True)
class Run:
    """One parameter combination: positions of its signal, hold scores and sizer, and its exit."""

    combo: int
    signal: int
    exit: ExitRule
    score: int | None = None
    size: int | None = None


TRADE = ("struct<entry_i:int,exit_i:int,entry_time:date,exit_time:date,direction:int,entry_price:double,"
         "exit_price:double,reason:string,size:double>")

_IDLE = """named_struct('d', 0, 'i', 0, 't', CAST(NULL AS DATE), 'px', 0D, 'atr', 0D, 'size', 1D,
  'stop', 0D, 'goal', CAST(NULL AS DOUBLE)"""

_STOP = "greatest(s.stop, s.d * b.close - g.trail * coalesce(b.atr, s.atr))"


def _close(price: str, reason: str, more: str) -> str:
    trade = (f"named_struct('entry_i', s.i, 'exit_i', b.idx, 'entry_time', s.t, 'exit_time', b.date, "
             f"'direction', s.d, 'entry_price', s.px, 'exit_price', {price}, 'reason', '{reason}', 'size', s.size)")
    return f"{_IDLE}{more}, 'out', array_append(s.out, {trade}))"


def _seen(expression: str, side: str, entry: str, held: str, state: str) -> str:
    """An expression of a user exit with its ``v`` bound."""
    v = (f"named_struct('close', b.close, 'atr', b.atr, 'side', {side}, 'entry', {entry}, 'held', {held}, "
         f"'state', CAST({state} AS DOUBLE))")
    return f"transform(array({v}), v -> {expression})[0]"


def _machine(users: Sequence[UserExit]) -> tuple[str, str]:
    """Initial state and step; only runs with user exits carry a state for them."""
    now = ("s.d", "s.px", "b.idx - s.i")

    def chosen(expression) -> str:
        return "CASE g.user " + " ".join(f"WHEN {k} THEN CAST({expression(u)} AS DOUBLE)" for k, u in enumerate(users)) + " END"

    none, opened, kept = ", 'x', CAST(NULL AS DOUBLE)", "", ""
    if users:
        opened = ", 'x', " + chosen(lambda u: _seen(u.initial, "b.sig[g.signal]", "b.close", "0", "NULL"))
        kept = ", 'x', " + chosen(lambda u: _seen(u.update, *now, "s.x"))
    else:
        none = ""
    leaves = " ".join(
        f"WHEN g.user = {k} AND {_seen(u.leave, *now, _seen(u.update, *now, 's.x'))} THEN {_close('b.close', u.reason, none)}"
        for k, u in enumerate(users))
    still = "FALSE" if users else "g.trail IS NULL"
    step = f"""CASE
  WHEN s.d = 0 THEN CASE
    WHEN b.sig[g.signal] = 0 OR b.atr IS NULL OR b.idx >= last_idx THEN s
    ELSE named_struct('d', b.sig[g.signal], 'i', b.idx, 't', b.date, 'px', b.close, 'atr', b.atr,
      'size', coalesce(b.size[g.size], 1D),
      'stop', b.sig[g.signal] * b.close - g.sl * b.atr,
      'goal', b.sig[g.signal] * b.close + g.tp * b.atr{opened}, 'out', s.out) END
  WHEN s.d * b.close <= {_STOP} THEN {_close(f"CASE WHEN g.at_stop THEN s.d * {_STOP} ELSE b.close END", "stop", none)}
  WHEN s.d * b.close >= s.goal THEN {_close("s.d * s.goal", "target", none)}
  WHEN (CASE WHEN s.d = 1 THEN b.up[g.score] ELSE b.down[g.score] END) < g.hold THEN {_close("b.close", "ml_exit", none)}
  {leaves}
  WHEN b.idx = last_idx THEN {_close("b.close", "eod", none)}
  WHEN {still} THEN s
  ELSE named_struct('d', s.d, 'i', s.i, 't', s.t, 'px', s.px, 'atr', s.atr, 'size', s.size, 'stop', {_STOP},
      'goal', s.goal{kept}, 'out', s.out) END"""
    return f"{_IDLE}{none}, 'out', CAST(array() AS ARRAY<{TRADE}>))", step


def users_of(runs: Sequence[Run]) -> list[UserExit]:
    """The distinct SQL exits of a set of runs, in the order by which their settings refer to them."""
    users = list(dict.fromkeys(r.exit.user for r in runs if r.exit.user is not None))
    kinds = {isinstance(u, PythonExit) for u in users}
    if len(kinds) > 1:
        raise ValueError("exits in SQL and exits in Python need runs of their own")
    return [] if True in kinds else users


def in_python(runs: Sequence[Run]) -> bool:
    return any(isinstance(r.exit.user, PythonExit) for r in runs)


def _number(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}D"


def _index(i: int | None) -> str:
    return "CAST(NULL AS INT)" if i is None else str(i)


def runs_sql(runs: Sequence[Run], users: Sequence[UserExit] = ()) -> str:
    rows = [f"named_struct('combo', {r.combo}, 'signal', {r.signal}, 'score', {_index(r.score)}, "
            f"'size', {_index(r.size)}, 'sl', {_number(r.exit.sl)}, "
            f"'tp', {_number(r.exit.tp)}, 'trail', {_number(r.exit.trail)}, 'hold', {_number(r.exit.hold)}, "
            f"'user', {_index(None if r.exit.user is None else users.index(r.exit.user))}, "
            f"'at_stop', {str(r.exit.at_stop).lower()})" for r in runs]
    return f"array({', '.join(rows)})"


def pack(df: DataFrame, signals: Sequence[Column], up: Sequence[Column] = (), down: Sequence[Column] = (),
         size: Sequence[Column] = (), keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """One row per fold: its bars in order with everything the state machine reads.

    ``df`` carries ``idx``, ``last_idx``, ``date``, ``close`` and ``atr``.
    """
    def doubles(cols):
        return F.array(*cols).cast("array<double>") if cols else F.lit(None).cast("array<double>")

    bar = F.struct("idx", "date", "close", "atr", F.array(*[s.cast("int") for s in signals]).alias("sig"),
                   doubles(up).alias("up"), doubles(down).alias("down"), doubles(size).alias("size"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.max("last_idx").alias("last_idx"))


def run_column(runs: str, bars: str = "bars", users: Sequence[UserExit] = ()) -> Column:
    """Array of ``(combo, trades)`` for a packed row; ``runs`` is an array of run settings."""
    start, step = _machine(users)
    scan = f"aggregate({bars}, {start}, (s, b) -> {step}, s -> s.out)"
    return F.expr(f"transform({runs}, g -> named_struct('combo', g.combo, 'trades', {scan}))")


def trade_columns(fee_bps: float | Column, sized: bool = True) -> dict[str, Column]:
    """``gross``, ``ret`` (and the size already applied to both) of an unpacked trade."""
    gross = F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    fee = (fee_bps if isinstance(fee_bps, Column) else F.lit(float(fee_bps))) / 1e4
    scale = F.col("size") if sized else F.lit(1.0)
    return {"gross": gross * scale, "ret": (gross - fee) * scale}


def extract(df: DataFrame, signals: Sequence[Column], runs: Sequence[Run], fee_bps: float | Column = 7.0,
            keys: Sequence[str] = FOLD_KEYS, up: Sequence[Column] = (), down: Sequence[Column] = (),
            size: Sequence[Column] = ()) -> DataFrame:
    """All trades of all runs on every fold: one row per closed position, tagged ``combo``."""
    users = users_of(runs)
    packed = pack(df, signals, up, down, size, keys)
    if in_python(runs):
        kinds = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)
        rows = packed.select(*keys, "bars").mapInArrow(states.every_trade(runs, keys), f"{kinds}, combo int, {states.TRADE}")
        return rows.withColumns(trade_columns(fee_bps))
    packed = packed.withColumn("runs", run_column(runs_sql(runs, users), users=users))
    rows = packed.select(*keys, F.explode("runs").alias("r"))
    rows = rows.select(*keys, F.col("r.combo").alias("combo"), F.explode("r.trades").alias("t"))
    return rows.select(*keys, "combo", "t.*").withColumns(trade_columns(fee_bps))


def trades_of(df: DataFrame, signal: Column, rule: ExitRule, fee_bps: float = 7.0,
              keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """Trades of a single signal and exit rule."""
    return extract(df, [signal], [Run(0, 0, rule)], fee_bps, keys).drop("combo")
