"""All parameter combinations of many folds in one pass over their bars.

Bars are met in order of time; every combination of every fold of a block of instruments is one element of the state
arrays (side, entry, stop, goal), so a bar is read once however many combinations are tried, and a step costs the same few array
operations for one instrument or fifty. Combinations that differ in their sizing only share a state. The folds of an instrument
(at most one bar per calendar day) come in one row, so selection on a fold and trading on the next are array lookups: only trades
that count leave the task.

The rules are those of ``scan``: a test holds both against each other.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STOP, TARGET, SCORE, END = "stop", "target", "ml_exit", "eod"


@dataclass(frozen=True)
class PythonExit:
    """An exit of one's own in Python: a state carried from bar to bar and a condition to leave at the close.

    Functions over ``v``, whose fields ``close``, ``atr``, ``side`` (1 or -1), ``entry`` (price), ``held`` (bars since the entry) and
    ``state`` are arrays with one element for each open position. Only the current bar is in them, so an exit cannot look
    ahead. ``initial`` gives the state on the entry bar, ``update`` that of each later bar, on which ``leave`` is then asked.
    A state may have further axes. ``reason`` marks the trades it closes.
    """

    reason: str
    leave: Callable[[View], np.ndarray]
    initial: Callable[[View], np.ndarray] | None = None
    update: Callable[[View], np.ndarray] | None = None


@dataclass
class View:
    close: np.ndarray
    atr: np.ndarray
    side: np.ndarray
    entry: np.ndarray
    held: np.ndarray
    state: np.ndarray | None = None


class Bars:
    """Bars of packed folds as arrays (fold, bar) and (fold, bar, column); missing values and bars behind a fold's end are NaN."""

    def __init__(self, bars: pa.ListArray):
        rows = bars.flatten()
        length = bars.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start, self.last = np.cumsum(length) - length, length - 1
        self.shape = (len(length), int(length.max(initial=0)))
        inside = np.arange(self.shape[1])[None, :] < length[:, None]
        self.close, self.atr = (self._placed(self._numbers(rows.field(c)), inside) for c in ("close", "atr"))
        self.date = rows.field("date")
        self.sig, self.up, self.down, self.size = (self._lists(rows.field(c), inside) for c in ("sig", "up", "down", "size"))

    @staticmethod
    def _placed(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.full((*inside.shape, *values.shape[1:]), np.nan)
        out[inside] = values
        return out

    @staticmethod
    def _numbers(a: pa.Array) -> np.ndarray:
        return a.to_numpy(zero_copy_only=False).astype(float)

    def _lists(self, a: pa.ListArray, inside: np.ndarray) -> np.ndarray:
        flat = self._numbers(a.flatten())
        return self._placed(flat.reshape(len(a), -1), inside) if len(flat) else np.zeros((*inside.shape, 0))


def machines(runs: Sequence) -> tuple[list, list[int]]:
    """The distinct (signal, exit, score) of runs, and which of them each run is."""
    keys = [(r.signal, r.exit, r.score) for r in runs]
    distinct = list(dict.fromkeys(keys))
    at = {k: i for i, k in enumerate(distinct)}
    return distinct, [at[k] for k in keys]


class Events:
    """Closed positions in the order of their exits: arrays of fold, machine, entry and exit bar, side, prices, reason."""

    def __init__(self, parts: list[tuple], names: list[str]):
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, int)] * 8
        self.fold, self.machine, self.entry, self.exit, self.side = (c.astype(np.int64) for c in cols[:5])
        self.entry_price, self.exit_price = cols[5].astype(float), cols[6].astype(float)
        self.reason, self.names = cols[7].astype(np.int64), names


def scan(bars: Bars, distinct: Sequence[tuple]) -> Events:
    """One pass over the bars of all folds with the state of every machine."""
    none = float("nan")
    number = lambda x: none if x is None else float(x)
    rules = [rule for _, rule, _ in distinct]
    sl, tp, trail, hold = (np.array([number(getattr(r, f)) for r in rules]) for f in ("sl", "tp", "trail", "hold"))
    at_stop = np.array([r.at_stop for r in rules], bool)
    signal = np.array([s for s, _, _ in distinct])
    score = np.array([-1 if p is None else p for _, _, p in distinct])
    scored = np.flatnonzero((score >= 0) & ~np.isnan(hold))
    users = list(dict.fromkeys(r.user for r in rules if r.user is not None))
    of_user = [np.array([r.user is u for r in rules]) for u in users]
    owned: list[np.ndarray | None] = [None] * len(users)
    names = [STOP, TARGET, SCORE, END, *(u.reason for u in users)]
    folds, n = bars.shape
    shape = (folds, len(distinct))
    side, begun = np.zeros(shape), np.zeros(shape, np.int64)
    price, range0, stop, goal = (np.full(shape, none) for _ in range(4))
    trails = not np.isnan(trail).all()
    parts: list[tuple] = []
    for t in range(n):
        close, atr = bars.close[:, t, None], bars.atr[:, t, None]
        open_ = side != 0
        if open_.any():
            signed = side * close
            if trails:
                stop = np.fmax(stop, signed - trail * np.where(np.isnan(atr), range0, atr))  # fmax skips what is missing
            stopped = open_ & (signed <= stop)
            reached = open_ & ~stopped & (signed >= goal)
            reason = np.where(stopped, 0, np.where(reached, 1, -1))
            if len(scored):
                p = np.full(shape, none)
                p[:, scored] = np.where(side[:, scored] == 1, bars.up[:, t][:, score[scored]], bars.down[:, t][:, score[scored]])
                reason[open_ & (reason < 0) & (p < hold)] = 2
            for k, user in enumerate(users):
                f, m = np.nonzero(open_ & of_user[k])
                if len(f):
                    v = View(close[f, 0], atr[f, 0], side[f, m], price[f, m], t - begun[f, m], None if owned[k] is None else owned[k][f, m])
                    if user.update is not None:
                        v.state = np.asarray(user.update(v))
                        owned[k][f, m] = v.state
                    leaves = np.asarray(user.leave(v), bool) & (reason[f, m] < 0)
                    reason[f[leaves], m[leaves]] = 4 + k
            if (ends := bars.last == t).any():
                reason[open_ & (reason < 0) & ends[:, None]] = 3
            f, m = np.nonzero(reason >= 0)
            if len(f):
                why = reason[f, m]
                fill = np.broadcast_to(close, shape)[f, m].copy()
                level = (why == 0) & at_stop[m]
                fill[level] = (side[f, m] * stop[f, m])[level]
                fill[why == 1] = (side[f, m] * goal[f, m])[why == 1]
                parts.append((f, m, begun[f, m], np.full(len(f), t), side[f, m], price[f, m], fill, why))
                side[f, m] = 0
                stop[f, m] = none
        said = bars.sig[:, t][:, signal]
        enters = ~open_ & (np.abs(said) > 0) & ~np.isnan(atr) & (bars.last > t)[:, None]
        f, m = np.nonzero(enters)
        if len(f):
            d, c, a = said[f, m], close[f, 0], atr[f, 0]
            side[f, m], begun[f, m], price[f, m], range0[f, m] = d, t, c, a
            stop[f, m], goal[f, m] = d * c - sl[m] * a, d * c + tp[m] * a
            for k, user in enumerate(users):
                mine = of_user[k][m]
                if user.initial is not None and mine.any():
                    first = np.asarray(user.initial(View(c[mine], a[mine], d[mine], c[mine], np.zeros(mine.sum(), np.int64))))
                    if owned[k] is None:
                        owned[k] = np.zeros((*shape, *first.shape[1:]), first.dtype)
                    owned[k][f[mine], m[mine]] = first
    return Events(parts, names)


TRADE = "entry_i int, exit_i int, entry_time date, exit_time date, direction int, entry_price double, exit_price double, reason string, size double"


def _trades(e: Events, bars: Bars, rows: np.ndarray, sizer: np.ndarray) -> dict[str, pa.Array]:
    """The columns of TRADE for chosen events; ``sizer`` is the size column of each, -1 for none."""
    fold, entry, leave = e.fold[rows], e.entry[rows], e.exit[rows]
    size = np.ones(len(rows))
    sized = sizer >= 0
    size[sized] = bars.size[fold[sized], entry[sized], sizer[sized]]
    return {
        "entry_i": pa.array(entry, pa.int32()),
        "exit_i": pa.array(leave, pa.int32()),
        "entry_time": bars.date.take(pa.array(bars.start[fold] + entry)),
        "exit_time": bars.date.take(pa.array(bars.start[fold] + leave)),
        "direction": pa.array(e.side[rows], pa.int32()),
        "entry_price": pa.array(e.entry_price[rows]),
        "exit_price": pa.array(e.exit_price[rows]),
        "reason": pa.array(e.names, pa.string()).take(pa.array(e.reason[rows])),
        "size": pa.array(np.where(np.isnan(size), 1.0, size)),
    }


BLOCK = 20_000  # bars that are stepped through together


def _blocks(rows: pa.ListArray) -> list[slice]:
    """Runs of rows of about ``BLOCK`` bars; one row at least."""
    block = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(rows)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _sizers(runs: Sequence) -> np.ndarray:
    return np.array([-1 if r.size is None else r.size for r in runs], np.int64)


def every_trade(runs: Sequence, keys: Sequence[str]) -> Callable:
    """A map over packed folds that gives all trades of all runs."""
    distinct, of = machines(runs)
    sizers = _sizers(runs)

    def trade(batches):
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for part in _blocks(column["bars"]):
                bars = Bars(column["bars"][part])
                e = scan(bars, distinct)
                found = [np.flatnonzero(e.machine == m) for m in of]
                run = np.repeat(np.arange(len(runs)), [len(f) for f in found])
                rows = np.concatenate(found)
                at = pa.array(e.fold[rows])
                combo = np.array([r.combo for r in runs], np.int64)[run]
                yield pa.RecordBatch.from_pydict({**{k: column[k][part].take(at) for k in keys}, "combo": pa.array(combo, pa.int32()), **_trades(e, bars, rows, sizers[run])})

    return trade


@dataclass(frozen=True)
class Plan:
    """A variant of a walk-forward run: its name, the trades a choice needs, its fee (one, or one per market), its runs."""

    variant: str
    need: int
    fee: float | Mapping[str, float]
    runs: tuple


WALKED = f"market string, symbol string, variant string, fold int, start int, fee double, combo int, is_mean_ret double, {TRADE}"


def chosen_trades(plans: Sequence[Plan]) -> Callable:
    """A map over instruments with their packed folds: trades of each fold under the best combination of the one before."""
    runs = [r for p in plans for r in p.runs]
    distinct, of = machines(runs)
    starts = np.cumsum([0, *(len(p.runs) for p in plans)])
    sizers, combos = _sizers(runs), np.array([r.combo for r in runs], np.int64)

    def walk(batches):
        for batch in batches:
            market, symbol, folds = (batch.column(batch.schema.get_field_index(c)) for c in ("market", "symbol", "folds"))
            bars = folds.flatten().field("bars")
            of_fold = np.repeat(np.arange(len(folds)), folds.value_lengths().to_numpy(zero_copy_only=False))
            number = folds.flatten().field("fold").to_numpy(zero_copy_only=False)
            length = np.bincount(of_fold, bars.value_lengths().to_numpy(zero_copy_only=False), len(folds))
            for part in _blocks(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.nulls(int(length.sum())))):
                lo, hi = np.searchsorted(of_fold, [part.start, part.stop])
                yield from block(market, symbol, of_fold[lo:hi], number[lo:hi], bars[lo:hi])

    def block(market, symbol, owner, number, packed):
        """Trades of the folds ``number`` of the instruments ``owner``, ordered by instrument and fold."""
        bars = Bars(packed)
        e = scan(bars, distinct)
        gross = e.side * (e.exit_price - e.entry_price) / e.entry_price
        cell = e.fold * len(distinct) + e.machine
        shape = (len(number), len(distinct))
        count = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
        order = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[order], np.arange(count.size + 1))
        follows = np.zeros(len(number), bool)
        follows[:-1] = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1] + 1)
        names = market.take(pa.array(owner)).to_pylist()
        parts = []
        for p, (variant, at) in zip(plans, enumerate(starts)):
            fees = np.array([p.fee.get(m) if isinstance(p.fee, Mapping) else p.fee for m in names], float)  # a missing one is NaN
            total = np.bincount(cell, gross - fees[e.fold] / 1e4, count.size).reshape(shape)  # in the order of exits
            mine = np.array(of[at : at + len(p.runs)])
            n = count[:, mine]
            mean = np.where(n >= p.need, total[:, mine] / np.maximum(n, 1), -np.inf)
            best = np.argmax(mean, axis=1)  # the first of equal ones
            f = np.flatnonzero((n >= p.need).any(axis=1) & follows)
            c = (f + 1) * len(distinct) + mine[best[f]]
            m = bounds[c + 1] - bounds[c]
            rows = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[c], m)]
            chosen = np.repeat(f, m)
            parts.append((rows, chosen, np.full(len(rows), variant), at + best[chosen], fees[chosen], mean[chosen, best[chosen]]))
        rows, chosen, variant, run, fee, mean = (np.concatenate(x) for x in zip(*parts))
        start = number[e.fold[rows]] * (bars.last[e.fold[rows]] + 1)
        yield pa.RecordBatch.from_pydict({
            "market": market.take(pa.array(owner[chosen])), "symbol": symbol.take(pa.array(owner[chosen])),
            "variant": pa.array([p.variant for p in plans], pa.string()).take(pa.array(variant)),
            "fold": pa.array(number[chosen], pa.int32()), "start": pa.array(start, pa.int32()), "fee": pa.array(fee, pa.float64()),
            "combo": pa.array(combos[run], pa.int32()), "is_mean_ret": pa.array(mean, pa.float64()), **_trades(e, bars, rows, sizers[run])})

    return walk
