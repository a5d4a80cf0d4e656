"""Walk-forward selection and out-of-sample trading.

Every parameter combination of every strategy is scanned once per fold, all of them in one pass
over the bars of an instrument (``states``). On fold k the combination with the best mean trade return
is chosen; the trades of fold k+1 under that combination are already there, so only they leave the group.
The whole operator costs one exchange on the instrument key.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FOLD_KEYS, KEYS
from ..functions.indicators import with_features, without_recursion
from . import scan, states
from .folds import as_one_fold, chunk
from .signals import JMA_CROSS, SignalRule, combos, gated

T = TypeVar("T")
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Strategy:
    """The five decisions of a rule-based system plus its parameter grids and costs.

    ``exit``    name of a built-in exit, or a function of the grid's parameters and ``fill`` that gives an ``ExitRule``
    ``gate``    boolean column over the feature frame; NULL blocks the entry
    ``sizer``   multiplier column read on the entry bar; NULL means 1
    ``hold``    pair of columns with the probability of holding a long / a short
    ``scorers`` functions that add the score columns those expressions use
    ``fee_bps`` round-trip cost, one number or one per market
    """

    signal: SignalRule = JMA_CROSS
    exit: str | Callable[..., scan.ExitRule] = "bracket"
    exit_grid: Mapping[str, Sequence[float]] = field(
        default_factory=lambda: {"sl_mult": [1.0, 1.5, 2.0], "tp_mult": [1.5, 2.0, 3.0, 4.0]})
    gate: Column | None = None
    sizer: Column | None = None
    hold: tuple[Column, Column] | None = None
    scorers: tuple[Scorer, ...] = ()
    fee_bps: float | Mapping[str, float] = 7.0
    lag: int = 0
    fill: str = "stop"
    exit_args: Mapping[str, float] = field(default_factory=dict)

    def with_(self, **changes) -> "Strategy":
        return replace(self, **changes)

    def exit_rule(self, **params) -> scan.ExitRule:
        make = self.exit if callable(self.exit) else scan.EXITS[self.exit]
        return make(fill=self.fill, **{**self.exit_args, **params})


def build_strategy(signal: SignalRule, exit: str, signal_grid: Mapping, exit_grid: Mapping, cost_bps,
                   fill: str = "close", lag: int = 0) -> Strategy:
    """A control strategy from a configuration entry."""
    return Strategy(signal=replace(signal, grid=dict(signal_grid)), exit=exit, exit_grid=dict(exit_grid),
                    fee_bps=cost_bps, fill=fill, lag=lag)


def _score(frame: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    done: list[Scorer] = []
    for s in strategies:
        for scorer in s.scorers:
            if not any(scorer is d for d in done):
                frame = scorer(frame)
                done.append(scorer)
    return frame


def _filters(strategies: Sequence[Strategy], grids: bool):
    return [f for s in strategies for p in (s.signal.combos() if grids else [{}]) for f in s.signal.filters(**p)]


def feature_frame(folds: DataFrame, strategies: Sequence[Strategy], grids: bool = True) -> DataFrame:
    """Fold-local features, the filters of every signal grid, and all model scores."""
    frame = with_features(folds, FOLD_KEYS, _filters(strategies, grids))
    return _score(frame, strategies)


def _on_features(folds: DataFrame, strategies: Sequence[Strategy], grids: bool, build: Callable[[DataFrame], T]) -> T:
    """``build`` on the features of ``folds``, without the recursive ones where no column of ``build`` names them.

    Those take every bar through a Python stage and a further exchange, which no planner can prune. Models
    read all features; for the rest the analyzer tells whether a column is missing.
    """
    if not any(s.scorers for s in strategies):
        try:
            return build(without_recursion(folds, FOLD_KEYS, _filters(strategies, grids)))
        except AnalysisException as missing:
            if not (missing.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
    return build(feature_frame(folds, strategies, grids))


class SignalColumns:
    """Signal columns of a run, each distinct one computed once however many variants use it."""

    def __init__(self, frame: DataFrame, keys: Sequence[str]):
        self.frame, self.keys = frame, keys
        self.raw: dict[tuple, str] = {}
        self.final: dict[tuple, tuple[str, Column]] = {}

    def add(self, s: Strategy, grids: bool) -> list[str]:
        """Column names of the gated and delayed signals of a strategy, one per combination."""
        names = []
        for p in s.signal.combos() if grids else [{}]:
            params = tuple(sorted({**s.signal.defaults, **p}.items()))
            rule = (s.signal.name, s.signal.build, params)
            if rule not in self.raw:
                self.raw[rule] = f"_raw{len(self.raw)}"
                self.frame = s.signal.add(self.frame, self.keys, self.raw[rule], **p)
            use = (self.raw[rule], None if s.gate is None else id(s.gate), s.lag)
            if use not in self.final:
                self.final[use] = (f"_sig{len(self.final)}", gated(F.col(self.raw[rule]), s.gate, s.lag, self.keys))
            names.append(self.final[use][0])
        return names

    def build(self) -> tuple[DataFrame, list[Column], dict[str, int]]:
        """The frame with every signal, the signals in order, and the position of each."""
        frame = self.frame.withColumns(dict(self.final.values()))
        order = [name for name, _ in self.final.values()]
        return frame, [F.col(n) for n in order], {n: i for i, n in enumerate(order)}


def default_trades(bars: DataFrame, s: Strategy) -> DataFrame:
    """Trades of the ungated, unsized strategy at its default parameters on the whole history."""
    plain = s.with_(gate=None, sizer=None)
    up, down = ([plain.hold[0]], [plain.hold[1]]) if plain.hold else ((), ())
    run = scan.Run(0, 0, plain.exit_rule(), 0 if plain.hold else None)

    def trades(frame: DataFrame) -> DataFrame:
        columns = SignalColumns(frame, FOLD_KEYS)
        columns.add(plain, grids=False)
        frame, cols, _ = columns.build()
        return scan.extract(frame, cols, [run], F.expr(fee_sql(plain.fee_bps)), up=up, down=down).drop("combo")

    return _on_features(as_one_fold(bars), [plain], False, trades)


def walk_forward(bars: DataFrame, strategies: Mapping[str, Strategy], n_splits: int = 5,
                 min_trades: int | Mapping[str, int] = 10, frame: DataFrame | None = None) -> DataFrame:
    """Out-of-sample trades of every strategy on every instrument, tagged ``variant``.

    ``fold`` is the selection fold; the trades come from the fold after it and carry the
    in-sample mean return of the chosen combination. Sizing never takes part in selection.
    Pass ``frame`` to reuse an already computed (and possibly materialised) feature frame.
    """
    if frame is None:
        return _on_features(chunk(bars, n_splits), list(strategies.values()), True,
                            lambda made: walk_forward(bars, strategies, n_splits, min_trades, made))
    columns = SignalColumns(frame, FOLD_KEYS)
    used = {name: columns.add(s, grids=True) for name, s in strategies.items()}
    frame, signals, at = columns.build()
    up: list[Column] = []
    down: list[Column] = []
    sizes: list[Column] = []
    plans = []
    for name, s in strategies.items():
        pair = size = None
        if s.hold is not None:
            pair = len(up)
            up.append(s.hold[0])
            down.append(s.hold[1])
        if s.sizer is not None:
            size = len(sizes)
            sizes.append(s.sizer)
        exits = [s.exit_rule(**p) for p in combos(s.exit_grid)]
        runs = [scan.Run(i * len(exits) + j, at[col], e, pair, size)
                for i, col in enumerate(used[name]) for j, e in enumerate(exits)]
        need = min_trades if isinstance(min_trades, int) else min_trades[name]
        plans.append((name, need, s.fee_bps, runs))
    packed = scan.pack(frame, signals, up, down, sizes)
    users = scan.users_of([r for *_, runs in plans for r in runs])
    if users:  # exits in SQL are compiled into the state machine of the JVM
        every = ", ".join(_plan_sql(*p, users) for p in plans)
        return _select_and_trade(packed.withColumn("plan", F.explode(F.expr(f"array({every})"))), users)
    walk = states.chosen_trades([states.Plan(name, max(need, 1), fee, tuple(runs)) for name, need, fee, runs in plans])
    whole = packed.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("fold", "bars"))).alias("folds"))
    return _placed(whole.mapInArrow(walk, states.WALKED))


def fee_sql(fee_bps: float | Mapping[str, float]) -> str:
    if not isinstance(fee_bps, Mapping):
        return f"{float(fee_bps)!r}D"
    cases = " ".join(f"WHEN '{m}' THEN {float(v)!r}D" for m, v in fee_bps.items())
    return f"CASE market {cases} END"


def _plan_sql(name: str, need: int, fee_bps, runs: Sequence[scan.Run], users: Sequence[scan.UserExit]) -> str:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return (f"named_struct('variant', '{quoted}', 'need', {max(need, 1)}, 'fee', {fee_sql(fee_bps)}, "
            f"'runs', {scan.runs_sql(runs, users)})")


def _select_and_trade(rows: DataFrame, users: Sequence[scan.UserExit] = ()) -> DataFrame:
    """Choose per fold, then read the next fold's trades of the chosen combination."""
    rows = rows.select(*FOLD_KEYS, "last_idx", "plan.variant", "plan.need", "plan.fee", scan.run_column("plan.runs", users=users).alias("runs"))
    mean = ("aggregate(r.trades, 0D, (a, t) -> a + (t.direction * (t.exit_price - t.entry_price) / t.entry_price "
            "- fee / 1e4D)) / size(r.trades)")
    best = F.expr(f"array_max(transform(filter(runs, r -> size(r.trades) >= need), "
                  f"r -> named_struct('mean', {mean}, 'rank', -r.combo)))")
    rows = rows.withColumn("best", best)
    before = F.lag("best").over(Window.partitionBy(*KEYS, "variant").orderBy("fold"))
    rows = rows.withColumn("chosen", before).where(F.col("chosen").isNotNull())
    start = F.col("fold") * (F.col("last_idx") + 1)
    rows = rows.select(*KEYS, "variant", (F.col("fold") - 1).alias("fold"), start.alias("start"), "fee",
                       (-F.col("chosen.rank")).alias("combo"), F.col("chosen.mean").alias("is_mean_ret"),
                       F.explode(F.expr("runs[-chosen.rank].trades")).alias("t"))
    return _placed(rows.select(*KEYS, "variant", "fold", "combo", "is_mean_ret", "fee", "start", "t.*"))


def _placed(rows: DataFrame) -> DataFrame:
    """Trades with their positions in the instrument's history and their returns."""
    rows = rows.withColumns({"entry_pos": F.col("start") + F.col("entry_i"), "exit_pos": F.col("start") + F.col("exit_i")})
    return rows.withColumns(scan.trade_columns(F.col("fee"))).drop("fee", "start")


def never_traded(trades: DataFrame, control: str) -> bool:
    """True, with a warning, when the control has no out-of-sample trade at all."""
    if trades.where(F.col("variant") == control).limit(1).count():
        return False
    warnings.warn("the control has no out-of-sample trades: no fold had a parameter combination with enough "
                  "in-sample trades; use a faster signal, a longer history, fewer folds or a lower minimum",
                  stacklevel=2)
    return True
