"""Single-market attribution: freeze, hold-out, forward window, one decision at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window
from ..functions.distribution import expected_best
from ..operators.decisions import ModelRegistry, trials_per_family
from ..operators.inference import day_bootstrap, excludes_zero
from ..operators.metrics import realized_summary, with_deflated_sharpe
from ..operators.models import TrainingData
from ..operators.valuation import realized_daily
from ..operators.walkforward import Strategy, never_traded, walk_forward
from ..session import cut_lineage
from .reports import run_matrix

CONTROL = "Baseline (rule-based)"


@dataclass
class Attribution:
    """``table``: one row per variant and window; ``trades``: every out-of-sample trade."""

    table: DataFrame
    trades: DataFrame

    def matrix(self) -> DataFrame:
        return run_matrix(self.table)


def windowed(trades: DataFrame, windows: Sequence[tuple]) -> DataFrame:
    """Tag trades with every window that holds their entry date."""
    parts = [trades.where(in_window(F.col("entry_time"), lo, hi)).withColumn("window", F.lit(name))
             for name, lo, hi in windows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attribution_table(trades: DataFrame, control: str, kinds: Mapping[str, str], trials: Mapping[str, int],
                      paired_ci: bool = False, reps: int = 2000, seed: int = 0) -> DataFrame:
    """Score every variant against the control inside each window.

    ``trades`` carries ``market, variant, window``. The deflated Sharpe ratio accounts for the
    number of screened variants of the same type of decision.
    """
    keys = ["market", "window", "variant"]
    names = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("kind"),
                               F.lit(expected_best(int(trials.get(v, 1)))).alias("best")) for v, k in kinds.items()])
    seen = trades.select("market", "window").distinct()
    grid = seen.select("market", "window", F.explode(names).alias("v")).select("market", "window", "v.*")
    summary = realized_summary(trades, keys).join(grid.select(*keys, "best"), keys)
    s = with_deflated_sharpe(summary, F.col("best")).drop("best")
    table = grid.join(s, keys, "left").fillna({"n_trades": 0, "sharpe": 0.0, "total_return": 0.0, "max_drawdown": 0.0,
                                               "deflated_sharpe": 0.0})
    base = table.where(F.col("variant") == control).select("market", "window", F.col("sharpe").alias("baseline_sharpe"))
    daily = realized_daily(trades, keys)
    ctl = daily.where(F.col("variant") == control).drop("variant")
    others = grid.where(F.col("variant") != control).select(*keys)
    ci = day_bootstrap(daily.where(F.col("variant") != control), ctl.join(others, ["market", "window"]), keys, reps,
                       seed=seed, paired=paired_ci)
    out = table.join(base, ["market", "window"]).join(ci, keys, "left")
    return out.select("market", "window", "variant", "kind", "n_trades", "sharpe", "mean_trade_bps", "total_return",
                      "max_drawdown", "baseline_sharpe", (F.col("sharpe") - F.col("baseline_sharpe")).alias("delta_sharpe"),
                      "deflated_sharpe", "ci_lo", "ci_hi", excludes_zero().alias("significant"))


def run_attribution(bars: DataFrame, decisions: Sequence, split_date, forward_start=None, base: Strategy | None = None,
                    n_splits: int = 5, min_trades: int = 10, paired_ci: bool = False, reps: int = 2000,
                    warn: bool = True) -> Attribution:
    """Learn every decision once before ``split_date``, trade all variants, score them by entry date.

    The variants share one walk-forward plan, so bars are read and shuffled once for all.
    """
    base = base or Strategy()
    registry = ModelRegistry({"all": TrainingData(bars)}, workers=4)
    registry.fit(f for d in decisions for f in d.fits("all", split_date, base))
    strategies = {CONTROL: base, **{d.name: d.learned(base, registry, "all", split_date, base) for d in decisions}}
    trades = cut_lineage(walk_forward(bars, strategies, n_splits, min_trades))
    if warn:
        never_traded(trades, CONTROL)
    windows = [("holdout", split_date, forward_start)] + ([("forward", forward_start, None)] if forward_start else [])
    kinds = {CONTROL: "control", **{d.name: d.kind for d in decisions}}
    table = attribution_table(windowed(trades, windows), CONTROL, kinds, trials_per_family(decisions), paired_ci, reps)
    return Attribution(table, trades)


def calendar_split(bars: DataFrame, share: float = 0.7):
    """Freeze date at a share of the calendar span of all instruments, as a one-row DataFrame."""
    span = F.floor(share * F.datediff(F.max("date"), F.min("date"))).cast("int")
    return bars.agg(F.date_add(F.min("date"), span).alias("split"))
