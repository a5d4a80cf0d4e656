"""Multi-market study: every strategy, market, freeze date and variant.

Rule-based variants of all markets run in one plan. Learned variants need models per market
and freeze; one registry holds them all, so that what does not depend on the strategy is fitted
once for all strategies, and thresholds share their model. Each market's variants of both freezes
share one walk-forward plan. Variants are named ``<component>``, ``<component>@transfer`` for
models fitted on every other market, and ``<component>@<setting>`` for execution settings;
freeze-independent ones carry freeze ``all``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window
from ..operators.cleaning import CleaningRules
from ..operators.decisions import ModelRegistry, rule_gate, study_decisions
from ..operators.model_store import ModelStore
from ..operators.models import TrainingData
from ..operators.signals import RULES
from ..operators.walkforward import build_strategy, walk_forward
from ..session import cut_lineage

# The keys of the variants and their kinds.
MAIN = ("rule_adx", "regime_linearity", "meta_label", "position_sizing", "entry", "exit", "best_combined")
KIND = {"rule_adx": "rule", "regime_linearity": "independent", "meta_label": "narrowing",
        "position_sizing": "narrowing", "entry": "replacing", "exit": "replacing", "best_combined": "combination"}
ABLATIONS = ("meta_label_thr045", "meta_label_thr055", "meta_label_small_model", "exit_small_model")


@dataclass(frozen=True)
class Freeze:
    name: str
    split: str
    test_end: str


@dataclass(frozen=True)
class Market:
    name: str
    cost_bps: float
    survivorship_free: bool = True


@dataclass(frozen=True)
class Setting:
    """An execution assumption the listed variants are run again under."""

    name: str
    fill: str
    lag: int
    variants: tuple[str, ...] = ("baseline", "exit", "best_combined")


# Fixed values of the five documented strategies.
STRATEGIES = {
    "jma_trend": dict(signal="jma_cross", signal_grid={"fast": [5, 7, 9], "slow": [21, 28]}, exit="trailing",
                      exit_grid={"sl_mult": [1.5, 2.0], "trail_mult": [2.0, 3.0]}, min_trades=10),
    "sma_cross": dict(signal="sma_cross", signal_grid={"fast": [20, 50], "slow": [100, 200]}, exit="trailing",
                      exit_grid={"sl_mult": [2.0, 3.0], "trail_mult": [3.0, 4.0]}, min_trades=4),
    "donchian": dict(signal="donchian", signal_grid={"lookback": [20, 55]}, exit="trailing",
                     exit_grid={"sl_mult": [2.0], "trail_mult": [2.0, 3.0]}, min_trades=6),
    "ts_momentum": dict(signal="ts_momentum", signal_grid={"lookback": [126, 252]}, exit="trailing",
                        exit_grid={"sl_mult": [2.0, 3.0], "trail_mult": [3.0, 4.0]}, min_trades=4),
    "rsi2_reversion": dict(signal="rsi2", signal_grid={"entry": [5, 10]}, exit="bracket",
                           exit_grid={"sl_mult": [2.0, 3.0], "tp_mult": [1.0, 1.5]}, min_trades=10),
}


@dataclass(frozen=True)
class StudyConfig:
    markets: Sequence[Market]
    freezes: Sequence[Freeze] = (Freeze("F2008", "2008-01-01", "2018-01-01"), Freeze("F2018", "2018-01-01", "2100-01-01"))
    strategies: Mapping[str, Mapping] = field(default_factory=lambda: dict(STRATEGIES))
    main: Sequence[str] = MAIN
    ablations: Sequence[str] = ABLATIONS
    transfer: Sequence[str] = ("meta_label", "best_combined")
    settings: Sequence[Setting] = (Setting("optimistic_stop_fill", "stop", 0), Setting("one_day_lag", "close", 1))
    fill: str = "close"
    lag: int = 0
    n_splits: int = 5
    block_days: int = 20
    n_boot: int = 2000
    alpha: float = 0.05
    cost_multipliers: Sequence[float] = (0.0, 1.0, 2.0, 4.0)
    trend_sma_days: int = 200
    vol_window_days: int = 20
    # Names and dates of the crises.
    crises: Sequence[tuple[str, str, str]] = (
        ("GFC", "2008-09-01", "2009-03-31"), ("Euro debt crisis", "2011-07-01", "2011-12-31"),
        ("2015-16 selloff", "2015-08-01", "2016-02-29"), ("COVID crash", "2020-02-19", "2020-04-30"),
        ("2022 bear market", "2022-01-01", "2022-10-31"))
    cleaning: CleaningRules = CleaningRules()
    model_params: Mapping = field(default_factory=dict)
    min_days: int = 250

    def costs(self) -> dict[str, float]:
        return {m.name: m.cost_bps for m in self.markets}

    def control(self, strategy: str, fill: str | None = None, lag: int | None = None, costs=None):
        s = self.strategies[strategy]
        return build_strategy(RULES[s["signal"]], s["exit"], s["signal_grid"], s["exit_grid"],
                              self.costs() if costs is None else costs, fill or self.fill,
                              self.lag if lag is None else lag)


def _tag(trades: DataFrame, strategy: str, freezes: Mapping[str, Freeze | None]) -> DataFrame:
    """Split the plan's ``variant|freeze`` label and keep learned trades inside their test window."""
    df = trades.withColumns({"strategy": F.lit(strategy), "freeze": F.split_part("variant", F.lit("|"), F.lit(2)),
                             "variant": F.split_part("variant", F.lit("|"), F.lit(1))})
    keep = F.col("freeze") == "all"
    for name, fz in freezes.items():
        keep = keep | ((F.col("freeze") == name) & in_window(F.col("entry_time"), fz.split, fz.test_end))
    return df.where(keep)


def rule_variants(bars: DataFrame, cfg: StudyConfig, strategy: str) -> DataFrame:
    """Control, rule gate and the control under each execution setting, for all markets at once."""
    control = cfg.control(strategy)
    plans = {"baseline|all": control, "rule_adx|all": rule_gate().on(control, [])}
    for s in cfg.settings:
        if "baseline" in s.variants:
            plans[f"baseline@{s.name}|all"] = cfg.control(strategy, s.fill, s.lag)
    return _tag(walk_forward(bars, plans, cfg.n_splits, cfg.strategies[strategy]["min_trades"]), strategy, {})


OTHERS = "all but "  # name of the pool of every other market


def study_pools(bars: DataFrame, cfg: StudyConfig) -> dict[str, TrainingData]:
    """One pool per market and one of all other markets, over features that are written once."""
    whole = TrainingData(bars)
    pools = {m.name: whole.where(F.col("market") == m.name) for m in cfg.markets}
    if len(cfg.markets) > 1:
        pools |= {OTHERS + m.name: whole.where(F.col("market") != m.name) for m in cfg.markets}
    return pools


def _wanted(cfg: StudyConfig, market: str, control, foreign) -> list[tuple[str, str, Freeze, object]]:
    """(variant, pool, freeze, control for labels) of one market's learned variants."""
    own = [k for k in (*cfg.main, *cfg.ablations) if k != "rule_adx"]
    jobs = [(k, market, fz, control) for fz in cfg.freezes for k in own]
    # A pool of other markets pays this market's cost in its labels of trades.
    return jobs + [(k, OTHERS + market, fz, foreign) for fz in cfg.freezes for k in cfg.transfer if len(cfg.markets) > 1]


def learned_variants(bars: DataFrame, cfg: StudyConfig, strategy: str, market: str,
                     registry: ModelRegistry) -> tuple[DataFrame | None, list[tuple]]:
    """All learned variants of one market; one that cannot be fitted is reported, not raised."""
    control, made, skipped, plans = cfg.control(strategy), study_decisions(cfg.model_params), [], {}
    jobs = _wanted(cfg, market, control, cfg.control(strategy, costs=cfg.costs()[market]))
    registry.fit(f for k, pool, fz, base in jobs for f in made[k].fits(pool, fz.split, base))
    for key, pool, fz, base in jobs:
        name = key if pool == market else f"{key}@transfer"
        try:
            plans[f"{name}|{fz.name}"] = made[key].learned(control, registry, pool, fz.split, base)
            for s in cfg.settings:
                if key in s.variants and pool == market:
                    changed = cfg.control(strategy, s.fill, s.lag)
                    plans[f"{key}@{s.name}|{fz.name}"] = made[key].learned(changed, registry, pool, fz.split, base)
        except ValueError as e:
            skipped.append((strategy, market, name, fz.name, str(e)))
    if not plans:
        return None, skipped
    mine = bars.where(F.col("market") == market)
    trades = walk_forward(mine, plans, cfg.n_splits, cfg.strategies[strategy]["min_trades"])
    return _tag(trades, strategy, {f.name: f for f in cfg.freezes}), skipped


def run_study(bars: DataFrame, cfg: StudyConfig, registry: ModelRegistry | None = None,
              store: ModelStore | None = None) -> tuple[DataFrame, DataFrame]:
    """``(trades, skipped)`` of the whole study; each branch's trades are written as they are made.

    With a ``store``, a run that follows another on the same bars fits nothing.

    A learned variant that was fitted but has no trade in its window is in ``skipped`` too. Any
    object with the methods of ``ModelRegistry`` can stand in for it.
    """
    registry = registry or ModelRegistry(study_pools(bars, cfg), workers=4, store=store)
    parts, skipped = [], []
    for s in cfg.strategies:
        parts.append(cut_lineage(rule_variants(bars, cfg, s)))
        for m in cfg.markets:
            trades, missed = learned_variants(bars, cfg, s, m.name, registry)
            skipped += missed
            if trades is not None:
                parts.append(cut_lineage(trades))
                traded = {(r["variant"], r["freeze"]) for r in parts[-1].select("variant", "freeze").distinct().collect()}
                failed = {(v, f) for _, _, v, f, _ in missed}
                names = {(k if pool == m.name else f"{k}@transfer", fz.name) for k, pool, fz, _ in _wanted(cfg, m.name, None, None)}
                skipped += [(s, m.name, v, f, "no trades") for v, f in sorted(names - traded - failed)]
    log = bars.sparkSession.createDataFrame(skipped, "strategy string, market string, variant string, freeze string, "
                                                     "reason string")
    return reduce(DataFrame.unionByName, parts), log


def run_log(trades: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Per strategy and market: trades, variants, and the skipped variants with their reasons."""
    done = trades.groupBy("strategy", "market").agg(F.count(F.lit(1)).alias("n_trades"),
                                                    F.countDistinct("variant").alias("n_variants"))
    if skipped is None:
        return done
    why = F.concat_ws("", "variant", F.lit("/"), "freeze", F.lit(": "), "reason")
    missed = skipped.groupBy("strategy", "market").agg(
        F.array_join(F.array_sort(F.collect_set(why)), "; ").alias("skipped"))
    return done.join(missed, ["strategy", "market"], "full").fillna({"n_trades": 0, "n_variants": 0, "skipped": ""})

