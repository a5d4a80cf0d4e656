"""Decisions of a rule that a learned score can take over, stated as data.

A ``Decision`` names the models it needs and says, as a function of their score columns, which
fields of a ``Strategy`` it sets. One function fits and applies any of them; decisions combine by
merging. Models come from a registry keyed by what determines them, so that decisions which
need the same model share one fit. A score is a column: any other score can stand in for it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import KEYS, is_true
from ..functions.indicators import FEATURES, features_known
from . import labels
from .model_store import ModelStore
from .models import BUDGET, SMALL_BUDGET, ProbModel, TrainingData, pooled
from .signals import SignalRule, adx_gate
from .walkforward import Strategy, default_trades


# ---- decisions as columns over a score ------------------------------------------------

def score_gate(score: Column, threshold: float = 0.5) -> Column:
    """Allow the entry when the score reaches the threshold; a missing score blocks it."""
    return is_true(score >= threshold)


def score_size(score: Column, lo: float = 0.0, hi: float = 2.0) -> Column:
    """Multiplier between ``lo`` and ``hi``; 1 for an entry without a score."""
    return F.coalesce(lo + score * (hi - lo), F.lit(1.0))


def score_signal(long: Column, short: Column, threshold: float = 0.5) -> Column:
    """Side whose score is strictly larger and reaches the threshold, else no entry."""
    pl, ps = F.coalesce(long, F.lit(-1.0)), F.coalesce(short, F.lit(-1.0))
    return F.when((pl >= threshold) & (pl > ps), 1).when((ps >= threshold) & (ps > pl), -1).otherwise(0)


def score_rule(long: Column, short: Column, threshold: float = 0.5, name: str = "score") -> SignalRule:
    return SignalRule(name, lambda df, keys, out: df.withColumn(out, score_signal(long, short, threshold)))


# ---- what a model learns --------------------------------------------------------------

#: Label columns over a feature frame, by target; ``trade`` is not a label of bars but of trades.
TARGETS: dict[str, Callable[..., DataFrame]] = {
    "linearity": lambda frame, side, horizon: labels.label_linearity(frame, KEYS, horizon),
    "excursion": lambda frame, side, horizon: labels.label_excursion(frame, KEYS, horizon),
    "move_size": lambda frame, side, horizon: labels.label_move_size(frame, KEYS, horizon),
    "bracket": lambda frame, side, horizon, sl, tp: labels.label_bracket(frame, side, KEYS, horizon, sl, tp),
    "continuation": lambda frame, side, horizon: labels.label_continuation(frame, side, KEYS, horizon),
}


@dataclass(frozen=True)
class ModelSpec:
    """A classifier up to its data: target, side, label horizon, further label settings, budget."""

    target: str
    horizon: int = 0
    side: int = 0
    settings: tuple[float, ...] = ()
    budget: tuple[tuple[str, float], ...] = ()

    def training_rows(self, data: TrainingData, split, base: Strategy) -> DataFrame:
        if self.target == "trade":
            return trade_labels(data, split, base)
        return pooled(TARGETS[self.target](data.frame, self.side, self.horizon, *self.settings), split, self.horizon)


def trade_labels(data: TrainingData, split, base: Strategy) -> DataFrame:
    """Entry-bar features of the control's own resolved trades, labelled by a positive return.

    Uses the ungated, unsized control at its default parameters on the full history; only
    trades that exit before the freeze count.
    """
    trades = default_trades(data.bars, base).where(F.col("exit_time") < F.lit(split).cast("date"))
    entries = trades.select(*KEYS, F.col("entry_i").alias("pos"), (F.col("ret") > 0).cast("double").alias("label"))
    return entries.join(data.frame.where(features_known()).select(*KEYS, "pos", *FEATURES), [*KEYS, "pos"]).select(
        *FEATURES, "label")


@dataclass(frozen=True)
class Fit:
    """A model with its data: pool by name, freeze date, and the control for labels of trades."""

    spec: ModelSpec
    pool: str
    split: str
    base: Strategy | None

    def key(self) -> tuple:
        # Labels of bars do not depend on the control; for trades the object itself is part of the entry.
        return self.spec, self.pool, str(self.split), id(self.base) if self.spec.target == "trade" else None


class ModelRegistry:
    """Models of a run, each fitted once; a fit that cannot be made stays recorded with its reason.

    With a ``store``, models of earlier runs on the same training rows are loaded and new ones are kept there;
    ``fitted`` counts the models that this run had to fit.
    """

    def __init__(self, pools: Mapping[str, TrainingData], workers: int = 1, store: ModelStore | None = None):
        self.pools, self.workers, self.store = dict(pools), workers, store
        self._new: list[str] = []
        self.entries: dict[tuple, tuple[Fit, ProbModel | ValueError]] = {}
        self.scorers: dict[tuple, Callable[[DataFrame], DataFrame]] = {}

    @property
    def fitted(self) -> int:
        return len(self._new)

    def made(self, f: Fit) -> ProbModel:
        """The model of a fit, from the store if it is there."""
        model = ProbModel(**dict(f.spec.budget))
        rows = f.spec.training_rows(self.pools[f.pool], f.split, f.base).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            address = self.store.address(rows, model.params) if self.store else None
            model.model = self.store.load(address) if self.store else None
            if model.model is None:
                model = model.fit(rows)
                self._new.append(f.pool)
                if self.store:
                    self.store.save(address, model.model)
        finally:
            rows.unpersist()
        return model

    def fit(self, wanted: Iterable[Fit]) -> None:
        """Fit all models not fitted before, ``workers`` at a time."""
        new = {f.key(): f for f in wanted if f.key() not in self.entries}

        def run(f: Fit) -> tuple[Fit, ProbModel | ValueError]:
            try:
                return f, self.made(f)
            except ValueError as reason:
                return f, reason

        for pool in {f.pool for f in new.values()}:
            _ = self.pools[pool].frame  # written before threads share it
        with ThreadPoolExecutor(self.workers) as threads:
            self.entries.update(zip(new, threads.map(run, new.values())))

    def scorer(self, f: Fit) -> tuple[str, Callable[[DataFrame], DataFrame]]:
        """Name of the score column and the function that adds it; raises why there is no model."""
        self.fit([f])
        key, model = f.key(), self.entries[f.key()][1]
        if isinstance(model, ValueError):
            raise model
        out = f"p_{f.spec.target}_{zlib.crc32(repr(key).encode()):08x}"
        if key not in self.scorers:
            self.scorers[key] = lambda df: model.score(df, out)
        return out, self.scorers[key]


# ---- decisions ------------------------------------------------------------------------

@dataclass(frozen=True)
class Decision:
    """``sets`` maps the score columns of ``models`` to the strategy fields that change.

    ``family`` groups variants of one type of decision, which a run counts as trials.
    """

    name: str
    kind: str
    family: str
    models: tuple[ModelSpec, ...] = ()
    sets: Callable[..., dict] = lambda: {}

    def named(self, name: str) -> "Decision":
        return replace(self, name=name)

    def fits(self, pool: str, split, base: Strategy) -> list[Fit]:
        return [Fit(m, pool, split, base) for m in self.models]

    def on(self, strategy: Strategy, scores: Sequence[Column], scorers: Sequence = ()) -> Strategy:
        """The strategy with this decision taken by the given score columns."""
        mine = [s for s in scorers if not any(s is t for t in strategy.scorers)]
        return strategy.with_(**self.sets(*scores), scorers=(*strategy.scorers, *mine))

    def learned(self, strategy: Strategy, registry: ModelRegistry, pool: str, split, base: Strategy) -> Strategy:
        """The strategy with this decision taken by models of the registry."""
        registry.fit(self.fits(pool, split, base))  # those of one decision side by side
        made = [registry.scorer(f) for f in self.fits(pool, split, base)]
        return self.on(strategy, [F.col(out) for out, _ in made], [s for _, s in made])


def combined(name: str, *parts: Decision) -> Decision:
    """All parts at once; where two set the same field, the later one holds."""
    models = tuple(dict.fromkeys(m for p in parts for m in p.models))

    def sets(*scores):
        of = dict(zip(models, scores))
        return {k: v for p in parts for k, v in p.sets(*(of[m] for m in p.models)).items()}

    return Decision(name, "combination", "combination", models, sets)


def _budget(changes: Mapping | None) -> tuple[tuple[str, float], ...]:
    return tuple(sorted({**BUDGET, **(changes or {})}.items()))


def rule_gate(gate: Column | None = None, name: str = "Rule-based ADX gate") -> Decision:
    """A rule as a comparison variant; nothing is learned."""
    return Decision(name, "independent", "rule gate", sets=lambda: {"gate": adx_gate() if gate is None else gate})


def regime_filter(target: str = "linearity", threshold: float = 0.5, horizon: int = 15, budget: Mapping | None = None) -> Decision:
    """Gate on a trend classifier that does not look at the signal."""
    return Decision(f"ML Regime Filter ({target})", "independent", "regime filter", (ModelSpec(target, horizon, budget=_budget(budget)),),
                    lambda p: {"gate": score_gate(p, threshold)})


def meta_label(threshold: float = 0.5, budget: Mapping | None = None) -> Decision:
    """Gate on the probability that this very trade of the control is profitable."""
    return Decision("ML Meta-Labeling", "narrowing", "meta label", (ModelSpec("trade", budget=_budget(budget)),),
                    lambda p: {"gate": score_gate(p, threshold)})


def position_sizing(lo: float = 0.0, hi: float = 2.0, budget: Mapping | None = None) -> Decision:
    """Scale each trade by the score of the meta label; never adds or removes a trade."""
    return Decision("ML Position Sizing", "narrowing", "position sizing", (ModelSpec("trade", budget=_budget(budget)),),
                    lambda p: {"sizer": score_size(p, lo, hi)})


def learned_entry(threshold: float = 0.5, horizon: int = 40, sl_mult: float = 1.5, tp_mult: float = 3.0, budget: Mapping | None = None) -> Decision:
    """Replace the signal by two classifiers of long and short bracket outcomes."""
    models = tuple(ModelSpec("bracket", horizon, side, (sl_mult, tp_mult), _budget(budget)) for side in (1, -1))
    return Decision("ML Entry", "replacing", "entry", models, lambda up, down: {"signal": score_rule(up, down, threshold, "ML Entry")})


def learned_exit(threshold: float = 0.5, horizon: int = 10, sl_mult: float = 3.0, budget: Mapping | None = None) -> Decision:
    """Replace the exit by two continuation classifiers and a wide safety stop."""
    models = tuple(ModelSpec("continuation", horizon, side, (), _budget(budget)) for side in (1, -1))
    return Decision("ML Exit", "replacing", "exit", models, lambda up, down: {
        "exit": "learned", "exit_grid": {"sl_mult": [sl_mult]}, "exit_args": {"threshold": threshold}, "hold": (up, down)})


def trials_per_family(decisions: Sequence[Decision]) -> dict[str, int]:
    """How many variants of the same type of decision a run screens, by decision name."""
    n = Counter(d.family for d in decisions)
    return {d.name: n[d.family] for d in decisions}


def attribution_grid(budget: Mapping | None = None) -> list[Decision]:
    """The configurations of the single-market grid: a rule gate, each learned decision, four combinations."""
    one = {"entry": learned_entry(budget=budget), "exit": learned_exit(budget=budget), "meta": meta_label(budget=budget),
           "size": position_sizing(budget=budget)}
    # The display names of the combinations.
    pairs = {"Entry+Exit": ("entry", "exit"), "Entry+Sizing": ("entry", "size"), "Exit+Sizing": ("exit", "size"),
             "Best Combined (Meta-Label + Sizing)": ("meta", "size")}
    regimes = [regime_filter(t, budget=budget) for t in ("linearity", "excursion", "move_size")]
    return [rule_gate(), *regimes, one["meta"], one["size"], one["entry"], one["exit"],
            *(combined(name, *(one[p] for p in parts)) for name, parts in pairs.items())]


def study_decisions(budget: Mapping | None = None) -> dict[str, Decision]:
    """The decisions of a study by their fixed keys."""
    small = {**SMALL_BUDGET, **(budget or {})}
    meta, size, exit_ = meta_label(budget=budget), position_sizing(budget=budget), learned_exit(budget=budget)
    return {"rule_adx": rule_gate(), "regime_linearity": regime_filter("linearity", budget=budget), "meta_label": meta,
            "position_sizing": size, "entry": learned_entry(budget=budget), "exit": exit_,
            "best_combined": combined("best_combined", meta, size), "meta_label_thr045": meta_label(0.45, budget),
            "meta_label_thr055": meta_label(0.55, budget), "meta_label_small_model": meta_label(budget=small),
            "exit_small_model": learned_exit(budget=small)}
