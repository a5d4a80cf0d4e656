"""Freeze discipline, sharing and composition of learned decisions (a tiny tree budget)."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from swaplens.functions.columns import KEYS
from swaplens.functions.indicators import FEATURES
from swaplens.operators import decisions as D
from swaplens.operators.labels import resolved_before
from swaplens.operators.models import ProbModel, TrainingData
from swaplens.operators.signals import DONCHIAN
from swaplens.operators.walkforward import Strategy
from swaplens.plans.attribution import CONTROL, run_attribution
from swaplens.plans.analysis import analyze
from swaplens.plans.study import Freeze, Market, StudyConfig, run_log, run_study
from swaplens.session import cut_lineage

SPLIT = "1999-07-01"
TINY = {"maxIter": 2, "maxDepth": 2}
BASE = Strategy(DONCHIAN.__class__("d", DONCHIAN.build, {"lookback": 10}, {"lookback": [5, 10]}), "bracket",
                {"sl_mult": [1.0], "tp_mult": [1.5]}, fill="close")


@pytest.mark.parametrize("decision", [D.regime_filter("excursion", budget=TINY), D.meta_label(budget=TINY)])
def test_models_never_see_rows_after_the_freeze(bars, decision):
    """Distorting everything from the freeze on must not change a single prediction."""
    late = F.col("date") >= F.lit(SPLIT).cast("date")
    noisy = bars.withColumns({c: F.when(late, F.col(c) * (1 + F.abs(F.hash("date", "symbol") % 7) / 10)).otherwise(F.col(c))
                              for c in ("open", "high", "low", "close")})
    registry = D.ModelRegistry({"a": TrainingData(bars), "b": TrainingData(noisy)}, workers=2)
    made = [registry.scorer(*decision.fits(pool, SPLIT, BASE)) for pool in "ab"]
    both = registry.pools["a"].frame
    for out, scorer in made:
        both = scorer(both)
    (pa, _), (pb, _) = made
    r = both.agg(F.count(pa).alias("n"), F.count_if(F.col(pa) != F.col(pb)).alias("bad")).first()
    assert pa != pb and r["n"] > 1000 and r["bad"] == 0


def test_models_are_shared_and_depend_on_their_control(bars, monkeypatch):
    fits = []
    monkeypatch.setattr(D.ProbModel, "fit", lambda self, train: fits.append(self.params) or self)
    registry = D.ModelRegistry({"all": TrainingData(bars)})
    other = BASE.with_(exit_grid={"sl_mult": [2.0]})
    grid = [*D.attribution_grid(TINY), D.meta_label(0.45, TINY), D.meta_label(0.55, TINY)]
    for d in grid:
        d.learned(BASE, registry, "all", SPLIT, BASE)
    assert len(fits) == 3 + 1 + 2 + 2  # three regimes, one meta label, two sides of entry and of exit
    registry.fit(D.meta_label(budget=TINY).fits("all", SPLIT, other))
    assert len(fits) == 9
    registry.fit(D.regime_filter(budget=TINY).fits("all", SPLIT, other))
    assert len(fits) == 9


def test_straddling_labels_are_excluded(bars):
    ok = bars.withColumns({"ok": resolved_before(SPLIT, 40), "end": F.lead("date", 40).over(Window.partitionBy(*KEYS).orderBy("date"))})
    assert str(ok.where("ok").agg(F.max("end")).first()[0]) < SPLIT


def test_decisions_replace_one_field(bars):
    p, q = F.col("p"), F.col("q")
    meta, exit_, sizing = D.meta_label(), D.learned_exit(), D.position_sizing()
    assert meta.on(BASE, [p]).signal is BASE.signal and meta.on(BASE, [p]).gate is not None
    assert exit_.on(BASE, [p, q]).gate is None and exit_.on(BASE, [p, q]).exit == "learned"
    assert sizing.on(BASE, [p]).gate is None and sizing.on(BASE, [p]).sizer is not None
    both = D.combined("both", exit_, sizing)
    assert len(both.models) == 3 and both.on(BASE, [p, q, p]).exit == "learned" and both.on(BASE, [p, q, p]).sizer is not None
    assert D.combined("shared", meta, sizing).models == meta.models
    assert D.trials_per_family([meta, D.meta_label(0.45).named("low"), exit_]) == {"ML Meta-Labeling": 2, "low": 2, "ML Exit": 1}


def test_single_class_is_an_error(spark):
    df = spark.createDataFrame([(*[0.0] * 8, 1.0)], [*FEATURES, "label"])
    with pytest.raises(ValueError, match="single class"):
        ProbModel(**TINY).fit(df)


def test_attribution_end_to_end(bars):
    res = run_attribution(bars, [D.meta_label(budget=TINY), D.position_sizing(budget=TINY), D.rule_gate()], SPLIT, "2000-07-01", BASE,
                          min_trades=2, reps=50)
    t = res.table.toPandas()
    assert set(t.window) == {"holdout", "forward"} and len(t) == 2 * 4 * 3
    for _, g in t.groupby(["market", "window"]):
        n = g.set_index("variant").n_trades
        assert n["ML Position Sizing"] == n[CONTROL] >= 1
    assert not t[t.variant == CONTROL].significant.any() and res.matrix().count() == 9


def test_study_reports_what_has_no_trades(bars):
    """Stand-in models: a registry of scores that say yes, never, or cannot be made."""
    class StandIn:
        def fit(self, wanted):
            pass

        def scorer(self, f):
            if f.spec.target == "linearity":
                raise ValueError("no rows")
            p = F.lit(0.0 if f.spec.target == "bracket" else 0.9)
            return f"p_{f.spec.target}{f.spec.side}", lambda df: df.withColumn(f"p_{f.spec.target}{f.spec.side}", p)

    cfg = StudyConfig(markets=[Market(m, 5.0) for m in ("M0", "M1", "M2")], freezes=[Freeze("F1", "1997-07-01", "2100-01-01")], ablations=(), min_days=20,
                      strategies={"don": dict(signal="donchian", signal_grid={"lookback": [5, 10]}, exit="trailing",
                                              exit_grid={"sl_mult": [2.0], "trail_mult": [2.0]}, min_trades=2)})
    trades, skipped = run_study(bars, cfg, StandIn())
    why = {(r["market"], r["variant"]): r["reason"] for r in skipped.collect()}
    assert why == {(m, v): r for m in ("M0", "M1", "M2") for v, r in (("regime_linearity", "no rows"), ("entry", "no trades"))}
    seen = {r["variant"] for r in trades.select("variant").distinct().collect()}
    assert seen == {"baseline", "rule_adx", "baseline@optimistic_stop_fill", "baseline@one_day_lag", "meta_label", "position_sizing", "exit",
                    "best_combined", "exit@optimistic_stop_fill", "exit@one_day_lag", "best_combined@optimistic_stop_fill",
                    "best_combined@one_day_lag", "meta_label@transfer", "best_combined@transfer"}
    assert run_log(trades, skipped).count() == 3
    tables = analyze(cut_lineage(trades), bars, cfg)
    assert tables["tests"].count() > 0 and set(tables) == {
        "tests", "jackknife", "cost_sensitivity", "is_oos_decay", "buy_and_hold", "regimes", "crises", "global_daily"}
    for name in ("cost_sensitivity", "is_oos_decay", "buy_and_hold", "global_daily"):
        assert tables[name].count() > 0, name


def test_study_with_models(bars):
    cfg = StudyConfig(markets=[Market(m, 5.0) for m in ("M0", "M1", "M2")], freezes=[Freeze("F1", "1999-07-01", "2100-01-01")], ablations=(),
                      main=("rule_adx", "meta_label", "best_combined"), transfer=("meta_label",), settings=(), model_params=TINY,
                      strategies={"don": dict(signal="donchian", signal_grid={"lookback": [5, 10]}, exit="trailing",
                                              exit_grid={"sl_mult": [2.0], "trail_mult": [2.0]}, min_trades=2)})
    trades, skipped = run_study(bars, cfg)
    seen = {(r["market"], r["variant"]) for r in trades.select("market", "variant").distinct().collect()}
    missed = {(r["market"], r["variant"]) for r in skipped.collect()}
    assert {(m, v) for m in ("M0", "M1", "M2") for v in ("baseline", "rule_adx", "meta_label", "best_combined", "meta_label@transfer")} <= seen | missed


def test_models_outlive_a_run_and_follow_their_training_rows(spark, bars, tmp_path):
    """A second run fits nothing and scores alike; a changed bar refits only the pools that hold it."""
    from swaplens.operators.model_store import MARK, ModelStore

    folder = f"file://{tmp_path}/models"
    meta = D.regime_filter("excursion", budget=TINY)

    def registry(frame):
        whole = TrainingData(frame)
        pools = {m: whole.where(F.col("market") == m) for m in ("M0", "M1")}
        r = D.ModelRegistry(pools, workers=2, store=ModelStore(spark, folder))
        r.fit(f for m in pools for f in meta.fits(m, SPLIT, BASE))
        return r

    def scores(r, pool):
        out, scorer = r.scorer(*meta.fits(pool, SPLIT, BASE))
        return sorted(map(tuple, scorer(r.pools[pool].frame).select(*KEYS, "date", out).collect()))

    first, second = registry(bars), registry(bars.repartition(3))
    assert (first.fitted, second.fitted) == (2, 0)
    assert scores(first, "M0") == scores(second, "M0")
    changed = bars.withColumn("high", F.when((F.col("market") == "M1") & (F.year("date") < 1996), F.col("high") * 1.01).otherwise(F.col("high")))
    third = registry(changed)
    assert third.fitted == 1 and third._new == ["M1"]
    late = bars.withColumn("close", F.when(F.col("date") > F.lit("2000-01-01"), F.col("close") * 1.01).otherwise(F.col("close")))
    assert registry(late).fitted == 0  # bars after the freeze are in no training row
    other = D.ModelRegistry(first.pools, store=ModelStore(spark, folder))
    other.fit(D.regime_filter("excursion", budget={**TINY, "maxDepth": 1}).fits("M0", SPLIT, BASE))
    assert other.fitted == 1  # another budget is another model
    for mark in tmp_path.glob(f"models/*/{MARK}"):
        mark.unlink()  # as after a driver that was lost while it saved
    assert registry(bars).fitted == 2
