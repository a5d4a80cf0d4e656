"""From study trades to every statistic: tests, stability, costs, regimes and crises.

All keys (strategy, market, freeze, variant) are handled in the same plans. The daily values
are added up where they are made; portfolios are additive sums, so market, global and left-out portfolios
are re-aggregations of one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_window
from ..functions.indicators import TRADING_DAYS as P
from ..operators.inference import block_bootstrap, paired_series, with_adjusted
from ..operators.metrics import mtm_sharpe, portfolio_metrics, selection_decay, trade_metrics
from ..operators.regimes import crisis_performance, regime_labels, regime_sharpes
from ..operators.valuation import (equal_weight, left_out, market_index, portfolio_totals, roll_up, with_positions)
from ..session import cut_lineage
from .study import KIND, MAIN, StudyConfig

TAGS = ("strategy", "variant", "freeze")
TEST = ["strategy", "market", "freeze", "variant"]
PAIR = ["ret", "turnover", "exposure"]


def family(variant: Column) -> dict[str, Column]:
    """Family, component and control of a variant from its name."""
    comp, setting = F.split_part(variant, F.lit("@"), F.lit(1)), F.split_part(variant, F.lit("@"), F.lit(2))
    control_run = comp == "baseline"
    fam = (F.when(setting == "transfer", "transfer").when(setting != "", "execution")
           .when(comp.isin(*MAIN), "main").otherwise("ablation"))
    control = F.when((setting == "") | (setting == "transfer") | control_run, F.lit("baseline")).otherwise(
        F.concat(F.lit("baseline@"), setting))
    return {"family": fam, "component": comp, "control": control}


def kind_of(component: Column) -> Column:
    out = F.lit("ablation")
    for c, k in KIND.items():
        out = F.when(component == c, k).otherwise(out)
    return out


def in_freezes(df: DataFrame, cfg: StudyConfig, when: str = "date") -> DataFrame:
    """Replace ``freeze`` by each test window the row belongs to; ``all`` belongs to every window."""
    hit = [F.when(F.col("freeze").isin("all", f.name) & in_window(F.col(when), f.split, f.test_end), F.lit(f.name))
           for f in cfg.freezes]
    windows = F.array_compact(F.array(*hit))
    return df.withColumn("freeze", F.explode(windows))


def cost_column(cfg: StudyConfig) -> Column:
    out = F.lit(None).cast("double")
    for m in cfg.markets:
        out = F.when(F.col("market") == m.name, float(m.cost_bps)).otherwise(out)
    return out


def tested(names: DataFrame, with_control_runs: bool) -> DataFrame:
    """Variants to test and the control each is compared with."""
    df = names.withColumns(family(F.col("variant"))).where(F.col("variant") != "baseline")
    return df if with_control_runs else df.where(F.col("component") != "baseline")


def main_or_control(trades: DataFrame) -> DataFrame:
    """Trades of the main variants and of the control they are compared with: all that a jackknife reads."""
    return trades.where((F.col("variant") == "baseline") | (family(F.col("variant"))["family"] == "main"))


def control_for(tests: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The control's rows once per variant that is compared with it."""
    ctl = rows.withColumnRenamed("variant", "control")
    return tests.select(*on, "variant", "control").join(ctl, [*on, "control"]).drop("control")


@dataclass
class Portfolios:
    """Portfolio sums inside the test windows, and the tests to run on them."""

    sums: DataFrame
    tests: DataFrame
    trades: DataFrame


def portfolios(sums: DataFrame, trades: DataFrame, cfg: StudyConfig, global_scope: bool) -> Portfolios:
    """Sums and trades per test window, and the tests whose control covers enough days."""
    sums = in_freezes(sums, cfg)
    trades = in_freezes(trades, cfg, "entry_time")
    if global_scope:
        sums, trades = sums.withColumn("market", F.lit("ALL")), trades.withColumn("market", F.lit("ALL"))
    on = ["strategy", "market", "freeze"]
    days = sums.groupBy(*on, "variant").agg(F.count(F.lit(1)).alias("_days"))
    names = tested(days.drop("_days"), global_scope)
    enough = days.where(F.col("_days") >= cfg.min_days).select(*on, F.col("variant").alias("control"))
    return Portfolios(sums, names.join(enough, [*on, "control"], "left_semi"), trades)


def pairs(p: Portfolios, tests: DataFrame | None = None, multiplier: Column | float = 1.0) -> DataFrame:
    """Daily series of every tested variant next to its control."""
    tests = p.tests if tests is None else tests
    on = ["strategy", "market", "freeze"]
    pf = equal_weight(p.sums, multiplier)
    v = pf.join(tests.select(*TEST), TEST, "left_semi")
    return paired_series(v, control_for(tests, pf, on), TEST, PAIR)


def run_tests(p: Portfolios, cfg: StudyConfig, scope: str, n_trials: int = len(MAIN)) -> DataFrame:
    """Metrics of both portfolios, their deltas, the block bootstrap and both sets of trade metrics."""
    series = cut_lineage(pairs(p))
    v = portfolio_metrics(series, TEST, n_trials, "v_ret", "v_turnover", "v_exposure", "v_")
    b = portfolio_metrics(series, TEST, 1, "b_ret", "b_turnover", "b_exposure", "b_")
    boot = block_bootstrap(series, TEST, cfg.block_days, cfg.n_boot, 0, cfg.alpha)
    vt = trade_metrics(p.trades.join(p.tests.select(*TEST), TEST, "left_semi"), TEST, "v_")
    bt = trade_metrics(control_for(p.tests, p.trades, ["strategy", "market", "freeze"]), TEST, "b_")
    out = p.tests.join(v, TEST).join(b, TEST).join(boot, TEST).join(vt, TEST, "left").join(bt, TEST, "left")
    out = out.withColumns({f"delta_{k}": F.col(f"v_{k}") - F.col(f"b_{k}") for k in (
        "ann_return", "ann_vol", "sortino", "max_drawdown", "cvar95", "turnover")})
    free = F.lit(None).cast("boolean")
    if scope == "market":
        for m in cfg.markets:
            free = F.when(F.col("market") == m.name, m.survivorship_free).otherwise(free)
    return out.withColumns({"family": F.concat(F.lit(f"{scope}_"), "family"), "scope": F.lit(scope),
                            "kind": kind_of(F.col("component")), "survivorship_free": free}).drop("control")


def _moments(series: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return series.groupBy(*keys).agg(*[F.sum(F.col(c) if k == 1 else F.col(c) * F.col(c)).alias(f"{prefix}{c}{k}")
                                       for c in ("v_ret", "b_ret") for k in (1, 2)],
                                     F.count(F.lit(1)).alias(f"{prefix}days"))


def _sharpe_of(s1: Column, s2: Column, n: Column) -> Column:
    var = (s2 - s1 * s1 / n) / (n - 1)
    return F.when(var > 1e-20, F.sqrt(F.lit(float(P))) * (s1 / n) / F.sqrt(var)).otherwise(0.0)


def shifts(p: Portfolios, parts: DataFrame, part_key: str) -> DataFrame:
    """Changes of the sums of returns and squares where a part is left out: one join of the parts with their totals, no copy of every series per part."""
    on = ["strategy", "market", "freeze", "variant", "date"]
    total = equal_weight(p.sums).select(*on, F.col("ret").alias("whole"))
    whole_sums = F.broadcast(p.sums.select(*on, "gross", "cost", "n").join(total, on))  # a row per series and date
    p_cols = [F.col(c).alias(f"_{c}") for c in ("gross", "cost", "n")]
    rest = parts.select(*on, part_key, *p_cols).join(whole_sums, on)
    n = F.greatest(F.col("n") - F.col("_n"), F.lit(1))
    rest = rest.withColumn("without", ((F.col("gross") - F.col("_gross")) - (F.col("cost") - F.col("_cost"))) / n)
    return rest.groupBy("strategy", "market", "freeze", "variant", part_key).agg(
        F.sum(F.col("without") - F.col("whole")).alias("d1"),
        F.sum(F.col("without") ** 2 - F.col("whole") ** 2).alias("d2"))


def leave_one_out(p: Portfolios, shift: DataFrame, part_key: str) -> DataFrame:
    """Sharpe difference of variant and control without each part (instrument or market).

    Leaving a part out changes only the days the part has a bar; ``shift`` is what it changes in the sums of returns and
    squares of each series. A part that the control never traded leaves the control unchanged.
    """
    main = p.tests.where(F.col("family") == "main")
    full = _moments(pairs(p, main), TEST, "")
    k = ["strategy", "market", "freeze"]
    v = shift.join(main.select(*TEST, "control"), TEST)
    b = shift.select(*k, F.col("variant").alias("control"), part_key, F.col("d1").alias("b1"), F.col("d2").alias("b2"))
    both = v.join(b, [*k, "control", part_key], "left").join(full, TEST)
    zero = F.lit(0.0)
    sv = _sharpe_of(F.col("v_ret1") + F.col("d1"), F.col("v_ret2") + F.col("d2"), F.col("days"))
    sb = _sharpe_of(F.col("b_ret1") + F.coalesce("b1", zero), F.col("b_ret2") + F.coalesce("b2", zero), F.col("days"))
    whole = _sharpe_of(F.col("v_ret1"), F.col("v_ret2"), F.col("days")) - _sharpe_of(
        F.col("b_ret1"), F.col("b_ret2"), F.col("days"))
    return both.select(*TEST, part_key, whole.alias("delta_full"), (sv - sb).alias("delta"))


def jackknife_instruments(p: Portfolios, trades: DataFrame, bars: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Range of the Sharpe difference over left-out instruments and how often its sign flips.

    ``trades`` as the walk-forward tags them; instruments are valued and left out where their bars are.
    """
    loo = leave_one_out(p, left_out(main_or_control(trades), bars, cost_column(cfg), main_or_control(p.sums)), "symbol")
    return loo.groupBy(*TEST).agg(
        F.first("delta_full").alias("delta_full"), F.min("delta").alias("loo_min"), F.max("delta").alias("loo_max"),
        F.count(F.lit(1)).alias("n_left_out"),
        F.count_if(F.signum("delta") != F.signum("delta_full")).alias("sign_flips")).withColumn("scope", F.lit("market"))


def jackknife_markets(p: Portfolios, market_sums: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Global Sharpe difference without each market that traded both sides."""
    parts = in_freezes(market_sums, cfg).withColumnRenamed("market", "part").withColumn("market", F.lit("ALL"))
    k = ["strategy", "freeze", "part"]
    ctl = parts.where(F.col("variant") == "baseline").select(*k).distinct()
    loo = leave_one_out(p, shifts(p, parts.join(ctl, k, "left_semi"), "part"), "part")
    return loo.select("strategy", F.col("part").alias("market"), "freeze", "variant", "delta_full",
                      F.col("delta").alias("delta_without_market"), F.lit("global_minus_market").alias("scope"))


def cost_sensitivity(p: Portfolios, cfg: StudyConfig) -> DataFrame:
    """Global Sharpe ratios with transaction costs scaled; gross and cost are already separate."""
    multiples = F.explode(F.array(*[F.lit(float(m)) for m in cfg.cost_multipliers]))
    sums = p.sums.where(~F.col("variant").contains("@")).withColumn("cost_multiplier", multiples)
    pf = equal_weight(sums, F.col("cost_multiplier"))
    main = p.tests.where(F.col("family") == "main")
    keys = [*TEST, "cost_multiplier"]
    v = pf.join(main.select(*TEST), TEST, "left_semi")
    series = paired_series(v, control_for(main, pf, ["strategy", "market", "freeze"]), keys, ["ret"])
    out = series.groupBy(*keys).agg(mtm_sharpe(F.col("v_ret")).alias("v_sharpe"), mtm_sharpe(F.col("b_ret")).alias("b_sharpe"))
    return out.withColumn("delta_sharpe", F.col("v_sharpe") - F.col("b_sharpe")).drop("market")


def buy_and_hold(bars: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Metrics of the equal-weight index of each market in each test window."""
    index = in_freezes(market_index(bars).withColumns({"freeze": F.lit("all"), "turnover": F.lit(0.0),
                                                       "exposure": F.lit(1.0)}), cfg)
    return portfolio_metrics(index, ["market", "freeze"])


def global_daily(p: Portfolios) -> DataFrame:
    """Daily returns of the main variants and the control in long form, one row per series and date."""
    main = p.tests.where(F.col("family") == "main").select("strategy", "freeze", "variant")
    ctl = main.select("strategy", "freeze").distinct().withColumn("variant", F.lit("baseline"))
    want = main.unionByName(ctl)
    out = equal_weight(p.sums).join(want, ["strategy", "freeze", "variant"], "left_semi")
    return out.select("date", "ret", "strategy", "variant", "freeze").dropDuplicates(["strategy", "variant", "freeze", "date"])


def crises_frame(spark, cfg: StudyConfig) -> DataFrame:
    rows = spark.createDataFrame(list(cfg.crises), "crisis string, start string, end string")
    return rows.select("crisis", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def analyze(trades: DataFrame, bars: DataFrame, cfg: StudyConfig) -> dict[str, DataFrame]:
    """Every result table of the study. Trades and bars should come from written tables."""
    spark = trades.sparkSession
    placed = with_positions(trades, bars)
    market_sums = cut_lineage(portfolio_totals(placed, bars, cost_column(cfg), TAGS))
    world_sums = roll_up(market_sums, TAGS)
    mk, gl = portfolios(market_sums, trades, cfg, False), portfolios(world_sums, trades, cfg, True)
    tests = with_adjusted(run_tests(mk, cfg, "market").unionByName(run_tests(gl, cfg, "global")), alpha=cfg.alpha,
                          order=TEST)
    main = pairs(gl, gl.tests.where(F.col("family") == "main"))
    index = market_index(bars.withColumn("scope", F.lit("ALL")), ("scope",))
    labels = regime_labels(index, ("scope",), cfg.trend_sma_days, cfg.vol_window_days).drop("scope")
    baseline = trades.where(F.col("variant") == "baseline")
    return {
        "tests": tests,
        "jackknife": jackknife_instruments(mk, placed, bars, cfg).unionByName(
            jackknife_markets(gl, market_sums, cfg), allowMissingColumns=True),
        "cost_sensitivity": cost_sensitivity(gl, cfg),
        "is_oos_decay": selection_decay(baseline),
        "buy_and_hold": buy_and_hold(bars, cfg),
        "regimes": regime_sharpes(main, labels, TEST).drop("market"),
        "crises": crisis_performance(main, crises_frame(spark, cfg), TEST).drop("market", "days"),
        "global_daily": global_daily(gl),
    }

