"""Aggregations behind the report tables and figures.

Inputs are result tables (one row per test, market, freeze and variant), whose size is set
by the design of a study and not by the bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.indicators import TRADING_DAYS
from ..operators.cleaning import safe_corr

def _delta() -> Column:
    return F.col("delta_sharpe")


def _gain() -> Column:
    return F.col("significant") & (_delta() > 0)


def _loss() -> Column:
    return F.col("significant") & (_delta() < 0)


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


# ---- single-market attribution ------------------------------------------------------------

def recommendation(cells: str = "cells") -> Column:
    """Decision text from an array of ``(market, sig_gain, sig_loss, mean_delta)`` in market order."""
    def names(cond: str) -> str:
        return f"array_join(transform(filter({cells}, c -> {cond}), c -> c.market), ', ')"

    gain, loss = names("c.sig_gain"), names("c.sig_loss")
    hope = names("c.mean_delta IS NOT NULL AND c.mean_delta > 0 AND NOT c.sig_loss")
    return F.expr(f"""CASE
        WHEN {gain} <> '' THEN concat('Adopt (significant gain in ', {gain}, ')')
        WHEN {loss} <> '' AND {hope} = '' THEN concat('Avoid (significant loss in ', {loss}, ')')
        WHEN {loss} <> '' THEN concat('Mixed (avoid in ', {loss}, '; promising, unreplicated in ', {hope}, ')')
        WHEN {hope} <> '' THEN concat('Worth exploring in ', {hope}, ' (unreplicated)')
        ELSE 'Neutral (no consistent effect)' END""")


def cells(table: DataFrame, keys: Sequence[str] = ("variant", "market")) -> DataFrame:
    """Per variant and market, over windows: any significant gain or loss and the mean difference."""
    return table.where(F.col("kind") != "control").groupBy(*keys).agg(
        F.min("kind").alias("kind"), F.bool_or(_gain()).alias("sig_gain"), F.bool_or(_loss()).alias("sig_loss"),
        F.avg("delta_sharpe").alias("mean_delta"))


def run_matrix(table: DataFrame) -> DataFrame:
    """One row per market and variant with the mean difference and its recommendation."""
    one = F.array(F.struct("market", "sig_gain", "sig_loss", "mean_delta"))
    df = cells(table, ("market", "variant")).withColumn("cells", one)
    return df.select("market", "variant", "kind", F.round("mean_delta", 3).alias("mean_delta_sharpe"),
                     recommendation().alias("recommendation"))


def opportunity_matrix(table: DataFrame, markets: Sequence[str]) -> DataFrame:
    """Variant by market: mean difference, ``*+`` / ``*-`` for significance, and a recommendation.

    The order of ``markets`` is the order of the columns and of the names in the text.
    """
    tag = F.when(F.col("sig_gain"), "*+").when(F.col("sig_loss"), "*-").otherwise("")
    # Half-even on the exact binary value, the way a float is printed with two decimals.
    two = F.bround(F.col("mean_delta").cast("decimal(38,18)"), 2)
    text = F.concat(F.when(two < 0, "-").when((two == 0) & (F.col("mean_delta") < 0), "-").otherwise("+"),
                    F.abs(two).cast("string"), tag)
    rank = F.array_position(F.array(*[F.lit(m) for m in markets]), F.col("market"))
    c = cells(table).withColumns({"cell": text, "_rank": rank})
    wide = c.groupBy("variant").agg(
        F.min("kind").alias("kind"), *[F.max(F.when(F.col("market") == m, F.col("cell"))).alias(m) for m in markets],
        F.array_sort(F.collect_list(F.struct("_rank", "market", "sig_gain", "sig_loss", "mean_delta"))).alias("cells"))
    return wide.withColumn("recommendation", recommendation()).drop("cells")


def compare_replication(original: DataFrame, rerun: DataFrame, variant_names: dict[str, str],
                        market_names: dict[str, str], by_name: Sequence[str] = ("ML Regime Filter", "Combinations")
                        ) -> DataFrame:
    """Configuration-by-configuration comparison of an original table with a re-run.

    The original names a variant by its component except for the components in ``by_name``;
    ``variant_names`` and ``market_names`` translate to the re-run's names.
    """
    def renamed(col: Column, names: dict[str, str]) -> Column:
        out = col
        for a, b in names.items():
            out = F.when(col == a, b).otherwise(out)
        return out

    variant = F.when(F.col("component").isin(*by_name), renamed(F.col("variant"), variant_names)).otherwise(F.col("component"))
    o = original.select(renamed(F.col("market"), market_names).alias("market"), "window", variant.alias("variant"),
                        _delta().alias("delta_sharpe_paper"), F.col("significant").alias("significant_paper"))
    r = rerun.select("market", "window", "variant", _delta().alias("delta_sharpe_rep"), F.col("significant").alias("significant_rep"))
    return o.join(r, ["market", "window", "variant"]).withColumn(
        "sign_agrees", (F.col("delta_sharpe_paper") > 0) == (F.col("delta_sharpe_rep") > 0))


def trade_inflation(table: DataFrame, variant: str, control: str, keys: Sequence[str] = ("market", "window")) -> DataFrame:
    """Trades of a variant per trade of its control."""
    n = lambda v: F.max(F.when(F.col("variant") == v, F.col("n_trades")))
    return table.groupBy(*keys).agg(ratio(n(variant), n(control)).alias("ratio")).where(F.col("ratio").isNotNull())


def headline_counts(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Configurations and significant gains and losses, overall or per key."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("configs"), F.count_if(_gain()).alias("gains"),
                                    F.count_if(_loss()).alias("losses"))


def forest_rows(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Variants in display order with the per-day interval on the annualised scale."""
    k = F.sqrt(F.lit(float(TRADING_DAYS)))
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("variant"))
    return table.where(rank > 0).select("market", "window", "variant", rank.cast("int").alias("rank"), "delta_sharpe",
                                        (F.col("ci_lo") * k).alias("lo"), (F.col("ci_hi") * k).alias("hi"), "significant")


# ---- multi-market study -------------------------------------------------------------------

def significance_counts(tests: DataFrame, keys: Sequence[str] = ("family",), alpha: float = 0.05) -> DataFrame:
    """Tests, significant gains and losses, positive share, and raw and Holm counts."""
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(_gain()).alias("gains"), F.count_if(_loss()).alias("losses"),
        _share(_delta() > 0).alias("positive_share"), F.count_if(F.col("p_value") < alpha).alias("raw_significant"),
        F.count_if(F.col("p_holm") < alpha).alias("holm_significant"))


def component_summary(market_tests: DataFrame, reversion: str = "rsi2_reversion") -> DataFrame:
    """Per component: medians and counts, split into the reversion strategy and the others."""
    rev = F.col("strategy") == reversion
    return market_tests.groupBy("component").agg(
        F.count(F.lit(1)).alias("tests"), _share(_delta() > 0).alias("positive_share"), F.count_if(_gain()).alias("gains"),
        F.count_if(_loss()).alias("losses"), F.median("delta_sharpe").alias("median"),
        F.count_if(_gain() & rev).alias("gains_reversion"), F.count_if(_loss() & rev).alias("losses_reversion"),
        F.median(F.when(~rev, _delta())).alias("median_trend"), F.median(F.when(rev, _delta())).alias("median_reversion"),
        F.median(F.col("v_turnover") - F.col("b_turnover")).alias("median_turnover_change"),
        (F.median("v_turnover") - F.median("b_turnover")).alias("turnover_median_change"))


def global_summary(global_tests: DataFrame) -> DataFrame:
    return global_tests.groupBy("component").agg(
        F.count(F.lit(1)).alias("tests"), F.median("delta_sharpe").alias("median"), F.count_if(_delta() > 0).alias("positive"),
        F.count_if(F.col("delta_max_drawdown") > 0).alias("shallower"),
        F.median(F.col("v_exposure") - F.col("b_exposure")).alias("median_exposure_change"))


def freeze_replication(market_tests: DataFrame, first: str, second: str) -> DataFrame:
    """Sign agreement and correlation over the cells observed at both freeze dates."""
    one = lambda f: F.avg(F.when(F.col("freeze") == f, _delta()))
    both = market_tests.groupBy("component", "strategy", "market").agg(one(first).alias("a"), one(second).alias("b"))
    both = both.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy("component").agg(
        F.count(F.lit(1)).alias("cells"), _share(F.signum("a") == F.signum("b")).alias("agreement"),
        F.when(F.count(F.lit(1)) > 2, safe_corr("a", "b")).alias("corr"))


def strategy_matrix(market_tests: DataFrame, components: Sequence[str]) -> DataFrame:
    """Strategy by component: median difference with significant gains and losses."""
    cell = market_tests.groupBy("strategy", "component").agg(
        F.median("delta_sharpe").alias("m"), F.count_if(_gain()).alias("g"), F.count_if(_loss()).alias("l"))
    two = F.bround(F.col("m").cast("decimal(38,18)"), 2)
    text = F.concat(F.when(F.col("m") < 0, "-").otherwise("+"), F.abs(two).cast("string"), F.lit(" ("),
                    F.col("g").cast("string"), F.lit("/"), F.col("l").cast("string"), F.lit(")"))
    return cell.withColumn("cell", text).groupBy("strategy").pivot("component", list(components)).agg(F.max("cell"))


def delta_summary(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, range, positive share and significance of the differences per key."""
    return tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tests"), F.median("delta_sharpe").alias("median"), _share(_delta() > 0).alias("positive_share"),
        F.count_if("significant").alias("significant"), F.count_if(_loss()).alias("losses"),
        F.min("delta_sharpe").alias("min"), F.max("delta_sharpe").alias("max"))


def cost_curve(costs: DataFrame) -> DataFrame:
    return costs.groupBy("cost_multiplier", "variant").agg(F.median("delta_sharpe").alias("median"))


def survivorship_split(market_tests: DataFrame) -> DataFrame:
    bias = F.when(F.col("survivorship_free"), "free").otherwise("prone")
    return market_tests.groupBy(bias.alias("bias"), "component").agg(F.median("delta_sharpe").alias("median"))


def jackknife_summary(jackknife: DataFrame, market_tests: DataFrame) -> DataFrame:
    """Share of tests whose sign depends on one instrument, among all and among significant ones."""
    key = ["strategy", "market", "freeze", "variant"]
    sig = market_tests.where("significant").select(*key, F.lit(True).alias("_sig"))
    j = jackknife.where(F.col("scope") == "market").join(sig, key, "left")
    flips = F.col("sign_flips") > 0
    return j.agg(_share(flips).alias("flip_share"), F.count_if("_sig").alias("significant"),
                 F.count_if(F.col("_sig") & flips).alias("significant_flips"))


def market_flip_share(jackknife: DataFrame) -> DataFrame:
    j = jackknife.where(F.col("scope") == "global_minus_market")
    return j.agg(_share(F.signum("delta_without_market") != F.signum("delta_full")).alias("flip_share"))


def regime_table(regimes: DataFrame, names: Sequence[str] = ("bull", "bear", "low_vol", "high_vol")) -> DataFrame:
    return regimes.groupBy("variant").pivot("regime", list(names)).agg(F.avg("delta_sharpe"))


def crisis_table(crises: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean change of return and drawdown in percentage points per variant and crisis."""
    df = crises.where(F.col("crisis").isin(*names))
    return df.groupBy("variant", "crisis").agg(
        F.avg(100 * (F.col("v_return") - F.col("b_return"))).alias("return_change"),
        F.avg(100 * (F.col("v_max_drawdown") - F.col("b_max_drawdown"))).alias("drawdown_change"))


def universe_activity(manifest: DataFrame) -> DataFrame:
    """Instruments with data per market and year."""
    years = F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year")
    return manifest.where(F.col("status") == "ok").select("market", years).groupBy("market", "year").agg(
        F.count(F.lit(1)).alias("instruments"))


def exchange_counts(manifest: DataFrame) -> DataFrame:
    """Instruments per listing suffix; none means the home listing."""
    suffix = F.regexp_extract("symbol", r"\.([A-Z]+)$", 1)
    return manifest.where((F.col("status") == "ok") & F.col("market").startswith("stocks")).groupBy(
        F.when(suffix == "", "US").otherwise(suffix).alias("exchange")).agg(F.count(F.lit(1)).alias("instruments"))


def p_value_histogram(tests: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of p-values in equal bins of [0, 1]; the last bin includes 1. With the uniform expectation."""
    b = F.least(F.floor(F.col("p_value") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    known = tests.where(F.col("p_value").isNotNull())
    counts = known.groupBy(b).agg(F.count(F.lit(1)).alias("tests"))
    axis = tests.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    expected = tests.agg((F.count(F.lit(1)) / bins).alias("expected"))
    return axis.join(counts, "bin", "left").fillna({"tests": 0}).join(F.broadcast(expected))


def heat_map(market_tests: DataFrame) -> DataFrame:
    """Mean difference and any significance over freezes, by strategy, component and market."""
    return market_tests.groupBy("strategy", "component", "market").agg(
        F.avg("delta_sharpe").alias("mean_delta"), F.bool_or("significant").alias("any_significant"))


def risk_profile(global_tests: DataFrame) -> DataFrame:
    """Median change of the risk profile per component, rates in percentage points."""
    d = lambda k, scale=1.0: F.median(scale * (F.col(f"v_{k}") - F.col(f"b_{k}")))
    return global_tests.groupBy("component").agg(
        d("sharpe").alias("sharpe"), d("ann_return", 100.0).alias("ann_return"), d("ann_vol", 100.0).alias("ann_vol"),
        d("max_drawdown", 100.0).alias("max_drawdown"), d("turnover").alias("turnover"),
        d("exposure", 100.0).alias("exposure"))


def transfer_against_own(tests: DataFrame) -> DataFrame:
    """Correlation of the effect of models fitted on other markets with that of the market's own."""
    key = ["strategy", "market", "freeze", "component"]
    own = tests.where(F.col("family") == "market_main").select(*key, _delta().alias("own"))
    other = tests.where(F.col("family") == "market_transfer").select(*key, _delta().alias("other"))
    return other.join(own, key).groupBy("component").agg(F.count(F.lit(1)).alias("cells"), safe_corr("own", "other").alias("corr"))


def quartiles(tests: DataFrame, keys: Sequence[str] = ("component",)) -> DataFrame:
    q = F.percentile("delta_sharpe", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return tests.groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def headline(global_main: DataFrame) -> DataFrame:
    """Control and variant Sharpe, difference, interval and q per strategy and freeze."""
    return global_main.select("strategy", "freeze", "component", "b_sharpe", "v_sharpe", "delta_sharpe", "ci_lo", "ci_hi", "q_bh")


def timeline(bars: DataFrame, freezes: Sequence[tuple[str, str, str]], keys: Sequence[str] = ("market",)) -> DataFrame:
    """Train and test segment of every freeze per market; a test ends at the last bar at the latest."""
    span = bars.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    segs = []
    for name, split, end in freezes:
        s, e = F.lit(split).cast("date"), F.least(F.lit(end).cast("date"), F.col("last"))
        segs += [F.struct(F.lit(name).alias("freeze"), F.lit("train").alias("segment"), F.col("first").alias("start"), s.alias("end")),
                 F.struct(F.lit(name).alias("freeze"), F.lit("test").alias("segment"), s.alias("start"), e.alias("end"))]
    return span.select(*keys, F.explode(F.array(*segs)).alias("s")).select(*keys, "s.*")
