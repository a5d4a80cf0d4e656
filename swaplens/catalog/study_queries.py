"""Queries on a whole study: comparison, inference, stability, regimes and reports.

The study runs two strategies on the derived bars with stand-in scores in place of fitted
models, under two freeze dates, with transfer, ablation and execution variants, so that every
family of tests exists. Its trades and tests are shared by the queries of one session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import in_window
from ..functions.distribution import expected_best
from ..functions.draws import PRIME, STEP_AGAIN, STEP_ONE, STEP_REP, STEP_SLOT
from ..operators import decisions, inference, regimes, signals, valuation
from ..operators.walkforward import walk_forward
from ..plans import analysis, reports
from ..plans.attribution import attribution_table, windowed
from ..plans.study import Freeze, Market, StudyConfig, run_log
from .bar_queries import bars
from .base import register, shared
from .trade_queries import (DON, IDX_SQL, METRICS, MIN_TRADES, PAIR_SQL, RD_SQL, SMA, WALK, daily_sql, don_runs, exit_by_score,
                            frame_sql, gate, learned_runs, metrics_sql, p_sql, pair_trades, scan_sql, sma_runs, stand_in)

REPS = 2000
COSTS = {"M0": 5.0, "M1": 3.0, "M2": 10.0}
FREEZES = (Freeze("F1", "1997-07-01", "1999-07-01"), Freeze("F2", "1999-07-01", "2100-01-01"))
SHIFT = {"F1": 0.0, "F2": 0.2}
CRISES = (("first", "1998-01-01", "1998-03-31"), ("second", "2000-06-01", "2000-12-31"), ("short", "2001-01-01", "2001-01-10"))
CFG = StudyConfig(markets=[Market("M0", 5.0), Market("M1", 3.0, False), Market("M2", 10.0)], freezes=FREEZES, n_boot=REPS, crises=CRISES,
                  trend_sma_days=100)
KEYS = "scope:s strategy:s market:s freeze:s variant:s"


# ---- the study --------------------------------------------------------------------------

def _plans(base):
    base = base.with_(fee_bps=COSTS)
    lag = base.with_(lag=1)
    out = {"baseline|all": base, "rule_adx|all": base.with_(gate=signals.adx_gate()), "baseline@one_day_lag|all": lag}
    for fz, x in SHIFT.items():
        out |= {f"meta_label|{fz}": base.with_(gate=gate(x)), f"meta_label@transfer|{fz}": base.with_(gate=gate(x + 0.1)),
                f"meta_label_thr055|{fz}": base.with_(gate=gate(x, 0.55)),
                f"position_sizing|{fz}": base.with_(sizer=decisions.score_size(stand_in(x))),
                f"exit|{fz}": exit_by_score(base, x), f"exit@one_day_lag|{fz}": exit_by_score(lag, x)}
    return out


def study_trades(spark, d):
    def build():
        plans = {f"{n}#{k}": s for n, base in (("sma", SMA), ("don", DON)) for k, s in _plans(base).items()}
        df = walk_forward(bars(spark, d), plans, 5, MIN_TRADES)
        tag = F.split_part("variant", F.lit("#"), F.lit(2))
        df = df.withColumns({"strategy": F.split_part("variant", F.lit("#"), F.lit(1)),
                             "freeze": F.split_part(tag, F.lit("|"), F.lit(2)), "variant": F.split_part(tag, F.lit("|"), F.lit(1))})
        keep = F.col("freeze") == "all"
        for f in FREEZES:
            keep = keep | ((F.col("freeze") == f.name) & in_window(F.col("entry_time"), f.split, f.test_end))
        return df.where(keep)
    return shared(spark, d, "study", build)


def left_out_instruments(spark, d):
    return analysis.jackknife_instruments(scope(spark, d, False), study_trades(spark, d), bars(spark, d), CFG)


def market_sums(spark, d):
    return shared(spark, d, "market_sums", lambda: valuation.portfolio_totals(
        study_trades(spark, d), bars(spark, d), analysis.cost_column(CFG), analysis.TAGS))


def scope(spark, d, world: bool):
    sums = market_sums(spark, d)
    sums = valuation.roll_up(sums, analysis.TAGS) if world else sums
    return analysis.portfolios(sums, study_trades(spark, d), CFG, world)


def tests(spark, d):
    def build():
        both = analysis.run_tests(scope(spark, d, False), CFG, "market").unionByName(analysis.run_tests(scope(spark, d, True), CFG, "global"))
        return inference.with_adjusted(both, alpha=CFG.alpha, order=["strategy", "market", "freeze", "variant"])
    return shared(spark, d, "tests", build)


FEE = "CASE market " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in COSTS.items()) + " END"


def _runs(make, rule):
    n = f"{'sma' if rule == 'sma' else 'don'}"
    kw = {"fee": FEE}
    out = make("baseline|all", **kw) + make("rule_adx|all", gate="adx >= 25", **kw) + make("baseline@one_day_lag|all", lag=1, **kw)
    for fz, x in SHIFT.items():
        out += make(f"meta_label|{fz}", gate=f"{p_sql(x)} >= 0.5", **kw) + make(f"meta_label@transfer|{fz}", gate=f"{p_sql(x + 0.1)} >= 0.5", **kw)
        out += make(f"meta_label_thr055|{fz}", gate=f"{p_sql(x)} >= 0.55", **kw) + make(f"position_sizing|{fz}", size=f"2 * {p_sql(x)}", **kw)
        out += learned_runs(f"exit|{fz}", n, x, **kw) + learned_runs(f"exit@one_day_lag|{fz}", n, x, lag=1, **kw)
    return out


TRADES_SQL = frame_sql() + scan_sql(_runs(sma_runs, "sma") + _runs(don_runs, "don")) + WALK + """
windows(name, lo, hi) AS (VALUES """ + ", ".join(f"('{f.name}', DATE '{f.split}', DATE '{f.test_end}')" for f in FREEZES) + """),
stt AS MATERIALIZED (
  SELECT * FROM (SELECT w.* EXCLUDE (variant), split_part(variant, '|', 1) AS variant, split_part(variant, '|', 2) AS fz FROM walked w) q
  WHERE fz = 'all' OR EXISTS (SELECT 1 FROM windows v WHERE v.name = q.fz AND entry_time >= lo AND entry_time < hi)),
"""
SUMS_SQL = TRADES_SQL + daily_sql("stt", FEE.replace("CASE market", "CASE b.market"), True) + """
ms AS MATERIALIZED (SELECT strategy, market, variant, fz, date, sum(gross) AS gross, sum(cost) AS cost, sum(turnover) AS turnover,
  sum(abs(position)) AS exposure, count(*) AS n FROM day GROUP BY ALL),
mw AS MATERIALIZED (SELECT 'market' AS scope, strategy, market, name AS fz, variant, date, gross, cost, turnover, exposure, n
  FROM ms JOIN windows w ON (ms.fz = 'all' OR ms.fz = w.name) AND date >= lo AND date < hi),
gw AS MATERIALIZED (SELECT 'global' AS scope, strategy, 'ALL' AS market, fz, variant, date, sum(gross) AS gross, sum(cost) AS cost,
  sum(turnover) AS turnover, sum(exposure) AS exposure, sum(n) AS n FROM mw GROUP BY ALL),
aw AS MATERIALIZED (SELECT * FROM mw UNION ALL BY NAME SELECT * FROM gw),
pw AS MATERIALIZED (SELECT *, (gross - cost) / n AS ret, turnover / n AS tu, exposure / n AS ex FROM aw),
fam AS (SELECT *, CASE WHEN setting = 'transfer' THEN 'transfer' WHEN setting <> '' THEN 'execution'
    WHEN comp IN ('rule_adx', 'regime_linearity', 'meta_label', 'position_sizing', 'entry', 'exit', 'best_combined') THEN 'main' ELSE 'ablation' END AS fam,
    CASE WHEN setting IN ('', 'transfer') OR comp = 'baseline' THEN 'baseline' ELSE 'baseline@' || setting END AS control
  FROM (SELECT *, split_part(variant, '@', 1) AS comp, split_part(variant, '@', 2) AS setting
        FROM (SELECT DISTINCT scope, strategy, market, fz, variant FROM pw) WHERE variant <> 'baseline')
  WHERE scope = 'global' OR comp <> 'baseline'),
tst AS MATERIALIZED (SELECT row_number() OVER (ORDER BY scope, strategy, market, fz, variant) AS id, * FROM fam f
  WHERE (SELECT count(*) FROM pw c WHERE c.scope = f.scope AND c.strategy = f.strategy AND c.market = f.market AND c.fz = f.fz AND c.variant = f.control) >= 250),
ser AS MATERIALIZED (SELECT id, date, sum(v_ret) AS v_ret, sum(b_ret) AS b_ret, sum(v_tu) AS v_tu, sum(b_tu) AS b_tu, sum(v_ex) AS v_ex, sum(b_ex) AS b_ex
  FROM (SELECT id, date, ret AS v_ret, 0 AS b_ret, tu AS v_tu, 0 AS b_tu, ex AS v_ex, 0 AS b_ex
        FROM tst t JOIN pw p ON p.scope = t.scope AND p.strategy = t.strategy AND p.market = t.market AND p.fz = t.fz AND p.variant = t.variant
        UNION ALL
        SELECT id, date, 0, ret, 0, tu, 0, ex
        FROM tst t JOIN pw p ON p.scope = t.scope AND p.strategy = t.strategy AND p.market = t.market AND p.fz = t.fz AND p.variant = t.control)
  GROUP BY id, date),
"""


def draw_cte(name: str, src: str, seed: int = 0) -> str:
    """Adds ``start``, the draw for columns rep, slot and t of ``src``."""
    p = PRIME
    return f"""
{name}_1 AS (SELECT *, (rep * {STEP_REP} + slot * {STEP_SLOT} + {seed * 1299709 + STEP_ONE}) % {p} AS x FROM {src}),
{name}_2 AS (SELECT *, (x * x % {p}) * (x * x % {p}) % {p} * x % {p} AS y FROM {name}_1),
{name}_3 AS (SELECT *, (y * {STEP_AGAIN} + rep + slot) % {p} AS u FROM {name}_2),
{name} AS (SELECT * EXCLUDE (x, y, u), ((u * u % {p}) * (u * u % {p}) % {p} * u % {p}) % t AS start FROM {name}_3),
"""


BOOT_SQL = """
po AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS i, v_ret, b_ret FROM ser),
tl AS (SELECT id, count(*) AS t FROM ser GROUP BY id),
sl AS (SELECT id, t, r.rep, s.slot FROM tl, (SELECT unnest(range(""" + str(REPS) + """)) AS rep) r, LATERAL (SELECT unnest(range(CAST(ceil(t / 20.0) AS BIGINT))) AS slot) s),
""" + draw_cte("st", "sl") + """
dd AS (SELECT id, rep, (start + j) % t AS i FROM st, (SELECT unnest(range(20)) AS j) WHERE slot * 20 + j < t),
bs AS (SELECT id, rep, sqrt(252) * (avg(v_ret) / stddev_samp(v_ret) - avg(b_ret) / stddev_samp(b_ret)) AS d FROM dd JOIN po USING (id, i) GROUP BY id, rep),
bt AS MATERIALIZED (SELECT id, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi,
  least(1, 2 * least(avg(CAST(d <= 0 AS INT)), avg(CAST(d >= 0 AS INT)))) AS p_value FROM bs GROUP BY id),
pt AS (SELECT id, sqrt(252) * (avg(v_ret) / stddev_samp(v_ret) - avg(b_ret) / stddev_samp(b_ret)) AS delta_sharpe FROM ser GROUP BY id),
"""
TM = """count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(ret) * 1e4 AS mean_trade_bps"""
TESTS_SQL = SUMS_SQL + metrics_sql("ser", "id", expected_best(7), "xv", "v_ret", "v_tu", "v_ex") + metrics_sql(
    "ser", "id", 0.0, "xb", "b_ret", "b_tu", "b_ex") + BOOT_SQL + f"""
tw AS MATERIALIZED (SELECT strategy, x.market, name AS fz, variant, ret FROM (SELECT strategy, variant, fz, entry_time, ret, unnest([market, 'ALL']) AS market FROM stt) x
  JOIN windows w ON (x.fz = 'all' OR x.fz = w.name) AND entry_time >= lo AND entry_time < hi),
tm AS (SELECT strategy, market, fz, variant, {TM} FROM tw GROUP BY ALL),
tj AS MATERIALIZED (SELECT t.id, t.scope, t.strategy, t.market, t.fz, t.variant, t.comp, t.scope || '_' || t.fam AS family, {', '.join(
    f'xv.{c.split(":")[0]} AS v_{c.split(":")[0]}, xb.{c.split(":")[0]} AS b_{c.split(":")[0]}' for c in METRICS.split())},
    delta_sharpe, ci_lo, ci_hi, p_value, a.n_trades AS v_n_trades, a.win_rate AS v_win_rate, b.n_trades AS b_n_trades
  FROM tst t JOIN xv ON xv.id = t.id JOIN xb ON xb.id = t.id JOIN bt ON bt.id = t.id JOIN pt ON pt.id = t.id
  LEFT JOIN tm a ON a.strategy = t.strategy AND a.market = t.market AND a.fz = t.fz AND a.variant = t.variant
  LEFT JOIN tm b ON b.strategy = t.strategy AND b.market = t.market AND b.fz = t.fz AND b.variant = t.control),
rk AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p_value, id) AS k FROM tj),
al AS MATERIALIZED (SELECT *, least(1, min(p_value * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_bh,
  least(1, max(p_value * (m - k + 1)) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm FROM rk),
tests AS MATERIALIZED (SELECT *, fz AS "freeze", comp AS component, q_bh < 0.05 AS significant,
  v_max_drawdown - b_max_drawdown AS delta_max_drawdown, market IN ('M0', 'M2') AS survivorship_free FROM al),
mk AS MATERIALIZED (SELECT * FROM tests WHERE family = 'market_main'),
gl AS MATERIALIZED (SELECT * FROM tests WHERE family = 'global_main'),
"""


# ---- N: comparison and inference --------------------------------------------------------

def tested(name, spec, final, post=lambda df: df):
    register(name, spec, lambda s, d: post(tests(s, d)), TESTS_SQL, final)


M = [c.split(":")[0] for c in METRICS.split()]
tested("n1_compare_with_control", f"{KEYS} {' '.join(f'v_{m}:d b_{m}:d' for m in M)} delta_max_drawdown:d v_n_trades:i b_n_trades:i v_win_rate:d",
       "SELECT * FROM tests WHERE scope = 'market'", lambda df: df.where("scope = 'market'"))
tested("n2_block_bootstrap", f"{KEYS} delta_sharpe:d ci_lo:d ci_hi:d p_value:d", "SELECT * FROM tests")
tested("n6_benjamini_hochberg", f"family:s {KEYS} p_value:d q_bh:d", "SELECT * FROM tests")
tested("n7_holm", f"family:s {KEYS} p_value:d p_holm:d", "SELECT * FROM tests")
register("n8_test_families", "strategy:s market:s freeze:s variant:s family:s component:s control:s", lambda s, d: scope(s, d, True).tests, SUMS_SQL,
         "SELECT strategy, market, fz AS \"freeze\", variant, fam AS family, comp AS component, control FROM tst WHERE scope = 'global'")
tested("n9_market_tests", f"family:s {KEYS} component:s survivorship_free:b delta_sharpe:d p_value:d", "SELECT * FROM tests WHERE scope = 'market'",
       lambda df: df.where("scope = 'market'"))
tested("n11_global_tests", f"family:s {KEYS} component:s v_sharpe:d b_sharpe:d delta_sharpe:d p_value:d", "SELECT * FROM tests WHERE scope = 'global'",
       lambda df: df.where("scope = 'global'"))
tested("n17_family_wise_significance", f"family:s {KEYS} significant:b", "SELECT * FROM tests")


def day_ci(spark, d, paired):
    daily = valuation.realized_daily(pair_trades(spark, d), ["variant", "market"])
    v, c = daily.where("variant = 'scored'").drop("variant"), daily.where("variant = 'control'").drop("variant")
    out = inference.day_bootstrap(v, c, ["market"], REPS, paired=paired)
    return out.withColumn("significant", inference.excludes_zero())


MARKET_RD = RD_SQL + "rm AS MATERIALIZED (SELECT variant, market, exit_time AS date, avg(ret) AS ret FROM walked GROUP BY ALL),\n"


def _side(name, src, seed):
    return f"""
{name}_p AS (SELECT market, row_number() OVER (PARTITION BY market ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market) AS t, {src}),
{name}_s AS (SELECT market, t, rep, i AS slot FROM {name}_p, (SELECT unnest(range({REPS})) AS rep)),
""" + draw_cte(f"{name}_d", f"{name}_s", seed)


DAY_OUT = ("SELECT market, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, "
           "quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS significant FROM df GROUP BY market")
register("n3_unpaired_day_bootstrap", "market:s ci_lo:d ci_hi:d", lambda s, d: day_ci(s, d, False), MARKET_RD + _side(
    "a", "ret FROM rm WHERE variant = 'scored'", 0) + _side("b", "ret FROM rm WHERE variant = 'control'", 1) + """
ra AS (SELECT d.market, rep, avg(ret) / stddev_samp(ret) AS s FROM a_d d JOIN a_p p ON p.market = d.market AND p.i = d.start GROUP BY ALL),
rb AS (SELECT d.market, rep, avg(ret) / stddev_samp(ret) AS s FROM b_d d JOIN b_p p ON p.market = d.market AND p.i = d.start GROUP BY ALL),
df AS (SELECT ra.market, ra.s - rb.s AS d FROM ra JOIN rb USING (market, rep))
""", DAY_OUT)
PAIRED_RD = MARKET_RD + """
un AS (SELECT market, date, coalesce(max(ret) FILTER (variant = 'scored'), 0) AS va, coalesce(max(ret) FILTER (variant = 'control'), 0) AS vb FROM rm GROUP BY ALL),
""" + _side("a", "va, vb FROM un", 0) + """
df AS (SELECT d.market, rep, avg(va) / stddev_samp(va) - avg(vb) / stddev_samp(vb) AS d FROM a_d d JOIN a_p p ON p.market = d.market AND p.i = d.start GROUP BY ALL)
"""
register("n4_paired_day_bootstrap", "market:s ci_lo:d ci_hi:d", lambda s, d: day_ci(s, d, True), PAIRED_RD, DAY_OUT)
register("n5_interval_excludes_zero", "market:s significant:b", lambda s, d: day_ci(s, d, True), PAIRED_RD, DAY_OUT)

LOO_SQL = SUMS_SQL + """
dw AS MATERIALIZED (SELECT strategy, market, name AS fz, variant, symbol, date, gross - cost AS net FROM day JOIN windows w
  ON (day.fz = 'all' OR day.fz = w.name) AND date >= lo AND date < hi),
mt AS MATERIALIZED (SELECT * FROM tst WHERE scope = 'market' AND fam = 'main'),
sy AS MATERIALIZED (SELECT DISTINCT t.id, d.symbol FROM mt t JOIN dw d ON d.strategy = t.strategy AND d.market = t.market AND d.fz = t.fz AND d.variant = t.variant),
lo AS (
  SELECT t.id, sy.symbol, 'v' AS side, p.date, (p.gross - p.cost - coalesce(d.net, 0)) / greatest(p.n - CASE WHEN d.net IS NULL THEN 0 ELSE 1 END, 1) AS ret
  FROM mt t JOIN sy ON sy.id = t.id JOIN pw p ON p.scope = 'market' AND p.strategy = t.strategy AND p.market = t.market AND p.fz = t.fz AND p.variant = t.variant
  LEFT JOIN dw d ON d.strategy = t.strategy AND d.market = t.market AND d.fz = t.fz AND d.variant = t.variant AND d.symbol = sy.symbol AND d.date = p.date
  UNION ALL
  SELECT t.id, sy.symbol, 'b', p.date, (p.gross - p.cost - coalesce(d.net, 0)) / greatest(p.n - CASE WHEN d.net IS NULL THEN 0 ELSE 1 END, 1)
  FROM mt t JOIN sy ON sy.id = t.id JOIN pw p ON p.scope = 'market' AND p.strategy = t.strategy AND p.market = t.market AND p.fz = t.fz AND p.variant = t.control
  LEFT JOIN dw d ON d.strategy = t.strategy AND d.market = t.market AND d.fz = t.fz AND d.variant = t.control AND d.symbol = sy.symbol AND d.date = p.date),
un AS (SELECT id, symbol, date, sum(ret) FILTER (side = 'v') AS v, sum(ret) FILTER (side = 'b') AS b FROM lo GROUP BY ALL),
sh AS (SELECT id, symbol, sqrt(252) * (coalesce(avg(coalesce(v, 0)) / nullif(stddev_samp(coalesce(v, 0)), 0), 0)
                                       - coalesce(avg(coalesce(b, 0)) / nullif(stddev_samp(coalesce(b, 0)), 0), 0)) AS delta FROM un GROUP BY ALL),
full_delta AS (SELECT id, sqrt(252) * (avg(v_ret) / stddev_samp(v_ret) - avg(b_ret) / stddev_samp(b_ret)) AS delta_full FROM ser GROUP BY id),
"""
register("n10_leave_one_instrument_out", "strategy:s market:s freeze:s variant:s delta_full:d loo_min:d loo_max:d n_left_out:i sign_flips:i",
         left_out_instruments, LOO_SQL, """
SELECT t.strategy, t.market, t.fz AS "freeze", t.variant, any_value(delta_full) AS delta_full, min(delta) AS loo_min, max(delta) AS loo_max,
       count(*) AS n_left_out, count(*) FILTER (sign(delta) <> sign(delta_full)) AS sign_flips
FROM sh JOIN mt t USING (id) JOIN full_delta USING (id) GROUP BY ALL""")
LOM_SQL = SUMS_SQL + """
gt AS MATERIALIZED (SELECT * FROM tst WHERE scope = 'global' AND fam = 'main'),
pm AS MATERIALIZED (SELECT strategy, market AS part, fz, variant, date, gross - cost AS net, n FROM mw),
op AS (SELECT DISTINCT t.id, v.part FROM gt t JOIN pm v ON v.strategy = t.strategy AND v.fz = t.fz AND v.variant = t.variant
       JOIN pm b ON b.strategy = t.strategy AND b.fz = t.fz AND b.variant = t.control AND b.part = v.part),
lo AS (
  SELECT t.id, op.part, c.side, p.date, (p.gross - p.cost - coalesce(d.net, 0)) / greatest(p.n - coalesce(d.n, 0), 1) AS ret
  FROM gt t JOIN op ON op.id = t.id JOIN (VALUES ('v'), ('b')) c(side) ON true
  JOIN pw p ON p.scope = 'global' AND p.strategy = t.strategy AND p.fz = t.fz AND p.variant = CASE c.side WHEN 'v' THEN t.variant ELSE t.control END
  LEFT JOIN pm d ON d.strategy = t.strategy AND d.fz = t.fz AND d.variant = p.variant AND d.part = op.part AND d.date = p.date),
un AS (SELECT id, part, date, coalesce(sum(ret) FILTER (side = 'v'), 0) AS v, coalesce(sum(ret) FILTER (side = 'b'), 0) AS b FROM lo GROUP BY ALL),
"""
register("n12_leave_one_market_out", "strategy:s market:s freeze:s variant:s delta_without_market:d",
         lambda s, d: analysis.jackknife_markets(scope(s, d, True), market_sums(s, d), CFG), LOM_SQL, """
SELECT t.strategy, part AS market, t.fz AS "freeze", t.variant, sqrt(252) * (avg(v) / stddev_samp(v) - avg(b) / stddev_samp(b)) AS delta_without_market
FROM un JOIN gt t USING (id) GROUP BY ALL""")
COST_SQL = SUMS_SQL + """
gt AS (SELECT * FROM tst WHERE scope = 'global' AND fam = 'main'),
ml(m) AS (VALUES (0.0), (1.0), (2.0), (4.0)),
cs AS (SELECT t.id, m, date, coalesce(sum(CASE WHEN p.variant = t.variant THEN (gross - m * cost) / n END), 0) AS v,
         coalesce(sum(CASE WHEN p.variant = t.control THEN (gross - m * cost) / n END), 0) AS b
       FROM gt t JOIN pw p ON p.scope = 'global' AND p.strategy = t.strategy AND p.fz = t.fz AND p.variant IN (t.variant, t.control), ml GROUP BY ALL),
costs AS MATERIALIZED (SELECT t.strategy, t.fz AS "freeze", t.variant, CAST(m AS DOUBLE) AS cost_multiplier, sqrt(252) * avg(v) / stddev_samp(v) AS v_sharpe,
  sqrt(252) * avg(b) / stddev_samp(b) AS b_sharpe, sqrt(252) * (avg(v) / stddev_samp(v) - avg(b) / stddev_samp(b)) AS delta_sharpe
  FROM cs JOIN gt t USING (id) GROUP BY ALL),
"""


def costs(spark, d):
    return analysis.cost_sensitivity(scope(spark, d, True), CFG)


register("n13_cost_sensitivity", "strategy:s freeze:s variant:s cost_multiplier:d v_sharpe:d b_sharpe:d delta_sharpe:d", costs, COST_SQL, "SELECT * FROM costs")

EXPAND = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LABEL_SQL = """
gx AS (SELECT date, coalesce(avg(r), 0) AS ret FROM ir GROUP BY date),
lv AS (SELECT *, product(1 + ret) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level,
         CASE WHEN count(*) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20
              THEN stddev_samp(ret) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rv FROM gx),
rg AS MATERIALIZED (SELECT date,
         coalesce(level > CASE WHEN count(*) OVER w100 >= 100 THEN avg(level) OVER w100 END, false) AS bull,
         coalesce(rv > CASE WHEN count(rv) OVER wall >= 250 THEN quantile_cont(rv, 0.5) OVER wall END, false) AS high FROM lv
       WINDOW w100 AS (ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), wall AS """ + EXPAND + """),
labels0 AS MATERIALIZED (SELECT date, CASE lag(bull) OVER (ORDER BY date) WHEN true THEN 'bull' WHEN false THEN 'bear' END AS trend,
         CASE lag(high) OVER (ORDER BY date) WHEN true THEN 'high_vol' WHEN false THEN 'low_vol' END AS vol FROM rg),
"""


def world_labels(spark, d):
    index = valuation.market_index(bars(spark, d).withColumn("scope", F.lit("ALL")), ("scope",))
    return regimes.regime_labels(index, ("scope",), CFG.trend_sma_days, CFG.vol_window_days).drop("scope")


register("n14_regime_labels", "date:t trend:s vol:s", world_labels, IDX_SQL + LABEL_SQL, "SELECT * FROM labels0")


def main_pairs(spark, d):
    p = scope(spark, d, True)
    return analysis.pairs(p, p.tests.where("family = 'main'"))


def regime_rows(spark, d):
    return regimes.regime_sharpes(main_pairs(spark, d), world_labels(spark, d), analysis.TEST)


def crisis_rows(spark, d):
    return regimes.crisis_performance(main_pairs(spark, d), analysis.crises_frame(spark, CFG), analysis.TEST)


IR = IDX_SQL.split("ir AS", 1)[1].split("ix AS", 1)[0]
REGIME_SQL = SUMS_SQL + "ir AS" + IR + LABEL_SQL + """
sr AS (SELECT s.*, t.strategy, t.fz, t.variant FROM ser s JOIN tst t USING (id) WHERE scope = 'global' AND fam = 'main'),
rl AS (SELECT sr.*, dim AS dimension, CASE dim WHEN 'trend' THEN trend ELSE vol END AS regime FROM sr JOIN labels0 USING (date), (VALUES ('trend'), ('vol')) q(dim)),
regimes AS MATERIALIZED (SELECT strategy, fz AS "freeze", variant, dimension, regime, count(*) AS days, sqrt(252) * avg(v_ret) / stddev_samp(v_ret) AS v_sharpe,
  sqrt(252) * avg(b_ret) / stddev_samp(b_ret) AS b_sharpe, sqrt(252) * (avg(v_ret) / stddev_samp(v_ret) - avg(b_ret) / stddev_samp(b_ret)) AS delta_sharpe
  FROM rl WHERE regime IS NOT NULL GROUP BY ALL HAVING count(*) >= 60),
"""
register("n15_regime_sharpe", "strategy:s freeze:s variant:s dimension:s regime:s days:i v_sharpe:d b_sharpe:d delta_sharpe:d", regime_rows, REGIME_SQL, "SELECT * FROM regimes")
CRISIS_SQL = SUMS_SQL + """
cr(crisis, a, z) AS (VALUES """ + ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in CRISES) + """),
cd AS (SELECT s.*, t.strategy, t.fz, t.variant, crisis FROM ser s JOIN tst t USING (id) JOIN cr ON s.date BETWEEN a AND z WHERE scope = 'global' AND fam = 'main'),
ce AS (SELECT *, product(1 + v_ret) OVER w AS ve, product(1 + b_ret) OVER w AS be FROM cd
       WINDOW w AS (PARTITION BY id, crisis ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cf AS (SELECT *, ve / max(ve) OVER w - 1 AS vd, be / max(be) OVER w - 1 AS bd FROM ce
       WINDOW w AS (PARTITION BY id, crisis ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
crises AS MATERIALIZED (SELECT strategy, fz AS "freeze", variant, crisis, product(1 + v_ret) - 1 AS v_return, product(1 + b_ret) - 1 AS b_return,
  min(vd) AS v_max_drawdown, min(bd) AS b_max_drawdown FROM cf GROUP BY ALL HAVING count(*) >= 20),
"""
register("n16_crisis_performance", "strategy:s freeze:s variant:s crisis:s v_return:d b_return:d v_max_drawdown:d b_max_drawdown:d", crisis_rows, CRISIS_SQL, "SELECT * FROM crises")
register("a14_buy_and_hold_metrics", f"market:s freeze:s {METRICS}", lambda s, d: analysis.buy_and_hold(bars(s, d), CFG), IDX_SQL + """
windows(name, lo, hi) AS (VALUES """ + ", ".join(f"('{f.name}', DATE '{f.split}', DATE '{f.test_end}')" for f in FREEZES) + """),
iw AS (SELECT market, name AS fz, date, ret FROM ix JOIN windows ON date >= lo AND date < hi),
""" + metrics_sql("iw", "market, fz", 0.0, "mt", "ret", "0.0", "1.0"), "SELECT *, fz AS \"freeze\" FROM mt")
register("s11_global_daily_long", "date:t ret:d strategy:s variant:s freeze:s", lambda s, d: analysis.global_daily(scope(s, d, True)), SUMS_SQL,
         "SELECT date, ret, strategy, variant, fz AS \"freeze\" FROM pw WHERE scope = 'global' AND (variant = 'baseline' OR variant IN "
         "(SELECT variant FROM tst WHERE scope = 'global' AND fam = 'main'))")
register("s12_run_log", "strategy:s market:s n_trades:i n_variants:i", lambda s, d: run_log(study_trades(s, d)), TRADES_SQL,
         "SELECT strategy, market, count(*) AS n_trades, count(DISTINCT variant) AS n_variants FROM stt GROUP BY ALL")

# ---- single-market attribution table ----------------------------------------------------

WINDOWS = [("holdout", "1998-07-01", "2000-07-01"), ("forward", "2000-07-01", None)]


def attribution(spark, d):
    t = windowed(pair_trades(spark, d), WINDOWS)
    return attribution_table(t, "control", {"control": "control", "scored": "replacing"}, {"scored": 2}, reps=REPS)


AT_SQL = PAIR_SQL + """
wi(name, lo, hi) AS (VALUES ('holdout', DATE '1998-07-01', DATE '2000-07-01'), ('forward', DATE '2000-07-01', DATE '2100-01-01')),
wt AS MATERIALIZED (SELECT w.*, name FROM walked w JOIN wi ON entry_time >= lo AND entry_time < hi),
wd AS MATERIALIZED (SELECT market, name, variant, exit_time AS date, avg(ret) AS ret FROM wt GROUP BY ALL),
""" + metrics_sql("wd", "market, name, variant", 0.0, "m0", "ret", "0.0", "0.0") + """
base_rows AS MATERIALIZED (SELECT m0.market, m0.name, m0.variant, n_trades, bps AS mean_trade_bps, max_drawdown, rs AS sharpe, tot AS total_return FROM m0
  JOIN (SELECT market, name, variant, count(*) AS n_trades, avg(ret) * 1e4 AS bps FROM wt GROUP BY ALL) t USING (market, name, variant)
  JOIN (SELECT market, name, variant, sqrt(252) * (avg(ret) - 0.06 / 252) / stddev_pop(ret) AS rs, product(1 + ret) - 1 AS tot FROM wd GROUP BY ALL) u USING (market, name, variant)),
""" + "".join(f"""
{n}_p AS (SELECT market, name, row_number() OVER (PARTITION BY market, name ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY market, name) AS t, ret FROM wd WHERE variant = '{v}'),
{n}_s AS (SELECT market, name, t, rep, i AS slot FROM {n}_p, (SELECT unnest(range({REPS})) AS rep)),
""" + draw_cte(f"{n}_d", f"{n}_s", k) + f"""
{n}_r AS (SELECT d.market, d.name, rep, avg(ret) / stddev_samp(ret) AS s FROM {n}_d d JOIN {n}_p p ON p.market = d.market AND p.name = d.name AND p.i = d.start GROUP BY ALL),
""" for n, v, k in (("va", "scored", 0), ("vb", "control", 1))) + """
ci AS (SELECT market, name, quantile_cont(va_r.s - vb_r.s, 0.025) AS ci_lo, quantile_cont(va_r.s - vb_r.s, 0.975) AS ci_hi FROM va_r JOIN vb_r USING (market, name, rep) GROUP BY ALL),
att AS MATERIALIZED (SELECT a.market, a.name AS "window", a.variant, CASE a.variant WHEN 'control' THEN 'control' ELSE 'replacing' END AS kind, a.n_trades, a.sharpe,
  a.mean_trade_bps, a.total_return, a.max_drawdown, b.sharpe AS baseline_sharpe, a.sharpe - b.sharpe AS delta_sharpe,
  CASE WHEN a.variant = 'scored' THEN ci_lo END AS ci_lo, CASE WHEN a.variant = 'scored' THEN ci_hi END AS ci_hi,
  a.variant = 'scored' AND (ci_lo > 0 OR ci_hi < 0) AS significant
  FROM base_rows a JOIN base_rows b ON b.market = a.market AND b.name = a.name AND b.variant = 'control' JOIN ci ON ci.market = a.market AND ci.name = a.name),
"""
AT_SPEC = ("market:s window:s variant:s kind:s n_trades:i sharpe:d mean_trade_bps:d total_return:d max_drawdown:d baseline_sharpe:d delta_sharpe:d "
           "ci_lo:d ci_hi:d significant:b")


def at(spark, d):
    return shared(spark, d, "attribution", lambda: attribution(spark, d))


register("d7_attribution_table", AT_SPEC, at, AT_SQL, "SELECT * FROM att")
CELL = """
ce AS MATERIALIZED (SELECT market, variant, any_value(kind) AS kind, bool_or(significant AND delta_sharpe > 0) AS g, bool_or(significant AND delta_sharpe < 0) AS l, avg(delta_sharpe) AS m
  FROM att WHERE kind <> 'control' GROUP BY ALL),
"""
SAY = """CASE WHEN gain <> '' THEN 'Adopt (significant gain in ' || gain || ')' WHEN loss <> '' AND hope = '' THEN 'Avoid (significant loss in ' || loss || ')'
 WHEN loss <> '' THEN 'Mixed (avoid in ' || loss || '; promising, unreplicated in ' || hope || ')' WHEN hope <> '' THEN 'Worth exploring in ' || hope || ' (unreplicated)'
 ELSE 'Neutral (no consistent effect)' END AS recommendation"""
NAMES = """coalesce(string_agg(market, ', ' ORDER BY market) FILTER (g), '') AS gain, coalesce(string_agg(market, ', ' ORDER BY market) FILTER (l), '') AS loss,
 coalesce(string_agg(market, ', ' ORDER BY market) FILTER (m > 0 AND NOT l), '') AS hope"""
register("r1_run_matrix", "market:s variant:s kind:s mean_delta_sharpe:d recommendation:s", lambda s, d: reports.run_matrix(at(s, d)), AT_SQL + CELL,
         f"SELECT *, {SAY} FROM (SELECT market, variant, any_value(kind) AS kind, round(any_value(m), 3) AS mean_delta_sharpe, {NAMES} FROM ce GROUP BY market, variant)")
CELLTEXT = "(printf('%+.2f', m) || CASE WHEN g THEN '*+' WHEN l THEN '*-' ELSE '' END)"
register("r2_opportunity_matrix", "variant:s kind:s M0:s M1:s M2:s", lambda s, d: reports.opportunity_matrix(at(s, d), ["M0", "M1", "M2"]), AT_SQL + CELL,
         "SELECT variant, any_value(kind) AS kind, " + ", ".join(f"max({CELLTEXT}) FILTER (market = '{m}') AS {m}" for m in ("M0", "M1", "M2")) + " FROM ce GROUP BY variant")
register("r3_recommendation", "variant:s recommendation:s", lambda s, d: reports.opportunity_matrix(at(s, d), ["M0", "M1", "M2"]), AT_SQL + CELL,
         f"SELECT variant, {SAY} FROM (SELECT variant, {NAMES} FROM ce GROUP BY variant)")


def replicated(spark, d):
    t = at(spark, d).where("variant = 'scored'")
    original = t.select(F.when(F.col("market") == "M0", "zero").otherwise(F.col("market")).alias("market"), "window",
                        F.when(F.col("variant") == "scored", "Combinations").otherwise(F.col("variant")).alias("component"),
                        F.when(F.col("variant") == "scored", "renamed").otherwise("x").alias("variant"),
                        (F.col("delta_sharpe") - 0.1).alias("delta_sharpe"), "significant")
    return reports.compare_replication(original, t, {"renamed": "scored"}, {"zero": "M0"})


register("r4_compare_replication", "market:s window:s variant:s delta_sharpe_paper:d delta_sharpe_rep:d significant_paper:b significant_rep:b sign_agrees:b", replicated, AT_SQL,
         "SELECT market, \"window\", variant, delta_sharpe - 0.1 AS delta_sharpe_paper, delta_sharpe AS delta_sharpe_rep, significant AS significant_paper, "
         "significant AS significant_rep, (delta_sharpe - 0.1 > 0) = (delta_sharpe > 0) AS sign_agrees FROM att WHERE variant = 'scored'")
register("r5_trade_inflation", "market:s window:s ratio:d", lambda s, d: reports.trade_inflation(at(s, d), "scored", "control"), AT_SQL,
         "SELECT a.market, a.\"window\", a.n_trades / b.n_trades AS ratio FROM att a JOIN att b ON a.market = b.market AND a.\"window\" = b.\"window\" WHERE a.variant = 'scored' AND b.variant = 'control'")
register("r24_forest_rows", "market:s window:s variant:s rank:i delta_sharpe:d lo:d hi:d significant:b", lambda s, d: reports.forest_rows(at(s, d), ["scored"]), AT_SQL,
         "SELECT *, 1 AS rank, ci_lo * sqrt(252) AS lo, ci_hi * sqrt(252) AS hi FROM att WHERE variant = 'scored'")
register("r26_headline_counts", "market:s configs:i gains:i losses:i", lambda s, d: reports.headline_counts(at(s, d), ["market"]), AT_SQL,
         "SELECT market, count(*) AS configs, count(*) FILTER (significant AND delta_sharpe > 0) AS gains, count(*) FILTER (significant AND delta_sharpe < 0) AS losses FROM att GROUP BY market")

# ---- R: study reports -------------------------------------------------------------------

G, L = "significant AND delta_sharpe > 0", "significant AND delta_sharpe < 0"
MED = "quantile_cont({}, 0.5)".format


def mk(df):
    return df.where("family = 'market_main'")


def gl(df):
    return df.where("family = 'global_main'")


tested("r6_significance_counts", "family:s tests:i gains:i losses:i positive_share:d raw_significant:i holm_significant:i",
       f"SELECT family, count(*) AS tests, count(*) FILTER ({G}) AS gains, count(*) FILTER ({L}) AS losses, avg(CAST(delta_sharpe > 0 AS INT)) AS positive_share, "
       "count(*) FILTER (p_value < 0.05) AS raw_significant, count(*) FILTER (p_holm < 0.05) AS holm_significant FROM tests GROUP BY family", reports.significance_counts)
tested("r7_component_summary", "component:s tests:i positive_share:d gains:i losses:i median:d gains_reversion:i losses_reversion:i median_trend:d median_reversion:d "
       "median_turnover_change:d turnover_median_change:d",
       f"SELECT component, count(*) AS tests, avg(CAST(delta_sharpe > 0 AS INT)) AS positive_share, count(*) FILTER ({G}) AS gains, count(*) FILTER ({L}) AS losses, "
       f"{MED('delta_sharpe')} AS median, count(*) FILTER ({G} AND strategy = 'don') AS gains_reversion, count(*) FILTER ({L} AND strategy = 'don') AS losses_reversion, "
       f"{MED('delta_sharpe')} FILTER (strategy <> 'don') AS median_trend, {MED('delta_sharpe')} FILTER (strategy = 'don') AS median_reversion, "
       f"{MED('v_turnover - b_turnover')} AS median_turnover_change, {MED('v_turnover')} - {MED('b_turnover')} AS turnover_median_change FROM mk GROUP BY component",
       lambda df: reports.component_summary(mk(df), "don"))
tested("r7_global_summary", "component:s tests:i median:d positive:i shallower:i median_exposure_change:d",
       f"SELECT component, count(*) AS tests, {MED('delta_sharpe')} AS median, count(*) FILTER (delta_sharpe > 0) AS positive, count(*) FILTER (delta_max_drawdown > 0) AS shallower, "
       f"{MED('v_exposure - b_exposure')} AS median_exposure_change FROM gl GROUP BY component", lambda df: reports.global_summary(gl(df)))
tested("r8_freeze_replication", "component:s cells:i agreement:d corr:d",
       "SELECT component, count(*) AS cells, avg(CAST(sign(a) = sign(b) AS INT)) AS agreement, CASE WHEN count(*) > 2 THEN corr(a, b) END AS corr FROM "
       "(SELECT component, strategy, market, avg(delta_sharpe) FILTER (fz = 'F1') AS a, avg(delta_sharpe) FILTER (fz = 'F2') AS b FROM mk GROUP BY ALL) "
       "WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY component", lambda df: reports.freeze_replication(mk(df), "F1", "F2"))
COMPS = ("rule_adx", "meta_label", "position_sizing", "exit")
tested("r9_strategy_matrix", "strategy:s " + " ".join(f"{c}:s" for c in COMPS),
       "SELECT strategy, " + ", ".join(f"max(txt) FILTER (component = '{c}') AS {c}" for c in COMPS) + " FROM (SELECT strategy, component, "
       f"printf('%+.2f (%d/%d)', {MED('delta_sharpe')}, count(*) FILTER ({G}), count(*) FILTER ({L})) AS txt FROM mk GROUP BY ALL) GROUP BY strategy",
       lambda df: reports.strategy_matrix(mk(df), COMPS))
tested("r10_robustness_summary", "family:s variant:s tests:i median:d positive_share:d significant:i losses:i min:d max:d",
       f"SELECT family, variant, count(*) AS tests, {MED('delta_sharpe')} AS median, avg(CAST(delta_sharpe > 0 AS INT)) AS positive_share, count(*) FILTER (significant) AS significant, "
       f"count(*) FILTER ({L}) AS losses, min(delta_sharpe) AS min, max(delta_sharpe) AS max FROM tests WHERE NOT family LIKE '%main' GROUP BY family, variant",
       lambda df: reports.delta_summary(df.where("family NOT LIKE '%main'"), ["family", "variant"]))
register("r11_cost_curve", "cost_multiplier:d variant:s median:d", lambda s, d: reports.cost_curve(costs(s, d)), COST_SQL,
         f"SELECT cost_multiplier, variant, {MED('delta_sharpe')} AS median FROM costs GROUP BY ALL")
tested("r12_survivorship_split", "bias:s component:s median:d",
       f"SELECT CASE WHEN survivorship_free THEN 'free' ELSE 'prone' END AS bias, component, {MED('delta_sharpe')} AS median FROM mk GROUP BY ALL",
       lambda df: reports.survivorship_split(mk(df)))


def jackknives(spark, d):
    return shared(spark, d, "jackknife", lambda: left_out_instruments(spark, d))


register("r13_jackknife_flip_share", "flip_share:d", lambda s, d: reports.jackknife_summary(jackknives(s, d), mk(tests(s, d))), LOO_SQL + """
fl AS (SELECT id, count(*) FILTER (sign(delta) <> sign(delta_full)) AS flips FROM sh JOIN full_delta USING (id) GROUP BY id)""",
         "SELECT avg(CAST(flips > 0 AS INT)) AS flip_share FROM fl")
register("r13_market_flip_share", "flip_share:d", lambda s, d: reports.market_flip_share(analysis.jackknife_markets(scope(s, d, True), market_sums(s, d), CFG)), LOM_SQL + """
ud AS (SELECT id, part, avg(v) / stddev_samp(v) - avg(b) / stddev_samp(b) AS delta FROM un GROUP BY ALL),
fd2 AS (SELECT id, avg(v_ret) / stddev_samp(v_ret) - avg(b_ret) / stddev_samp(b_ret) AS delta_full FROM ser GROUP BY id)""",
         "SELECT avg(CAST(sign(delta) <> sign(delta_full) AS INT)) AS flip_share FROM ud JOIN fd2 USING (id)")
REG = ("bull", "bear", "low_vol", "high_vol")
register("r14_regime_table", "variant:s " + " ".join(f"{r}:d" for r in REG), lambda s, d: reports.regime_table(regime_rows(s, d)), REGIME_SQL,
         "SELECT variant, " + ", ".join(f"avg(delta_sharpe) FILTER (regime = '{r}') AS {r}" for r in REG) + " FROM regimes GROUP BY variant")
register("r14_crisis_table", "variant:s crisis:s return_change:d drawdown_change:d", lambda s, d: reports.crisis_table(crisis_rows(s, d), ["first", "second"]), CRISIS_SQL,
         "SELECT variant, crisis, avg(100 * (v_return - b_return)) AS return_change, avg(100 * (v_max_drawdown - b_max_drawdown)) AS drawdown_change FROM crises GROUP BY ALL")
tested("r16_p_value_histogram", "bin:i tests:i expected:d",
       "SELECT b.bin, count(mk.id) AS tests, any_value(e.expected) AS expected FROM (SELECT unnest(range(20)) AS bin) b "
       "LEFT JOIN mk ON least(floor(p_value * 20), 19) = b.bin, (SELECT count(*) / 20 AS expected FROM mk) e GROUP BY b.bin", lambda df: reports.p_value_histogram(mk(df)))
tested("r17_heat_map", "strategy:s component:s market:s mean_delta:d any_significant:b",
       "SELECT strategy, component, market, avg(delta_sharpe) AS mean_delta, bool_or(significant) AS any_significant FROM mk GROUP BY ALL", lambda df: reports.heat_map(mk(df)))


def equity(spark, d):
    from ..functions.indicators import with_equity

    return with_equity(analysis.global_daily(scope(spark, d, True)), "ret", ["strategy", "variant", "freeze"])


register("r18_equity_curves", "strategy:s variant:s freeze:s date:t equity:d drawdown:d", equity, SUMS_SQL + """
eq AS (SELECT strategy, variant, fz, date, product(1 + ret) OVER (PARTITION BY strategy, variant, fz ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
  FROM pw WHERE scope = 'global' AND (variant = 'baseline' OR variant IN (SELECT variant FROM tst WHERE scope = 'global' AND fam = 'main')))""",
         "SELECT *, fz AS \"freeze\", equity / max(equity) OVER (PARTITION BY strategy, variant, fz ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq")
RISK = (("sharpe", 1), ("ann_return", 100), ("ann_vol", 100), ("max_drawdown", 100), ("turnover", 1), ("exposure", 100))
tested("r19_risk_profile", "component:s " + " ".join(f"{k}:d" for k, _ in RISK),
       "SELECT component, " + ", ".join(f"{MED(f'{s} * (v_{k} - b_{k})')} AS {k}" for k, s in RISK) + " FROM gl GROUP BY component", lambda df: reports.risk_profile(gl(df)))
tested("r20_transfer_against_own", "component:s cells:i corr:d",
       "SELECT o.component, count(*) AS cells, corr(m.delta_sharpe, o.delta_sharpe) AS corr FROM tests o JOIN mk m ON m.strategy = o.strategy AND m.market = o.market "
       "AND m.fz = o.fz AND m.component = o.component WHERE o.family = 'market_transfer' GROUP BY o.component", reports.transfer_against_own)
tested("r21_ablation_quartiles", "component:s q1:d median:d q3:d",
       "SELECT component, quantile_cont(delta_sharpe, 0.25) AS q1, quantile_cont(delta_sharpe, 0.5) AS median, quantile_cont(delta_sharpe, 0.75) AS q3 FROM tests "
       "WHERE family = 'market_ablation' GROUP BY component", lambda df: reports.quartiles(df.where("family = 'market_ablation'")))
tested("r25_headline_rows", "strategy:s freeze:s component:s b_sharpe:d v_sharpe:d delta_sharpe:d ci_lo:d ci_hi:d q_bh:d", "SELECT * FROM gl", lambda df: reports.headline(gl(df)))

