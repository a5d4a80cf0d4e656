"""Queries on trades: extraction, walk-forward, decisions over a score, valuation, metrics.

Learned decisions are checked with a stand-in score, a logistic function of the return
z-score, in place of a model: gates, sizes, entries and exits are columns over any score. The
model-backed versions are registered without an oracle.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FOLD_KEYS, KEYS
from ..functions.distribution import expected_best
from ..functions.indicators import FEATURES, with_features
from ..operators import decisions, metrics, models, scan, signals, valuation
from ..operators.walkforward import Strategy, default_trades, walk_forward
from .bar_queries import FEATURE_SQL, SPLIT, W, chunks
from .bar_queries import FEATURES as FEATURE_SPEC
from .base import ADX, ATR, FOLDS, KEY, NUM, ONE, PART, back, bars, register, shared

# ---- strategies of the checks ----------------------------------------------------------

SMA_RULE = replace(signals.SMA_CROSS, grid={"fast": [3, 5], "slow": [10]}, defaults={"fast": 5, "slow": 10})
DON_RULE = replace(signals.DONCHIAN, grid={"lookback": [5, 10]}, defaults={"lookback": 10})
SMA = Strategy(SMA_RULE, "trailing", {"sl_mult": [1.5], "trail_mult": [2.0, 3.0]}, fee_bps=5.0, fill="close")
DON = Strategy(DON_RULE, "bracket", {"sl_mult": [1.0], "tp_mult": [1.5, 2.5]}, fee_bps=5.0, fill="close")
MIN_TRADES = 2


def stand_in(shift: float = 0.0, sign: float = 1.0):
    """Logistic of the return z-score, NULL where it is missing."""
    return 1.0 / (1.0 + F.exp(-(sign * F.col("ret_zscore") - shift)))


def gate(shift=0.0, threshold=0.5):
    return decisions.score_gate(stand_in(shift), threshold)


def hold(shift=0.0):
    return (stand_in(shift), stand_in(shift, -1.0))


def exit_by_score(s, shift=0.0, threshold=0.35):
    return s.with_(exit="learned", exit_grid={"sl_mult": [3.0]}, exit_args={"threshold": threshold}, hold=hold(shift))


# ---- the same state machine as a SQL recursion over the position ------------------------

def frame_sql(base: str = FOLDS) -> str:
    """Fold frame with the raw signals of both rules and the stand-in score."""
    def m(n):
        return f"CASE WHEN idx >= {n - 1} THEN avg(close) OVER {back(n - 1)} END"

    def channel(n):
        w = f"({PART} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return (f"CASE WHEN idx >= {n} THEN CAST(close > max(high) OVER {w} AS INT) - CAST(close < min(low) OVER {w} AS INT) "
                f"ELSE 0 END AS don{n}")

    def cross(a, b, name):
        return (f"CASE WHEN {a} > {b} AND lag({a}) OVER ({PART}) <= lag({b}) OVER ({PART}) THEN 1 "
                f"WHEN {a} < {b} AND lag({a}) OVER ({PART}) >= lag({b}) OVER ({PART}) THEN -1 ELSE 0 END AS {name}")

    return base + ATR + ADX + f"""
mv AS (SELECT *, {m(3)} AS m3, {m(5)} AS m5, {m(10)} AS m10, {channel(5)}, {channel(10)} FROM fd),
sg AS MATERIALIZED (SELECT *, {cross('m3', 'm10', 'sma3')}, {cross('m5', 'm10', 'sma5')} FROM mv),
"""


def p_sql(shift: float = 0.0, sign: int = 1) -> str:
    return f"(1 / (1 + exp(-({sign} * z - {shift}))))"


def run_sql(variant, combo, signal, sl, tp="NULL", trail="NULL", hold="NULL", at_stop=False, fee=5.0, gate=None, lag=0,
            up="NULL", down="NULL", size="1", strategy="sma", held="NULL") -> str:
    """Rows of one run: the gated, delayed signal per bar with the exit setting."""
    sig = signal if gate is None else f"CASE WHEN coalesce({gate}, false) THEN {signal} ELSE 0 END"
    if lag:
        sig = f"lag({sig}, {lag}, 0) OVER ({PART})"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return (f"SELECT market, symbol, fold, idx, last_idx, date, close, atr, '{strategy}' AS strategy, '{variant}' AS variant, "
            f"{combo} AS combo, {sig} AS sig, {d(sl)} AS sl, {d(tp)} AS tp, {d(trail)} AS trail, {d(hold)} AS hold, {at_stop} AS at_stop, "
            f"{d(fee)} AS fee, {d(up)} AS up, {d(down)} AS down, coalesce({d(size)}, 1.0) AS size, CAST({held} AS INT) AS held FROM sg")


def sma_runs(variant, **kw):
    return [run_sql(variant, 2 * i + j, s, 1.5, trail=t, **kw) for i, s in enumerate(("sma3", "sma5")) for j, t in enumerate((2.0, 3.0))]


def don_runs(variant, **kw):
    return [run_sql(variant, 2 * i + j, s, 1.0, tp=t, strategy="don", **kw) for i, s in enumerate(("don5", "don10")) for j, t in enumerate((1.5, 2.5))]


def learned_runs(variant, rule="sma", shift=0.0, hold=0.35, **kw):
    names = ("sma3", "sma5") if rule == "sma" else ("don5", "don10")
    return [run_sql(variant, i, s, 3.0, hold=hold, up=p_sql(shift), down=p_sql(shift, -1), strategy=rule, **kw) for i, s in enumerate(names)]


def scan_sql(runs: list[str]) -> str:
    on = ("f.market = s.market AND f.symbol = s.symbol AND f.fold = s.fold AND f.strategy = s.strategy "
          "AND f.variant = s.variant AND f.combo = s.combo")
    return "runs AS MATERIALIZED (\n" + "\nUNION ALL ".join(runs) + f"""),
scan AS (
  SELECT market, symbol, fold, strategy, variant, combo, idx, CAST(0 AS INT) AS d, idx AS ei, date AS et, close AS px, atr AS ea,
         close AS stop, close AS goal, size AS sz, CAST(NULL AS VARCHAR) AS reason, close AS xpx, date AS xt, idx AS xi,
         fee, last_idx
  FROM runs WHERE idx = 0
  UNION ALL
  SELECT market, symbol, fold, strategy, variant, combo, idx,
         CASE WHEN now <> 0 THEN CASE WHEN why IS NULL THEN now ELSE 0 END WHEN opens THEN sig ELSE 0 END,
         CASE WHEN opens THEN idx ELSE ei END, CASE WHEN opens THEN date ELSE et END, CASE WHEN opens THEN close ELSE px END,
         CASE WHEN opens THEN atr ELSE ea END,
         CASE WHEN opens THEN sig * close - sl * atr ELSE new_stop END,
         CASE WHEN opens THEN sig * close + tp * atr ELSE goal END,
         CASE WHEN opens THEN size ELSE sz END, why,
         CASE why WHEN 'stop' THEN CASE WHEN at_stop THEN now * new_stop ELSE close END WHEN 'target' THEN now * goal ELSE close END,
         date, idx, fee, last_idx
  FROM (
    SELECT *, CASE WHEN now = 0 THEN NULL WHEN now * close <= new_stop THEN 'stop' WHEN now * close >= goal THEN 'target'
                   WHEN CASE WHEN now = 1 THEN up ELSE down END < hold THEN 'ml_exit' WHEN idx - ei >= held THEN 'time' WHEN idx = last_idx THEN 'eod' END AS why,
           now = 0 AND sig <> 0 AND atr IS NOT NULL AND idx < last_idx AS opens
    FROM (
      SELECT f.market, f.symbol, f.fold, f.strategy, f.variant, f.combo, f.idx, f.date, f.close, f.atr, f.sig, f.sl, f.tp, f.hold, f.at_stop,
             f.up, f.down, f.size, f.held, f.fee, f.last_idx, s.d AS now, s.ei, s.et, s.px, s.ea, s.goal, s.sz,
             CASE WHEN f.trail IS NULL THEN s.stop ELSE greatest(s.stop, s.d * f.close - f.trail * coalesce(f.atr, s.ea)) END AS new_stop
      FROM scan s JOIN runs f ON {on} AND f.idx = s.idx + 1))),
done AS MATERIALIZED (
  SELECT market, symbol, fold, strategy, variant, combo, ei AS entry_i, xi AS exit_i, et AS entry_time, xt AS exit_time, px AS entry_price,
         xpx AS exit_price, reason, sz AS size, fee, last_idx, side AS direction,
         side * (xpx - px) / px AS gross0, side * (xpx - px) / px - fee / 1e4 AS ret0
  FROM (SELECT *, lag(d) OVER (PARTITION BY market, symbol, fold, strategy, variant, combo ORDER BY idx) AS side FROM scan)
  WHERE reason IS NOT NULL),
"""


WALK = f"""
score AS (
  SELECT strategy, variant, market, symbol, fold, combo, count(*) AS n,
         list_reduce(list(ret0 ORDER BY entry_i), lambda a, b: a + b) / count(*) AS mean
  FROM done GROUP BY ALL HAVING count(*) >= {MIN_TRADES}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, variant, market, symbol, fold ORDER BY mean DESC, combo) AS rk
                        FROM score) WHERE rk = 1),
walked AS MATERIALIZED (
  SELECT d.market, d.symbol, d.strategy, d.variant, b.fold, d.combo, b.mean AS is_mean_ret, entry_i, exit_i, entry_time, exit_time,
         direction, entry_price, exit_price, reason, size, gross0 * size AS gross, ret0 * size AS ret,
         d.fold * (last_idx + 1) + entry_i AS entry_pos, d.fold * (last_idx + 1) + exit_i AS exit_pos
  FROM done d JOIN best b ON b.market = d.market AND b.symbol = d.symbol AND b.strategy = d.strategy AND b.variant = d.variant
   AND b.fold = d.fold - 1 AND b.combo = d.combo),
"""

TRADE = f"{KEY} fold:i entry_i:i exit_i:i entry_time:t exit_time:t direction:i entry_price:d exit_price:d reason:s gross:d ret:d"
FOUND = "SELECT *, gross0 * size AS gross, ret0 * size AS ret FROM done"


# ---- X: trade extraction ----------------------------------------------------------------

def scanned(name, build, runs, spec=TRADE, base=FOLDS):
    register(name, spec, build, frame_sql(base) + scan_sql(runs), FOUND)


def frame(spark, d):
    df = with_features(chunks(spark, d), FOLD_KEYS)
    for n in (5, 10):
        df = signals.DONCHIAN.add(df, FOLD_KEYS, f"don{n}", lookback=n)
    return df




def don10():
    return F.col("don10")


scanned("x1_scan_close_fill", lambda s, d: scan.trades_of(frame(s, d), don10(), scan.ExitRule(1.0, at_stop=False), 7.0),
        [run_sql("v", 0, "don10", 1.0, fee=7.0)])
scanned("x2_bracket_exit", lambda s, d: scan.trades_of(frame(s, d), don10(), scan.bracket(1.5, 3.0)),
        [run_sql("v", 0, "don10", 1.5, tp=3.0, at_stop=True, fee=7.0)])
scanned("x3_trailing_exit", lambda s, d: scan.trades_of(frame(s, d), don10(), scan.trailing(1.5, 2.0)),
        [run_sql("v", 0, "don10", 1.5, trail=2.0, at_stop=True, fee=7.0)])
scanned("x4_learned_exit", lambda s, d: scan.extract(frame(s, d), [don10()], [scan.Run(0, 0, scan.learned(3.0, 0.35), 0)],
                                                     up=[stand_in()], down=[stand_in(0.0, -1.0)]),
        [run_sql("v", 0, "don10", 3.0, hold=0.35, up=p_sql(), down=p_sql(0.0, -1), at_stop=True, fee=7.0)])
scanned("x5_trade_returns_whole_history", lambda s, d: default_trades(bars(s, d), DON), [run_sql("v", 0, "don10", 1.5, tp=3.0)], base=ONE)
scanned("x6_sized_trades", lambda s, d: scan.extract(frame(s, d), [don10()], [scan.Run(0, 0, scan.bracket(), None, 0)],
                                                     size=[decisions.score_size(stand_in())]),
        [run_sql("v", 0, "don10", 1.5, tp=3.0, at_stop=True, fee=7.0, size=f"2 * {p_sql()}")], spec=f"{TRADE} size:d")


HELD = DON.with_(exit=lambda bars, fill: scan.holding_time(bars, 2.0, fill), exit_grid={"bars": [4, 8]})
scanned("x12_user_exit", lambda s, d: scan.trades_of(frame(s, d), don10(), scan.holding_time(5)), [run_sql("v", 0, "don10", "NULL", held=5, fee=7.0)])
scanned("x13_python_exit", lambda s, d: scan.trades_of(frame(s, d), don10(), scan.python_holding_time(5)), [run_sql("v", 0, "don10", "NULL", held=5, fee=7.0)])


def grid_trades(spark, d):
    runs = [scan.Run(2 * i + j, i, scan.bracket(1.0, t, "close")) for i in range(2) for j, t in enumerate((1.5, 2.5))]
    return scan.extract(frame(spark, d), [F.col("don5"), don10()], runs, 5.0)


scanned("x7_parameter_grid", grid_trades, don_runs("v"), spec=f"{TRADE} combo:i")
register("x8_equal_folds", f"{KEY} date:t fold:i idx:i last_idx:i", chunks, FOLDS, "SELECT * FROM fr")
WALKED = (f"variant:s {KEY} fold:i combo:i is_mean_ret:d entry_i:i exit_i:i entry_time:t exit_time:t direction:i entry_price:d "
          "exit_price:d reason:s size:d gross:d ret:d")


def walked(name, strategies, runs, spec=WALKED, final="SELECT * FROM walked", post=lambda df: df):
    register(name, spec, lambda s, d: post(walk_forward(bars(s, d), strategies(), 5, MIN_TRADES)), frame_sql() + scan_sql(runs) + WALK, final)


walked("x9_in_sample_selection", lambda: {"sma": SMA, "don": DON}, sma_runs("sma") + don_runs("don"),
       f"variant:s {KEY} fold:i combo:i is_mean_ret:d", "SELECT DISTINCT variant, market, symbol, fold, combo, is_mean_ret FROM walked",
       lambda df: df.select("variant", *KEYS, "fold", "combo", "is_mean_ret").distinct())
walked("x10_walk_forward", lambda: {"sma": SMA, "don": DON}, sma_runs("sma") + don_runs("don"))
walked("x12_user_exit_walk_forward", lambda: {"held": HELD, "don": DON},
       [run_sql("held", 2 * i + j, s, 2.0, held=h, strategy="don") for i, s in enumerate(("don5", "don10")) for j, h in enumerate((4, 8))]
       + don_runs("don"))
HELD_IN_PYTHON = HELD.with_(exit=lambda bars, fill: scan.python_holding_time(bars, 2.0, fill))
walked("x13_python_exit_walk_forward", lambda: {"held": HELD_IN_PYTHON, "don": DON},
       [run_sql("held", 2 * i + j, s, 2.0, held=h, strategy="don") for i, s in enumerate(("don5", "don10")) for j, h in enumerate((4, 8))]
       + don_runs("don"))
walked("x10_walk_forward_summary", lambda: {"control": SMA, "gated": SMA.with_(gate=signals.adx_gate())},
       sma_runs("control") + sma_runs("gated", gate="adx >= 25"), "variant:s market:s trades:i mean_ret:d",
       "SELECT variant, market, count(*) AS trades, avg(ret) AS mean_ret FROM walked GROUP BY ALL",
       lambda df: df.groupBy("variant", "market").agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("mean_ret")))
walked("x11_all_instruments_tagged", lambda: {"don": DON}, don_runs("don"), f"variant:s {KEY} trades:i",
       "SELECT variant, market, symbol, count(*) AS trades FROM walked GROUP BY ALL",
       lambda df: df.groupBy("variant", *KEYS).agg(F.count(F.lit(1)).alias("trades")))
LAGGED = {"control": DON, "lag": DON.with_(lag=1), "stop_fill": DON.with_(fill="stop")}
walked("g9_strategy_settings", lambda: LAGGED, don_runs("control") + don_runs("lag", lag=1) + don_runs("stop_fill", at_stop=True))

# ---- M: decisions over a score ----------------------------------------------------------

walked("m4_regime_gate_by_score", lambda: {"score": DON.with_(gate=gate())}, don_runs("score", gate=f"{p_sql()} >= 0.5"))
walked("m5_meta_gate_thresholds", lambda: {f"t{k}": DON.with_(gate=gate(0.2, t)) for k, t in (("45", 0.45), ("50", 0.5), ("55", 0.55))},
       [r for k, t in (("45", 0.45), ("50", 0.5), ("55", 0.55)) for r in don_runs(f"t{k}", gate=f"{p_sql(0.2)} >= {t}")])
walked("m6_position_sizing_by_score", lambda: {"sized": SMA.with_(sizer=decisions.score_size(stand_in(0.2)))},
       sma_runs("sized", size=f"2 * {p_sql(0.2)}"))
walked("m7_entry_by_score", lambda: {"entry": DON.with_(signal=decisions.score_rule(stand_in(0.3), stand_in(0.3, -1.0), 0.6))},
       [run_sql("entry", j, f"CASE WHEN coalesce({p_sql(0.3)}, -1) >= 0.6 AND coalesce({p_sql(0.3)}, -1) > coalesce({p_sql(0.3, -1)}, -1) THEN 1 "
                f"WHEN coalesce({p_sql(0.3, -1)}, -1) >= 0.6 AND coalesce({p_sql(0.3, -1)}, -1) > coalesce({p_sql(0.3)}, -1) THEN -1 ELSE 0 END",
                1.0, tp=t, strategy="don") for j, t in enumerate((1.5, 2.5))])
walked("m8_exit_by_score", lambda: {"exit": exit_by_score(DON)}, learned_runs("exit", "don"))
walked("m9_rule_gate", lambda: {"rule": DON.with_(gate=signals.adx_gate())}, don_runs("rule", gate="adx >= 25"))
walked("m10_combined_decisions", lambda: {"all": exit_by_score(SMA.with_(gate=gate(), sizer=decisions.score_size(stand_in(0.2))))},
       learned_runs("all", gate=f"{p_sql()} >= 0.5", size=f"2 * {p_sql(0.2)}"))


def meta_training(spark, d):
    return decisions.trade_labels(models.TrainingData(bars(spark, d)), SPLIT, DON)


register("l6_meta_label_training_set", f"{FEATURE_SPEC} label:i", meta_training,
         ONE + FEATURE_SQL + f"""
sg AS MATERIALIZED (SELECT f.*, CASE WHEN idx >= 10 THEN
  CAST(close > max(high) OVER (PARTITION BY f.market, f.symbol, f.fold ORDER BY f.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS INT)
  - CAST(close < min(low) OVER (PARTITION BY f.market, f.symbol, f.fold ORDER BY f.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS INT)
  ELSE 0 END AS don10 FROM feat f),
""" + scan_sql([run_sql("v", 0, "don10", 1.5, tp=3.0)]),
         f"SELECT f.*, CAST(d.ret0 > 0 AS INT) AS label FROM done d JOIN feat f ON f.market = d.market AND f.symbol = d.symbol "
         f"AND f.idx = d.entry_i WHERE d.exit_time < DATE '{SPLIT}' AND " + " AND ".join(f"f.{c} IS NOT NULL" for c in FEATURES))

# Model-backed variants at the full budget; the registry of a session fits each model once.

def registry(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _registries:
        whole = models.TrainingData(bars(spark, d))
        others = {f"all but {m}": whole.where(F.col("market") != m) for m in MARKETS}
        _registries[key] = decisions.ModelRegistry({"all": whole, **others}, workers=4)
    return _registries[key]


_registries: dict = {}
MARKETS = ("M0", "M1", "M2")
MOVE = decisions.regime_filter("move_size")


def scored(spark, d):
    r = registry(spark, d)
    out, scorer = r.scorer(MOVE.fits("all", SPLIT, DON)[0])
    return scorer(r.pools["all"].frame).withColumnRenamed(out, "p")


def learned_trades(decision, strategy=DON):
    return lambda spark, d: walk_forward(bars(spark, d), {"learned": decision.learned(strategy, registry(spark, d), "all", SPLIT, strategy)}, 5, MIN_TRADES)


register("m2_fit_classifier", f"{KEY} date:t p:d", scored)
register("m3_score_missing_stays_missing", "scored:i missing:i",
         lambda s, d: scored(s, d).agg(F.count("p").alias("scored"), F.count_if(F.col("p").isNull()).alias("missing")),
         ONE + FEATURE_SQL, f"SELECT count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}) AS scored, "
                            f"count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in FEATURES)}) AS missing FROM feat")
register("m4_regime_filter_model", WALKED, learned_trades(decisions.regime_filter("linearity")))
register("m5_meta_label_model", WALKED, learned_trades(decisions.meta_label()))
register("m6_position_sizing_model", WALKED, learned_trades(decisions.position_sizing()))
register("m7_entry_model", WALKED, learned_trades(decisions.learned_entry()))
register("m8_exit_model", WALKED, learned_trades(decisions.learned_exit()))
register("m10_combination_model", WALKED, learned_trades(decisions.combined("combined", decisions.meta_label(), decisions.position_sizing())))


def transferred(spark, d):
    """Each market traded with the model of all others."""
    r, meta = registry(spark, d), decisions.meta_label()
    r.fit(f for m in MARKETS for f in meta.fits(f"all but {m}", SPLIT, DON))
    parts = [walk_forward(bars(spark, d).where(F.col("market") == m), {"meta_label@transfer": meta.learned(DON, r, f"all but {m}", SPLIT, DON)}, 5, MIN_TRADES)
             for m in MARKETS]
    return reduce(DataFrame.unionByName, parts)


register("m13_transfer_model", WALKED, transferred)

# ---- A: valuation and metrics -----------------------------------------------------------

PAIR_SQL = frame_sql() + scan_sql(don_runs("control") + learned_runs("scored", "don")) + WALK


def pair_trades(spark, d):
    return shared(spark, d, "pair", lambda: walk_forward(
        bars(spark, d), {"control": DON, "scored": exit_by_score(DON)}, 5, MIN_TRADES))


def daily(spark, d):
    return valuation.daily_values(pair_trades(spark, d), bars(spark, d), 5.0)


def sums(spark, d):
    return valuation.portfolio_totals(pair_trades(spark, d), bars(spark, d), 5.0)


# Day by day as the definition reads: an interval join of bars with trades.
DAILY_SQL = """
nb AS MATERIALIZED (SELECT *, lag(close) OVER (PARTITION BY market, symbol ORDER BY date) AS prev FROM num),
held AS (
  SELECT w.strategy, w.variant, {extra} b.market, b.symbol, b.date, b.pos,
         sum(CASE WHEN b.pos > entry_pos THEN direction * size * (CASE WHEN b.pos = exit_pos THEN exit_price ELSE b.close END / b.prev - 1)
             ELSE 0 END) AS gross,
         sum(CASE WHEN b.pos IN (entry_pos, exit_pos) THEN {cost} / 2e4 * abs(direction * size) ELSE 0 END) AS cost,
         sum(CASE WHEN b.pos > entry_pos THEN direction * size ELSE 0 END) AS position
  FROM {trades} w JOIN nb b ON b.market = w.market AND b.symbol = w.symbol AND b.pos BETWEEN entry_pos AND exit_pos
  WHERE exit_pos > entry_pos GROUP BY ALL),
day0 AS (
  SELECT t.strategy, t.variant, {extra_t} b.market, b.symbol, b.date, b.pos, coalesce(h.gross, 0) AS gross, coalesce(h.cost, 0) AS cost,
         coalesce(h.position, 0) AS position
  FROM nb b JOIN (SELECT DISTINCT strategy, variant, {extra} market, symbol FROM {trades}) t ON t.market = b.market AND t.symbol = b.symbol
  LEFT JOIN held h ON h.market = b.market AND h.symbol = b.symbol AND h.pos = b.pos AND h.variant = t.variant AND h.strategy = t.strategy {extra_on}),
day AS MATERIALIZED (
  SELECT *, gross - cost AS ret, abs(position - coalesce(lag(position) OVER (PARTITION BY strategy, variant, {extra} market, symbol ORDER BY pos), 0)) AS turnover
  FROM day0),
"""


def daily_sql(trades="walked", cost="5", freeze=False):
    e = 'fz,' if freeze else ''
    return DAILY_SQL.format(trades=trades, cost=cost, extra=e, extra_t='t.fz,' if freeze else '', extra_on='AND h.fz = t.fz' if freeze else '')


PF_SQL = PAIR_SQL + daily_sql() + """
sums AS MATERIALIZED (SELECT variant, market, date, sum(gross) AS gross, sum(cost) AS cost, sum(ret) AS ret, sum(turnover) AS turnover,
                 sum(abs(position)) AS exposure, count(*) AS n FROM day GROUP BY variant, market, date),
pf AS MATERIALIZED (SELECT variant, market, date, ret / n AS ret, turnover / n AS turnover, exposure / n AS exposure, n FROM sums),
"""
register("a1_daily_mark_to_market", f"variant:s {KEY} date:t gross:d cost:d ret:d position:d turnover:d", daily, PAIR_SQL + daily_sql(), "SELECT * FROM day")
register("a2_equal_weight_portfolio", "variant:s market:s date:t ret:d turnover:d exposure:d n:i",
         lambda s, d: valuation.equal_weight(sums(s, d)), PF_SQL, "SELECT * FROM pf")
register("a2_portfolio_all_listed", "variant:s market:s date:t ret:d n:i",
         lambda s, d: valuation.equal_weight(valuation.listed_sums(pair_trades(s, d), bars(s, d), 5.0)), PF_SQL + """
every AS (SELECT market, date, count(*) AS n FROM bars GROUP BY market, date)""",
         "SELECT v.variant, e.market, e.date, coalesce(s.ret, 0) / e.n AS ret, e.n FROM every e JOIN (SELECT DISTINCT variant, market FROM sums) v "
         "ON v.market = e.market LEFT JOIN sums s ON s.variant = v.variant AND s.market = e.market AND s.date = e.date")
register("a3_global_roll_up", "variant:s date:t ret:d turnover:d exposure:d n:i",
         lambda s, d: valuation.equal_weight(valuation.roll_up(sums(s, d), ["variant"])), PF_SQL,
         "SELECT variant, date, sum(ret) / sum(n) AS ret, sum(turnover) / sum(n) AS turnover, sum(exposure) / sum(n) AS exposure, sum(n) AS n "
         "FROM sums GROUP BY variant, date")


def without_market(spark, d):
    parts = sums(spark, d)
    totals = valuation.roll_up(parts, ["variant"])
    left = valuation.without_part(totals, parts.where(F.col("market") == "M0").drop("market"), ["variant", "date"])
    return valuation.equal_weight(left)


register("a4_leave_one_out_portfolio", "variant:s date:t ret:d n:i", without_market, PF_SQL, """
SELECT variant, date, coalesce(sum(ret) FILTER (market <> 'M0'), 0) / greatest(coalesce(sum(n) FILTER (market <> 'M0'), 0), 1) AS ret,
       coalesce(sum(n) FILTER (market <> 'M0'), 0) AS n FROM sums GROUP BY variant, date""")
RD_SQL = PAIR_SQL + "rd AS MATERIALIZED (SELECT variant, exit_time AS date, avg(ret) AS ret FROM walked GROUP BY ALL),\n"
register("a5_realized_daily_returns", "variant:s date:t ret:d", lambda s, d: valuation.realized_daily(pair_trades(s, d)), RD_SQL, "SELECT * FROM rd")
register("a6_realized_sharpe", "variant:s sharpe:d", lambda s, d: valuation.realized_daily(pair_trades(s, d)).groupBy("variant").agg(
    metrics.realized_sharpe(F.col("ret")).alias("sharpe")), RD_SQL,
    "SELECT variant, sqrt(252) * (avg(ret) - 0.06 / 252) / stddev_pop(ret) AS sharpe FROM rd GROUP BY variant")
SUMMARY_SQL = RD_SQL + """
req AS (SELECT *, product(1 + ret) OVER (PARTITION BY variant ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM rd),
rdd AS (SELECT *, eq / max(eq) OVER (PARTITION BY variant ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM req),
su AS (SELECT variant, sqrt(252) * (avg(ret) - 0.06 / 252) / stddev_pop(ret) AS sharpe, product(1 + ret) - 1 AS total_return, min(dd) AS max_drawdown
       FROM rdd GROUP BY variant)
"""
register("a7_trade_summary", "variant:s n_trades:i sharpe:d mean_trade_bps:d total_return:d max_drawdown:d",
         lambda s, d: metrics.realized_summary(pair_trades(s, d), ["variant"]), SUMMARY_SQL,
         "SELECT su.*, t.n_trades, t.bps AS mean_trade_bps FROM su JOIN (SELECT variant, count(*) AS n_trades, avg(ret) * 1e4 AS bps FROM walked GROUP BY variant) t USING (variant)")
register("a8_mtm_sharpe", "variant:s market:s sharpe:d", lambda s, d: valuation.equal_weight(sums(s, d)).groupBy("variant", "market").agg(
    metrics.mtm_sharpe(F.col("ret")).alias("sharpe")), PF_SQL,
    "SELECT variant, market, sqrt(252) * avg(ret) / stddev_samp(ret) AS sharpe FROM pf GROUP BY ALL")

METRICS = ("days:d ann_return:d ann_vol:d sharpe:d sortino:d max_drawdown:d calmar:d var95:d cvar95:d skew:d excess_kurtosis:d turnover:d exposure:d "
           "deflated_sharpe:d")
PHI = """(0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120),
   lambda k: ({z}) * power(({z}) * ({z}), k) / exp(lgamma(k + 1.5) + (k + 1) * ln(2) - 0.5 * ln(pi())))))"""


def metrics_sql(src: str, keys: str, best: float, out: str, ret="ret", turnover="turnover", exposure="exposure") -> str:
    """All portfolio metrics of ``src`` per ``keys``; CTEs named after ``out``."""
    return f"""
{out}_e AS (SELECT {keys}, date, {ret} AS r, {turnover} AS tu, {exposure} AS ex,
  product(1 + {ret}) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM {src}),
{out}_d AS MATERIALIZED (SELECT *, eq / max(eq) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd,
  quantile_cont(r, 0.05) OVER (PARTITION BY {keys}) AS q05, avg(r) OVER (PARTITION BY {keys}) AS mu FROM {out}_e),
{out}_a AS (SELECT {keys}, count(*) AS days, avg(r) AS mean, stddev_samp(r) AS sd, product(1 + r) AS fin, min(dd) AS max_drawdown,
  stddev_samp(r) FILTER (r < 0) AS sdd, any_value(q05) AS q05, -avg(r) FILTER (r <= q05) AS cvar95,
  sum(power(r - mu, 3)) / count(*) / power(sum(power(r - mu, 2)) / count(*), 1.5) AS skew,
  sum(power(r - mu, 4)) / count(*) / power(sum(power(r - mu, 2)) / count(*), 2) - 3 AS excess_kurtosis,
  avg(tu) * 252 AS turnover, avg(ex) AS exposure FROM {out}_d GROUP BY {keys} HAVING count(*) >= 2 AND max(abs(r)) > 0),
{out}_b AS (SELECT *, mean / sd AS sr, sqrt(greatest((1 - skew * mean / sd + (excess_kurtosis + 2) / 4 * mean / sd * mean / sd) / (days - 1), 1e-12)) AS sp FROM {out}_a),
{out} AS MATERIALIZED (SELECT {keys}, days, power(fin, 252 / days) - 1 AS ann_return, sd * sqrt(252) AS ann_vol, sqrt(252) * mean / sd AS sharpe,
  sqrt(252) * mean / sdd AS sortino, max_drawdown, CASE WHEN max_drawdown < 0 THEN (power(fin, 252 / days) - 1) / abs(max_drawdown) ELSE 0 END AS calmar,
  -q05 AS var95, cvar95, skew, excess_kurtosis, turnover, exposure,
  {PHI.format(z=f'(sr - sp * {best!r}) / sp')} AS deflated_sharpe FROM {out}_b),
"""


register("a9_portfolio_metrics", f"variant:s market:s {METRICS}",
         lambda s, d: metrics.portfolio_metrics(valuation.equal_weight(sums(s, d)), ["variant", "market"], 7), PF_SQL + metrics_sql(
             "pf", "variant, market", expected_best(7), "mt"), "SELECT * FROM mt")
register("a10_trade_metrics", "variant:s market:s n_trades:i win_rate:d avg_hold_days:d mean_trade_bps:d profit_factor:d",
         lambda s, d: metrics.trade_metrics(pair_trades(s, d), ["variant", "market"]), PAIR_SQL, """
SELECT variant, market, count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate,
       avg(date_diff('day', entry_time, exit_time)) AS avg_hold_days, avg(ret) * 1e4 AS mean_trade_bps,
       sum(greatest(ret, 0)) / -sum(least(ret, 0)) AS profit_factor FROM walked GROUP BY ALL""")
register("a11_deflated_sharpe", "variant:s deflated_sharpe:d", lambda s, d: metrics.with_deflated_sharpe(
    metrics.realized_summary(pair_trades(s, d), ["variant"]), 3), RD_SQL + metrics_sql(
        "rd", "variant", expected_best(3), "mt", "ret", "0", "0"), "SELECT variant, deflated_sharpe FROM mt")
register("a12_trials_per_component_type", "variant:s trials:i trades:i", lambda s, d: _trials(s, d), PAIR_SQL,
         "SELECT variant, CASE variant WHEN 'scored' THEN 2 ELSE 1 END AS trials, count(*) AS trades FROM walked GROUP BY variant")


def _trials(spark, d):
    a, b = decisions.learned_exit().named("scored"), decisions.learned_exit().named("other")
    n = {"control": 1, **decisions.trials_per_family([a, b])}
    trials = F.lit(None).cast("int")
    for k, v in n.items():
        trials = F.when(F.col("variant") == k, v).otherwise(trials)
    return pair_trades(spark, d).groupBy("variant").agg(F.count(F.lit(1)).alias("trades")).withColumn("trials", trials)


IDX_SQL = NUM + f"""
ir AS (SELECT market, symbol, date, close / lag(close) OVER {W} - 1 AS r FROM num),
ix AS MATERIALIZED (SELECT market, date, coalesce(avg(r), 0) AS ret FROM ir GROUP BY market, date),
"""
register("a13_buy_and_hold_index", "market:s date:t ret:d", lambda s, d: valuation.market_index(bars(s, d)), IDX_SQL, "SELECT * FROM ix")
register("a15_selection_decay", "strategy:s market:s is_mean_trade_bps:d oos_mean_trade_bps:d n_trades:i",
         lambda s, d: metrics.selection_decay(pair_trades(s, d).withColumn("strategy", F.col("variant"))), PAIR_SQL,
         "SELECT variant AS strategy, market, avg(is_mean_ret) * 1e4 AS is_mean_trade_bps, avg(ret) * 1e4 AS oos_mean_trade_bps, count(*) AS n_trades FROM walked GROUP BY ALL")
register("a15_weighted_decay", "strategy:s is_mean_trade_bps:d oos_mean_trade_bps:d n_trades:i",
         lambda s, d: metrics.weighted_decay(metrics.selection_decay(pair_trades(s, d).withColumn("strategy", F.col("variant")))), PAIR_SQL,
         "SELECT variant AS strategy, avg(is_mean_ret) * 1e4 AS is_mean_trade_bps, avg(ret) * 1e4 AS oos_mean_trade_bps, count(*) AS n_trades FROM walked GROUP BY ALL")
