"""Hand-computed trades, accounting and invariants."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaplens.functions.columns import FOLD_KEYS, KEYS
from swaplens.functions.indicators import with_atr
from swaplens.operators import scan, valuation
from swaplens.operators.folds import as_one_fold, chunk
from swaplens.operators.signals import column_rule
from swaplens.operators.walkforward import Strategy, default_trades, never_traded, walk_forward

FLAT = [100.0] * 15


def hand(spark, closes, signals):
    """Bars half a point around the close; signals as {row: side}."""
    c = FLAT + [float(x) for x in closes]
    pdf = pd.DataFrame({"market": "m", "symbol": "s", "date": pd.bdate_range("2020-01-01", periods=len(c)).date,
                        "open": c, "high": [x + 0.5 for x in c], "low": [x - 0.5 for x in c], "close": c,
                        "sig": [signals.get(i, 0) for i in range(len(c))]})
    return spark.createDataFrame(pdf)


def trades(spark, closes, signals, rule, fee=0.0):
    df = with_atr(as_one_fold(hand(spark, closes, signals)), FOLD_KEYS)
    return scan.trades_of(df, F.col("sig"), rule, fee).orderBy("entry_i").toPandas()


def test_target_then_reentry(spark):
    t = trades(spark, [100, 101, 102, 104, 100, 99, 97, 94], {15: 1, 17: -1, 19: -1}, scan.bracket(1.5, 3.0))
    assert t.entry_i.tolist() == [15, 19] and t.exit_i[0] == 18
    assert t.reason[0] == "target" and t.ret[0] == pytest.approx(0.03)


def test_trailing_stop_ratchets(spark):
    t = trades(spark, [100, 102, 104, 106, 108, 104, 100], {15: 1}, scan.trailing(1.5, 2.0))
    assert t.reason[0] == "stop" and t.ret[0] > 0


def test_gap_through_stop_fills(spark):
    path = ([100, 101, 95, 96], {15: 1})
    assert trades(spark, *path, scan.bracket(fill="stop")).ret[0] == pytest.approx(-0.015)
    assert trades(spark, *path, scan.bracket(fill="close")).ret[0] == pytest.approx(-0.05)
    assert trades(spark, *path, scan.trailing(fill="close")).exit_price[0] == 95


def test_mark_to_market_compounds_to_the_trade(spark):
    df = hand(spark, [100, 102, 101, 104, 99, 98], {15: 1})
    t = scan.trades_of(with_atr(as_one_fold(df), FOLD_KEYS), F.col("sig"), scan.bracket(1.5, 10.0, "close"), 0.0)
    t = t.withColumn("variant", F.lit("v"))
    free = valuation.daily_values(t, df, 0.0).orderBy("date").toPandas()
    paid = valuation.daily_values(t, df, 10.0).toPandas()
    assert (1 + free.ret).prod() - 1 == pytest.approx(t.first()["gross"])
    assert free.ret.sum() - paid.ret.sum() == pytest.approx(10 / 1e4)
    assert free.position.max() == 1 and free.position[15] == 0


def plain_scan(close, atr, sig, sl, tp):
    """Sequential statement of the bracket rule, filled at the close."""
    out, i, n = [], 0, len(close)
    while i < n - 1:
        if sig[i] == 0 or pd.isna(atr[i]):
            i += 1
            continue
        d, stop, goal = sig[i], close[i] - sig[i] * sl * atr[i], close[i] + sig[i] * tp * atr[i]
        for j in range(i + 1, n):
            if d * close[j] <= d * stop or d * close[j] >= d * goal or j == n - 1:
                out.append((i, j))
                break
        i = j + 1
    return out


def test_scan_matches_a_sequential_loop(bars):
    df = with_atr(as_one_fold(bars), FOLD_KEYS).withColumn("sig", F.signum(F.hash("date", "symbol") % 3).cast("int"))
    got = scan.trades_of(df, F.col("sig"), scan.bracket(1.0, 2.0, "close")).toPandas()
    assert (got.entry_i < got.exit_i).all()
    for symbol, p in df.orderBy("date").toPandas().groupby("symbol"):
        mine = sorted(zip(got[got.symbol == symbol].entry_i, got[got.symbol == symbol].exit_i))
        assert mine == plain_scan(p.close.tolist(), p.atr.tolist(), p.sig.tolist(), 1.0, 2.0)


def rule(grid):
    return column_rule("calendar", lambda keys, every: F.when(F.col("idx") % every == 0, 1).otherwise(0), {"every": 3}, grid)


def test_walk_forward_selects_first_of_equal_combinations(bars):
    s = Strategy(rule({"every": [4, 4, 5]}), "bracket", {"sl_mult": [1.0], "tp_mult": [1.0]}, fill="close")
    t = walk_forward(bars, {"v": s}, 5, 2).toPandas()
    assert len(t) and not (t.combo == 1).any()  # combination 1 repeats combination 0
    assert (t.exit_pos > t.entry_pos).all() and set(t.fold) <= {0, 1, 2, 3}


def test_too_few_trades_is_reported(bars):
    t = walk_forward(bars, {"control": Strategy(rule({"every": [10 ** 6]}))}, 5, 10)
    with pytest.warns(UserWarning, match="no out-of-sample trades"):
        assert never_traded(t, "control")


def test_folds_are_equal_and_drop_the_remainder(bars):
    n = bars.groupBy(*KEYS).count().toPandas().set_index("symbol")["count"]
    f = chunk(bars).groupBy("symbol", "fold").count().toPandas()
    for symbol, g in f.groupby("symbol"):
        assert g["count"].tolist() == [n[symbol] // 5] * 5


def test_sizing_never_changes_the_trade_set(bars):
    s = Strategy(rule({"every": [3, 5]}), "bracket", {"sl_mult": [1.0], "tp_mult": [1.0, 2.0]})
    t = walk_forward(bars, {"plain": s, "sized": s.with_(sizer=F.lit(0.5))}, 5, 2).toPandas()
    a, b = (t[t.variant == v].sort_values(["symbol", "entry_pos"]).reset_index(drop=True) for v in ("plain", "sized"))
    assert a.entry_pos.tolist() == b.entry_pos.tolist() and (b.ret - 0.5 * a.ret).abs().max() < 1e-12


def test_default_run_uses_default_parameters(bars):
    s = Strategy(rule({"every": [7]}), "bracket", fill="close")
    assert (default_trades(bars, s).select(F.max(F.col("entry_i") % 3)).first()[0]) == 0


def test_an_exit_with_a_state_of_its_own(spark):
    """Leave when the close falls a tenth below the best close since the entry: the state is that best close."""
    from swaplens.operators import scan

    close = [10, 11, 12, 11.5, 10.7, 10, 10, 12, 13, 14, 13]
    rows = [(0, i, len(close) - 1, f"2020-01-{i + 1:02d}", float(c), 1.0, 1 if i in (0, 6) else 0) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "k int, idx int, last_idx int, d string, close double, atr double, sig int").withColumn("date", F.to_date("d"))
    rule = scan.ExitRule(None, user=scan.UserExit("fall", "v.close < 0.9D * v.state", "v.close", "greatest(v.state, v.close)"))
    got = scan.trades_of(df, F.col("sig"), rule, keys=["k"]).orderBy("entry_i").collect()
    assert [(r.entry_i, r.exit_i, r.exit_price, r.reason) for r in got] == [(0, 4, 10.7, "fall"), (6, 10, 13.0, "eod")]


def packed_runs(df, signals, rule_list):
    """The trades of both scans over the same packed folds: SQL in the JVM, and all states in one pass."""
    from swaplens.operators import states

    runs = [scan.Run(10 * i + j, i, r) for i in range(len(signals)) for j, r in enumerate(rule_list)]
    packed = scan.pack(df, signals, up=[F.col("p")], down=[1 - F.col("p")], size=[F.col("p") * 2]).persist()
    runs = [scan.Run(r.combo, r.signal, r.exit, 0 if r.exit.hold else None, 0 if k % 2 else None) for k, r in enumerate(runs)]
    jvm = packed.withColumn("r", F.explode(scan.run_column(scan.runs_sql(runs)))).select(*FOLD_KEYS, "r.combo", F.explode("r.trades").alias("t")).select(*FOLD_KEYS, "combo", "t.*")
    keys = "market string, symbol string, fold int"
    one = packed.select(*FOLD_KEYS, "bars").mapInArrow(states.every_trade(runs, FOLD_KEYS), f"{keys}, combo int, {states.TRADE}")
    return jvm, one


def test_one_pass_over_all_states_equals_the_scan_of_each(bars):
    df = with_atr(chunk(bars, 3), FOLD_KEYS)
    df = df.withColumns({"a": F.signum(F.hash("date", "symbol") % 3).cast("int"), "b": F.signum(F.hash("symbol", "date", "close") % 5).cast("int"), "p": F.when(F.hash("date") % 7 != 0, F.abs(F.hash("date", "close") % 100) / 100.0)})
    rules = [scan.bracket(1.0, 2.0), scan.bracket(0.5, 1.0, "close"), scan.trailing(1.5, 1.0), scan.trailing(1.0, 0.5, "close"), scan.learned(3.0, 0.4), scan.ExitRule(None, trail=1.0), scan.ExitRule(None, tp=0.7)]
    jvm, one = packed_runs(df, [F.col("a"), F.col("b")], rules)
    cols = jvm.columns
    got, want = (sorted(map(tuple, x.select(*cols).collect())) for x in (one, jvm))
    assert len(want) > 1000 and got == want


def test_an_exit_in_python_equals_the_one_in_sql(bars):
    """A state that is updated: leave when the close falls three percent below the best close since the entry."""
    import numpy as np

    df = with_atr(chunk(bars, 3), FOLD_KEYS).withColumn("sig", F.signum(F.hash("date", "symbol") % 3).cast("int"))
    sql = scan.ExitRule(2.0, user=scan.UserExit("fall", "v.side * v.close < v.state - 0.03D * v.entry", "v.side * v.close", "greatest(v.state, v.side * v.close)"))
    own = scan.PythonExit("fall", lambda v: v.side * v.close < v.state - 0.03 * v.entry, lambda v: v.side * v.close, lambda v: np.maximum(v.state, v.side * v.close))
    jvm, python = (sorted(map(tuple, scan.trades_of(df, F.col("sig"), r).collect())) for r in (sql, scan.ExitRule(2.0, user=own)))
    assert len(jvm) > 100 and python == jvm and {t[10] for t in jvm} >= {"fall", "stop"}


def test_an_exit_in_python_cannot_look_ahead(bars):
    """Trades that close before a day are the same whatever comes after it."""
    import numpy as np

    own = scan.PythonExit("two", lambda v: (v.state[:, 0] > 1) & (v.close > v.state[:, 1]), lambda v: np.stack([v.held * 0.0, v.close], 1), lambda v: np.stack([v.state[:, 0] + 1, v.close], 1))
    df = with_atr(as_one_fold(bars), FOLD_KEYS).withColumn("sig", F.signum(F.hash("date", "symbol") % 3).cast("int"))
    cut = 200
    later = df.withColumn("close", F.when(F.col("idx") > cut, F.col("close") * (1 + F.abs(F.hash("date") % 50) / 100.0)).otherwise(F.col("close")))
    before, after = (sorted(map(tuple, scan.trades_of(x, F.col("sig"), scan.ExitRule(3.0, user=own)).where(F.col("exit_i") <= cut).collect())) for x in (df, later))
    assert before and before == after


def test_exits_in_sql_and_in_python_do_not_mix(bars):
    df = with_atr(as_one_fold(bars), FOLD_KEYS).withColumn("sig", F.lit(0))
    with pytest.raises(ValueError, match="runs of their own"):
        scan.extract(df, [F.col("sig")], [scan.Run(0, 0, scan.holding_time(3)), scan.Run(1, 0, scan.python_holding_time(3))])


def test_the_sweep_over_events_equals_a_walk_over_days():
    """Overlapping, equal and reversed trades of several series, and a zero price."""
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        n, rows = r.randint(2, 30), r.randint(1, 3)
        close = np.array([r.choice([0.0, 1.0, 2.0, 4.0, 5.0]) if r.random() < 0.1 else r.uniform(1, 9) for _ in range(n)])
        t = [(r.randrange(n), r.randrange(n), r.randrange(rows), r.uniform(-2, 2), r.uniform(1, 9), r.random()) for _ in range(r.randint(0, 9))]
        got = valuation.sweep(*(np.array(c, k) for c, k in zip(zip(*t) if t else [[]] * 6, (np.int64, np.int64, np.int64, float, float, float))), close, rows)
        want = np.zeros((3, rows, n))
        for v in range(rows):
            mine = sorted((x for x in t if x[2] == v and x[1] > x[0]), key=lambda x: (x[0], x[1]))
            for d in range(n):
                prev = close[d - 1] if d and close[d - 1] != 0 else None
                want[0, v, d] = sum(x[3] for x in mine if x[0] < d < x[1]) * (close[d] / prev - 1 if prev else 0)
                want[0, v, d] += sum(x[3] * x[4] for x in mine if x[1] == d) / prev - sum(x[3] for x in mine if x[1] == d) if prev else 0
                want[1, v, d] = sum(x[5] * abs(x[3]) for x in mine if d in (x[0], x[1]))
                want[2, v, d] = ([x[3] for x in mine if x[0] < d <= x[1]] or [0])[-1]
        assert np.allclose(got, want, atol=1e-12)


def test_listed_instruments_count_without_a_trade(spark, bars):
    df = with_atr(chunk(bars, 2), FOLD_KEYS).withColumn("sig", F.when(F.col("symbol") == bars.agg(F.min("symbol")).first()[0], F.signum(F.hash("date") % 3)).otherwise(0).cast("int"))
    t = scan.trades_of(df.where("fold = 0"), F.col("sig"), scan.bracket()).withColumn("variant", F.lit("v"))
    sums = valuation.listed_sums(t, bars, 5.0).toPandas()
    want = bars.join(t.select("market").distinct(), "market").groupBy("market", "date").count().toPandas()
    assert len(sums) == len(want) and sums.n.sum() == want["count"].sum() and sums.exposure.max() == 1.0
