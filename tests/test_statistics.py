"""Bootstrap size and power, adjusted p-values, decision rule, cleaning counts, files."""
import gzip
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaplens.operators import cleaning, inference, metrics
from swaplens.plans import reports
from swaplens.sources import files


def series(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"k": "a", "date": pd.bdate_range("2010-01-01", periods=n).date, **cols}))


def test_block_sums_equal_naive_resampling():
    rng = np.random.default_rng(0)
    for n in (500, 517):
        a, b = rng.normal(0, 0.01, n), rng.normal(0, 0.01, n)
        k = -(-n // 20)
        starts = inference.draws.draw_np(np.arange(50)[:, None], np.arange(k)[None, :], 1, n)
        idx = ((starts[:, :, None] + np.arange(20)) % n).reshape(50, -1)[:, :n]
        want = [(x[idx].mean(1) / x[idx].std(1, ddof=1)) * np.sqrt(252) for x in (a, b)]
        np.testing.assert_allclose(inference.block_differences(a, b, 20, 50, 1), want[0] - want[1], rtol=1e-8)


def test_block_bootstrap_size_and_power(spark):
    rng = np.random.default_rng(0)
    rows = [pd.DataFrame({"k": str(i), "date": pd.bdate_range("2010-01-01", periods=1500).date,
                          "v_ret": rng.normal(2e-4, 0.01, 1500), "b_ret": rng.normal(2e-4, 0.01, 1500)}) for i in range(60)]
    null = inference.block_bootstrap(spark.createDataFrame(pd.concat(rows)), ["k"], reps=400).toPandas()
    assert (null.p_value < 0.05).sum() <= 9
    base = rng.normal(2e-4, 0.01, 1500)
    r = inference.block_bootstrap(series(spark, v_ret=base + 0.002, b_ret=base), ["k"]).first()
    assert r["p_value"] < 0.01 and r["ci_lo"] > 0
    short = inference.block_bootstrap(series(spark, v_ret=base[:30], b_ret=base[:30]), ["k"]).first()
    assert short["ci_lo"] is None and short["delta_sharpe"] == 0


def test_day_bootstrap_of_identical_series(spark):
    r = series(spark, ret=np.random.default_rng(0).normal(0.001, 0.01, 400))
    free = inference.day_bootstrap(r, r, ["k"]).first()
    same = inference.day_bootstrap(r, r, ["k"], paired=True).first()
    assert free["ci_lo"] < 0 < free["ci_hi"] and (same["ci_lo"], same["ci_hi"]) == (0, 0)


def test_adjusted_p_values(spark):
    p = [0.001, 0.01, 0.03, 0.04, 0.5, None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i int, p_value double")
    got = inference.with_adjusted(df).orderBy("i").toPandas()
    assert got.q_bh[0] == pytest.approx(0.005) and (got.q_bh[:5] >= got.p_value[:5]).all()
    assert (got.p_holm[:5] >= got.q_bh[:5] - 1e-12).all() and np.isnan(got.q_bh[5]) and not got.significant[5]


def test_deflated_sharpe_falls_with_trials(spark):
    r = series(spark, ret=np.random.default_rng(1).normal(5e-4, 0.01, 500)).withColumns({"turnover": F.lit(0.0), "exposure": F.lit(1.0)})
    d = [metrics.portfolio_metrics(r, ["k"], n).first()["deflated_sharpe"] for n in (1, 10, 100)]
    assert d[0] > d[1] > d[2]


@pytest.mark.parametrize("cells, word", [
    ([("a", True, False, 1.0)], "Adopt"), ([("a", False, True, -1.0)], "Avoid"), ([("a", False, True, -1.0), ("b", False, False, 0.5)], "Mixed"),
    ([("a", False, False, 0.5)], "Worth exploring"), ([("a", False, False, -0.5)], "Neutral")])
def test_recommendation(spark, cells, word):
    df = spark.createDataFrame([(cells,)], "cells array<struct<market:string,sig_gain:boolean,sig_loss:boolean,mean_delta:double>>")
    assert df.select(reports.recommendation().alias("r")).first()["r"].startswith(word)


def test_cleaning_counts_and_digest(spark):
    day = pd.bdate_range("2020-01-01", periods=12).date
    rows = [("m", "s", d, 0, 10.0, 11.0, 9.0, 10.0, 10.0, 1.0) for d in day]
    rows[2] = (*rows[2][:7], None, None, 1.0)            # missing close
    rows[3] = (*rows[3][:4], 0.0, *rows[3][5:])          # non-positive open
    rows[4] = (*rows[4][:4], None, *rows[4][5:])         # missing open becomes the close
    rows[5] = (*rows[5][:5], 9.5, *rows[5][6:])          # high below close
    rows[7] = (*rows[7][:7], 19.0, 19.0, 1.0)            # +90 % that reverses
    rows.append((*rows[8][:3], 1, *rows[8][4:]))         # the same day again
    raw = spark.createDataFrame(rows, "market string, symbol string, date date, ordinal int, open double, high double, low double, "
                                      "close double, adjclose double, volume double")
    a = cleaning.audit(raw, cleaning.CleaningRules(min_rows=5)).first()
    assert (a["raw_rows"], a["duplicate_dates"], a["missing_or_nonpositive"], a["bad_ticks"], a["clean_rows"], a["status"]) == (13, 1, 2, 1, 9, "ok")
    assert a["ohlc_repaired"] == 2  # the low high and the spike above its high
    line = "\n".join(f"{d},10.0,{h},9.0,10.0,1.0" for d, h in zip(day, [11.0] * 5 + [10.0] + [11.0] * 6) if d not in (day[2], day[3], day[7]))
    assert a["sha256_csv"] == hashlib.sha256(line.encode()).hexdigest()
    assert cleaning.clean(raw, cleaning.CleaningRules(min_rows=10)).count() == 0


def test_quotes_to_rows(spark):
    body = {"chart": {"result": [{"timestamp": [1577975400, 1578061800], "meta": {"exchangeTimezoneName": "Asia/Tokyo"},
                                  "indicators": {"quote": [{"open": [1, 2], "high": [2, 3], "low": [1, 1], "close": [1.5, None]}]}}]}}
    df = spark.createDataFrame([("m", "ok", json.dumps(body)), ("m", "bad", "{}")], "market string, symbol string, payload string")
    r = files.parse_quotes(df).orderBy("ordinal").collect()
    assert [str(x["date"]) for x in r] == ["2020-01-02", "2020-01-03"] and r[0]["adjclose"] == 1.5 and r[0]["volume"] is None
    assert [x["symbol"] for x in files.parse_errors(df).collect()] == ["bad"]


def test_files_round_trip(spark, bars, tmp_path):
    folder = tmp_path / "bars"
    folder.mkdir()
    (folder / "AAA.csv").write_text("Date,Open,High,Low,Close\n2020-01-02,1,2,0.5,1.5\n2020-01-03,1,2,0.5,nan\n")
    with gzip.open(folder / "BBB.csv.gz", "wt") as f:
        f.write("Date,Open,High,Low,Close\n2020-01-02,1,2,0.5,1.5\n")
    df = files.read_bars(spark, str(folder / "AAA.csv"), "m").orderBy("date").collect()
    assert df[0]["close"] == 1.5 and df[1]["close"] is None and df[0]["symbol"] == "AAA"
    assert {r["symbol"] for r in files.read_bars(spark, str(folder), "m").collect()} == {"AAA", "BBB"}
    assert files.file_manifest(spark, str(folder)).count() == 2
    files.write_clean(bars, str(tmp_path / "clean"))
    manifest = bars.select("market", "symbol").distinct().withColumn("status", F.when(F.col("symbol") == "S1", "ok").otherwise("x"))
    back = files.read_clean(spark, str(tmp_path / "clean"), manifest, ["M1"])
    assert back.count() == bars.where("symbol = 'S1'").count() > 0
    t = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "strategy string, market string, ret double")
    files.write_trades(t, str(tmp_path / "trades"))
    assert files.read_trades(spark, str(tmp_path / "trades"), "a").first()["ret"] == 1.0
    files.write_csv(t.withColumn("ret", F.lit(1 / 3)), str(tmp_path / "csv"), 8)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["ret"] == "0.33333333"


def test_bootstrap_is_dealt_by_all_keys(spark):
    """Many global series, one market: their replicates must not meet in one partition, nor in one per market."""
    days = spark.range(300).select(F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    tests = spark.range(12).select(F.lit("ALL").alias("market"), F.col("id").cast("string").alias("variant"))
    pairs = tests.crossJoin(days).select("market", "variant", "date", F.lit(0.001).alias("v_ret"), (F.rand(1) / 100).alias("b_ret"))

    def compute(a, b, first, n):
        return 0.0, [float(first)] * n

    df = pairs.select("market", "variant", "date", F.col("v_ret").alias("a"), F.col("b_ret").alias("b"))
    out = inference._differences(df, ["market", "variant"], 1200, compute)
    seen = out.select(F.spark_partition_id().alias("p"), F.get("d", F.lit(0)).alias("first"), F.size("d").alias("n")).collect()
    assert len({r["p"] for r in seen}) > 1 and len(seen) == 12 * 3
    assert sorted({(r["first"], r["n"]) for r in seen}) == [(0.0, 500), (500.0, 500), (1000.0, 200)]


def test_replicate_ranges_continue_one_sequence():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.01, 300), rng.normal(0, 0.01, 300)
    whole = inference.block_differences(a, b, 20, 90, 5)
    np.testing.assert_array_equal(np.concatenate([inference.block_differences(a, b, 20, 50, 5), inference.block_differences(a, b, 20, 40, 5, 50)]), whole)
    whole = inference.day_differences(a, b, 90, 5, False)
    np.testing.assert_array_equal(np.concatenate([inference.day_differences(a, b, 50, 5, False), inference.day_differences(a, b, 40, 5, False, 50)]), whole)


def test_normal_cdf_to_double_precision(spark):
    import math

    from swaplens.functions.distribution import norm_cdf

    x = [None, float("nan"), -40.0, -9.0, 9.0, *np.linspace(-8.4, 8.4, 201).tolist()]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        if r["x"] is None:
            assert r["p"] is None
        elif math.isnan(r["x"]):
            assert math.isnan(r["p"])
        else:
            assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=3e-15)


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1.5,10\n2020-01-01,3,4,2.5,3.5,20\n2020-01-02,x,,1,2,3\n")
    (tmp_path / "B=X.csv").write_text("Date,Close,Open,High,Low\n2020-01-01,9,5,10,4\n")
    with gzip.open(tmp_path / "^C1.csv.gz", "wt") as f:
        f.write("date,low,high,close,open\n2020-01-03,1,4,2,3\n")
    path = str(tmp_path)
    got = {(r.symbol, str(r.date)): (r.open, r.high, r.low, r.close, r.volume) for r in files.read_bars(spark, path).collect()}
    assert got == {("A", "2020-01-01"): (3, 4, 2.5, 3.5, 20), ("A", "2020-01-02"): (None, None, 1, 2, 3), ("B=X", "2020-01-01"): (5, 10, 4, 9, None),
                   ("^C1", "2020-01-03"): (3, 4, 1, 2, None)}
    one = files.read_bars(spark, path, "m", ["B=X"])
    assert [r.symbol for r in one.collect()] == ["B=X"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_bars(spark, str(tmp_path / "empty"))


def test_odd_payloads_give_no_rows(spark):
    rows = [("m", k, p) for k, p in (("e", '{"chart":{"result":[]}}'), ("n", None), ("x", "no json"), ("z", '{"chart":{"result":null}}'))]
    df = spark.createDataFrame(rows, "market string, symbol string, payload string")
    assert files.parse_quotes(df).count() == 0
    errors = files.parse_errors(df)
    assert errors.count() == 4
    manifest = cleaning.audit(files.parse_quotes(df), universe=df.select("market", "symbol").union(spark.createDataFrame([("m", "gone")], "a string, b string")), errors=errors)
    assert {r["symbol"]: r["status"] for r in manifest.collect()} == {**{k: "parse_error: unexpected payload" for k in "enxz"}, "gone": "no_raw_file"}


def test_tables_of_a_run_need_a_shared_folder(spark):
    from swaplens import session

    class Far:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.run_folder(Far)
    assert session.run_folder(spark).endswith(spark.sparkContext.applicationId)
