"""Filters and features against plain loops; no look-ahead."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaplens.functions import filters as rec
from swaplens.functions.columns import KEYS
from swaplens.functions.draws import draw, draw_np
from swaplens.functions.indicators import FEATURES, with_features
from swaplens.operators.signals import RULES
from swaplens.operators.walkforward import Strategy


def price(n=300, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_exponential_filters_match_pandas(n):
    p = price(n)
    s = pd.Series(p)
    np.testing.assert_allclose(rec._ema(p, 20), s.ewm(span=20, adjust=False).mean(), rtol=1e-12)
    line = s.ewm(span=12).mean() - s.ewm(span=26).mean()
    np.testing.assert_allclose(rec._macd_hist(p, 12, 26, 9), line - line.ewm(span=9).mean(), atol=1e-10)
    d = s.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(rec._rsi(p, 14), 100 - 100 / (1 + up / down.replace(0, 1e-12)), rtol=1e-9)


def test_adaptive_filters_match_a_loop():
    p = price()
    p[100:110] = p[100]  # a flat stretch: efficiency undefined, KAMA holds
    level, out = p[0], [p[0]]
    for i in range(1, len(p)):
        path = np.abs(np.diff(p[i - 3:i + 1])).sum() if i >= 3 else 0
        if path > 0:
            level += (abs(p[i] - p[i - 3]) / path * (2 / 3 - 2 / 51) + 2 / 51) ** 2 * (p[i] - level)
        out.append(level)
    np.testing.assert_allclose(rec._kama(p, 3, 2, 50), out, rtol=1e-12)
    beta = 0.45 * 6 / (0.45 * 6 + 2)
    a, m, d0, d1, j, out = beta ** 2, p[0], p[0], p[0], p[0], []
    for x in p:
        m = (1 - a) * x + a * m
        d0 = (x - m) * (1 - beta) + beta * d0
        d1 = (m + 1.5 * d0 - j) * (1 - a) ** 2 + a ** 2 * d1
        j += d1
        out.append(j)
    np.testing.assert_allclose(rec._jma(p, 7, 0, 2), out, rtol=1e-11)


def test_features_and_signals_do_not_look_ahead(bars):
    filters = [f for r in RULES.values() for f in r.filters()]
    def run(df):
        df = with_features(df, KEYS, filters)
        for name, r in RULES.items():
            df = r.add(df, KEYS, f"s_{name}")
        cols = [*FEATURES, *[f"s_{n}" for n in RULES]]
        return df.select("symbol", "date", *cols).toPandas().set_index(["symbol", "date"]).sort_index()
    full, cut = run(bars), pd.Timestamp("2000-06-01").date()
    part = run(bars.where(F.col("date") <= F.lit(cut)))
    pd.testing.assert_frame_equal(part, full[full.index.get_level_values("date") <= cut], rtol=1e-9)
    assert (full.drop(columns=list(FEATURES)) != 0).any().all()


def test_draws_agree_between_numpy_and_sql(spark):
    df = spark.range(200).select(F.col("id").alias("r"), (F.col("id") * 7).alias("s"))
    got = df.withColumn("d", draw("r", "s", 3, "501")).orderBy("r").toPandas()
    assert got.d.tolist() == draw_np(got.r, got.s, 3, 501).tolist()
    many = draw_np(np.arange(2000)[:, None], np.arange(50)[None, :], 0, 100)
    assert abs(np.bincount(many.ravel(), minlength=100) / many.size * 100 - 1).max() < 0.15


def test_every_documented_strategy_builds():
    from swaplens.plans.study import Market, StudyConfig

    cfg = StudyConfig([Market("m", 5.0)])
    for name in cfg.strategies:
        s = cfg.control(name)
        assert isinstance(s, Strategy) and s.fill == "close" and s.signal.combos()
