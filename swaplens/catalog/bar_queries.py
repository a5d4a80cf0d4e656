"""Queries on bars: sources, cleaning, scalar functions, indicators, signals, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters as rec
from ..functions import indicators as ind
from ..functions.columns import (FOLD_KEYS, KEYS, by_time, change, clip, compound, in_window, last_n, no_nan, pct_change,
                                 rolling, running)
from ..functions.distribution import norm_cdf
from ..operators import cleaning, folds, labels, signals
from ..operators.models import pooled
from ..operators.regimes import _with_expanding_median
from ..operators.valuation import market_index
from ..plans.attribution import calendar_split
from ..sources import files
from .base import ADX, ATR, BARS, FOLDS, KEY, NUM, ONE, PART, RECURSION, back, bars, jma_sql, register, rsi_sql

BAR = f"{KEY} date:t"
FBAR = f"{KEY} fold:i idx:i"
SPLIT = "1999-07-01"


def one(spark, d):
    return folds.as_one_fold(bars(spark, d))


def chunks(spark, d):
    return folds.chunk(bars(spark, d))


# ---- quotes with defects --------------------------------------------------------------

DIRTY_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY date) - 1 AS k FROM {bars}),
moved AS (
  SELECT market, symbol, date, k, volume,
         CASE WHEN k % 37 = 4 THEN 0e0 WHEN k % 53 = 6 THEN -1e0 WHEN k % 31 = 8 THEN CAST(NULL AS DOUBLE) ELSE open END AS open,
         CASE WHEN k % 29 = 7 THEN CAST(NULL AS DOUBLE) WHEN k % 23 = 9 THEN close * 99e-2 ELSE high END AS high, low,
         CASE WHEN k % 41 = 5 THEN CAST(NULL AS DOUBLE)
              ELSE close * CASE WHEN k % 101 = 50 THEN 19e-1 ELSE 1e0 END
                         * CASE WHEN k >= 300 AND market = 'M1' THEN 19e-1 ELSE 1e0 END END AS close
  FROM numbered),
dirty AS (
  SELECT market, symbol, date, 0 AS ordinal, open, high, low, close,
         CASE WHEN k % 59 = 10 THEN CAST(NULL AS DOUBLE) WHEN k < 100 THEN close * 4.999137e-1 ELSE close END AS adjclose, volume
  FROM moved
  UNION ALL
  SELECT market, symbol, date, 1 AS ordinal, open, high, low, close * 1001e-3, close * 1001e-3, volume
  FROM moved WHERE k % 17 = 3)"""
DIRTY = BARS + DIRTY_SQL.format(bars="bars").strip() + ",\n"
RULES = cleaning.CleaningRules(min_rows=500)

CLEANING = DIRTY + """
last_row AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, date ORDER BY ordinal DESC) AS rn,
                        count(*) OVER (PARTITION BY market, symbol, date) AS copies FROM dirty) WHERE rn = 1),
judged AS (
  SELECT *, close IS NULL OR coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false)
            OR coalesce(close <= 0, false) AS unusable,
         CASE WHEN adjclose > 0 THEN adjclose / close ELSE 1 END AS f FROM last_row),
filled AS (
  SELECT market, symbol, date, volume, copies, unusable, coalesce(open, close) * f AS open, coalesce(high, close) * f AS high,
         coalesce(low, close) * f AS low, close * f AS close FROM judged),
fixed AS (
  SELECT market, symbol, date, volume, copies, unusable, open, close, least(low, open, close) AS low,
         greatest(high, open, close) AS high,
         NOT unusable AND coalesce(low > least(open, close) OR high < greatest(open, close), false) AS repaired
  FROM filled),
ticks AS (
  SELECT *, close / lag(close) OVER w - 1 AS r, lead(close) OVER w / close - 1 AS nr FROM fixed
  WINDOW w AS (PARTITION BY market, symbol, unusable ORDER BY date)),
flagged AS MATERIALIZED (
  SELECT *, NOT unusable AND coalesce(abs(r) > 0.75 AND abs(nr) > 0.375, false) AS bad_tick FROM ticks),
kept AS (SELECT * FROM flagged WHERE NOT unusable AND NOT bad_tick),
"""


def dirty(spark, d):
    b = bars(spark, d)
    return spark.sql(f"WITH {DIRTY_SQL.replace('FROM {bars}', 'FROM {b}')} SELECT * FROM dirty", b=b)


def flags(spark, d):
    return cleaning.flag_rows(dirty(spark, d), RULES)


register("c1_keep_last_duplicate", f"{BAR} close:d copies:i", lambda s, d: cleaning.keep_last(dirty(s, d)), CLEANING,
         "SELECT * FROM last_row")
register("c2_drop_unusable", f"{BAR} close:d",
         lambda s, d: cleaning.keep_last(dirty(s, d)).where(~cleaning.unusable(RULES)), CLEANING,
         "SELECT * FROM judged WHERE NOT unusable")
register("c3_fill_flat_bar", f"{BAR} open:d high:d low:d",
         lambda s, d: cleaning.fill_flat(cleaning.keep_last(dirty(s, d))), CLEANING,
         "SELECT market, symbol, date, coalesce(open, close) AS open, coalesce(high, close) AS high, "
         "coalesce(low, close) AS low FROM last_row")
register("c4_adjust_prices", f"{BAR} open:d high:d low:d close:d",
         lambda s, d: cleaning.adjust(cleaning.keep_last(dirty(s, d))), CLEANING,
         "SELECT market, symbol, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close FROM judged")
register("c5_repair_ohlc", f"{BAR} low:d high:d repaired:b", flags, CLEANING, "SELECT * FROM fixed")
register("c6_bad_ticks", f"{BAR} close:d", lambda s, d: flags(s, d).where("bad_tick"), CLEANING,
         "SELECT * FROM flagged WHERE bad_tick")
register("c7_clean_bars", f"{BAR} open:d high:d low:d close:d volume:d", lambda s, d: cleaning.clean(dirty(s, d), RULES),
         CLEANING, "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY market, symbol) AS m FROM kept) WHERE m >= 500")

AUDIT = CLEANING + """
universe AS (SELECT DISTINCT market, symbol FROM bars UNION ALL SELECT 'M0', 'absent'),
counted AS (
  SELECT market, symbol, CAST(sum(copies) AS BIGINT) AS raw_rows, CAST(sum(copies - 1) AS BIGINT) AS duplicate_dates,
         count(*) FILTER (unusable) AS missing_or_nonpositive, count(*) FILTER (repaired) AS ohlc_repaired,
         count(*) FILTER (bad_tick) AS bad_ticks, count(*) FILTER (NOT unusable AND NOT bad_tick) AS clean_rows
  FROM flagged GROUP BY market, symbol),
digits AS (
  SELECT market, symbol, date, concat_ws(',', CAST(date AS VARCHAR),
    CAST(CAST(printf('%.7e', open) AS DOUBLE) AS VARCHAR), CAST(CAST(printf('%.7e', high) AS DOUBLE) AS VARCHAR),
    CAST(CAST(printf('%.7e', low) AS DOUBLE) AS VARCHAR), CAST(CAST(printf('%.7e', close) AS DOUBLE) AS VARCHAR),
    CAST(CAST(printf('%.7e', volume) AS DOUBLE) AS VARCHAR)) AS line FROM kept),
hashed AS (
  SELECT market, symbol, min(date) AS first, max(date) AS last, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256_csv
  FROM digits GROUP BY market, symbol),
manifest AS MATERIALIZED (
  SELECT u.market, u.symbol, raw_rows, duplicate_dates, missing_or_nonpositive, ohlc_repaired, bad_ticks, clean_rows,
         CASE WHEN raw_rows IS NULL THEN 'no_raw_file' WHEN clean_rows < 500 THEN 'excluded_min_rows' ELSE 'ok' END AS status,
         CASE WHEN clean_rows >= 500 THEN first END AS first, CASE WHEN clean_rows >= 500 THEN last END AS last,
         CASE WHEN clean_rows >= 500 THEN sha256_csv END AS sha256_csv
  FROM universe u LEFT JOIN counted c ON c.market = u.market AND c.symbol = u.symbol
  LEFT JOIN hashed h ON h.market = u.market AND h.symbol = u.symbol),
"""
MANIFEST = (f"{KEY} raw_rows:d duplicate_dates:d missing_or_nonpositive:d ohlc_repaired:d bad_ticks:d clean_rows:d "
            "status:s first:t last:t")


def manifest(spark, d):
    universe = bars(spark, d).select(*KEYS).distinct().unionByName(
        spark.createDataFrame([("M0", "absent")], "market string, symbol string"))
    return cleaning.audit(dirty(spark, d), RULES, universe)


register("c8_audit_manifest", f"{MANIFEST} has_digest:b", lambda s, d: manifest(s, d).withColumn("has_digest", F.length("sha256_csv") == 64).fillna(
    {"has_digest": False}), AUDIT, "SELECT *, coalesce(length(sha256_csv) = 64, false) AS has_digest FROM manifest")

REFERENCE_SQL = """
ref AS (
  SELECT market, symbol, date,
         CASE WHEN market = 'M1' THEN 1e0 / (close * (1e0 + 1e-3 * (k % 7 - 3))) ELSE close * (1e0 + 1e-3 * (k % 7 - 3)) END AS value
  FROM numbered WHERE market <> 'M2' OR k < 200)"""


def reference_series(spark, d):
    b = bars(spark, d)
    numbered = DIRTY_SQL.split("moved AS")[0].replace("FROM {bars}", "FROM {b}")
    ref = spark.sql(f"WITH {numbered} {REFERENCE_SQL} SELECT * FROM ref", b=b)
    absent = spark.createDataFrame([("M0", "absent", 1.0)], "market string, symbol string, value double")
    return ref.unionByName(absent.withColumn("date", F.to_date(F.lit("2000-01-03"))))


register("c9_cross_validate", f"{KEY} status:s orientation:s overlap_days:d first:t last:t return_corr:d return_corr_5d:d "
         "median_abs_pct_diff:d", lambda s, d: cleaning.cross_validate(bars(s, d), reference_series(s, d)),
         BARS + DIRTY_SQL.format(bars="bars").split("moved AS")[0] + REFERENCE_SQL + """,
sides AS (
  SELECT b.market, b.symbol, b.date, b.close, 'as_is' AS orientation, value AS v FROM bars b JOIN ref USING (market, symbol, date)
  UNION ALL
  SELECT b.market, b.symbol, b.date, b.close, 'inverted', 1 / value FROM bars b JOIN ref USING (market, symbol, date)),
placed AS (SELECT *, row_number() OVER (PARTITION BY market, symbol, orientation ORDER BY date) - 1 AS i FROM sides),
daily AS (SELECT *, close / lag(close) OVER w - 1 AS rc, v / lag(v) OVER w - 1 AS rv FROM placed
          WINDOW w AS (PARTITION BY market, symbol, orientation ORDER BY i)),
sparse AS (SELECT market, symbol, orientation, close / lag(close) OVER w - 1 AS rc, v / lag(v) OVER w - 1 AS rv
           FROM placed WHERE i % 5 = 0 WINDOW w AS (PARTITION BY market, symbol, orientation ORDER BY i)),
a AS (SELECT market, symbol, orientation, count(*) AS overlap_days, min(date) AS first, max(date) AS last,
        corr(rc, rv) AS return_corr, quantile_cont(abs(close / v - 1), 0.5) AS median_abs_pct_diff
      FROM daily GROUP BY ALL),
a5 AS (SELECT market, symbol, orientation, corr(rc, rv) AS return_corr_5d FROM sparse GROUP BY ALL),
best AS (SELECT * FROM (SELECT a.*, return_corr_5d, row_number() OVER (PARTITION BY market, symbol
           ORDER BY median_abs_pct_diff, orientation) AS rk FROM a JOIN a5 USING (market, symbol, orientation)
           WHERE overlap_days >= 250) WHERE rk = 1),
planned AS (SELECT DISTINCT market, symbol, true AS have FROM ref UNION ALL SELECT 'M0', 'absent', NULL)
""", "SELECT p.market, p.symbol, CASE WHEN have IS NULL THEN 'missing' WHEN overlap_days IS NULL THEN 'too_little_overlap' "
         "ELSE 'ok' END AS status, orientation, overlap_days, first, last, return_corr, return_corr_5d, median_abs_pct_diff "
         "FROM planned p LEFT JOIN best b ON b.market = p.market AND b.symbol = p.symbol")
register("c10_universe_summary", "market:s instruments:i first:t last:t median_rows:d rows_repaired:i rows_dropped:i",
         lambda s, d: cleaning.universe_summary(manifest(s, d)), AUDIT,
         "SELECT market, count(*) AS instruments, min(first) AS first, max(last) AS last, "
         "quantile_cont(clean_rows, 0.5) AS median_rows, sum(ohlc_repaired) AS rows_repaired, "
         "sum(missing_or_nonpositive) AS rows_dropped FROM manifest WHERE status = 'ok' GROUP BY market")
register("c11_spot_check_summary", "days:i symbols:i max_abs_diff:d",
         lambda s, d: cleaning.spot_check_summary(bars(s, d).withColumn("abs_diff", F.abs(F.col("close") - F.col("open")))),
         BARS, "SELECT count(*) AS days, count(DISTINCT symbol) AS symbols, max(abs(close - open)) AS max_abs_diff FROM bars")
register("s3_listed_scan", f"{BAR} close:d", lambda s, d: files.listed_only(
    bars(s, d), manifest(s, d).where((F.col("status") == "ok") & (F.col("market") == "M1")).select(*KEYS)), AUDIT,
    "SELECT b.* FROM bars b SEMI JOIN (SELECT * FROM manifest WHERE status = 'ok' AND market = 'M1') m "
    "ON b.market = m.market AND b.symbol = m.symbol")


def _files(spark, d):
    return bars(spark, d).groupBy(F.col("symbol").alias("file")).agg(F.count(F.lit(1)).alias("bytes"))


register("s7_manifest_upsert", "file:s bytes:i",
         lambda s, d: files.upsert_manifest(_files(s, d), _files(s, d).where("file LIKE '%1'").withColumn("bytes", F.col("bytes") * 10)),
         BARS + "f AS (SELECT symbol AS file, count(*) AS bytes FROM bars GROUP BY symbol)",
         "SELECT file, CASE WHEN file LIKE '%1' THEN bytes * 10 ELSE bytes END AS bytes FROM f")


# ---- scalar functions -----------------------------------------------------------------

def per_bar(name, spec, expr, sql, body=NUM):
    register(name, f"{BAR} {spec}", lambda s, d: bars(s, d).withColumns(expr()), body, f"SELECT *, {sql} FROM num")


W = "(PARTITION BY market, symbol ORDER BY date)"


def C():  # noqa: N802 -- reads like the column it stands for
    return F.col("close")


per_bar("p1_pct_change", "r1:d r5:d", lambda: {"r1": pct_change(C(), KEYS), "r5": pct_change(C(), KEYS, 5)},
        f"close / lag(close) OVER {W} - 1 AS r1, close / lag(close, 5) OVER {W} - 1 AS r5")
per_bar("p2_diff", "move:d", lambda: {"move": change(C(), KEYS)}, f"close - lag(close) OVER {W} AS move")
per_bar("p3_shift", "before:d after:d filled:d",
        lambda: {"before": F.lag("close", 2).over(by_time(KEYS)), "after": F.lead("close", 3).over(by_time(KEYS)),
                 "filled": F.lag("close", 1, 0.0).over(by_time(KEYS))},
        f"lag(close, 2) OVER {W} AS before, lead(close, 3) OVER {W} AS after, lag(close, 1, 0) OVER {W} AS filled")
per_bar("p4_sign", "side:d", lambda: {"side": F.signum(change(C(), KEYS)).cast("int")}, f"sign(close - lag(close) OVER {W}) AS side")
per_bar("p5_clip_abs_sqrt_where", "kept:d dist:d root:d side:s known:d",
        lambda: {"kept": clip(change(C(), KEYS), 0.0, 1.0), "dist": F.abs(C() - F.col("open")), "root": F.sqrt("close"),
                 "side": F.when(C() > F.col("open"), "up").when(C() < F.col("open"), "down").otherwise("flat"),
                 "known": F.coalesce(no_nan(change(C(), KEYS)), F.lit(-1.0))},
        f"""CASE WHEN lag(close) OVER {W} IS NULL THEN NULL ELSE least(greatest(close - lag(close) OVER {W}, 0), 1) END AS kept,
        abs(close - open) AS dist, sqrt(close) AS root,
        CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS side,
        coalesce(close - lag(close) OVER {W}, -1) AS known""")
per_bar("p6_fmax", "top:d", lambda: {"top": F.greatest(F.col("high") - F.col("low"), change(C(), KEYS))},
        f"greatest(high - low, close - lag(close) OVER {W}) AS top")
per_bar("p7_dates", "gap:d year:i", lambda: {"gap": F.datediff("date", F.lag("date").over(by_time(KEYS))), "year": F.year("date")},
        f"date_diff('day', lag(date) OVER {W}, date) AS gap, year(date) AS year")
register("p8_strings", "symbol:s stem:s component:s setting:s suffix:s is_first:b long_name:s",
         lambda s, d: bars(s, d).select("symbol").distinct().withColumn("name", F.concat("symbol", F.lit("@lag.XY"))).select(
             "symbol", F.regexp_replace(F.regexp_replace("name", "@", "_AT_"), r"\.", "_").alias("stem"),
             F.split_part("name", F.lit("@"), F.lit(1)).alias("component"),
             F.split_part("name", F.lit("@"), F.lit(2)).alias("setting"),
             F.regexp_extract("name", r"\.([A-Z]+)$", 1).alias("suffix"), F.col("symbol").startswith("S1").alias("is_first"),
             F.when(F.col("symbol") == "S1", "one").otherwise(F.col("symbol")).alias("long_name")),
         BARS, "SELECT DISTINCT symbol, symbol || '_AT_lag_XY' AS stem, symbol AS component, 'lag.XY' AS setting, 'XY' AS suffix, "
         "starts_with(symbol, 'S1') AS is_first, CASE WHEN symbol = 'S1' THEN 'one' ELSE symbol END AS long_name FROM bars")
register("p9_date_window", f"{BAR} close:d", lambda s, d: bars(s, d).where(in_window(F.col("date"), "1997-07-01", "1999-07-01")),
         BARS, "SELECT * FROM bars WHERE date >= DATE '1997-07-01' AND date < DATE '1999-07-01'")
register("p10_freeze_predicate", f"{BAR} ok:b",
         lambda s, d: bars(s, d).withColumn("ok", labels.resolved_before(SPLIT, 15)), NUM,
         f"SELECT *, date < DATE '{SPLIT}' AND coalesce(lead(date, 15) OVER {W} < DATE '{SPLIT}', false) AS ok FROM num")
per_bar("p11_normal_cdf", "p:d", lambda: {"p": norm_cdf(F.col("volume") - 2.5 + (C() - F.col("open")) / 10)},
        """(SELECT 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80),
          lambda k: z * power(z * z, k) / exp(lgamma(k + 1.5) + (k + 1) * ln(2) - 0.5 * ln(pi()))))
          FROM (SELECT volume - 2.5 + (close - open) / 10 AS z)) AS p""")
register("p12_compound", f"{KEY} total:d", lambda s, d: bars(s, d).withColumn("r", pct_change(C(), KEYS)).groupBy(*KEYS).agg(
    compound(F.col("r")).alias("total")), NUM + f"r AS (SELECT *, close / lag(close) OVER {W} AS g FROM num)",
    "SELECT market, symbol, product(g) - 1 AS total FROM r GROUP BY ALL")
register("p13_calendar_split", "split:t", lambda s, d: calendar_split(bars(s, d)), BARS,
         "SELECT min(date) + CAST(floor(0.7 * date_diff('day', min(date), max(date))) AS INT) AS split FROM bars")


# ---- indicators -----------------------------------------------------------------------

def filtered(name, spec, filters, out, cte, sql, fold=False):
    """A recursive filter over whole histories or folds against a row-by-row recursion."""
    register(name, f"{FBAR} {spec}", lambda s, d: rec.with_filters((chunks if fold else one)(s, d), filters, FOLD_KEYS).withColumns({k: F.col(v) for k, v in out.items()}),
             (FOLDS if fold else ONE) + cte, sql)


filtered("i1_ema", "ema:d", [rec.ema(20)], {"ema": "ema_20"}, RECURSION, "SELECT * FROM rf")
filtered("i2_jma", "fast:d slow:d", [rec.jma(7), rec.jma(21)], {"fast": "jma_7", "slow": "jma_21"},
         jma_sql("j7", 7) + jma_sql("j21", 21),
         "SELECT a.market, a.symbol, a.fold, a.idx, a.jm AS fast, b.jm AS slow FROM j7 a JOIN j21 b USING (market, symbol, fold, idx)")
filtered("i6_rsi", "rsi:d", [rec.rsi(14)], {"rsi": "rsi_14"}, rsi_sql("rs", 14), "SELECT * FROM rs")
filtered("i7_macd_histogram", "macd_hist:d", [rec.macd_hist()], {}, RECURSION, "SELECT * FROM rf")
filtered("i8_kama", "kama:d", [rec.kama()], {}, RECURSION, "SELECT * FROM rf")
register("i3_true_range", f"{FBAR} true_range:d", lambda s, d: ind.with_true_range(chunks(s, d), FOLD_KEYS), FOLDS + ATR,
         "SELECT *, tr AS true_range FROM fa")
register("i4_atr", f"{FBAR} atr:d", lambda s, d: ind.with_atr(chunks(s, d), FOLD_KEYS), FOLDS + ATR, "SELECT * FROM fa")
register("i5_adx", f"{FBAR} adx:d", lambda s, d: ind.with_adx(chunks(s, d), FOLD_KEYS), FOLDS + ATR + ADX, "SELECT * FROM fd")
register("i9_historical_volatility", f"{BAR} hist_vol:d", lambda s, d: ind.with_historical_volatility(bars(s, d)), ONE + ATR,
         f"SELECT *, CASE WHEN count(r) OVER {back(19)} >= 20 THEN stddev_samp(r) OVER {back(19)} * sqrt(252) END AS hist_vol FROM fa")
register("i10_rolling_zscore", f"{BAR} zscore:d",
         lambda s, d: ind.with_zscore(bars(s, d), pct_change(C(), KEYS), KEYS), ONE + ATR + ADX, "SELECT *, z AS zscore FROM fd")
R2 = f"({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
register("i11_trend_r2", f"{BAR} backward_r2:d", lambda s, d: ind.with_trend_r2(bars(s, d)), ONE,
         f"SELECT *, CASE WHEN count(close) OVER {R2} >= 20 THEN regr_r2(close, CAST(idx AS DOUBLE)) OVER {R2} END AS backward_r2 FROM fr")
register("i12_sma", f"{BAR} sma50:d sma200:d", lambda s, d: bars(s, d).withColumns({"sma50": ind.sma(C(), 50), "sma200": ind.sma(C(), 200)}),
         ONE, f"SELECT *, CASE WHEN idx >= 49 THEN avg(close) OVER {back(49)} END AS sma50, "
              f"CASE WHEN idx >= 199 THEN avg(close) OVER {back(199)} END AS sma200 FROM fr")
register("i13_channel", f"{BAR} hi:d lo:d", lambda s, d: bars(s, d).withColumns({"hi": ind.channel_high(20), "lo": ind.channel_low(20)}),
         ONE, f"SELECT *, CASE WHEN idx >= 20 THEN max(high) OVER {R2} END AS hi, CASE WHEN idx >= 20 THEN min(low) OVER {R2} END AS lo FROM fr")
UP = f"({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
register("i14_equity_drawdown", f"{BAR} equity:d drawdown:d", lambda s, d: ind.with_equity(
    bars(s, d).withColumn("r", F.coalesce(pct_change(C(), KEYS), F.lit(0.0))), "r", KEYS), ONE,
    f"SELECT *, close / first_value(close) OVER {UP} AS equity, close / max(close) OVER {UP} - 1 AS drawdown FROM fr")


def expanding_volatility(spark, d):
    idx = market_index(bars(spark, d))
    idx = idx.withColumn("rv", rolling(F.stddev_samp, F.col("ret"), last_n(("market",), 20), 20))
    return _with_expanding_median(idx, "rv", ("market",), 250, "median")


INDEX = ONE + ATR + """
ix AS MATERIALIZED (SELECT market, date, coalesce(avg(r), 0) AS ret FROM fa GROUP BY market, date),
rv AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER v >= 20 THEN stddev_samp(ret) OVER v END AS rv FROM ix
       WINDOW v AS (PARTITION BY market ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
"""
EXPAND = "(PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
register("i15_expanding_median", "market:s date:t rv:d median:d", expanding_volatility, INDEX,
         f"SELECT *, CASE WHEN count(rv) OVER {EXPAND} >= 250 THEN quantile_cont(rv, 0.5) OVER {EXPAND} END AS median FROM rv")
register("i16_running_extremes", f"{BAR} floor_ahead:d peak_so_far:d", lambda s, d: bars(s, d).withColumns({
    "floor_ahead": F.min("close").over(by_time(KEYS).rowsBetween(0, Window.unboundedFollowing)),
    "peak_so_far": F.max("close").over(running(KEYS))}), ONE,
    f"SELECT *, min(close) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS floor_ahead, max(close) OVER {UP} AS peak_so_far FROM fr")
AHEAD = f"({PART} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)"
register("i17_forward_window", f"{BAR} n:i ahead_sum:d", lambda s, d: bars(s, d).withColumn("ahead", labels.forward_closes(15)).withColumns(
    {"n": F.size("ahead"), "ahead_sum": F.aggregate("ahead", F.lit(0.0), lambda a, x: a + x)}), ONE,
    f"SELECT market, symbol, date, count(close) OVER {AHEAD} AS n, coalesce(sum(close) OVER {AHEAD}, 0) AS ahead_sum FROM fr")
FEATURES = " ".join(f"{f}:d" for f in ind.FEATURES)
FEATURE_SQL = RECURSION + ATR + ADX + f"""
feat AS MATERIALIZED (
  SELECT q.*, q.z AS ret_zscore, (q.close - rf.ema) / nullif(q.atr, 0) AS atr_norm_mom, rf.rsi, rf.macd_hist,
         rf.kama - lag(rf.kama) OVER (PARTITION BY q.market, q.symbol, q.fold ORDER BY q.date) AS kama_slope
  FROM (SELECT *, CASE WHEN count(r) OVER {back(19)} >= 20 THEN stddev_samp(r) OVER {back(19)} * sqrt(252) END AS hist_vol,
          CASE WHEN count(close) OVER {R2} >= 20 THEN regr_r2(close, CAST(idx AS DOUBLE)) OVER {R2} END AS backward_r2 FROM fd) q
  JOIN rf ON rf.market = q.market AND rf.symbol = q.symbol AND rf.fold = q.fold AND rf.idx = q.idx),
"""
register("i18_features_full_history", f"{FBAR} {FEATURES}", lambda s, d: ind.with_features(one(s, d), FOLD_KEYS), ONE + FEATURE_SQL,
         "SELECT * FROM feat")
register("i18_features_per_fold", f"{FBAR} {FEATURES}", lambda s, d: ind.with_features(chunks(s, d), FOLD_KEYS), FOLDS + FEATURE_SQL,
         "SELECT * FROM feat")


# ---- signals --------------------------------------------------------------------------

def signal(name, rule, params, cte, sql, fold=False):
    def build(s, d):
        frame = rec.with_filters((chunks if fold else one)(s, d), rule.filters(**params), FOLD_KEYS)
        return rule.add(frame, FOLD_KEYS, **params).where(F.col("signal") != 0)

    register(name, f"{FBAR} signal:i", build, (FOLDS if fold else ONE) + cte, f"SELECT * FROM ({sql}) WHERE signal <> 0")


def cross_sql(src: str, fast: str, slow: str) -> str:
    w = "(PARTITION BY market, symbol, fold ORDER BY idx)"
    return (f"SELECT *, CASE WHEN {fast} > {slow} AND lag({fast}) OVER {w} <= lag({slow}) OVER {w} THEN 1 "
            f"WHEN {fast} < {slow} AND lag({fast}) OVER {w} >= lag({slow}) OVER {w} THEN -1 ELSE 0 END AS signal FROM {src}")


signal("g1_crossover_close_sma", signals.SignalRule("x", lambda df, keys, out: signals.crossover(df, C(), ind.sma(C(), 20, keys), keys, out)),
       {}, f"a AS (SELECT *, CASE WHEN idx >= 19 THEN avg(close) OVER {back(19)} END AS m FROM fr)", cross_sql("a", "close", "m"))
signal("g2_jma_cross", signals.JMA_CROSS, {}, jma_sql("j7", 7) + jma_sql("j21", 21) +
       "a AS (SELECT x.market, x.symbol, x.fold, x.idx, x.jm AS f, y.jm AS s FROM j7 x JOIN j21 y USING (market, symbol, fold, idx))",
       cross_sql("a", "f", "s"))
signal("g3_sma_cross", signals.SMA_CROSS, {}, f"a AS (SELECT *, CASE WHEN idx >= 49 THEN avg(close) OVER {back(49)} END AS f, "
       f"CASE WHEN idx >= 199 THEN avg(close) OVER {back(199)} END AS s FROM fr)", cross_sql("a", "f", "s"))
signal("g4_donchian", signals.DONCHIAN, {}, f"a AS (SELECT *, CASE WHEN idx >= 20 THEN max(high) OVER {R2} END AS hi, "
       f"CASE WHEN idx >= 20 THEN min(low) OVER {R2} END AS lo FROM fr)",
       "SELECT *, CAST(coalesce(close > hi, false) AS INT) - CAST(coalesce(close < lo, false) AS INT) AS signal FROM a")
signal("g5_ts_momentum", signals.TS_MOMENTUM, {"lookback": 60}, f"a AS (SELECT *, sign(close / lag(close, 60) OVER ({PART}) - 1) AS s FROM fr)",
       f"SELECT *, CASE WHEN s <> lag(s) OVER ({PART}) AND s <> 0 THEN s ELSE 0 END AS signal FROM a")
signal("g6_rsi_reversion", signals.RSI_REVERSION, {"trend": 100}, rsi_sql("r2", 2) +
       f"a AS (SELECT f.*, r2.rsi, CASE WHEN f.idx >= 99 THEN avg(close) OVER (PARTITION BY f.market, f.symbol, f.fold ORDER BY f.date "
       "ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END AS m FROM fr f JOIN r2 ON r2.market = f.market AND r2.symbol = f.symbol "
       "AND r2.fold = f.fold AND r2.idx = f.idx)",
       "SELECT *, CAST(coalesce(rsi < 10 AND close > m, false) AS INT) - CAST(coalesce(rsi > 90 AND close < m, false) AS INT) AS signal FROM a")
register("g7_adx_gate", f"{FBAR} gate:b", lambda s, d: ind.with_adx(chunks(s, d), FOLD_KEYS).withColumn("gate", signals.adx_gate()),
         FOLDS + ATR + ADX, "SELECT *, coalesce(adx >= 25, false) AS gate FROM fd")


def gated_signal(spark, d):
    df = ind.with_adx(chunks(spark, d), FOLD_KEYS)
    df = signals.DONCHIAN.add(df, FOLD_KEYS, "raw", lookback=10)
    return df.withColumn("signal", signals.gated(F.col("raw"), signals.adx_gate(), 1, FOLD_KEYS))


W10 = f"({PART} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
register("g8_gate_then_lag", f"{FBAR} signal:i", gated_signal, FOLDS + ATR + ADX + f"""
a AS (SELECT *, CASE WHEN idx >= 10 THEN max(high) OVER {W10} END AS hi, CASE WHEN idx >= 10 THEN min(low) OVER {W10} END AS lo FROM fd),
b AS (SELECT *, CASE WHEN adx >= 25 THEN CAST(coalesce(close > hi, false) AS INT) - CAST(coalesce(close < lo, false) AS INT) ELSE 0 END AS g FROM a)
""", f"SELECT *, lag(g, 1, 0) OVER ({PART}) AS signal FROM b")


# ---- labels ---------------------------------------------------------------------------

def label(name, build, sql):
    register(name, f"{FBAR} label:d", lambda s, d: build(ind.with_atr(one(s, d), FOLD_KEYS)), ONE + ATR, sql)


label("l1_linearity", lambda df: labels.label_linearity(df, FOLD_KEYS),
      f"SELECT *, CASE WHEN count(close) OVER {AHEAD} >= 15 THEN CASE WHEN var_pop(close) OVER {AHEAD} = 0 THEN 0 "
      f"ELSE CAST(regr_r2(close, CAST(idx AS DOUBLE)) OVER {AHEAD} >= 0.5 AS INT) END END AS label FROM fa")
LISTS = f"(SELECT *, list(close) OVER {AHEAD} AS ahead FROM fa)"
label("l2_excursion", lambda df: labels.label_excursion(df, FOLD_KEYS), f"""
SELECT *, CASE WHEN len(ahead) < 15 OR ahead IS NULL OR atr IS NULL OR atr = 0 THEN NULL ELSE CAST(
  list_max(fav) >= 1.5 * atr AND list_min(fav[1:list_position(fav, list_max(fav))]) > -1.5 * atr AS INT) END AS label
FROM (SELECT *, list_transform(ahead, lambda c: (c - close) * CASE WHEN ahead[-1] < close THEN -1.0 ELSE 1.0 END) AS fav FROM {LISTS})""")
label("l3_move_size", lambda df: labels.label_move_size(df, FOLD_KEYS),
      f"SELECT *, CASE WHEN lead(close, 15) OVER ({PART}) IS NULL OR atr IS NULL OR atr = 0 THEN NULL "
      f"ELSE CAST(abs(lead(close, 15) OVER ({PART}) - close) >= 1.5 * atr AS INT) END AS label FROM fa")


def both_brackets(df):
    df = labels.label_bracket(labels.label_bracket(df, 1, FOLD_KEYS, out="long"), -1, FOLD_KEYS, out="short")
    return df.withColumn("label", 2 * F.col("long") + F.col("short"))


AHEAD40 = f"({PART} ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)"
register("l4_bracket", f"{FBAR} long:d short:d", lambda s, d: both_brackets(ind.with_atr(one(s, d), FOLD_KEYS)), ONE + ATR + f"""
a AS (SELECT *, list(close) OVER {AHEAD40} AS ahead FROM fa),
b AS (SELECT *, coalesce(list_position(list_transform(ahead, lambda c: c <= close - 1.5 * atr), true), 0) AS ls,
        coalesce(list_position(list_transform(ahead, lambda c: c >= close + 3.0 * atr), true), 0) AS lt,
        coalesce(list_position(list_transform(ahead, lambda c: c >= close + 1.5 * atr), true), 0) AS ss,
        coalesce(list_position(list_transform(ahead, lambda c: c <= close - 3.0 * atr), true), 0) AS st FROM a)
""", """SELECT *, CASE WHEN atr IS NULL OR atr = 0 OR (ls = 0 AND lt = 0) THEN NULL ELSE CAST(lt > 0 AND (ls = 0 OR lt < ls) AS INT) END AS long,
CASE WHEN atr IS NULL OR atr = 0 OR (ss = 0 AND st = 0) THEN NULL ELSE CAST(st > 0 AND (ss = 0 OR st < ss) AS INT) END AS short FROM b""")
register("l5_continuation", f"{FBAR} long:d short:d", lambda s, d: labels.label_continuation(
    labels.label_continuation(one(s, d), 1, FOLD_KEYS, out="long"), -1, FOLD_KEYS, out="short"), ONE,
    f"SELECT *, CAST(lead(close, 10) OVER ({PART}) - close > 0 AS INT) AS long, CAST(close - lead(close, 10) OVER ({PART}) > 0 AS INT) AS short FROM fr")


def pool(spark, d):
    df = ind.with_features(bars(spark, d))
    return pooled(labels.label_move_size(df), SPLIT, 15)


register("m1_pooled_training_set", f"{FEATURES} label:i", pool, ONE + FEATURE_SQL,
         f"""SELECT *, CAST(abs(ahead - close) >= 1.5 * atr AS INT) AS label FROM (
  SELECT *, lead(close, 15) OVER ({PART}) AS ahead, lead(date, 15) OVER ({PART}) AS until FROM feat)
WHERE date < DATE '{SPLIT}' AND until < DATE '{SPLIT}' AND atr > 0 AND ahead IS NOT NULL AND """
         + " AND ".join(f"{f} IS NOT NULL" for f in ind.FEATURES))
register("r15_universe_activity", "market:s year:i instruments:i", lambda s, d: _activity(s, d), AUDIT,
         "SELECT market, year, count(*) AS instruments FROM (SELECT market, unnest(range(year(first), year(last) + 1)) AS year "
         "FROM manifest WHERE status = 'ok') GROUP BY ALL")


def _activity(spark, d):
    from ..plans.reports import universe_activity

    return universe_activity(manifest(spark, d))


def _listings(spark, d):
    from ..plans.reports import exchange_counts

    named = F.concat("symbol", F.when(F.col("symbol").endswith("1"), ".DE").when(F.col("symbol").endswith("2"), ".T").otherwise(""))
    return exchange_counts(manifest(spark, d).withColumns({"symbol": named, "market": F.concat(F.lit("stocks_"), "market")}))


register("r23_exchange_counts", "exchange:s instruments:i", _listings, AUDIT,
         "SELECT CASE WHEN symbol LIKE '%1' THEN 'DE' WHEN symbol LIKE '%2' THEN 'T' ELSE 'US' END AS exchange, count(*) AS instruments "
         "FROM manifest WHERE status = 'ok' GROUP BY 1")


def _timeline(spark, d):
    from ..plans.reports import timeline

    return timeline(bars(spark, d), [("F1", "1997-07-01", "1999-07-01"), ("F2", "1999-07-01", "2100-01-01")])


register("r22_timeline", "market:s freeze:s segment:s start:t end:t", _timeline, BARS + """
sp AS (SELECT market, min(date) AS first, max(date) AS last FROM bars GROUP BY market),
fz(name, split, test_end) AS (VALUES ('F1', DATE '1997-07-01', DATE '1999-07-01'), ('F2', DATE '1999-07-01', DATE '2100-01-01'))
""", 'SELECT market, name AS "freeze", \'train\' AS segment, first AS "start", split AS "end" FROM sp, fz UNION ALL '
     'SELECT market, name, \'test\', split, least(test_end, last) FROM sp, fz')
