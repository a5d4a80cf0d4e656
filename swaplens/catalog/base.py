"""Registry of queries and the SQL building blocks of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPARK_TYPES = {"i": "bigint", "s": "string", "t": "date", "b": "boolean"}
SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "t": "DATE", "b": "BOOLEAN"}
KEY = "market:s symbol:s"
DIGITS = 6
SHIFT = "3.3e-9"  # moves decimal grid values off the rounding boundary


def columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Columns of the spec with fixed types; doubles rounded so that both engines agree."""
    out = []
    for name, kind in columns(spec):
        c = F.col(name)
        out.append((F.round(c.cast("double") + float(SHIFT), DIGITS) + 0.0 if kind == "d" else c.cast(SPARK_TYPES[kind])).alias(name))
    return df.select(*out)


def shaped_sql(body: str, final: str, spec: str) -> str:
    parts = [f'CAST(round(CAST("{n}" AS DOUBLE) + {SHIFT}, {DIGITS}) + 0.0 AS DOUBLE) AS "{n}"' if k == "d"
             else f'CAST("{n}" AS {SQL_TYPES[k]}) AS "{n}"' for n, k in columns(spec)]
    return f"WITH RECURSIVE {body.strip().rstrip(',')}\nSELECT {', '.join(parts)} FROM ({final}) AS result_rows"


def register(name: str, spec: str, build: Callable[[SparkSession, str], DataFrame], body: str | None = None,
             final: str | None = None) -> None:
    """Add a query; with ``body`` (common table expressions) and ``final`` also its oracle."""
    QUERIES[name] = lambda spark, sf_dir: shaped(build(spark, sf_dir), spec)
    if final is not None:
        ORACLES[name] = shaped_sql(body or BARS, final, spec)


_shared: dict = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries of one session start from, written once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = cut_lineage(build())
    return _shared[key]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.bars(spark, sf_dir)


# ---- SQL blocks ------------------------------------------------------------------------
# Windows: w = bars of one instrument (fold) in order, wN = the last N of them.

BARS = derived.BARS_SQL.replace("bars AS (", "bars AS MATERIALIZED (") + ",\n"

NUM = BARS + """
num AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY date) - 1 AS pos,
         count(*) OVER (PARTITION BY market, symbol) AS n FROM bars),
"""

ONE = NUM + "fr AS MATERIALIZED (SELECT *, 0 AS fold, pos AS idx, n - 1 AS last_idx FROM num),\n"

FOLDS = NUM + """
fr AS MATERIALIZED (
  SELECT *, pos // (n // 5) AS fold, pos % (n // 5) AS idx, n // 5 - 1 AS last_idx
  FROM num WHERE pos < (n // 5) * 5),
"""

PART = "PARTITION BY market, symbol, fold ORDER BY date"


def back(n: int, end: str = "CURRENT ROW") -> str:
    return f"({PART} ROWS BETWEEN {n} PRECEDING AND {end})"


W14, W20 = back(13), back(19)

ATR = f"""
tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({PART})), abs(low - lag(close) OVER ({PART}))) AS tr,
         high - lag(high) OVER ({PART}) AS up, lag(low) OVER ({PART}) - low AS down,
         close / lag(close) OVER ({PART}) - 1 AS r FROM fr),
fa AS MATERIALIZED (SELECT *, CASE WHEN count(tr) OVER {W14} >= 14 THEN avg(tr) OVER {W14} END AS atr FROM tr),
"""

ADX = f"""
dm AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS rise,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS fall FROM fa),
di AS (SELECT *, 100 * (avg(rise) OVER {W14}) / nullif(avg(tr) OVER {W14}, 0) AS plus,
         100 * (avg(fall) OVER {W14}) / nullif(avg(tr) OVER {W14}, 0) AS minus FROM dm),
dx AS (SELECT *, 100 * abs(plus - minus) / nullif(plus + minus, 0) AS dx FROM di),
fd AS MATERIALIZED (SELECT *, avg(dx) OVER {W14} AS adx,
         CASE WHEN count(r) OVER {W20} >= 10 THEN (r - avg(r) OVER {W20}) / (stddev_pop(r) OVER {W20} + 1e-8) END AS z
       FROM dx),
"""

# Recursive filters as a row-by-row recursion over the position.
RECURSION = """
rec AS (
  SELECT market, symbol, fold, idx, close AS ema, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss,
         close AS n12, close AS n26, CAST(1 AS DOUBLE) AS d12, CAST(1 AS DOUBLE) AS d26,
         CAST(0 AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS n9, CAST(1 AS DOUBLE) AS d9,
         close AS kama, close AS p1, CAST(NULL AS DOUBLE) AS p2, CAST(NULL AS DOUBLE) AS p3
  FROM fr WHERE idx = 0
  UNION ALL
  SELECT market, symbol, fold, idx, ema, gain, loss, n12, n26, d12, d26, line, line + n9 * 0.8, 1 + d9 * 0.8,
         CASE WHEN p3 IS NULL OR path = 0 THEN kama
              ELSE kama + power(abs(c - p3) / path * (2.0 / 3 - 2.0 / 51) + 2.0 / 51, 2) * (c - kama) END, c, p1, p2
  FROM (
    SELECT f.market, f.symbol, f.fold, f.idx, f.close AS c, s.ema + 2.0 / 21 * (f.close - s.ema) AS ema,
           CASE WHEN s.gain IS NULL THEN greatest(f.close - s.p1, 0)
                ELSE s.gain * 13 / 14 + greatest(f.close - s.p1, 0) / 14 END AS gain,
           CASE WHEN s.loss IS NULL THEN greatest(s.p1 - f.close, 0)
                ELSE s.loss * 13 / 14 + greatest(s.p1 - f.close, 0) / 14 END AS loss,
           f.close + s.n12 * 11 / 13 AS n12, f.close + s.n26 * 25 / 27 AS n26,
           1 + s.d12 * 11 / 13 AS d12, 1 + s.d26 * 25 / 27 AS d26,
           (f.close + s.n12 * 11 / 13) / (1 + s.d12 * 11 / 13)
             - (f.close + s.n26 * 25 / 27) / (1 + s.d26 * 25 / 27) AS line,
           s.n9, s.d9, s.kama, s.p1, s.p2, s.p3,
           abs(f.close - s.p1) + abs(s.p1 - s.p2) + abs(s.p2 - s.p3) AS path
    FROM rec s JOIN fr f ON f.market = s.market AND f.symbol = s.symbol AND f.fold = s.fold AND f.idx = s.idx + 1)),
rf AS MATERIALIZED (
  SELECT market, symbol, fold, idx, ema, kama, line - n9 / d9 AS macd_hist,
         100 - 100 / (1 + gain / CASE WHEN loss = 0 THEN 1e-12 ELSE loss END) AS rsi FROM rec),
"""


def jma_sql(name: str, length: int, phase: float = 0.0, power: float = 2.0) -> str:
    ratio = min(max(phase / 100 + 1.5, 0.5), 2.5)
    beta = 0.45 * (length - 1) / (0.45 * (length - 1) + 2)
    alpha = beta ** power
    a, b, c = f"CAST({alpha!r} AS DOUBLE)", f"CAST({beta!r} AS DOUBLE)", f"CAST({ratio!r} AS DOUBLE)"
    return f"""
{name} AS (
  SELECT market, symbol, fold, idx, close AS ma, close * {b} AS d0,
         (close + {c} * close * {b} - close) * (1 - {a}) * (1 - {a}) + {a} * {a} * close AS d1,
         close + (close + {c} * close * {b} - close) * (1 - {a}) * (1 - {a}) + {a} * {a} * close AS jm
  FROM fr WHERE idx = 0
  UNION ALL
  SELECT market, symbol, fold, idx, ma, d0, d1n, jm + d1n FROM (
    SELECT *, (ma + {c} * d0 - jm) * (1 - {a}) * (1 - {a}) + {a} * {a} * d1 AS d1n FROM (
      SELECT *, (c - ma) * (1 - {b}) + {b} * d0o AS d0 FROM (
        SELECT f.market, f.symbol, f.fold, f.idx, f.close AS c, (1 - {a}) * f.close + {a} * s.ma AS ma, s.d0 AS d0o,
               s.d1, s.jm
        FROM {name} s JOIN fr f
          ON f.market = s.market AND f.symbol = s.symbol AND f.fold = s.fold AND f.idx = s.idx + 1)))),
"""


def rsi_sql(name: str, length: int) -> str:
    return f"""
{name}_s AS (
  SELECT market, symbol, fold, idx, close AS p, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss
  FROM fr WHERE idx = 0
  UNION ALL
  SELECT f.market, f.symbol, f.fold, f.idx, f.close,
         CASE WHEN s.gain IS NULL THEN greatest(f.close - s.p, 0)
              ELSE s.gain * {length - 1} / {length} + greatest(f.close - s.p, 0) / {length} END,
         CASE WHEN s.loss IS NULL THEN greatest(s.p - f.close, 0)
              ELSE s.loss * {length - 1} / {length} + greatest(s.p - f.close, 0) / {length} END
  FROM {name}_s s JOIN fr f ON f.market = s.market AND f.symbol = s.symbol AND f.fold = s.fold AND f.idx = s.idx + 1),
{name} AS MATERIALIZED (
  SELECT market, symbol, fold, idx, 100 - 100 / (1 + gain / CASE WHEN loss = 0 THEN 1e-12 ELSE loss END) AS rsi
  FROM {name}_s),
"""
