"""Daily bars derived from the order tables, so that every query has prices to work on.

The instrument is the supplier: its daily line items move a price by their discount and
spread it by their tax. Line items are aggregated per (supplier, day) with partial
aggregation before the shuffle, so a supplier that holds a large share of the rows sends at
most one row per day and task. The number of instruments grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_instrument

MARKETS = ("M0", "M1", "M2")

ITEM = {
    "market": "concat('M', CAST(l_suppkey % 3 AS STRING))", "symbol": "concat('S', CAST(l_suppkey AS STRING))",
    "date": "CAST(l_shipdate AS DATE)", "step": "CAST(round(l_discount * 100) AS INT) - 5",
    "rng": "CAST(round(l_tax * 100) AS INT)",
}
DAY = {"step": "CAST(sum(step) AS DOUBLE) / CAST(count(*) AS DOUBLE)", "rng": "CAST(max(rng) AS DOUBLE)",
       "volume": "CAST(count(*) AS DOUBLE)"}
CLOSE = ("round(1e2 * exp(4e-3 * sum(step) OVER (PARTITION BY market, symbol ORDER BY date "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6)")
OPEN = "coalesce(lag(close) OVER (PARTITION BY market, symbol ORDER BY date), close)"
HIGH, LOW = "greatest(open, close) * (1e0 + 1e-3 * rng)", "least(open, close) * (1e0 - 1e-3 * rng)"


def _list(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


# The same bars as a list of common table expressions over a table named ``lineitem``.
BARS_SQL = f"""
l AS (SELECT {', '.join(_list(ITEM))} FROM lineitem),
g AS (SELECT market, symbol, date, {', '.join(_list(DAY))} FROM l GROUP BY market, symbol, date),
c AS (SELECT market, symbol, date, rng, volume, {CLOSE} AS close FROM g),
o AS (SELECT *, {OPEN} AS open FROM c),
bars AS (SELECT market, symbol, date, open, {HIGH} AS high, {LOW} AS low, close, volume FROM o)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*_list(ITEM))
    daily = items.groupBy("market", "symbol", "date").agg(*[F.expr(e).alias(n) for n, e in DAY.items()])
    closes = by_instrument(daily).selectExpr("market", "symbol", "date", "rng", "volume", f"{CLOSE} AS close")
    opened = closes.selectExpr("*", f"{OPEN} AS open")
    return opened.selectExpr("market", "symbol", "date", "open", f"{HIGH} AS high", f"{LOW} AS low", "close", "volume")
