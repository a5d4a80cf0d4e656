"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, by_instrument, no_nan

BAR_COLUMNS = ("open", "high", "low", "close", "volume")

# Shape of the raw quote payload: parallel arrays under one result.
QUOTE_SCHEMA = (
    "chart struct<result:array<struct<timestamp:array<bigint>,meta:struct<exchangeTimezoneName:string>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,"
    "close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)\.[^/]*$", 1)


def in_folder(key: str) -> Column:
    """Name of an instrument whose files lie in a folder ``<key>=<name>``, as Spark's own writers lay them out."""
    return F.url_decode(F.regexp_extract(F.input_file_name(), f"/{key}=([^/]+)/", 1))


def read_bars(spark: SparkSession, path: str, market: str | None = None, symbols: Sequence[str] | DataFrame | None = None,
              name: Column | None = None) -> DataFrame:
    """A directory of OHLC CSV files (optionally gzip), one per instrument named by the file, or by ``name``.

    Header names are matched without case, because some files write ``Open`` and some
    ``open``; a file without volume gets NULL. Every file is read with its own header, which meets its rows in the task
    that holds the instrument: no list of files passes through the driver. Of a sequence of ``symbols`` only the files are
    listed; a table with a column ``symbol``, for long lists, is joined. The driver lists the files once, as lines that are taken
    apart by column; folders of files with a ``name`` are no partitions to it. Of rows
    repeated for a day the last one stays. Raises when there is nothing to read.
    """
    few = symbols is not None and not isinstance(symbols, DataFrame)
    pick = spark.read if not few else spark.read.option(
        "pathGlobFilter", "{" + ",".join(re.sub(r"([\\*?\[\]{},])", r"\\\1", s) + ".*" for s in symbols) + "}")
    lines = (pick if name is None else pick.option("recursiveFileLookup", True)).text(path)
    line = _bare(F.col("value"))
    found = lines.where(line.rlike("(^|,)date(,|$)") & line.rlike("(^|,)close(,|$)"))
    width = found.agg(F.max(F.size(F.split(line, ",")))).first()[0]
    if width is None:
        raise FileNotFoundError(f"no bar files under {path}")
    cells = [f"c{k}" for k in range(width)]
    raw = lines.where(F.col("value").rlike(r"[^\x00-\x20]")).withColumn("c", F.from_csv("value", ", ".join(f"`{c}` string" for c in cells)))
    rows = raw.select(F.lit(market or "market").alias("market"), (F.url_decode(_stem(F.input_file_name())) if name is None else name).alias("symbol"),
                      F.xxhash64(F.input_file_name()).alias("_file"), F.monotonically_increasing_id().alias("_order"), *[F.col("c")[c].alias(c) for c in cells])
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(*rows.columns)
    names = F.array(*[_bare(F.coalesce(c, F.lit(""))) for c in cells])
    header = F.when(F.array_contains(names, "date") & F.array_contains(names, "close"), F.struct("_order", names.alias("names")))
    rows = by_instrument(rows).withColumn("_header", F.min(header).over(Window.partitionBy(*KEYS, "_file")))
    rows = rows.where(header.isNull() & (F.col("_order") > F.col("_header._order")))
    cell = lambda c: F.get(F.array(*cells), (F.array_position("_header.names", c) - 1).cast("int"))  # noqa: E731  a name that is missing: NULL
    rows = rows.select(*KEYS, cell("date").alias("date"), *[cell(c).alias(c) for c in BAR_COLUMNS], "_order")
    rows = rows.withColumns({"date": F.to_date(F.substring("date", 1, 10)), **{c: no_nan(F.expr(f"try_cast(`{c}` AS DOUBLE)")) for c in BAR_COLUMNS}})
    return rows.groupBy(*KEYS, "date").agg(*[F.max_by(c, "_order").alias(c) for c in BAR_COLUMNS])


def _bare(text: Column) -> Column:
    """Header text without case, quotes, white space and byte order mark."""
    return F.regexp_replace(F.lower(text), r'[\s"\x{FEFF}]', "")


def normalise(df: DataFrame) -> DataFrame:
    """Caller-supplied bars in engine form: DATE, DOUBLE without NaN, market and symbol present."""
    df = df.toDF(*[c.lower() for c in df.columns])
    if "market" not in df.columns:
        df = df.withColumn("market", F.lit("market"))
    prices = {c: no_nan(F.col(c).cast("double")) for c in BAR_COLUMNS if c in df.columns}
    return by_instrument(df.withColumns({"date": F.col("date").cast("date"), **prices}))


def read_clean(spark: SparkSession, path: str, manifest: DataFrame, markets: Sequence[str] | None = None) -> DataFrame:
    """Clean bars (Parquet, partitioned by market) of the instruments whose manifest status is ok."""
    df = spark.read.parquet(path)
    ok = manifest.where(F.col("status") == "ok").select(*KEYS)
    if markets is not None:  # reaches the scan as a partition filter
        df, ok = df.where(F.col("market").isin(*markets)), ok.where(F.col("market").isin(*markets))
    return listed_only(df, ok)


def listed_only(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """Bars of listed instruments. The planner broadcasts the list when its measured size allows."""
    return bars.join(listed, list(KEYS), "left_semi")


def parse_quotes(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Raw quote JSON, one payload per instrument, to rows for cleaning.

    Epoch seconds become the date at the exchange; a missing adjusted series falls back to
    the close, a missing volume to NULL. A payload without the expected parts yields no rows;
    ``parse_errors`` lists those.
    """
    res = F.get(F.col("j.chart.result"), 0)
    df = payloads.select(*KEYS, F.from_json(text, QUOTE_SCHEMA).alias("j")).select(*KEYS, res.alias("r"))
    q, adj = F.get(F.col("r.indicators.quote"), 0), F.get(F.col("r.indicators.adjclose"), 0)
    df = df.select(*KEYS, F.coalesce("r.meta.exchangeTimezoneName", F.lit("UTC")).alias("tz"),
                   F.col("r.timestamp").alias("ts"), *[q[c].alias(c) for c in BAR_COLUMNS],
                   F.coalesce(adj["adjclose"], q["close"]).alias("adjclose"))
    series = ("open", "high", "low", "close", "adjclose", "volume")
    # Zipping with a missing array would lose the payload; an empty one is filled with NULL.
    df = df.withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in series})
    rows = df.select(*KEYS, "tz", F.posexplode(F.arrays_zip("ts", *series)).alias("ordinal", "v"))
    # A UTC session: the instant shifted to the exchange's wall clock, then its day.
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("v.ts"), F.col("tz")))
    return rows.select(*KEYS, day.alias("date"), "ordinal", *[no_nan(F.col(f"v.{c}")).alias(c) for c in series])


def parse_errors(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Payloads that do not hold timestamps and closes, with the status for the manifest."""
    j = F.from_json(text, QUOTE_SCHEMA)
    df = payloads.select(*KEYS, F.get(j["chart"]["result"], 0).alias("r"))
    bad = F.col("r.timestamp").isNull() | F.get(F.col("r.indicators.quote"), 0)["close"].isNull()
    return df.where(bad).select(*KEYS, F.lit("parse_error: unexpected payload").alias("status"))


def read_quotes(spark: SparkSession, path: str, market: str) -> DataFrame:
    """Quote files as payload rows; one file is one payload, gzip is decoded by the reader."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.lit(market).alias("market"), F.url_decode(_stem(F.input_file_name())).alias("symbol"),
                      F.col("value").alias("payload"))


def read_reference_series(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Two-column CSV ``date, value`` per series, named by the file or by ``name``; unreadable or non-positive values are dropped."""
    df = spark.read.option("header", True).schema("date string, value string").csv(path)
    df = df.select((_stem(F.input_file_name()) if name is None else name).alias("series"), F.expr("try_cast(date AS DATE)").alias("date"),
                   no_nan(F.expr("try_cast(value AS DOUBLE)")).alias("value"))
    return df.where(F.col("date").isNotNull() & (F.col("value") > 0))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, digest and length of every file as stored."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256_raw_bytes"), F.col("length").alias("bytes"))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """New rows replace old rows with the same key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_clean(bars: DataFrame, path: str) -> None:
    bars.write.mode("overwrite").partitionBy("market").parquet(path)


def write_trades(trades: DataFrame, path: str) -> None:
    """Trades partitioned by strategy and market, replacing only the partitions written."""
    (trades.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "market")
     .parquet(path))


def read_trades(spark: SparkSession, path: str, strategy: str | None = None, market: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for c, v in (("strategy", strategy), ("market", market)):
        df = df if v is None else df.where(F.col(c) == v)
    return df


def significant_digits(x: Column, digits: int = 8) -> Column:
    """Value rounded to a number of significant digits, for text output of fixed precision."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Result table as CSV with a header; doubles optionally cut to significant digits."""
    if digits is not None:
        df = df.withColumns({n: significant_digits(F.col(n), digits) for n, t in df.dtypes if t == "double"})
    df.write.mode("overwrite").option("header", True).csv(path)


def write_daily(daily: DataFrame, path: str) -> None:
    """Long-format daily returns, one row per series and date."""
    daily.dropDuplicates(["strategy", "variant", "freeze", "date"]).write.mode("overwrite").parquet(path)
