"""Cleaning of raw quotes into bars, with a per-rule audit.

Input rows: ``market, symbol, date, ordinal, open, high, low, close, adjclose, volume`` where
``ordinal`` is the arrival order. Duplicate days are reduced by an aggregate with map-side
combine, so a symbol or day that is repeated without limit cannot overload one task; after
that step an instrument has at most one row per calendar day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, by_time, is_true, ratio, whole

PRICES = ("open", "high", "low", "close")


@dataclass(frozen=True)
class CleaningRules:
    use_adjusted: bool = True
    drop_nonpositive: bool = True
    repair_ohlc: bool = True
    max_abs_daily_return: float = 0.75
    min_rows: int = 1000


def keep_last(raw: DataFrame) -> DataFrame:
    """One row per instrument and day, the one that arrived last; ``copies`` counts the input rows."""
    rest = [c for c in raw.columns if c not in (*KEYS, "date", "ordinal")]
    last = [F.max_by(c, "ordinal").alias(c) for c in rest]  # one primitive buffer per column keeps a hash aggregate
    return raw.groupBy(*KEYS, "date").agg(*last, F.count(F.lit(1)).alias("copies"))


def unusable(rules: CleaningRules) -> Column:
    """Missing close, or any price at or below zero when that rule is on."""
    bad = F.col("close").isNull()
    if rules.drop_nonpositive:
        for c in PRICES:
            bad = bad | is_true(F.col(c) <= 0)
    return bad


def fill_flat(df: DataFrame) -> DataFrame:
    """A missing open, high or low becomes the close; no range is invented."""
    return df.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})


def adjust(df: DataFrame) -> DataFrame:
    """Scale the four prices by adjusted close over close."""
    factor = F.when(F.col("adjclose") > 0, ratio(F.col("adjclose"), F.col("close"))).otherwise(1.0)
    return df.withColumn("_f", factor).withColumns({c: F.col(c) * F.col("_f") for c in PRICES}).drop("_f")


def repair(df: DataFrame) -> DataFrame:
    """Widen high and low so that they contain open and close; ``repaired`` marks changed rows."""
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    return df.withColumns({"repaired": is_true((F.col("low") > lo) | (F.col("high") < hi)),
                           "low": F.least(F.col("low"), lo), "high": F.greatest(F.col("high"), hi)})


def bad_tick(max_abs_return: float, keys=KEYS) -> tuple[Column, Column]:
    """Return and next return of a bar; together they tell an implausible move that reverses."""
    w = by_time(keys)
    r = ratio(F.col("close"), F.lag("close").over(w)) - 1.0
    nxt = ratio(F.lead("close").over(w), F.col("close")) - 1.0
    return r, is_true((F.abs(r) > max_abs_return) & (F.abs(nxt) > max_abs_return / 2))


def flag_rows(raw: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Every distinct day with repaired and adjusted prices and the flags of each rule.

    Unusable rows stay in, flagged; the return checks run on usable rows only.
    """
    df = keep_last(raw)
    df = df.withColumn("unusable", unusable(rules))
    df = fill_flat(df)
    if rules.use_adjusted:
        df = adjust(df)
    df = repair(df) if rules.repair_ohlc else df.withColumn("repaired", F.lit(False))
    _, spike = bad_tick(rules.max_abs_daily_return, (*KEYS, "unusable"))
    return df.withColumns({"repaired": F.col("repaired") & ~F.col("unusable"),
                           "bad_tick": spike & ~F.col("unusable")})


def clean(raw: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Clean bars of every instrument with enough history."""
    rows = flag_rows(raw, rules).where(~F.col("unusable") & ~F.col("bad_tick"))
    return enough_history(rows.select(*KEYS, "date", *PRICES, "volume"), rules.min_rows)


def enough_history(bars: DataFrame, min_rows: int) -> DataFrame:
    counted = bars.withColumn("_n", F.count(F.lit(1)).over(whole(KEYS)))
    return counted.where(F.col("_n") >= min_rows).drop("_n")


def eight_digits(x: str) -> Column:
    """Text of a price with eight significant digits."""
    return F.format_string("%.7e", F.col(x)).cast("double").cast("string")


def bar_line() -> Column:
    """One clean bar as a line of text, prices with eight significant digits."""
    return F.concat_ws(",", F.col("date").cast("string"), *[eight_digits(c) for c in (*PRICES, "volume")])


def audit(raw: DataFrame, rules: CleaningRules = CleaningRules(), universe: DataFrame | None = None,
          errors: DataFrame | None = None) -> DataFrame:
    """Manifest: per instrument the rows lost to each rule, first and last day, digest, status.

    ``universe`` (``market, symbol``) adds planned instruments that have no quotes at all;
    ``errors`` (``market, symbol, status``) tells those apart whose payload could not be read.
    The digest covers the ordered lines of one instrument, at most one per calendar day.
    """
    kept = ~F.col("unusable") & ~F.col("bad_tick")
    out = flag_rows(raw, rules).groupBy(*KEYS).agg(
        F.sum("copies").alias("raw_rows"), F.sum(F.col("copies") - 1).alias("duplicate_dates"),
        F.count_if("unusable").alias("missing_or_nonpositive"), F.count_if("repaired").alias("ohlc_repaired"),
        F.count_if("bad_tick").alias("bad_ticks"), F.count_if(kept).alias("clean_rows"),
        F.min(F.when(kept, F.col("date"))).alias("first"), F.max(F.when(kept, F.col("date"))).alias("last"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(kept, bar_line()))), "\n"), 256).alias("sha256_csv"))
    status = F.when(F.col("clean_rows") < rules.min_rows, "excluded_min_rows").otherwise("ok")
    if universe is not None:
        out = universe.select(*KEYS).join(out, list(KEYS), "left")
        status = F.when(F.col("raw_rows").isNull(), "no_raw_file").otherwise(status)
    if errors is not None:
        unread = errors.groupBy(*KEYS).agg(F.min("status").alias("_unread"))
        out = out.join(unread, list(KEYS), "full" if universe is None else "left")
        status = F.when(F.col("raw_rows").isNull() & F.col("_unread").isNotNull(), F.col("_unread")).otherwise(status)
    out = out.withColumn("status", status).drop("_unread")
    ok = F.col("status") == "ok"
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("first", "last", "sha256_csv")})


def universe_summary(manifest: DataFrame) -> DataFrame:
    """Per market: instruments, span, median history and what cleaning changed."""
    return manifest.where(F.col("status") == "ok").groupBy("market").agg(
        F.count(F.lit(1)).alias("instruments"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.median("clean_rows").alias("median_rows"), F.sum("ohlc_repaired").alias("rows_repaired"),
        F.sum("missing_or_nonpositive").alias("rows_dropped"))


def spot_check_summary(checks: DataFrame) -> DataFrame:
    """Days compared by hand, instruments covered and the largest difference."""
    return checks.agg(F.count(F.lit(1)).alias("days"), F.countDistinct("symbol").alias("symbols"),
                      F.max("abs_diff").alias("max_abs_diff"))


def cross_validate(bars: DataFrame, reference: DataFrame, min_overlap: int = 250, every: int = 5) -> DataFrame:
    """Compare closes with a second source, trying the series as quoted and inverted.

    ``reference``: ``market, symbol, date, value`` (positive). Per instrument the orientation
    with the smaller median relative price difference is kept; instruments whose overlap is
    too short get the status ``too_little_overlap``.
    """
    joined = bars.select(*KEYS, "date", "close").join(reference.where(F.col("value") > 0), [*KEYS, "date"])
    both = joined.select(*KEYS, "date", "close", F.explode(F.expr(
        "array(named_struct('orientation', 'as_is', 'v', value), "
        "named_struct('orientation', 'inverted', 'v', 1D / value))")).alias("o"))
    both = both.select(*KEYS, "date", "close", "o.orientation", F.col("o.v").alias("v"))
    side = (*KEYS, "orientation")
    w = by_time(side)
    df = both.withColumn("_i", F.row_number().over(w) - 1)
    sparse = (*side, "_nth")
    df = df.withColumn("_nth", F.col("_i") % every == 0)
    def ret(c, win):
        return ratio(F.col(c), F.lag(c).over(win)) - 1.0
    df = df.withColumns({"_rc": ret("close", w), "_rv": ret("v", w)})
    ws = by_time(sparse)
    df = df.withColumns({"_sc": F.when(F.col("_nth"), ret("close", ws)), "_sv": F.when(F.col("_nth"), ret("v", ws))})
    stats = df.groupBy(*side).agg(
        F.count(F.lit(1)).alias("overlap_days"), F.min("date").alias("first"), F.max("date").alias("last"),
        safe_corr("_rc", "_rv").alias("return_corr"), safe_corr("_sc", "_sv").alias("return_corr_5d"),
        F.median(F.abs(ratio(F.col("close"), F.col("v")) - 1.0)).alias("median_abs_pct_diff"))
    fit = stats.where(F.col("overlap_days") >= min_overlap)
    rest = [c for c in fit.columns if c not in KEYS]
    # Ties go to the orientation as quoted, which sorts first.
    best = fit.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), F.struct("median_abs_pct_diff", "orientation")).alias("b"))
    planned = reference.select(*KEYS).distinct().join(bars.select(*KEYS).distinct().withColumn("_have", F.lit(True)),
                                                      list(KEYS), "left")
    out = planned.join(best.select(*KEYS, "b.*"), list(KEYS), "left")
    status = (F.when(F.col("_have").isNull(), "missing").when(F.col("overlap_days").isNull(), "too_little_overlap")
              .otherwise("ok"))
    return out.select(*KEYS, status.alias("status"), *rest)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate that is NULL, not an error, for a flat side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
