"""Forward-looking training labels. A label that is not resolved by the data is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, by_time, next_n


def forward_closes(horizon: int, keys: Sequence[str] = KEYS) -> Column:
    """The next ``horizon`` closes; shorter than that near the end of the history."""
    return F.collect_list("close").over(next_n(keys, horizon))


def _unusable_atr() -> Column:
    return F.col("atr").isNull() | (F.col("atr") == 0)


def label_linearity(df: DataFrame, keys: Sequence[str] = KEYS, horizon: int = 15, r2_min: float = 0.5,
                    out: str = "label") -> DataFrame:
    """1 when a straight line explains the next closes well; a flat stretch is not a trend."""
    frame = next_n(keys, horizon)
    df = df.withColumn("_t", F.row_number().over(by_time(keys)).cast("double"))
    fit = F.when(F.var_pop("close").over(frame) == 0, 0.0).otherwise(F.regr_r2(F.col("close"), F.col("_t")).over(frame))
    return df.withColumn(out, F.when(F.count("close").over(frame) >= horizon, (fit >= r2_min).cast("int"))).drop("_t")


def label_excursion(df: DataFrame, keys: Sequence[str] = KEYS, horizon: int = 15, k: float = 1.5,
                    out: str = "label") -> DataFrame:
    """1 when, along the net move, the best excursion reaches k ATR before the worst falls to -k ATR."""
    df = df.withColumn("_ahead", forward_closes(horizon, keys))
    side = F.when(F.element_at("_ahead", -1) < F.col("close"), -1.0).otherwise(1.0)
    df = df.withColumn("_gain", F.when(F.size("_ahead") >= horizon, F.transform(
        "_ahead", lambda c: (c - F.col("close")) * side)))
    df = df.withColumn("_best", F.array_max("_gain"))
    path = F.expr("slice(_gain, 1, CAST(array_position(_gain, _best) AS INT))")
    good = (F.col("_best") >= k * F.col("atr")) & (F.array_min(path) > -k * F.col("atr"))
    known = F.col("_gain").isNotNull() & ~_unusable_atr()
    return df.withColumn(out, F.when(known, good.cast("int"))).drop("_ahead", "_gain", "_best")


def label_move_size(df: DataFrame, keys: Sequence[str] = KEYS, horizon: int = 15, k: float = 1.5,
                    out: str = "label") -> DataFrame:
    """1 when the close ``horizon`` bars ahead is at least k ATR away."""
    ahead = F.lead("close", horizon).over(by_time(keys))
    far = F.abs(ahead - F.col("close")) >= k * F.col("atr")
    return df.withColumn(out, F.when(ahead.isNotNull() & ~_unusable_atr(), far.cast("int")))


def label_bracket(df: DataFrame, direction: int, keys: Sequence[str] = KEYS, horizon: int = 40, sl_mult: float = 1.5,
                  tp_mult: float = 3.0, out: str = "label") -> DataFrame:
    """1 when the target comes before the stop, 0 when the stop comes first, NULL when neither comes."""
    d = float(direction)
    df = df.withColumn("_ahead", F.transform(forward_closes(horizon, keys), lambda c: c * d))
    df = df.withColumns({"_stop": F.col("close") * d - sl_mult * F.col("atr"),
                         "_goal": F.col("close") * d + tp_mult * F.col("atr")})
    df = df.withColumns({
        "_s": F.expr("nullif(array_position(transform(_ahead, c -> c <= _stop), true), 0)"),
        "_g": F.expr("nullif(array_position(transform(_ahead, c -> c >= _goal), true), 0)")})
    won = F.col("_g").isNotNull() & (F.col("_s").isNull() | (F.col("_g") < F.col("_s")))
    touched = F.col("_g").isNotNull() | F.col("_s").isNotNull()
    return (df.withColumn(out, F.when(touched & ~_unusable_atr(), won.cast("int")))
            .drop("_ahead", "_stop", "_goal", "_s", "_g"))


def label_continuation(df: DataFrame, direction: int, keys: Sequence[str] = KEYS, horizon: int = 10,
                       out: str = "label") -> DataFrame:
    """1 when a position in ``direction`` is in profit ``horizon`` bars later."""
    ahead = F.lead("close", horizon).over(by_time(keys))
    return df.withColumn(out, (direction * (ahead - F.col("close")) > 0).cast("int"))


def resolved_before(split, horizon: int, keys: Sequence[str] = KEYS) -> Column:
    """The bar and the end of its label window both lie before the freeze date."""
    split = F.lit(split).cast("date")
    return (F.col("date") < split) & F.coalesce(F.lead("date", horizon).over(by_time(keys)) < split, F.lit(False))
