"""NULL-safe column helpers and the window frames every per-instrument operator uses.

Missing values are SQL NULL everywhere (never NaN), divisions go through ``try_divide`` so
that ANSI mode cannot fail a job on a flat price, and a comparison with a missing value is
false where the semantics say so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS = ("market", "symbol")
FOLD_KEYS = (*KEYS, "fold")


def by_instrument(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Hash-partition on the instrument, once, for a whole chain of per-instrument operators.

    The chain computes far more per byte than a plain scan, so it keeps the configured number
    of shuffle partitions instead of letting small partitions be merged by size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[k for k in keys if k in KEYS] or keys)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero denominator."""
    return F.try_divide(num, den)


def is_true(cond: Column) -> Column:
    """A comparison in which a missing operand counts as false."""
    return F.coalesce(cond, F.lit(False))


def no_nan(x: Column) -> Column:
    """NaN to NULL, for values that come from files or from a model."""
    return F.when(F.isnan(x), None).otherwise(x)


def by_time(keys: Sequence[str], order: str = "date") -> WindowSpec:
    """The ordered window of one instrument (or one fold of it).

    ``(keys, date)`` is unique after cleaning, so a partition holds at most one row per
    calendar day: its size is bounded by the calendar and not by the size of the table.
    """
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str], order: str = "date") -> WindowSpec:
    return by_time(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running(keys: Sequence[str], order: str = "date") -> WindowSpec:
    return by_time(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_n(keys: Sequence[str], n: int, order: str = "date") -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return by_time(keys, order).rowsBetween(-(n - 1), 0)


def prior_n(keys: Sequence[str], n: int, order: str = "date") -> WindowSpec:
    """The ``n`` rows strictly before the current one."""
    return by_time(keys, order).rowsBetween(-n, -1)


def next_n(keys: Sequence[str], n: int, order: str = "date") -> WindowSpec:
    """The ``n`` rows strictly after the current one."""
    return by_time(keys, order).rowsBetween(1, n)


def rolling(agg: Callable[[Column], Column], x: Column, frame: WindowSpec, min_rows: int) -> Column:
    """``agg(x)`` over ``frame``, NULL until ``min_rows`` non-missing values are in it."""
    value = agg(x).over(frame)
    return value if min_rows <= 1 else F.when(F.count(x).over(frame) >= min_rows, value)


def change(x: Column, keys: Sequence[str], k: int = 1, order: str = "date") -> Column:
    return x - F.lag(x, k).over(by_time(keys, order))


def pct_change(x: Column, keys: Sequence[str], k: int = 1, order: str = "date") -> Column:
    return ratio(x, F.lag(x, k).over(by_time(keys, order))) - 1.0


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp that keeps NULL as NULL (``greatest`` alone would turn it into the bound)."""
    y = x
    if lo is not None:
        y = F.when(y < lo, F.lit(float(lo))).otherwise(y)
    if hi is not None:
        y = F.when(y > hi, F.lit(float(hi))).otherwise(y)
    return y


def compound(r: Column) -> Column:
    """Aggregate ``prod(1 + r) - 1``."""
    return F.product(1.0 + r) - 1.0


def in_window(when: Column, lo, hi=None) -> Column:
    """Half-open date window ``lo <= when < hi``; ``hi`` may be missing."""
    cond = when >= F.lit(lo).cast("date")
    return cond if hi is None else cond & (when < F.lit(hi).cast("date"))
