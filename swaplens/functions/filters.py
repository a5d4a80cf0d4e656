"""Recursive price filters (EMA, RSI, MACD, JMA, KAMA) over per-instrument price arrays.

A window frame cannot express a value that depends on its own previous value. All of these
filters are linear recurrences, so a block of prices maps to outputs by one matrix product
and only a small state is carried from block to block. They run as one Arrow UDF over an
array column; the rows stay partitioned by instrument, so no shuffle is added.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import by_instrument

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64


@dataclass(frozen=True)
class Filter:
    """One recursive output column: ``kind`` with its numeric arguments."""

    out: str
    kind: str
    args: tuple[float, ...]


def ema(length: int = 20) -> Filter:
    return Filter(f"ema_{length}", "ema", (length,))


def rsi(length: int = 14) -> Filter:
    return Filter(f"rsi_{length}", "rsi", (length,))


def macd_hist(fast: int = 12, slow: int = 26, signal: int = 9) -> Filter:
    return Filter("macd_hist" if (fast, slow, signal) == (12, 26, 9) else f"macd_hist_{fast}_{slow}_{signal}",
                  "macd_hist", (fast, slow, signal))


def kama(length: int = 3, fast: int = 2, slow: int = 50) -> Filter:
    return Filter("kama" if (length, fast, slow) == (3, 2, 50) else f"kama_{length}_{fast}_{slow}",
                  "kama", (length, fast, slow))


def jma(length: int = 7, phase: float = 0.0, power: float = 2.0) -> Filter:
    plain = (phase, power) == (0.0, 2.0)
    return Filter(f"jma_{length}" if plain else f"jma_{length}_{phase:g}_{power:g}".replace("-", "m").replace(".", "p"),
                  "jma", (length, phase, power))


def _blocks(x: np.ndarray) -> np.ndarray:
    rows = -(-len(x) // BLOCK)
    return np.pad(x, (0, rows * BLOCK - len(x))).reshape(rows, BLOCK)


_KNOWN: dict = {}


def _responses(step: tuple, gain: tuple):
    """Block matrices of a recurrence: own-block response, closing state, carried response."""
    if (step, gain) in _KNOWN:
        return _KNOWN[step, gain]
    m = len(gain)
    powers = np.empty((BLOCK + 1, m, m))
    powers[0] = np.eye(m)
    for k in range(BLOCK):
        powers[k + 1] = np.array(step) @ powers[k]
    impulse = powers[:BLOCK] @ np.array(gain)
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0), 0], 0.0)
    _KNOWN[step, gain] = response.T.copy(), impulse[::-1].copy(), powers[1:, 0, :].T.copy(), powers[BLOCK]
    return _KNOWN[step, gain]


def linear_filter(x: np.ndarray, step: tuple, gain: tuple, start: tuple) -> np.ndarray:
    """First component of ``s_t = step @ s_{t-1} + gain * x_t`` with ``s_{-1} = start``."""
    response, closing, carry, advance = _responses(step, gain)
    xb = _blocks(x)
    ends = xb @ closing
    carried = np.empty((len(xb), len(gain)))
    state = np.array(start, dtype=float)
    for b in range(len(xb)):
        carried[b] = state
        state = advance @ state + ends[b]
    return (xb @ response + carried @ carry).ravel()[: len(x)]


def _decay(x: np.ndarray, decay: float, weight: float, start: float) -> np.ndarray:
    return linear_filter(x, ((decay,),), (weight,), (start,))


def _level(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that starts at its first value."""
    return _decay(x, 1 - alpha, alpha, x[0])


def _weighted(x: np.ndarray, span: float) -> np.ndarray:
    """Exponential mean normalised by the weights seen so far."""
    d = 1 - 2 / (span + 1)
    return _decay(x, d, 1.0, 0.0) * (1 - d) / (1 - d ** np.arange(1, len(x) + 1))


def _ema(p, length):
    return _level(p, 2 / (length + 1))


def _rsi(p, length):
    out = np.full(len(p), np.nan)
    if len(p) > 1:
        move = np.diff(p)
        up, down = _level(np.maximum(move, 0), 1 / length), _level(np.maximum(-move, 0), 1 / length)
        out[1:] = 100 - 100 / (1 + up / np.where(down == 0, 1e-12, down))
    return out


def _macd_hist(p, fast, slow, signal):
    line = _weighted(p, fast) - _weighted(p, slow)
    return line - _weighted(line, signal)


def _kama(p, length, fast, slow):
    length = int(length)
    hold = min(length, len(p))
    pace = np.zeros(len(p))
    if len(p) > length:
        path = np.convolve(np.abs(np.diff(p)), np.ones(length), "valid")
        net = np.abs(p[length:] - p[:-length])
        quick, lazy = 2 / (fast + 1), 2 / (slow + 1)
        share = np.divide(net, path, out=np.zeros_like(net), where=path > 0)
        pace[hold:] = np.where(path > 0, (share * (quick - lazy) + lazy) ** 2, 0.0)
    # k_t = (1 - pace_t) k_{t-1} + pace_t p_t: divide by the running product of (1 - pace)
    # inside a block; every term is positive, so nothing cancels.
    keep, add = _blocks(1 - pace), _blocks(pace * p)
    keep[-1, len(p) - (len(keep) - 1) * BLOCK:] = 1.0
    shrink = np.cumprod(keep, axis=1)
    inner = np.cumsum(add / shrink, axis=1)
    out, level = np.empty_like(inner), p[0]
    for b in range(len(out)):
        out[b] = shrink[b] * (level + inner[b])
        level = out[b, -1]
    return out.ravel()[: len(p)]


def _jma(p, length, phase, power):
    lead = min(max(phase / 100 + 1.5, 0.5), 2.5)
    beta = 0.45 * (length - 1) / (0.45 * (length - 1) + 2)
    alpha = beta ** power
    base = _decay(p, alpha, 1 - alpha, p[0])
    detail = _decay(p - base, beta, 1 - beta, p[0])
    pull, hold = (1 - alpha) ** 2, alpha ** 2
    return linear_filter(base + lead * detail, ((1 - pull, hold), (-pull, hold)), (pull, pull), (p[0], p[0]))


KERNELS = {"ema": _ema, "rsi": _rsi, "macd_hist": _macd_hist, "kama": _kama, "jma": _jma}


def filter_arrays(price: Column, filters: Sequence[Filter]) -> Column:
    """Struct of arrays, one per filter, aligned with the ``price`` array of the row."""
    plan = [(f.kind, f.args) for f in filters]
    returns = "struct<" + ",".join(f"`{f.out}`:array<double>" for f in filters) + ">"
    names = [f.out for f in filters]

    def apply(prices: pa.Array) -> pa.Array:
        offsets = prices.offsets.to_numpy()
        flat = prices.flatten().to_numpy(zero_copy_only=False).astype(float)
        offsets = offsets - offsets[0]
        outs = [np.full(len(flat), np.nan) for _ in plan]
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            if hi > lo:
                for out, (kind, args) in zip(outs, plan):
                    out[lo:hi] = KERNELS[kind](flat[lo:hi], *args)
        at = pa.array(offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(out, mask=np.isnan(out))) for out in outs]
        return pa.StructArray.from_arrays(lists, names)

    apply.__annotations__ = {"prices": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, returnType=returns)(price)


def with_filters(df: DataFrame, filters: Sequence[Filter], keys: Sequence[str], price: str = "close",
                 order: str = "date") -> DataFrame:
    """Add one column per filter, computed over the rows of each ``keys`` group in ``order``.

    The rows of a group (at most one per calendar day) are packed into arrays on the exchange
    the window operators below use, filtered, and unpacked again. A Python stage hides its
    partitioning from the planner, so the result is partitioned by instrument once more for
    the windows and scans above.
    """
    filters = list({f.out: f for f in filters}.values())
    if not filters:
        return df
    rest = [c for c in df.columns if c not in keys]
    first = [order, *[c for c in rest if c != order]]
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("rows"))
    packed = packed.withColumn("f", filter_arrays(F.col(f"rows.{price}"), filters))
    zipped = F.arrays_zip(F.col("rows"), *[F.col(f"f.{f.out}").alias(f.out) for f in filters])
    flat = packed.select(*keys, F.explode(zipped).alias("z"))
    flat = flat.select(*keys, *[F.col(f"z.rows.{c}").alias(c) for c in rest],
                       *[F.col(f"z.{f.out}").alias(f.out) for f in filters])
    return by_instrument(flat, keys)
