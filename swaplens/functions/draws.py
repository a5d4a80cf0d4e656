"""Reproducible resampling positions as plain integer arithmetic.

A draw is a pure function of (replicate, slot, seed), so a task that is re-run after an
executor loss draws the same days again. The mixing is an affine step followed by the fifth
power modulo the prime 2^31 - 1; it is twice applied and needs no engine hash, which makes
the same draw available in SQL, in Spark columns and in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the draw.
PRIME = 2147483647
STEP_REP, STEP_SLOT, STEP_SEED, STEP_ONE = 7919, 104729, 1299709, 15485863
STEP_AGAIN = 48271


def _fifth_np(x: np.ndarray) -> np.ndarray:
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draw_np(rep, slot, seed: int, n: int) -> np.ndarray:
    rep, slot = np.asarray(rep, dtype=np.int64), np.asarray(slot, dtype=np.int64)
    x = _fifth_np((rep * STEP_REP + slot * STEP_SLOT + seed * STEP_SEED + STEP_ONE) % PRIME)
    return _fifth_np((x * STEP_AGAIN + rep + slot) % PRIME) % n


def _fifth(x: str) -> str:
    square = f"(({x}) * ({x}) % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * ({x}) % {PRIME})"


def draw_sql(rep: str, slot: str, seed: int, n: str) -> str:
    """SQL text of the draw; ``rep`` and ``slot`` must be BIGINT expressions."""
    first = _fifth(f"(({rep}) * {STEP_REP} + ({slot}) * {STEP_SLOT} + {seed * STEP_SEED + STEP_ONE}) % {PRIME}")
    again = f"({first} * {STEP_AGAIN} + ({rep}) + ({slot})) % {PRIME}"
    return f"({_fifth(again)}) % ({n})"


def draw(rep: str, slot: str, seed: int, n: str) -> Column:
    return F.expr(draw_sql(rep, slot, seed, n))
