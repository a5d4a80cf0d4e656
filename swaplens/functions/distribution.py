"""Normal distribution: a column function for the CDF, plain values for constants."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


TERMS = 120  # enough for full precision up to FAR
FAR = 8.5  # standard deviations beyond which the CDF is 0 or 1 to double precision


def norm_cdf(x: Column) -> Column:
    """``0.5 + pdf(x) * (x + x^3/3 + x^5/15 + ...)``, summed from the last term by Horner's rule inside the JVM."""
    series = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), F.lit(1.0), lambda a, k: 1.0 + a * x * x / (2.0 * k + 1.0))
    near = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * x * series
    return F.when(x.isNull() | F.isnan(x), x).when(x > FAR, 1.0).when(x < -FAR, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def expected_best(n_trials: int) -> float:
    """Expected maximum, in standard deviations, of ``n_trials`` independent null Sharpe ratios."""
    if n_trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e))


def deflated_sharpe(mean: Column, sd: Column, skew: Column, kurt: Column, n: Column, n_trials: int | Column) -> Column:
    """Probability that the Sharpe ratio beats the best of ``n_trials`` null strategies.

    ``kurt`` is the plain (not excess) kurtosis; moments are population moments, ``sd`` the
    sample deviation. 0 when there are fewer than three days or no variation. A column for
    ``n_trials`` holds the expected-best multiple itself.
    """
    sr = F.try_divide(mean, sd)
    spread = F.sqrt(F.greatest(F.try_divide(1 - skew * sr + (kurt - 1) / 4 * sr * sr, n - 1), F.lit(1e-12)))
    best = n_trials if isinstance(n_trials, Column) else F.lit(expected_best(n_trials))
    return F.when((n < 3) | F.coalesce(sd == 0, F.lit(True)), 0.0).otherwise(norm_cdf((sr - spread * best) / spread))
