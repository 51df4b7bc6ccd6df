"""Normal distribution and Sharpe-ratio inference as column expressions.

The distribution function is the double-precision rational form of West (2005); the quantile is the
rational form of Acklam (1998).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Coefficients, highest power first, and breakpoints.
CDF_NUM = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DEN = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SPLIT = 7.07106781186547
CDF_CLAMP = 8.3
ROOT_TWO_PI = 2.506628274631
INV_CENTRAL_NUM = (
    -39.69683028665376, 220.9460984245205, -275.9285104469687,
    138.3577518672690, -30.66479806614716, 2.506628277459239,
)
INV_CENTRAL_DEN = (
    -54.47609879822406, 161.5858368580409, -155.6989798598866,
    66.80131188771972, -13.28068155288572, 1.0,
)
INV_TAIL_NUM = (
    -0.007784894002430293, -0.3223964580411365, -2.400758277161838,
    -2.549732539343734, 4.374664141464968, 2.938163982698783,
)
INV_TAIL_DEN = (
    0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0,
)
INV_LOW = 0.02425
EULER_GAMMA = 0.5772156649015329


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it by name inside `body`, which keeps nested formulas small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phi(x: Column) -> Column:
    """Standard normal distribution function, exactly 0 or 1 beyond |x| = 8.3."""
    return _bound(x.cast("double"), _phi)


def _phi(x: Column) -> Column:
    z = F.abs(x)
    density = F.exp(-z * z / 2.0)
    near = density * _horner(CDF_NUM, z) / _horner(CDF_DEN, z)
    fraction = z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))
    tail = F.when(z < CDF_SPLIT, near).otherwise(density / fraction / ROOT_TWO_PI)
    return (
        F.when(x >= CDF_CLAMP, F.lit(1.0)).when(x <= -CDF_CLAMP, F.lit(0.0))
        .when(x > 0, 1.0 - tail).otherwise(tail)
    )


def phi_inv(p: Column) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    return _bound(p.cast("double"), _phi_inv)


def _phi_inv(p: Column) -> Column:
    def tail(q: Column) -> Column:
        return _horner(INV_TAIL_NUM, q) / _horner(INV_TAIL_DEN, q)

    centred = p - 0.5
    r = centred * centred
    central = _horner(INV_CENTRAL_NUM, r) * centred / _horner(INV_CENTRAL_DEN, r)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < INV_LOW, tail(F.sqrt(-2.0 * F.ln(p))))
        .when(p > 1.0 - INV_LOW, -tail(F.sqrt(-2.0 * F.ln(1.0 - p))))
        .otherwise(central)
    )


def sharpe_variance(sr: Column, skew: Column, kurt: Column) -> Column:
    """Per-observation variance of a Sharpe estimate; kurtosis is the non-excess kind."""
    return 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr


def psr(sr: Column, benchmark: Column, t: Column, skew: Column, kurt: Column) -> Column:
    """Probability that the true Sharpe ratio exceeds the benchmark; NULL where undefined."""
    v = sharpe_variance(sr, skew, kurt)
    return F.when((t >= 2) & (v > 0), phi((sr - benchmark) * F.sqrt(t - 1.0) / F.sqrt(v)))


def expected_max_sharpe(trial_variance: Column, trials: Column) -> Column:
    """Expected best Sharpe among independent trials without skill; zero for a single trial."""
    n = trials.cast("double")
    blend = (1.0 - EULER_GAMMA) * phi_inv(1.0 - 1.0 / n) + EULER_GAMMA * phi_inv(1.0 - 1.0 / (n * math.e))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.sqrt(trial_variance) * blend)


def dsr(sr: Column, t: Column, skew: Column, kurt: Column, trial_variance: Column, trials: Column) -> Column:
    """Sharpe significance after deflation for the number of trials."""
    valid = (trials >= 1) & (trial_variance >= 0)
    return F.when(valid, psr(sr, expected_max_sharpe(trial_variance, trials), t, skew, kurt))


def min_track_record(sr: Column, benchmark: Column, alpha: Column, skew: Column, kurt: Column) -> Column:
    """Observations needed to reject the benchmark at level alpha; NULL if the Sharpe is not above it."""
    v = sharpe_variance(sr, skew, kurt)
    z = phi_inv(1.0 - alpha) / (sr - benchmark)
    return F.when((sr > benchmark) & (v > 0), 1.0 + v * z * z)
