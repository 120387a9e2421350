"""Distribution functions over numpy arrays, and the column functions made of them.

Built from the incomplete gamma and beta functions (series and continued fractions, Lentz's
form, as many parts as the arguments need; the uniform expansion for gamma functions of
large arguments) and bisection for inverses. Each column function is a pandas UDF: whole Arrow batches,
never a row at a time. Nulls and arguments outside a function's domain give null.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

log_gamma = np.vectorize(lambda x: math.lgamma(x) if x > 0 else math.nan, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
TINY, STEPS = 1e-300, 400
#: From here the incomplete gamma function is expanded, to some 1e-10; below, STEPS terms suffice.
LARGE = 1000.0
# The expansion's first two coefficients as power series.
FIRST = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -0.000178755144032922, 3.91926317852244e-05)
SECOND = (-1 / 540, -1 / 288, 1 / 378, -0.000990226337448560, 0.000205761316872428)
NORMAL = statistics.NormalDist()


def norm_cdf(x):
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def inverse(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """x with cdf(x) = p, for an ascending cdf; the upper bound grows as needed."""
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(60):
        short = cdf(b) < p
        if not short.any():
            break
        b = np.where(short, b * 2 + 1, b)
    for _ in range(200):
        m = (a + b) / 2
        below = cdf(m) < p
        a, b = np.where(below, m, a), np.where(below, b, m)
    return np.where((p > 0) & (p < 1), (a + b) / 2, np.nan)


_quantile = np.vectorize(lambda p: NORMAL.inv_cdf(p) if 0 < p < 1 else math.nan, otypes=[float])


def norm_inv(p):
    return _quantile(np.asarray(p, float))


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of the lower incomplete gamma function, for x under a + 1. Ends once no term counts any more."""
    term = total = 1 / a
    for n in range(1, STEPS):
        term = term * x / (a + n)
        total = total + term
        if not n % 8 and (term <= 1e-17 * total).all():
            break
    return total


def _lentz(first: np.ndarray, step: Callable[[int], tuple], steps: int = STEPS) -> np.ndarray:
    """A continued fraction 1 / (first + k1 / (b1 + k2 / (b2 + ...))); step(n): k and b of the nth part. Ends once no part counts any more."""
    bound = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.full_like(first, 1 / TINY), 1 / bound(first)
    h = d
    for n in range(1, steps):
        k, b = step(n)
        d = 1 / bound(b + k * d)
        c = bound(b + k / c)
        h = h * d * c
        if not n % 8 and (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def _expanded(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function of a large a, uniformly in x."""
    m = x / a - 1
    half = np.where(np.abs(m) < 1e-3, m * m * (0.5 - m / 3 + m * m / 4 - m**3 / 5), m - np.log1p(m))
    eta = np.sign(m) * np.sqrt(2 * half)
    near = np.abs(eta) < 0.1
    e, d = np.where(near, 1.0, eta), np.where(near, 1.0, m)
    first = np.where(near, np.polynomial.polynomial.polyval(eta, FIRST), 1 / d - 1 / e)
    second = np.where(near, np.polynomial.polynomial.polyval(eta, SECOND), 1 / e**3 - 1 / d**3 - 1 / d**2 - 1 / (12 * d))
    rest = np.exp(-a * half) / np.sqrt(2 * np.pi * a) * (first + second / a)
    return np.clip(0.5 * (1 + erf(eta * np.sqrt(a / 2))) - rest, 0, 1)


def gamma_p(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    shape, a, x = a.shape, np.atleast_1d(a), np.atleast_1d(x)
    out = np.zeros(a.shape)
    large = (a > LARGE) & (x > 0)
    low, high = (x > 0) & (x < a + 1) & ~large, (x >= a + 1) & ~large
    with np.errstate(all="ignore"):
        if large.any():
            out[large] = _expanded(a[large], x[large])
        for own in (low, high):
            u, v = a[own], x[own]
            front = np.exp(-v + u * np.log(np.maximum(v, TINY)) - log_gamma(u))
            if not own.any():
                continue
            if own is low:
                out[own] = front * _series(u, v)
            else:
                out[own] = 1 - front * _lentz(v + 1 - u, lambda n, u=u, v=v: (-n * (n - u), v + 1 - u + 2 * n))
    return out.reshape(shape)


def beta_i(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))

    def fraction(a, b, x):
        def step(n: int) -> tuple:
            m = n // 2
            if n % 2:
                return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), np.ones_like(x)
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), np.ones_like(x)

        most = np.nanmax(np.abs(np.concatenate([np.ravel(a), np.ravel(b)])), initial=1)
        return _lentz(np.ones_like(x), step, 2 * STEPS + int(10 * min(most, 1e14) ** 0.5))

    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(np.maximum(x, TINY)) + b * np.log(np.maximum(1 - x, TINY)))
        low = x < (a + 1) / (a + b + 2)
        u, v, w = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        part = front * fraction(u, v, w) / u
        out = np.where(low, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def chi_cdf(x, df):
    return gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_tail(x, df):
    """P(|T| > |x|)"""
    x, df = np.asarray(x, float), np.asarray(df, float)
    return beta_i(df / 2, 0.5, df / (df + x * x))


def f_cdf(x, d1, d2):
    x = np.maximum(np.asarray(x, float), 0)
    return beta_i(np.asarray(d1) / 2, np.asarray(d2) / 2, d1 * x / (d1 * x + d2))


def log_choose(n, k):
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def binomial_pmf(k, n, p):
    with np.errstate(all="ignore"):
        own = np.exp(log_choose(n, k) + k * np.log(np.maximum(p, TINY)) + (n - k) * np.log(np.maximum(1 - p, TINY)))
    return np.where((k < 0) | (k > n), 0.0, own)


def binomial_cdf(k, n, p):
    k = np.floor(k)
    return np.where(k >= n, 1.0, np.where(k < 0, 0.0, beta_i(np.maximum(n - k, 1e-9), k + 1, 1 - p)))


def poisson(k, mean, cumulative):
    k = np.floor(k)
    pmf = np.exp(k * np.log(np.maximum(mean, TINY)) - mean - log_gamma(k + 1))
    return np.where(cumulative != 0, 1 - gamma_p(k + 1, mean), pmf)


def hypergeometric(x, draws, hits, size, cumulative=0.0):
    pmf = lambda k: np.where((k < 0) | (k > hits) | (draws - k > size - hits), 0.0, np.exp(log_choose(hits, k) + log_choose(size - hits, draws - k) - log_choose(size, draws)))
    x, draws, hits, size, cumulative = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, draws, hits, size, cumulative)))
    out = np.array(pmf(x), float)
    for k in np.flatnonzero(cumulative != 0):
        steps = np.arange(0, x[k] + 1)
        one = [np.full(len(steps), v[k]) for v in (draws, hits, size)]
        d, h, s = one
        out[k] = np.where((steps > h) | (d - steps > s - h), 0, np.exp(log_choose(h, steps) + log_choose(s - h, d - steps) - log_choose(s, d))).sum()
    return out


def crit_binom(n, p, level):
    """The least k whose cumulative probability is at least level."""
    low, high = np.zeros_like(n), n.copy()
    while (low < high).any():
        mid = np.floor((low + high) / 2)
        enough = binomial_cdf(mid, n, p) >= level
        low, high = np.where(enough, low, np.minimum(mid + 1, n)), np.where(enough, mid, high)
    return low


def days_360(a: pd.Series, b: pd.Series, european: pd.Series) -> pd.Series:
    a, b = pd.to_datetime(a), pd.to_datetime(b)
    d1, d2 = a.dt.day.clip(upper=30), b.dt.day
    d2 = d2.where(~((d2 == 31) & (european.astype(bool) | (d1 == 30))), 30)
    return (b.dt.year - a.dt.year) * 360 + (b.dt.month - a.dt.month) * 30 + d2 - d1


def easter(year: np.ndarray) -> list:
    """Gregorian Easter Sunday as a date."""
    import datetime

    out = []
    for y in year:
        if y is None or y != y:
            out.append(None)
            continue
        y = int(y)
        golden, century = y % 19, y // 100
        moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
        week = (32 + 2 * (century % 4) + 2 * ((y % 100) // 4) - moon - (y % 100) % 4) % 7
        shift = moon + week - 7 * ((golden + 11 * moon + 22 * week) // 451) + 114
        out.append(datetime.date(y, shift // 31, shift % 31 + 1))
    return out


# Depreciation and root finding.


def declining(cost, salvage, life, period, factor=2.0):
    left = np.asarray(cost, float).copy()
    out = np.zeros_like(left)
    for k in range(1, int(np.nanmax(period)) + 1 if len(period) else 1):
        own = np.minimum(left * factor / life, np.maximum(left - salvage, 0))
        out = np.where(np.floor(period) == k, own, out)
        left = left - own
    return out


def fixed_declining(cost, salvage, life, period, months=12.0):
    rate = np.round(1 - (np.maximum(salvage, 0) / cost) ** (1 / life), 3)
    first = cost * rate * months / 12
    left = cost - first
    out = np.where(np.floor(period) == 1, first, 0.0)
    for k in range(2, int(np.nanmax(period)) + 1 if len(period) else 1):
        own = np.where(k == np.floor(life) + 1, left * rate * (12 - months) / 12, left * rate)
        out = np.where(np.floor(period) == k, own, out)
        left = left - own
    return out


def variable_declining(cost, salvage, life, start, end, factor=2.0):
    """Declining balance that turns to straight line where that is more, between two periods."""
    out, factor = np.zeros(len(cost)), np.broadcast_to(factor, len(cost))
    for i in range(len(cost)):
        left, total = float(cost[i]), 0.0
        for k in range(math.ceil(end[i])):
            own = max(min(left * factor[i] / life[i], left - salvage[i]), (left - salvage[i]) / max(life[i] - k, 1e-9))
            own = max(min(own, left - salvage[i]), 0.0)
            total += own * max(0.0, min(k + 1, end[i]) - max(k, start[i]))
            left -= own
        out[i] = total
    return out


def newton(value: Callable[[float], float], guess: float) -> float:
    """A root by secant steps from a guess; NaN where they don't settle."""
    a, b = guess, guess * 1.1 + 1e-3
    fa = value(a)
    for _ in range(200):
        fb = value(b)
        if abs(fb) < 1e-11 or fb == fa:
            return b if abs(fb) < 1e-6 else math.nan
        a, b, fa = b, max(b - fb * (b - a) / (fb - fa), -0.999999), fb
    return math.nan


def rate(nper, pmt, pv, fv=0.0, due=0.0, guess=0.1) -> float:
    def value(r: float) -> float:
        if abs(r) < 1e-12:
            return pv + pmt * nper + fv
        grown = (1 + r) ** nper
        return pv * grown + pmt * (1 + r * due) * (grown - 1) / r + fv

    return newton(value, guess)


def irr(flows, guess=0.1) -> float:
    return newton(lambda r: sum(v / (1 + r) ** k for k, v in enumerate(flows)), guess)


def mirr(flows, finance: float, reinvest: float) -> float:
    n = len(flows) - 1
    gains = sum(v * (1 + reinvest) ** (n - k) for k, v in enumerate(flows) if v > 0)
    costs = -sum(v / (1 + finance) ** k for k, v in enumerate(flows) if v < 0)
    return (gains / costs) ** (1 / n) - 1 if n > 0 and costs > 0 else math.nan


def numeric(function: Callable) -> Callable[..., Column]:
    """A column function of float columns from a numpy one."""

    def column(*args) -> Column:
        @F.pandas_udf("double")
        def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
            given = [np.asarray(s, float) for s in (first, *rest)]
            known = ~np.isnan(np.array(given)).any(axis=0)
            out = np.full(len(first), np.nan)
            if known.any():
                with np.errstate(all="ignore"):
                    out[known] = function(*(v[known] for v in given))
            return pd.Series(out).where(np.isfinite(out), None)

        return run(*(a.cast("double") if isinstance(a, Column) else F.lit(float(a)) for a in args))

    return column


def each(function: Callable) -> Callable:
    return lambda *arrays: np.array([function(*row) for row in zip(*arrays, strict=True)], float)
