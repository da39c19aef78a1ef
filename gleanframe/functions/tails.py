"""Distribution tails, applied with Arrow batches to small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution function, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c = 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return scale * h
    raise ArithmeticError(f"incomplete gamma of ({a}, {x}) did not settle")


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h / a
    raise ArithmeticError(f"incomplete beta of ({a}, {b}, {x}) did not settle")


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = 0.5 * (lo + hi)
        if beta_lower(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else np.nan).astype(float)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-squared with ``df`` degrees of freedom >= x)."""
    return pd.Series([gamma_upper(d / 2.0, v / 2.0) for v, d in zip(x, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def exact_binomial_limit(successes: pd.Series, trials: pd.Series, tail: pd.Series) -> pd.Series:
    """Clopper-Pearson limit: ``tail`` below 0.5 gives the lower one, above the upper one."""
    out = []
    for x, n, p in zip(successes, trials, tail):
        if p < 0.5:
            out.append(0.0 if x == 0 else beta_quantile(p, x, n - x + 1))
        else:
            out.append(1.0 if x == n else beta_quantile(p, x + 1, n - x))
    return pd.Series(out, dtype=float)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def log_normal_upper(z: float) -> float:
    """ln P(Z >= z) for z >= 0, also where the probability is too small for a float."""
    if z < 25:
        return math.log(0.5 * math.erfc(z / math.sqrt(2.0)))
    # the asymptotic series; its third term is below 1e-8 here
    return -0.5 * z * z - math.log(z * math.sqrt(2.0 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4 - 15 / z**6)


def normal_from_log_upper(log_p: float) -> float:
    """The z >= 0 with ln P(Z >= z) = ``log_p``, by bisection."""
    if log_p >= math.log(0.5):
        return 0.0
    lo, hi = 0.0, math.sqrt(-2.0 * log_p) + 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if log_normal_upper(mid) > log_p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def log_hypergeometric_tail(x: int, k: int, j: int, n: int) -> float:
    """ln of P(X >= x) if x is above the mean, else of P(X <= x).

    X is how many of ``k`` marked ones are among ``j`` drawn from ``n``. Terms are summed from x
    outwards, away from the mode, each from the one before, until they no longer count.
    """
    up = x * n > k * j
    log_first = log_choose(k, x) + log_choose(n - k, j - x) - log_choose(n, j)
    term = total = 1.0
    at = x
    while term > total * 1e-17:
        if up:
            term *= (k - at) * (j - at) / ((at + 1) * (n - k - j + at + 1)) if at < min(k, j) else 0.0
            at += 1
        else:
            term *= at * (n - k - j + at) / ((k - at + 1) * (j - at + 1)) if at > max(0, k + j - n) else 0.0
            at -= 1
        total += term
    return min(0.0, log_first + math.log(total))


@F.pandas_udf(T.StructType([T.StructField("p_value", T.DoubleType()), T.StructField("test_value", T.DoubleType())]))
def hypergeometric_test(x: pd.Series, k: pd.Series, j: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Two-sided p-value (twice the tail, at most 1) and the normal value of that p, signed by the side."""
    out = []
    for a, b, c, d in zip(x.tolist(), k.tolist(), j.tolist(), n.tolist()):
        tail = log_hypergeometric_tail(int(a), int(b), int(c), int(d))
        sign = 1.0 if a * d > b * c else -1.0
        out.append((min(1.0, 2.0 * math.exp(tail)), sign * normal_from_log_upper(tail)))
    return pd.DataFrame(out, columns=["p_value", "test_value"])


@F.pandas_udf(T.DoubleType())
def binomial_upper(m: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(Bin(n, p) >= m)."""
    return pd.Series([1.0 if a <= 0 else 0.0 if a > b else beta_lower(a, b - a + 1, q) for a, b, q in zip(m, n, p)], dtype=float)


@F.pandas_udf(T.DoubleType())
def log_binomial(n: pd.Series, k: pd.Series) -> pd.Series:
    """ln of n over k."""
    return pd.Series([log_choose(float(a), float(b)) for a, b in zip(n, k)], dtype=float)
