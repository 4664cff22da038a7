"""Special functions without SciPy: tails of the normal, t, F and chi-square distributions, hypergeometric sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    if x < s + 1:
        term = total = 1 / s
        for n in range(1, 1000):
            term *= x / (s + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + s * math.log(x) - math.lgamma(s))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by Newton steps on its tail, from a logistic start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    z = math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        err = 0.5 * math.erfc(-z / math.sqrt(2)) - p
        step = err * math.sqrt(2 * math.pi) * math.exp(min(z * z / 2, 700))
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return z


def hypergeometric_tail(a: int, b: int, c: int, d: int) -> float:
    """P(at least a) in a 2 x 2 table with its margins fixed."""
    n, k, m = a + b + c + d, a + b, a + c
    lc = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    return min(1.0, sum(math.exp(lc(m, x) + lc(n - m, k - x) - lc(n, k)) for x in range(a, min(k, m) + 1)))


def lcs_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length; bit-parallel."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best lcs_ratio of the shorter text with a window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max((lcs_ratio(short, long[i : i + n]) for i in range(len(long) - n + 1)), default=0.0) if n else float(not long)


def _column(f):
    """A vectorised column function: NULL where any argument is."""

    def run(*args):
        ok = np.logical_and.reduce([~pd.isna(a) for a in args])
        return pd.Series([f(*row) if good else None for good, *row in zip(ok, *args, strict=True)], dtype="float64")

    return run


@pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _column(normal_tail)(z)


@pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_tail)(t, df)


@pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column(f_tail)(f, d1, d2)


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _column(chi2_tail)(x, df)


@pandas_udf(DoubleType())
def normal_inverse(p: pd.Series) -> pd.Series:
    return _column(normal_quantile)(p)


@pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _column(lambda *x: hypergeometric_tail(*(int(v) for v in x)))(a, b, c, d)


@pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _column(lcs_ratio)(a, b)


@pandas_udf(DoubleType())
def fuzzy_partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return _column(partial_ratio)(a, b)


@pandas_udf(DoubleType())
def fuzzy_token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    words = lambda s: " ".join(sorted(s.split()))
    return _column(lambda x, y: lcs_ratio(words(x), words(y)))(a, b)
