"""Tail probabilities of the normal, chi-square, t and F distributions.

Used on one row per feature or per comparison, never on case rows. The functions
are the textbook series and continued fractions for the incomplete gamma and beta
integrals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOSE = 1e-14
_LARGE = 1e5  # shape beyond which expansions for large shapes are more exact than sums of log-gammas


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def log10_normal_upper(z: float) -> float:
    p = normal_upper(z)
    if p > 1e-290:
        return math.log10(p)
    # far tail: phi(z)/z * (1 - 1/z^2 + 3/z^4)
    log_p = -0.5 * z * z - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4)
    return log_p / math.log(10)


def _settled(fraction) -> float:
    """A continued fraction, ``fraction(n)`` with n terms, once twice the terms change nothing."""
    n, last = 32, fraction(16)
    while True:
        now = fraction(n)
        if abs(now - last) <= _CLOSE * abs(now):
            return now
        if n > 1 << 22:
            raise ArithmeticError("continued fraction does not settle")
        n, last = 2 * n, now


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if a > _LARGE:
        return _gamma_upper_large(a, x)
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # x^a e^-x / Gamma(a) times the sum of x^n / (a (a+1) ... (a+n))
        term, terms = 1.0 / a, []
        while term > _CLOSE * 1e-2 * (terms[0] if terms else 0.0):
            terms.append(term)
            term *= x / (a + len(terms))
        return 1.0 - math.fsum(terms) * scale

    def fraction(n):  # x + 1 - a + 1 (a-1) / (x + 3 - a + 2 (a-2) / (x + 5 - a + ...))
        value = x + 2 * n + 1 - a
        for i in range(n, 0, -1):
            value = x + 2 * i - 1 - a + i * (a - i) / value
        return value

    return scale / _settled(fraction)


def _gamma_upper_large(a: float, x: float) -> float:
    """First two terms of the uniform expansion: a normal tail in eta, eta^2 / 2 = x/a - 1 - ln(x/a)."""
    mu = x / a - 1
    half = mu - math.log1p(mu) if abs(mu) > 1e-4 else mu * mu * (0.5 - mu * (1 / 3 - mu / 4))
    eta = math.copysign(math.sqrt(2 * half), mu)
    skew = 1 / mu - 1 / eta if abs(mu) > 1e-4 else -1 / 3 + mu / 12
    tail = 0.5 * math.erfc(eta * math.sqrt(a / 2)) + math.exp(-a * half) / math.sqrt(2 * math.pi * a) * skew
    return min(1.0, max(0.0, tail))


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

    def part(i):
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def fraction(n):  # 1 + part(1) / (1 + part(2) / (1 + ...))
        value = 1.0
        for i in range(n, 0, -1):
            value = 1.0 + part(i) / value
        return value

    return front / (a * _settled(fraction))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    if df > _LARGE:  # the normal quantile with the same tail, to terms in 1 / df^2
        t2 = t * t
        z = abs(t) * (1 - (t2 + 1) / (4 * df) + (13 * t2 * t2 + 8 * t2 + 3) / (96 * df * df))
        return 2 * normal_upper(z) if t2 < math.sqrt(df) else 2 * normal_upper(math.sqrt(df * math.log1p(t2 / df)))
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    if d1 == 1:
        return t_two_sided(math.sqrt(f), d2)
    if d2 > 1e9 and d1 < 1e4:
        return chi2_upper(d1 * f, d1)
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _vector(fn):
    """Column version of a scalar tail function; NULL or NaN in gives NULL out."""

    def call(*cols) -> Column:
        n_args = len(cols)

        @F.pandas_udf(T.DoubleType())
        def apply(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
            args = [first, second, third][:n_args]
            out = [
                fn(*[float(v) for v in vals]) if not any(v is None or np.isnan(v) for v in vals) else None
                for vals in zip(*args)
            ]
            return pd.Series(out, dtype="float64")

        padded = [c.cast("double") for c in cols] + [F.lit(0.0)] * (3 - n_args)
        return apply(*padded)

    return call


normal_two_sided_p = _vector(lambda z: 2 * normal_upper(abs(z)))
log10_two_sided_p = _vector(lambda z: math.log10(2) + log10_normal_upper(abs(z)))
chi2_p = _vector(chi2_upper)
t_p = _vector(t_two_sided)
f_p = _vector(f_upper)
