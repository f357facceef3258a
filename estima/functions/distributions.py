"""Distribution functions for the driver: they see test statistics, never rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

TINY = 1e-300


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_pdf(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _root(f: Callable[[float], float], low: float, high: float) -> float:
    """Where the rising f is 0, by bisection to the last bit that matters."""
    for _ in range(200):
        mid = 0.5 * (low + high)
        if f(mid) < 0:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * max(1.0, abs(mid)):
            break
    return 0.5 * (low + high)


def norm_ppf(p: float) -> float:
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    if p > 0.5:
        return -norm_ppf(1 - p)
    return _root(lambda x: norm_cdf(x) - p, -40.0, 0.0)


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    out = d
    for m in range(1, 2000):
        for even in (True, False):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + k * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + k / (c if abs(c) > TINY else TINY)
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def gammainc(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    return gammainc_pair(a, x)[0]


def gammainc_pair(a: float, x: float) -> tuple[float, float]:
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = out = 1 / a
        k = a
        while abs(term) > abs(out) * 1e-17:
            k += 1
            term *= x / k
            out += term
        return min(1.0, front * out), max(0.0, 1 - front * out)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    out = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    upper = min(1.0, front * out)
    return 1 - upper, upper


def t_cdf(x: float, df: float) -> float:
    if math.isinf(df):
        return norm_cdf(x)
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_sf(x: float, df: float) -> float:
    return t_cdf(-x, df)


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(x * x / df))


def t_ppf(p: float, df: float) -> float:
    if p > 0.5:
        return -t_ppf(1 - p, df)
    if p <= 0:
        return -math.inf
    low = -1.0
    while t_cdf(low, df) > p:
        low *= 2
    return _root(lambda x: t_cdf(x, df) - p, low, 0.0)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d1 * x + d2))


def f_ppf(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while f_cdf(high, d1, d2) < p:
        high *= 2
    return _root(lambda x: f_cdf(x, d1, d2) - p, 0.0, high)


def chi2_cdf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2)


def chi2_sf(x: float, df: float) -> float:
    return gammainc_pair(df / 2, x / 2)[1]


def chi2_ppf(p: float, df: float) -> float:
    high = 1.0
    while chi2_cdf(high, df) < p:
        high *= 2
    return _root(lambda x: chi2_cdf(x, df) - p, 0.0, high)


def binom_cdf(k: int, n: int, p: float) -> float:
    return 1.0 if k >= n else 0.0 if k < 0 else betainc(n - k, k + 1, 1 - p)


def poisson_cdf(k: int, mean: float) -> float:
    return gammainc_pair(k + 1, mean)[1] if k >= 0 else 0.0


def kolmogorov_sf(x: float) -> float:
    if x <= 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def nct_cdf(x: float, df: float, delta: float) -> float:
    """Noncentral t: the normal tail averaged over the chi distribution of the scale."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    top = math.sqrt(chi2_ppf(1 - 1e-14, df) / df)
    s = 0.5 * top * (nodes + 1)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    cdf = np.array([norm_cdf(x * y - delta) for y in s])
    return float(min(1.0, max(0.0, 0.5 * top * (weights * np.exp(log_density) * cdf).sum())))


def ncf_cdf(x: float, d1: float, d2: float, nc: float) -> float:
    """Noncentral F: a Poisson mixture of beta distributions."""
    if x <= 0:
        return 0.0
    y, half, out = d1 * x / (d1 * x + d2), nc / 2, 0.0
    middle = int(half)
    reach = int(12 * math.sqrt(half + 1) + 40)
    for j in range(max(0, middle - reach), middle + reach):
        out += math.exp(-half + (j * math.log(half) if half > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1)) * betainc(d1 / 2 + j, d2 / 2, y)
    return min(1.0, out)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k normals / their pooled sd > q), by two Gauss-Legendre sums."""
    if q <= 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(64)
    zn, zw = np.polynomial.legendre.leggauss(128)
    z = 9.0 * zn
    cdf = np.vectorize(norm_cdf)
    phi, big = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), cdf(z)

    def inner(width: float) -> float:
        return float(9.0 * (zw * k * phi * np.maximum(0, big - cdf(z - width)) ** (k - 1)).sum())

    if math.isinf(df) or df > 1e5:
        return max(0.0, 1 - inner(q))
    low, high = math.sqrt(chi2_ppf(1e-13, df) / df), math.sqrt(chi2_ppf(1 - 1e-13, df) / df)
    s = low + (high - low) / 2 * (nodes + 1)
    density = np.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    return max(0.0, 1 - float((high - low) / 2 * (weights * density * np.array([inner(q * x) for x in s])).sum()))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    high = 4.0
    while studentized_range_sf(high, k, df) > 1 - p:
        high *= 1.5
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_sf(mid, k, df) > 1 - p else (low, mid)
    return (low + high) / 2


def two_sided(z: float, df: float = math.inf) -> float:
    """The p-value of a t statistic, or of a normal one if df is infinite."""
    return min(1.0, 2 * t_sf(abs(z), df)) if not math.isnan(z) else math.nan


def p_of(statistic: float, df: float, alternative: str) -> float:
    if alternative == "two-sided":
        return two_sided(statistic, df)
    if alternative not in ("less", "greater"):
        raise ValueError("alternative must be two-sided, less or greater")
    return t_cdf(statistic, df) if alternative == "less" else t_sf(statistic, df)
