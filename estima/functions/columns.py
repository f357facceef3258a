"""Column expressions: kernels, links, families, distances, and a translator for pandas-like expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- kernels -----------------------------------------------------------------


def triangular(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, 1 - F.abs(u)).otherwise(0.0)


def uniform(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, 0.5).otherwise(0.0)


def epanechnikov(u: Column) -> Column:
    return F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)


def bartlett(lag: Column, lags: int) -> Column:
    return F.when(F.abs(lag) <= lags, 1 - F.abs(lag) / (lags + 1)).otherwise(0.0)


KERNELS = {"triangular": triangular, "uniform": uniform, "rectangular": uniform, "epanechnikov": epanechnikov}


# --- special functions on rows -------------------------------------------------


def norm_cdf(x: Column) -> Column:
    """The normal distribution function within 1e-7 or so, by a rational approximation of its tail."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.5 * z)
    # The Chebyshev coefficients of a published approximation of erfc, of relative error below 1.2e-7.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    tail = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) * 0.3989422804014327


def log_gamma(x: Column) -> Column:
    """ln gamma for x > 0: shifted by 8, then the asymptotic series; relative error near 1e-14."""
    y = x + 8
    series = F.lit(0.0)
    for k, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)):
        series = series + c / F.pow(y, 2 * k + 1)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


# --- links and families ----------------------------------------------------------

LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": (F.log, F.exp, F.exp),
    "logit": (lambda m: F.log(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-F.abs(e)) / F.pow(1 + F.exp(-F.abs(e)), 2)),
    "probit": (None, norm_cdf, norm_pdf),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "inverse_squared": (lambda m: 1 / (m * m), lambda e: 1 / F.sqrt(e), lambda e: -0.5 / F.pow(e, 1.5)),
    "cloglog": (lambda m: F.log(-F.log(1 - m)), lambda e: 1 - F.exp(-F.exp(e)), lambda e: F.exp(e - F.exp(e))),
}


def link(name: str, mu: Column) -> Column:
    if name == "probit":
        raise ValueError("the probit link has no closed form; start from an adjusted mean instead")
    return LINKS[name][0](mu)


def inverse_link(name: str, eta: Column) -> Column:
    return LINKS[name][1](eta)


def mean_slope(name: str, eta: Column) -> Column:
    """d mean / d eta."""
    return LINKS[name][2](eta)


def variance(family: str, mu: Column, theta: float = 1.0) -> Column:
    return {
        "gaussian": lambda: F.lit(1.0), "binomial": lambda: mu * (1 - mu), "poisson": lambda: mu,
        "gamma": lambda: mu * mu, "negative_binomial": lambda: mu + mu * mu / theta,
    }[family]()


def unit_deviance(family: str, y: Column, mu: Column, theta: float = 1.0) -> Column:
    xlogy = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    return {
        "gaussian": lambda: F.pow(y - mu, 2),
        "binomial": lambda: 2 * (xlogy(y, mu) + xlogy(1 - y, 1 - mu)),
        "poisson": lambda: 2 * (xlogy(y, mu) - (y - mu)),
        "gamma": lambda: 2 * (-F.log(y / mu) + (y - mu) / mu),
        "negative_binomial": lambda: 2 * (xlogy(y, mu) - (y + theta) * F.log((y + theta) / (mu + theta))),
    }[family]()


# --- distances ---------------------------------------------------------------------


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b) / (F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b)) + 1e-10)


DISTANCES = {"l2": squared_l2, "euclidean": euclidean, "cosine": cosine_distance, "ip": lambda a, b: -inner_product(a, b)}


def soft_threshold(z: Column, g: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - g, F.lit(0.0))


# --- expressions -------------------------------------------------------------------

_NUMPY = {"np.log": "ln", "np.log10": "log10", "np.log2": "log2", "np.log1p": "log1p", "np.exp": "exp", "np.sqrt": "sqrt", "np.abs": "abs", "np.sin": "sin", "np.cos": "cos", "np.tan": "tan", "np.power": "power", "np.floor": "floor", "np.ceil": "ceil", "np.round": "round", "np.sign": "sign", "log": "ln"}
_STRINGS = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)""")


def to_sql(expression: str) -> str:
    """A pandas query or eval expression as Spark SQL: ==, !=, and/or/not, & | ~ between parentheses, **, in [..],
    numpy's functions. It is parsed by Spark and never run as Python."""
    out = []
    for i, part in enumerate(_STRINGS.split(expression)):
        if i % 2:
            out.append("'" + part[1:-1].replace("'", "\\'") + "'" if part[0] == '"' else part)
            continue
        if re.search(r"(?<![)\s])\s*[&|](?!\s*[(~])|(?<=[)\s])[&|](?!\s*[(~`\w])", part):
            raise ValueError("put the sides of & and | in parentheses")
        part = re.sub(r"\bnot\s+in\b\s*\[([^\]]*)\]", r"NOT IN (\1)", re.sub(r"\bin\b\s*\[([^\]]*)\]", r"IN (\1)", part))
        part = part.replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
        part = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", part))
        for name in sorted(_NUMPY, key=len, reverse=True):
            part = re.sub(rf"(?<![\w.]){re.escape(name)}(?=\s*\()", _NUMPY[name], part)
        if re.search(r"\bnp\.", part) or "__" in part or "@" in part:
            raise ValueError(f"unknown function or name in {expression!r}")
        out.append(part)
    text = "".join(out)
    while "**" in text:
        operand = r"(?:[\w.`]+(?:\([^()]*\))?|\([^()]*\))"
        new = re.sub(rf"({operand})\s*\*\*\s*(-?{operand})", r"power(\1, \2)", text, count=1)
        if new == text:
            raise ValueError("put the sides of ** in parentheses")
        text = new
    return text


def cell_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are not above x, by nested comparisons that halve them."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < F.lit(float(cuts[mid])), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(cuts)).cast("long")


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(to_sql(expression))


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, F.expr(to_sql(expression)))
