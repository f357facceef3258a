"""Time series. Order is always an explicit key. Models of one long series work from cross-products of lagged columns;
models that step through a series run per series as grouped Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import coefficients, frame
from ..plans.gram import Gram, complete, gram, number
from .diagnostics import _lagged
from .linear import INTERCEPT, Fit, _inverse, from_gram
from .optimise import minimise, numeric_hessian


def lagged(df: DataFrame, columns: Sequence[str], order: str, lags: int, keep_order: bool = False) -> DataFrame:
    """columns as doubles with <column>_1 .. <column>_lags, incomplete first rows left out."""
    out = df.select(F.col(order).alias("__o"), *[number(c).alias(c) for c in columns]).dropna()
    for c in columns:
        out = _lagged(out, ["__o"], c, lags)
    out = out.dropna()
    return out if keep_order else out.drop("__o")


# --- autoregressions -----------------------------------------------------------------------------------------------


def ar(df: DataFrame, column: str, order: str, p: int) -> tuple[DataFrame, Fit]:
    rows = lagged(df, [column], order, p)
    names = [f"{column}_{k}" for k in range(1, p + 1)]
    fit = from_gram(gram(rows, [column, *names]), column, names)
    return fit.table(df.sparkSession), fit


class Var:
    """A fitted vector autoregression: coef[lag - 1][equation, variable]."""

    def __init__(self, names: list[str], p: int, const: np.ndarray, coef: list[np.ndarray], sigma: np.ndarray, se: np.ndarray, n: int, g: Gram, last: np.ndarray):
        self.names, self.p, self.const, self.coef, self.sigma, self.se, self.n, self.gram, self.last = names, p, const, coef, sigma, se, n, g, last

    def companion(self) -> np.ndarray:
        k = len(self.names)
        out = np.zeros((k * self.p, k * self.p))
        out[:k] = np.hstack(self.coef)
        out[k:, :-k] = np.eye(k * (self.p - 1))
        return out

    def stable(self) -> bool:
        return bool(np.abs(np.linalg.eigvals(self.companion())).max() < 1)

    def criteria(self) -> dict[str, float]:
        k, m, n = len(self.names), len(self.names) * (len(self.names) * self.p + 1), self.n
        ml = np.linalg.slogdet(self.sigma * (n - k * self.p - 1) / n)[1]
        t = k * self.p + 1
        return {"aic": ml + 2 * m / n, "bic": ml + math.log(n) * m / n, "hqc": ml + 2 * math.log(math.log(n)) * m / n, "fpe": math.exp(ml) * ((n + t) / (n - t)) ** k}

    def moving_average(self, steps: int) -> list[np.ndarray]:
        out = [np.eye(len(self.names))]
        for h in range(1, steps + 1):
            out.append(sum(out[h - j] @ self.coef[j - 1] for j in range(1, min(h, self.p) + 1)))
        return out

    def irf(self, steps: int, orthogonal: bool = True) -> np.ndarray:
        """(step, response, shock)."""
        p = np.linalg.cholesky(self.sigma) if orthogonal else np.eye(len(self.names))
        return np.array([m @ p for m in self.moving_average(steps)])

    def fevd(self, steps: int) -> np.ndarray:
        """(step, variable, shock): shares of the forecast error's variance."""
        total = np.cumsum(self.irf(steps - 1) ** 2, axis=0)
        return total / total.sum(2, keepdims=True)

    def forecast(self, steps: int) -> np.ndarray:
        past, out = list(self.last), []
        for _ in range(steps):
            out.append(self.const + sum(a @ past[-j - 1] for j, a in enumerate(self.coef)))
            past.append(out[-1])
        return np.array(out)

    def granger(self, cause: str, effect: str) -> dict[str, float]:
        """F of leaving the cause's lags out of the effect's equation: both fits are blocks of one Gram."""
        every = [f"{c}_{k}" for k in range(1, self.p + 1) for c in self.names]
        wide = from_gram(self.gram, effect, every)
        narrow = from_gram(self.gram, effect, [x for x in every if x.rpartition("_")[0] != cause])
        f = (narrow.rss - wide.rss) / self.p / wide.sigma2
        return {"f_stat": f, "df1": self.p, "df2": wide.df, "p_value": D.f_sf(f, self.p, wide.df)}


def var(df: DataFrame, columns: Sequence[str], order: str, p: int) -> Var:
    names = list(columns)
    rows = lagged(df, names, order, p, keep_order=True)
    lags = [f"{c}_{k}" for k in range(1, p + 1) for c in names]
    g = gram(rows, [*names, *lags])
    fits = [from_gram(g, c, lags) for c in names]
    b = np.array([f.beta for f in fits])
    coef = [b[:, 1 + k * len(names) : 1 + (k + 1) * len(names)] for k in range(p)]
    i, j = g.at(names), g.at(lags)
    slope = b[:, 1:]
    resid = g.centred[np.ix_(i, i)] - slope @ g.centred[np.ix_(j, i)]
    sigma = resid / (g.n - len(lags) - 1)
    se = np.array([np.sqrt(np.diag(fits[0].bread) * sigma[c, c]) for c in range(len(names))])
    tail = rows.orderBy(F.desc("__o")).limit(p).select(*names).collect()
    return Var(names, p, b[:, 0], coef, (sigma + sigma.T) / 2, se, g.n, g, np.array([list(r) for r in reversed(tail)]))


def var_table(spark, model: Var) -> DataFrame:
    lags = [f"{c}_{k}" for k in range(1, model.p + 1) for c in model.names]
    out = None
    for i, name in enumerate(model.names):
        b = np.concatenate([[model.const[i]], np.hstack(model.coef)[i]])
        one = coefficients(spark, [INTERCEPT, *lags], b, model.se[i], model.n - len(lags) - 1).select(F.lit(name).alias("equation"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def var_select(df: DataFrame, columns: Sequence[str], order: str, most: int) -> DataFrame:
    """(lag, aic, bic, hqc, fpe) on the rows that the most lags leave: one Gram, whose blocks serve the smaller ones."""
    names = list(columns)
    rows = lagged(df, names, order, most)
    every = [f"{c}_{k}" for k in range(1, most + 1) for c in names]
    g = gram(rows, [*names, *every])
    out = []
    for p in range(1, most + 1):
        lags = [f"{c}_{k}" for k in range(1, p + 1) for c in names]
        i, j = g.at(names), g.at(lags)
        resid = g.centred[np.ix_(i, i)] - g.centred[np.ix_(i, j)] @ _inverse(g.centred[np.ix_(j, j)]) @ g.centred[np.ix_(j, i)]
        m = Var(names, p, np.zeros(len(names)), [], resid / (g.n - len(lags) - 1), np.zeros(0), g.n, g, np.zeros(0))
        c = m.criteria()
        out.append((p, c["aic"], c["bic"], c["hqc"], c["fpe"]))
    return frame(df.sparkSession, out, "lag int, aic double, bic double, hqc double, fpe double")


def irf_bands(df: DataFrame, columns: Sequence[str], order: str, p: int, steps: int, reps: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(step, response, shock, estimate, lower, upper): a residual bootstrap, its repetitions dealt over tasks. The series
    (of at most a million rows) goes to each of them."""
    names = list(columns)
    model = var(df, names, order, p)
    rows = df.select(F.col(order).alias("__o"), *[number(c).alias(c) for c in names]).dropna().orderBy("__o").limit(1_000_001).toPandas()
    if len(rows) > 1_000_000:
        raise ValueError("the bootstrap needs a series of at most a million rows")
    y = rows[names].to_numpy()
    const, coef, k = model.const, model.coef, len(names)
    x = np.hstack([y[p - j - 1 : len(y) - j - 1] for j in range(p)])
    resid = y[p:] - const - x @ np.hstack(coef).T

    def run(frames):
        for f in frames:
            for rep in f["rep"]:
                random = np.random.RandomState((seed * 100_003 + int(rep)) % 2**32)
                e = (resid - resid.mean(0))[random.randint(0, len(resid), len(resid))]
                z = np.empty_like(y)
                z[:p] = y[:p]
                for t in range(p, len(y)):
                    z[t] = const + sum(a @ z[t - j - 1] for j, a in enumerate(coef)) + e[t - p]
                xs = np.column_stack([np.ones(len(z) - p), np.hstack([z[p - j - 1 : len(z) - j - 1] for j in range(p)])])
                b = np.linalg.lstsq(xs, z[p:], rcond=None)[0].T
                s = (z[p:] - xs @ b.T).T @ (z[p:] - xs @ b.T) / (len(z) - p - xs.shape[1])
                m = Var(names, p, b[:, 0], [b[:, 1 + j * k : 1 + (j + 1) * k] for j in range(p)], s, np.zeros(0), 0, None, np.zeros(0)).irf(steps)
                at = np.indices(m.shape).reshape(3, -1)
                yield pd.DataFrame({"step": at[0], "response": at[1], "shock": at[2], "v": m.ravel()})

    spark = df.sparkSession
    draws = spark.range(reps).withColumnRenamed("id", "rep").repartition(min(reps, 64)).mapInPandas(run, "step int, response int, shock int, v double")
    bands = draws.groupBy("step", "response", "shock").agg(F.percentile("v", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    point = model.irf(steps)
    own = frame(spark, [(h, i, j, point[h, i, j]) for h in range(steps + 1) for i in range(k) for j in range(k)], "step int, response int, shock int, estimate double")
    out = own.join(bands, ["step", "response", "shock"])
    label = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1).alias(c)
    return out.select("step", label("response"), label("shock"), "estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


# --- unit roots and cointegration ------------------------------------------------------------------------------------

# Response surfaces of the Dickey-Fuller t statistic's 1, 5 and 10 % points (MacKinnon), in 1/T.
ADF_CRITICAL = {
    "none": ((-2.56574, -2.2358, -3.627), (-1.94100, -0.2686, -3.365), (-1.61682, 0.2656, -2.714)),
    "constant": ((-3.43035, -6.5393, -16.786), (-2.86154, -2.8903, -4.234), (-2.56677, -1.5384, -2.809)),
    "trend": ((-3.95877, -9.0531, -28.428), (-3.41049, -4.3904, -9.036), (-3.12705, -2.5856, -3.925)),
}
# The same with two variables, for residuals of a cointegrating regression with a constant.
EG_CRITICAL = ((-3.89644, -10.9519, -22.527), (-3.33613, -6.1101, -6.823), (-3.04445, -4.2412, -2.720))
# 10, 5, 2.5 and 1 % points of the KPSS statistic.
KPSS_CRITICAL = {"level": (0.347, 0.463, 0.574, 0.739), "trend": (0.119, 0.146, 0.176, 0.216)}
# 5 % points of Johansen's trace and largest-eigenvalue statistics with a constant, by common trends.
TRACE_CRITICAL = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189, 95.7542)
MAX_EIGEN_CRITICAL = (3.8415, 14.2639, 21.1314, 27.5858, 33.8777, 40.0763)


def _critical(surface, n: int) -> tuple[float, float, float]:
    return tuple(a + b / n + c / n**2 for a, b, c in surface)


def _p_by_points(t: float, points: tuple[float, float, float]) -> float:
    """A p-value by interpolating the normal quantiles of three critical values; rough away from them."""
    z = np.array([D.norm_ppf(p) for p in (0.01, 0.05, 0.10)])
    slope, base = np.polyfit(points, z, 1)
    return D.norm_cdf(base + slope * t)


def adf(df: DataFrame, column: str, order: str, lags: int | None = None, trend: str = "constant") -> dict[str, float]:
    """Augmented Dickey-Fuller. lags: the smallest AIC up to min(12 (n/100)^0.25, n/4) where none are given, all from one
    Gram of the longest."""
    n = df.agg(F.count(number(column))).first()[0]
    most = lags if lags is not None else int(min(12 * (n / 100) ** 0.25, n / 4))
    rows = lagged(df, [column], order, most + 1, keep_order=True)
    d = [F.col(column) - F.col(f"{column}_1")] + [F.col(f"{column}_{k}") - F.col(f"{column}_{k + 1}") for k in range(1, most + 1)]
    names = ["dy", *[f"d{k}" for k in range(1, most + 1)]]
    rows = rows.select("__o", F.col(f"{column}_1").alias("level"), *[x.alias(a) for x, a in zip(d, names)])
    if trend == "trend":
        from ..plans.ranks import running_counts

        place = running_counts(rows, "__o", ("c", F.count(F.lit(1)))).select("__o", (F.col("c_before") + 1).cast("double").alias("trend"))
        rows = rows.join(place, "__o")
    every = ["level", *names[1:], *(["trend"] if trend == "trend" else [])]
    g = gram(rows.select("dy", *every), ["dy", *every])
    best = None
    for k in [most] if lags is not None else range(most + 1):
        x = ["level", *names[1 : k + 1], *(["trend"] if trend == "trend" else [])]
        fit = from_gram(g, "dy", x, trend != "none")
        aic = fit.n * math.log(fit.rss / fit.n) + 2 * len(fit.terms)
        if best is None or aic < best[0]:
            best = (aic, k, fit)
    _, k, fit = best
    i = fit.terms.index("level")
    t = float(fit.beta[i] / fit.se[i])
    one, five, ten = _critical(ADF_CRITICAL[trend], fit.n)
    return {"statistic": t, "p_value": _p_by_points(t, (one, five, ten)), "lags": k, "n": fit.n, "crit_1": one, "crit_5": five, "crit_10": ten}


def kpss(df: DataFrame, column: str, order: str, trend: bool = False, lags: int | None = None) -> dict[str, float]:
    """Partial sums and lagged products of the residuals from a mean or a trend; Bartlett weights."""
    from ..plans.ranks import running_counts

    own = complete(df, {"x": column}, [F.col(order).alias("__o")])
    if trend:
        place = running_counts(own, "__o", ("c", F.count(F.lit(1)))).select("__o", F.col("c_before").cast("double").alias("t"))
        own = own.join(place, "__o")
        fit = from_gram(gram(own, ["x", "t"]), "x", ["t"])
        own = own.select("__o", (F.col("x") - float(fit.beta[0]) - float(fit.beta[1]) * F.col("t")).alias("e"))
    else:
        own = own.select("__o", (F.col("x") - own.agg(F.avg("x")).first()[0]).alias("e"))
    n = own.count()
    lags = int(math.sqrt(n)) if lags is None else lags
    sums = running_counts(own, "__o", ("e", F.sum("e")))
    s = sums.agg(F.sum(F.pow(F.col("e_before") + F.col("e"), 2))).first()[0]
    wide = _lagged(own, ["__o"], "e", lags) if lags else own
    row = wide.agg(F.sum(F.pow("e", 2)), *[F.sum(F.col("e") * F.col(f"e_{k}")) for k in range(1, lags + 1)]).first()
    long_run = (row[0] + 2 * sum((1 - k / (lags + 1)) * row[k] for k in range(1, lags + 1))) / n
    eta = s / n**2 / long_run
    points = KPSS_CRITICAL["trend" if trend else "level"]
    return {"statistic": eta, "p_value": float(np.interp(eta, points, (0.10, 0.05, 0.025, 0.01))), "lags": lags, "n": n, "crit_5": points[1]}


def engle_granger(df: DataFrame, y: str, x: str, order: str, lags: int = 1) -> dict[str, float]:
    """The unit-root statistic of the residuals of y on x, against points for two variables."""
    own = complete(df, {"y": y, "x": x}, [F.col(order).alias("__o")])
    fit = from_gram(gram(own.select("y", "x"), ["y", "x"]), "y", ["x"])
    r = adf(own.select("__o", (F.col("y") - float(fit.beta[0]) - float(fit.beta[1]) * F.col("x")).alias("e")), "e", "__o", lags, "none")
    one, five, ten = _critical(EG_CRITICAL, r["n"])
    return {"statistic": r["statistic"], "p_value": _p_by_points(r["statistic"], (one, five, ten)), "beta": float(fit.beta[1]), "n": r["n"], "crit_5": five}


def _johansen(df: DataFrame, names: list[str], order: str, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Gram]:
    rows = lagged(df, names, order, p)
    d = {f"d_{c}": F.col(c) - F.col(f"{c}_1") for c in names}
    level = {f"l_{c}": F.col(f"{c}_1") for c in names}
    more = {f"d{k}_{c}": F.col(f"{c}_{k}") - F.col(f"{c}_{k + 1}") for k in range(1, p) for c in names}
    every = {**d, **level, **more}
    g = gram(rows.select(*[v.alias(k) for k, v in every.items()]), list(every))
    i, j, k = g.at(list(d)), g.at(list(level)), g.at(list(more))
    c = g.centred
    part = lambda a, b: (c[np.ix_(a, b)] - c[np.ix_(a, k)] @ _inverse(c[np.ix_(k, k)]) @ c[np.ix_(k, b)] if len(k) else c[np.ix_(a, b)]) / g.n
    return part(i, i), part(i, j), part(j, j), np.array(0), g


def johansen(df: DataFrame, columns: Sequence[str], order: str, p: int = 2) -> tuple[DataFrame, np.ndarray, int]:
    """((rank, eigenvalue, trace, trace_crit_5, max_eigen, max_eigen_crit_5), cointegrating vectors, recommended rank) of a
    VAR(p) in levels with a constant."""
    names = list(columns)
    s00, s01, s11, _, g = _johansen(df, names, order, p)
    root = np.linalg.cholesky(s11)
    inv = np.linalg.inv(root)
    value, vector = np.linalg.eigh(inv @ s01.T @ np.linalg.inv(s00) @ s01 @ inv.T)
    at = np.argsort(value)[::-1]
    value, beta = np.clip(value[at], 0, 1 - 1e-15), inv.T @ vector[:, at]
    rows, rank = [], 0
    for r in range(len(names)):
        m = len(names) - r
        trace, top = -g.n * np.log(1 - value[r:]).sum(), -g.n * math.log(1 - value[r])
        rows.append((r, float(value[r]), float(trace), TRACE_CRITICAL[m - 1], float(top), MAX_EIGEN_CRITICAL[m - 1]))
        if trace > TRACE_CRITICAL[m - 1] and rank == r:
            rank = r + 1
    return frame(df.sparkSession, rows, "rank int, eigenvalue double, trace double, trace_crit_5 double, max_eigen double, max_eigen_crit_5 double"), beta, rank


def vecm(df: DataFrame, columns: Sequence[str], order: str, rank: int, p: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((equation, term, estimate, ...), beta): differences on the error-correction terms and lagged differences, from the
    same Gram."""
    names = list(columns)
    _, beta, _ = johansen(df, names, order, p)
    b = beta[:, :rank] / beta[:rank, :rank].diagonal()
    g = _johansen(df, names, order, p)[4]
    d, level = [f"d_{c}" for c in names], [f"l_{c}" for c in names]
    more = [x for x in g.names if x not in d and x not in level]
    t = np.zeros((len(g.names), len(d) + rank + len(more)))
    for k, x in enumerate(d):
        t[g.names.index(x), k] = 1
    for k in range(rank):
        for c, x in enumerate(level):
            t[g.names.index(x), len(d) + k] = b[c, k]
    for k, x in enumerate(more):
        t[g.names.index(x), len(d) + rank + k] = 1
    new = Gram([*d, *[f"ect{k + 1}" for k in range(rank)], *more], g.n, g.w, g.mean @ t, t.T @ g.centred @ t)
    out = None
    for x in d:
        one = from_gram(new, x, new.names[len(d) :]).table(df.sparkSession).select(F.lit(x[2:]).alias("equation"), "*")
        out = one if out is None else out.unionByName(one)
    return out, b


# --- volatility ------------------------------------------------------------------------------------------------------------


def _garch_variance(theta: np.ndarray, e: np.ndarray, kind: str) -> np.ndarray:
    """Of order (1, 1): omega, alpha, beta and, for the asymmetric kinds, gamma."""
    v = np.empty(len(e))
    base = float(np.mean(e * e))
    v[0] = base
    if kind == "egarch":
        omega, alpha, beta, gamma = theta
        log = math.log(base)
        for t in range(1, len(e)):
            z = e[t - 1] / math.sqrt(v[t - 1])
            log = min(50.0, max(-50.0, omega + beta * log + alpha * (abs(z) - math.sqrt(2 / math.pi)) + gamma * z))
            v[t] = math.exp(log)
        return v
    if kind == "igarch":
        omega, alpha = theta
        beta, gamma = 1 - alpha, 0.0
    elif kind == "gjr":
        omega, alpha, beta, gamma = theta
    else:
        (omega, alpha, beta), gamma = theta, 0.0
    news = omega + (alpha + gamma * (e[:-1] < 0)) * e[:-1] ** 2
    beta = float(beta)
    return np.array(list(accumulate(news.tolist(), lambda last, new: new + beta * last, initial=base)))


def fit_garch(returns: np.ndarray, kind: str = "garch", dist: str = "normal") -> dict[str, float]:
    """One series by maximum likelihood over unbounded parameters; dist: normal or t."""
    x = np.asarray(returns, float)
    mean, scale = x.mean(), x.std() or 1.0
    e = (x - mean) / scale
    sig = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    # A step may go far out: its infinite variance makes the search take a shorter one.
    exp = lambda z: math.exp(z) if z < 700 else math.inf

    def unpack(u: np.ndarray) -> tuple[np.ndarray, float]:
        if kind == "egarch":
            theta = np.array([u[0], u[1], math.tanh(u[2]), u[3]])
        elif kind == "igarch":
            theta = np.array([exp(u[0]), sig(u[1])])
        else:
            total = 0.9999 * sig(u[1])
            alpha = total * sig(u[2])
            theta = np.array([exp(u[0]), alpha, total - alpha])
            if kind == "gjr":
                theta = np.append(theta, 2 * (1 - total) * sig(u[3]))
        return theta, 2.05 + math.exp(min(10.0, u[-1])) if dist == "t" else math.inf

    start = {"egarch": [0.0, 0.1, 1.5, 0.0], "igarch": [-4.0, -2.0], "garch": [-2.5, 2.2, -2.0], "gjr": [-2.5, 2.0, -2.0, -2.0]}[kind]
    start = np.array([*start, *([1.5] if dist == "t" else [])], float)

    def loss(u: np.ndarray) -> float:
        theta, nu = unpack(u)
        v = _garch_variance(theta, e, kind)
        if not np.isfinite(v).all() or (v <= 0).any():
            return 1e10
        z2 = e * e / v
        if math.isinf(nu):
            return 0.5 * float(np.sum(np.log(2 * math.pi * v) + z2))
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return float(-np.sum(c - 0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(z2 / (nu - 2))))

    u, value, ok = minimise(loss, start, rounds=200, tol=1e-6)
    theta, nu = unpack(u)
    try:
        cov = np.linalg.inv(numeric_hessian(loss, u))
        jac = np.array([(unpack(u + d)[0] - unpack(u - d)[0]) / 2e-5 for d in np.eye(len(u)) * 1e-5]).T
        se = np.sqrt(np.maximum(0, np.diag(jac @ cov @ jac.T)))
    except np.linalg.LinAlgError:
        se = np.full(len(theta), math.nan)
    names = ["omega", "alpha", "beta", "gamma"][: len(theta)]
    out = dict(zip(names, theta.tolist())) | {f"se_{k}": float(s) for k, s in zip(names, se)}
    if kind != "egarch":
        out["omega"] *= scale**2
        out["se_omega"] *= scale**2
    else:
        out["omega"] += (1 - out["beta"]) * math.log(scale**2)
    beta = 1 - out["alpha"] if kind == "igarch" else out["beta"]
    p = {"egarch": beta, "igarch": 1.0}.get(kind, out["alpha"] + beta + out.get("gamma", 0.0) / 2)
    return out | {"beta": beta, "gamma": out.get("gamma", 0.0), "mean": mean, "nu": nu if not math.isinf(nu) else math.nan, "persistence": p, "unconditional": out["omega"] / (1 - p) if p < 1 and kind != "egarch" else math.nan, "half_life": math.log(0.5) / math.log(p) if 0 < p < 1 else math.nan, "loglik": -value - len(x) * math.log(scale), "n": float(len(x)), "converged": float(ok)}


def per_series(df: DataFrame, key: str, order: str, value: str, f: Callable[[np.ndarray], dict[str, float]], names: Sequence[str]) -> DataFrame:
    """(key, names...): f applied to each series in its order, one task a series; a series must fit a task."""
    kind = dict(df.dtypes)[key]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__o")
        out = f(rows["__v"].to_numpy())
        return pd.DataFrame([{"k": rows["k"].iloc[0], **{n: float(out[n]) if out.get(n) is not None else math.nan for n in names}}])

    own = df.select(F.col(key).alias("k"), F.col(order).alias("__o"), number(value).alias("__v")).dropna()
    return own.groupBy("k").applyInPandas(run, f"k {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("k", key)


GARCH_NAMES = ("omega", "alpha", "beta", "gamma", "persistence", "unconditional", "half_life", "loglik", "n")


def garch(df: DataFrame, key: str, order: str, value: str, kind: str = "garch", dist: str = "normal") -> DataFrame:
    return per_series(df, key, order, value, lambda x: fit_garch(x, kind, dist), GARCH_NAMES)


def garch_forecast(fit: dict[str, float], last_return: float, last_variance: float, steps: int, paths: int = 1000, seed: int = 1) -> pd.DataFrame:
    """(step, mean, lower, upper) of the variance over simulated paths, 5 and 95 % bounds."""
    random = np.random.RandomState(seed)
    v = np.full(paths, fit["omega"] + (fit["alpha"] + fit["gamma"] * (last_return < 0)) * last_return**2 + fit["beta"] * last_variance)
    rows = []
    for h in range(1, steps + 1):
        rows.append((h, v.mean(), *np.percentile(v, (5, 95))))
        e = np.sqrt(v) * random.randn(paths)
        v = fit["omega"] + (fit["alpha"] + fit["gamma"] * (e < 0)) * e**2 + fit["beta"] * v
    return pd.DataFrame(rows, columns=["step", "mean", "lower", "upper"])


def news_impact(fit: dict[str, float], shocks: Sequence[float], variance: float) -> list[tuple[float, float]]:
    return [(e, fit["omega"] + (fit["alpha"] + fit["gamma"] * (e < 0)) * e * e + fit["beta"] * variance) for e in shocks]


# --- state space -------------------------------------------------------------------------------------------------------------


class Kalman:
    """x' = F x + w, z = H x + v with covariances Q and R."""

    def __init__(self, f, h, q, r, x0=None, p0=None):
        self.f, self.h, self.q, self.r = (np.atleast_2d(np.asarray(m, float)) for m in (f, h, q, r))
        k = len(self.f)
        self.x = np.zeros(k) if x0 is None else np.asarray(x0, float)
        self.p = np.eye(k) if p0 is None else np.atleast_2d(np.asarray(p0, float))

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + self.q
        return self.x, self.p

    def update(self, z) -> float:
        """The measurement's log-likelihood; a missing one (NaN) changes nothing."""
        z = np.atleast_1d(np.asarray(z, float))
        if np.isnan(z).any():
            return 0.0
        e = z - self.h @ self.x
        s = self.h @ self.p @ self.h.T + self.r
        gain = np.linalg.solve(s, self.h @ self.p).T
        self.x = self.x + gain @ e
        m = np.eye(len(self.x)) - gain @ self.h
        self.p = m @ self.p @ m.T + gain @ self.r @ gain.T
        return float(-0.5 * (len(z) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e)))

    def filter(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """(predicted x and P, filtered x and P, loglik) over all measurements."""
        xp, pp, xf, pf, ll = [], [], [], [], 0.0
        for row in z:
            a, b = self.predict()
            xp.append(a)
            pp.append(b)
            ll += self.update(row)
            xf.append(self.x)
            pf.append(self.p)
        return np.array(xp), np.array(pp), np.array(xf), np.array(pf), ll

    def smooth(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rauch, Tung and Striebel's backward pass."""
        xp, pp, xs, ps, ll = self.filter(z)
        xs, ps = xs.copy(), ps.copy()
        for t in range(len(xs) - 2, -1, -1):
            c = np.linalg.solve(pp[t + 1], self.f @ ps[t]).T
            xs[t] = xs[t] + c @ (xs[t + 1] - xp[t + 1])
            ps[t] = ps[t] + c @ (ps[t + 1] - pp[t + 1]) @ c.T
        return xs, ps, ll


def local_level(df: DataFrame, key: str, order: str, value: str, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """(key, order, value, filtered, smoothed) of a random walk with noise, per series."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        z = rows["v"].to_numpy()[:, None]
        start = float(z[0, 0])
        filtered = Kalman(1.0, 1.0, q, r, [start], r).filter(z)[2]
        smoothed = Kalman(1.0, 1.0, q, r, [start], r).smooth(z)[0]
        return rows.assign(filtered=filtered[:, 0], smoothed=smoothed[:, 0])

    own = df.select(F.col(key).alias("k"), F.col(order).alias("o"), number(value).alias("v")).dropna()
    out = own.groupBy("k").applyInPandas(run, f"k {kinds[key]}, o {kinds[order]}, v double, filtered double, smoothed double")
    return out.withColumnsRenamed({"k": key, "o": order, "v": value})


# --- change points and warping -----------------------------------------------------------------------------------------------


def pelt(x: np.ndarray, cost: str = "l2", penalty: float | None = None, least: int = 2) -> list[int]:
    """The starts of the segments after the first, by pruned exact search. penalty: 2 ln n times the variance of the noise
    for l2 (from first differences), 4 ln n else."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 * least:
        return []
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    if penalty is None:
        noise = max(np.median(np.abs(np.diff(x))) / 0.6745, 1e-8) ** 2 / 2
        penalty = 2 * math.log(n) * noise if cost == "l2" else 4 * math.log(n)

    def costs(a: np.ndarray, b: int) -> np.ndarray:
        m = b - a
        t = s1[b] - s1[a]
        ss = np.maximum(s2[b] - s2[a] - t * t / m, 0)
        if cost == "l2":
            return ss
        if cost == "gaussian":
            return m * (np.log(np.maximum(ss / m, 1e-8)) + 1)
        if cost == "poisson":
            return 2 * np.where(t > 0, t - t * np.log(np.maximum(t / m, 1e-300)), 0.0)
        raise ValueError("cost must be l2, gaussian or poisson")

    best = np.full(n + 1, math.inf)
    best[0], back, live = -penalty, np.zeros(n + 1, int), np.array([0])
    for b in range(least, n + 1):
        c = best[live] + costs(live, b)
        k = int(c.argmin())
        best[b], back[b] = c[k] + penalty, live[k]
        live = live[c <= best[b]] if b >= 2 * least else live
        new = b - least + 1
        if new >= least and math.isfinite(best[new]):
            live = np.append(live, new)
    out, b = [], n
    while back[b]:
        b = back[b]
        out.append(int(b))
    return out[::-1]


def change_points(df: DataFrame, key: str, order: str, value: str, cost: str = "l2", penalty: float | None = None) -> DataFrame:
    """(key, order) of the first row of each segment but the first, per series."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o").reset_index(drop=True)
        return rows.loc[pelt(rows["v"].to_numpy(), cost, penalty), ["k", "o"]]

    own = df.select(F.col(key).alias("k"), F.col(order).alias("o"), number(value).alias("v")).dropna()
    return own.groupBy("k").applyInPandas(run, f"k {kinds[key]}, o {kinds[order]}").withColumnsRenamed({"k": key, "o": order})


def dtw_distance(a: Sequence[float], b: Sequence[float], window: int | None = None) -> float:
    """The root of the least sum of squares over warping paths within a band (10 % of the longer, 10 at least)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if not n or not m:
        return math.nan
    w = max(window if window is not None else max(10, int(0.1 * max(n, m))), abs(n - m))
    last = np.full(m + 1, math.inf)
    last[0] = 0.0
    for i in range(1, n + 1):
        now = np.full(m + 1, math.inf)
        for j in range(max(1, i - w), min(m, i + w) + 1):
            now[j] = (a[i - 1] - b[j - 1]) ** 2 + min(last[j], last[j - 1], now[j - 1])
        last = now
    return math.sqrt(last[m])


def dtw_path(a: Sequence[float], b: Sequence[float]) -> list[tuple[int, int]]:
    a, b = np.asarray(a, float), np.asarray(b, float)
    d = np.full((len(a) + 1, len(b) + 1), math.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i - 1, j - 1], d[i, j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        out.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda s: d[s])
    return out[::-1]


def dtw(df: DataFrame, a: str, b: str, into: str = "dtw", window: int | None = None) -> DataFrame:
    """A column of distances between two array columns, by Arrow batches."""
    f = F.pandas_udf(lambda x, y: pd.Series([dtw_distance(p, q, window) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64"), "double")
    return df.withColumn(into, f(F.col(a), F.col(b)))


def series_plot(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    return df.select(order, *columns).orderBy(order)
