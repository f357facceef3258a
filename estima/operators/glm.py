"""Generalized linear, count and discrete-choice models: Newton steps, one aggregate an iteration.

Parameters enter each round as literals of a fresh expression over the same base, so plans don't grow.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import distributions as D
from ..functions.result import coefficients, frame
from ..plans.gram import complete, gram, number
from .linear import INTERCEPT, _inverse, solve

CANONICAL = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "log", "negative_binomial": "log"}


@dataclass
class GlmFit:
    family: str
    link: str
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    deviance: float
    null_deviance: float
    loglik: float
    dispersion: float
    theta: float
    rounds: int

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, np.diag(self.vcov)))

    def table(self, spark, level: float = 0.95) -> DataFrame:
        free = self.family in ("gaussian", "gamma")
        return coefficients(spark, self.terms, self.beta, self.se, self.n - len(self.beta) if free else math.inf, level)

    def metrics(self) -> dict[str, float]:
        k = len(self.beta) + (self.family in ("gaussian", "gamma", "negative_binomial"))
        return {"n": self.n, "deviance": self.deviance, "null_deviance": self.null_deviance, "loglik": self.loglik, "dispersion": self.dispersion, "theta": self.theta, "aic": -2 * self.loglik + 2 * k, "bic": -2 * self.loglik + math.log(self.n) * k, "rounds": self.rounds}

    def linear(self, offset: Column | None = None) -> Column:
        out = offset if offset is not None else F.lit(0.0)
        for t, b in zip(self.terms, self.beta):
            out = out + (F.lit(float(b)) if t == INTERCEPT else F.lit(float(b)) * number(t))
        return out

    def prediction(self, offset: Column | None = None) -> Column:
        return C.inverse_link(self.link, self.linear(offset))


def _eta(beta: np.ndarray, names: Sequence[str], offset: Column) -> Column:
    out = offset + F.lit(float(beta[0]))
    for n, b in zip(names, beta[1:]):
        out = out + F.lit(float(b)) * F.col(f"`{n}`")
    return out


def _loglik(family: str, y: Column, mu: Column, theta: float, dispersion: float) -> Column:
    if family == "gaussian":
        return -0.5 * (F.pow(y - mu, 2) / dispersion + math.log(2 * math.pi * dispersion))
    if family == "binomial":
        return F.when(y > 0, y * F.log(mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0.0)
    if family == "poisson":
        return y * F.log(mu) - mu - C.log_gamma(y + 1)
    if family == "gamma":
        a = 1 / dispersion
        return a * F.log(a * y / mu) - a * y / mu - F.log(y) - math.lgamma(a)
    return C.log_gamma(y + theta) - math.lgamma(theta) - C.log_gamma(y + 1) + theta * F.log(theta / (theta + mu)) + F.when(y > 0, y * F.log(mu / (theta + mu))).otherwise(0.0)


def _irls(own: DataFrame, names: list[str], family: str, link: str, theta: float, weight: Column, l2: float, start: np.ndarray | None, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(beta, (X'WX)^-1, Pearson statistic / total weight less terms, rounds)."""
    y, offset = F.col("__y"), F.col("__offset")
    beta, bread = start, None
    for step in range(1, rounds + 1):
        if beta is None:
            mu = {"binomial": (y + 0.5) / 2, "gaussian": y}.get(family, y + 0.1)
            eta = (mu - 0.5) * 2.5 if link == "probit" else C.link(link, mu)
        else:
            eta = _eta(beta, names, offset)
            if family == "binomial":
                eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))
            mu = C.inverse_link(link, eta)
        if family == "binomial":
            mu = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), mu))
        slope = C.mean_slope(link, eta)
        w = weight * slope * slope / C.variance(family, mu, theta)
        z = eta - offset + (y - mu) / slope
        g = gram(own.select(z.alias("__z"), w.alias("__w"), *[F.col(f"`{n}`") for n in names]).where("__w > 0"), ["__z", *names], "__w")
        if l2:
            i, j = g.at(names), 0
            a = g.centred[np.ix_(i, i)] + l2 * np.eye(len(i))
            b = np.linalg.solve(a, g.centred[i, j])
            new, bread = np.concatenate([[g.mean[j] - g.mean[i] @ b], b]), solve(g, "__z", names)[2]
        else:
            _, new, bread, _, _ = solve(g, "__z", names)
        done = beta is not None and np.abs(new - beta).max() <= tol * (1 + np.abs(new).max())
        beta = new
        if done:
            break
    return beta, bread, math.nan, step


def glm(df: DataFrame, y: str, x: Sequence[str], family: str = "gaussian", link: str | None = None, weight: str | None = None, offset: str | None = None, theta: float | None = None, l2: float = 0.0, rounds: int = 50, tol: float = 1e-8) -> GlmFit:
    """By iteratively reweighted least squares. theta: of the negative binomial; estimated in turn with the
    coefficients where none is given. An offset is added to the linear predictor."""
    link = link or CANONICAL[family]
    names = list(x)
    columns = {"__y": y, **{n: n for n in names}}
    columns |= {"__weight": weight} if weight else {}
    columns |= {"__offset": offset} if offset else {}
    own = complete(df, columns)
    own = own if offset else own.withColumn("__offset", F.lit(0.0))
    if family == "gamma" and own.where("__y <= 0").limit(1).count():
        raise ValueError("gamma regression needs y > 0")
    w = F.col("__weight") if weight else F.lit(1.0)
    total = lambda c: own.agg(F.sum(c)).first()[0]
    t = theta or 1.0
    beta, bread, _, steps = _irls(own, names, family, link, t, w, l2, None, rounds, tol)
    if family == "negative_binomial" and theta is None:
        for _ in range(25):
            mu = C.inverse_link(link, _eta(beta, names, F.col("__offset")))
            new = _theta(own, mu, t)
            beta, bread, _, more = _irls(own, names, family, link, new, w, l2, beta, rounds, tol)
            steps += more
            if abs(new - t) < 1e-6 * new:
                t = new
                break
            t = new
    mu = C.inverse_link(link, _eta(beta, names, F.col("__offset")))
    yc = F.col("__y")
    r = own.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * C.unit_deviance(family, yc, mu, t)).alias("dev"), F.sum(w * F.pow(yc - mu, 2) / C.variance(family, mu, t)).alias("pearson"), (F.sum(w * yc) / F.sum(w)).alias("mean")).first()
    dispersion = r["pearson"] / (r["n"] - len(beta)) if family in ("gaussian", "gamma") else 1.0
    null = total(w * C.unit_deviance(family, yc, F.lit(float(r["mean"])), t)) if offset is None else math.nan
    phi = r["dev"] / r["n"] if family in ("gaussian", "gamma") else 1.0
    loglik = total(w * _loglik(family, yc, mu, t, phi))
    return GlmFit(family, link, [INTERCEPT, *names], beta, bread * dispersion, r["n"], r["dev"], null, loglik, dispersion, t if family == "negative_binomial" else math.nan, steps)


def _theta(own: DataFrame, mu: Column, start: float) -> float:
    """The negative binomial's theta for fixed means: the likelihood on a grid that narrows, all points in one pass."""
    low, high = start / 30, start * 30
    y = F.col("__y")
    for _ in range(6):
        grid = np.geomspace(low, high, 13)
        row = own.agg(*[F.sum(_loglik("negative_binomial", y, mu, float(t), 1.0)).alias(f"l{i}") for i, t in enumerate(grid)]).first()
        k = int(np.argmax([row[i] for i in range(len(grid))]))
        low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    return float(math.sqrt(low * high))


def logistic(df: DataFrame, y: str, x: Sequence[str], **more) -> GlmFit:
    return glm(df, y, x, "binomial", **more)


def probit(df: DataFrame, y: str, x: Sequence[str], **more) -> GlmFit:
    return glm(df, y, x, "binomial", "probit", **more)


def poisson(df: DataFrame, y: str, x: Sequence[str], **more) -> GlmFit:
    return glm(df, y, x, "poisson", **more)


def negative_binomial(df: DataFrame, y: str, x: Sequence[str], **more) -> GlmFit:
    return glm(df, y, x, "negative_binomial", **more)


def gamma(df: DataFrame, y: str, x: Sequence[str], link: str = "log", **more) -> GlmFit:
    return glm(df, y, x, "gamma", link, **more)


def proximal(df: DataFrame, y: str, x: Sequence[str], family: str = "binomial", l1: float = 0.0, l2: float = 0.0, rounds: int = 30) -> dict[str, float]:
    """A penalised fit, -loglik / n + l1 |b| + l2/2 |b|^2, the intercept free: each round solves the penalised weighted
    least squares of the current quadratic approximation by coordinate descent on its cross-products."""
    from .linear import _descend

    link, names = CANONICAL[family], list(x)
    own = complete(df, {"__y": y, **{n: n for n in names}}).withColumn("__offset", F.lit(0.0))
    beta = np.zeros(len(names) + 1)
    m = own.agg(F.avg("__y")).first()[0]
    beta[0] = {"binomial": lambda: math.log(m / (1 - m)), "gaussian": lambda: m}.get(family, lambda: math.log(m))()
    for _ in range(rounds):
        eta = _eta(beta, names, F.col("__offset"))
        mu, slope = C.inverse_link(link, eta), C.mean_slope(link, eta)
        w = slope * slope / C.variance(family, mu)
        g = gram(own.select((eta + (F.col("__y") - mu) / slope).alias("__z"), w.alias("__w"), *[F.col(f"`{n}`") for n in names]), ["__z", *names], "__w")
        i = g.at(names)
        b = _descend(g.centred[np.ix_(i, i)] / g.n, g.centred[i, 0] / g.n, l1, l2)
        new = np.concatenate([[g.mean[0] - g.mean[i] @ b], b])
        done = np.abs(new - beta).max() < 1e-8 * (1 + np.abs(new).max())
        beta = new
        if done:
            break
    return dict(zip([INTERCEPT, *names], beta.tolist()))


# --- zero-inflated and hurdle models -------------------------------------------------------------------------------


def zero_inflated(df: DataFrame, y: str, x: Sequence[str], z: Sequence[str], family: str = "poisson", rounds: int = 60, tol: float = 1e-7) -> tuple[DataFrame, dict[str, float]]:
    """(coefficients of the count and the zero part with standard errors, metrics): by the EM algorithm, two weighted fits
    a round. Standard errors come from the observed information, whose gradient products are one aggregate."""
    xs, zs = list(x), list(z)
    own = complete(df, {"__y": y, **{f"x_{c}": c for c in xs}, **{f"z_{c}": c for c in zs}}).withColumn("__offset", F.lit(0.0))
    nx, nz = [f"x_{c}" for c in xs], [f"z_{c}" for c in zs]
    yc, theta = F.col("__y"), 1.0
    n, zero, mean = own.agg(F.count("*"), F.avg((yc == 0).cast("double")), F.avg("__y")).first()
    b, a = np.zeros(len(nx) + 1), np.zeros(len(nz) + 1)
    b[0], a[0] = math.log(max(mean, 1e-6) / max(1e-6, 1 - zero / 2)), math.log(max(zero / 2, 1e-3) / max(1e-3, 1 - zero / 2))
    last = -math.inf

    def parts(b: np.ndarray, a: np.ndarray, theta: float) -> tuple[Column, Column, Column, Column]:
        mu = F.exp(_eta(b, nx, F.lit(0.0)))
        pi = 1 / (1 + F.exp(-_eta(a, nz, F.lit(0.0))))
        p0 = F.exp(-mu) if family == "poisson" else F.pow(theta / (theta + mu), theta)
        return mu, pi, p0, F.when(yc == 0, pi / (pi + (1 - pi) * p0)).otherwise(0.0)

    for step in range(rounds):
        mu, pi, p0, w = parts(b, a, theta)
        held = own.withColumns({"__w": 1 - w, "__t": w})
        b = _irls(held, nx, family, "log", theta, F.col("__w"), 0.0, b, 3, tol)[0]
        a = _irls(held.withColumn("__y", F.col("__t")), nz, "binomial", "logit", 1.0, F.lit(1.0), 0.0, a, 3, tol)[0]
        if family == "negative_binomial" and step % 3 == 0:
            theta = _zinb_theta(own, lambda t: parts(b, a, t), theta)
        mu, pi, p0, w = parts(b, a, theta)
        one = F.when(yc == 0, F.log(pi + (1 - pi) * p0)).otherwise(F.log(1 - pi) + _loglik(family, yc, mu, theta, 1.0))
        now = own.agg(F.sum(one)).first()[0]
        if abs(now - last) < tol * (abs(now) + 1):
            break
        last = now
    mu, pi, p0, w = parts(b, a, theta)
    slope = (yc - mu) / (1 if family == "poisson" else 1 + mu / theta)
    gx, gz = (1 - w) * slope, w - pi
    x1, z1 = [F.lit(1.0), *[F.col(c) for c in nx]], [F.lit(1.0), *[F.col(c) for c in nz]]
    names = [f"g{i}" for i in range(len(x1) + len(z1))]
    outer = gram(own.select(*[(c * gx).alias(m) for m, c in zip(names, x1)], *[(c * gz).alias(m) for m, c in zip(names[len(x1) :], z1)]), names).raw(names)
    se = np.sqrt(np.diag(_inverse(outer)))
    fitted = own.agg(F.avg((1 - pi) * mu), F.avg(pi + (1 - pi) * p0)).first()
    table = coefficients(df.sparkSession, [f"count:{t}" for t in [INTERCEPT, *xs]] + [f"zero:{t}" for t in [INTERCEPT, *zs]], np.concatenate([b, a]), se)
    plain = glm(df, y, xs, family, theta=None if family == "negative_binomial" else 1.0)
    mu0 = F.exp(_eta(plain.beta, nx, F.lit(0.0)))
    one = F.when(yc == 0, F.log(pi + (1 - pi) * p0)).otherwise(F.log(1 - pi) + _loglik(family, yc, mu, theta, 1.0))
    m = own.agg(F.avg(one - _loglik(family, yc, mu0, plain.theta if family != "poisson" else 1.0, 1.0)), F.stddev_samp(one - _loglik(family, yc, mu0, plain.theta if family != "poisson" else 1.0, 1.0))).first()
    return table, {"n": n, "loglik": now, "aic": -2 * now + 2 * len(names), "zero_share": zero, "fitted_mean": fitted[0], "fitted_zero": fitted[1], "theta": theta, "vuong": math.sqrt(n) * m[0] / m[1] if m[1] else math.nan, "rounds": step + 1}


def _zinb_theta(own: DataFrame, parts: Callable, start: float) -> float:
    low, high, yc = start / 10, start * 10, F.col("__y")
    for _ in range(3):
        grid = np.geomspace(low, high, 9)
        sums = []
        for i, t in enumerate(grid):
            mu, pi, p0, _ = parts(float(t))
            sums.append(F.sum(F.when(yc == 0, F.log(pi + (1 - pi) * p0)).otherwise(F.log(1 - pi) + _loglik("negative_binomial", yc, mu, float(t), 1.0))).alias(f"l{i}"))
        row = own.agg(*sums).first()
        k = int(np.argmax([row[i] for i in range(len(grid))]))
        low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    return float(math.sqrt(low * high))


def newton(own: DataFrame, start: np.ndarray, terms: Callable[[np.ndarray], tuple[Column, list[Column], list[list[Column]]]], rounds: int = 60, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(parameters, inverse information, loglik, rounds) by Newton's method: terms gives the row's log-likelihood, its
    gradient and Hessian as expressions, which one aggregate a round sums. Steps that lose are halved."""
    p, last, step = start.astype(float), None, None
    for done in range(1, rounds + 1):
        ll, grad, hess = terms(p)
        k = len(p)
        row = own.agg(F.sum(ll).alias("l"), *[F.sum(g).alias(f"g{i}") for i, g in enumerate(grad)], *[F.sum(hess[i][j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if last is not None and (row["l"] is None or math.isnan(row["l"]) or row["l"] < last - 1e-9 * (abs(last) + 1)):
            step = step / 2
            if np.abs(step).max() < 1e-10:
                break
            p = base + step
            continue
        g = np.array([row[f"g{i}"] for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.lstsq(-h, g, rcond=None)[0]
        base, last, info = p, row["l"], -h
        if np.abs(step).max() <= tol * (1 + np.abs(p).max()):
            break
        p = p + step
    return base, _inverse(info), last, done


def hurdle_poisson(df: DataFrame, y: str, x: Sequence[str], z: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """A logit of y > 0 and a zero-truncated Poisson of the positive counts."""
    xs, zs = list(x), list(z or x)
    first = glm(df.withColumn("__pos", (number(y) > 0).cast("double")), "__pos", zs, "binomial")
    own = complete(df.where(number(y) > 0), {"__y": y, **{c: c for c in xs}})
    cols, yc = [F.lit(1.0), *[F.col(f"`{c}`") for c in xs]], F.col("__y")

    def terms(p: np.ndarray):
        mu = F.exp(_eta(p, xs, F.lit(0.0)))
        q = -F.expm1(-mu)
        ratio = mu / q
        slope = yc - ratio
        curve = ratio * (1 - mu * F.exp(-mu) / q)
        return yc * F.log(mu) - mu - F.log(q) - C.log_gamma(yc + 1), [slope * c for c in cols], [[-curve * a * b for b in cols] for a in cols]

    start = np.zeros(len(cols))
    start[0] = math.log(own.agg(F.avg("__y")).first()[0])
    b, cov, ll, _ = newton(own, start, terms)
    se = np.concatenate([np.sqrt(np.diag(cov)), first.se])
    table = coefficients(df.sparkSession, [f"count:{t}" for t in [INTERCEPT, *xs]] + [f"zero:{t}" for t in [INTERCEPT, *zs]], np.concatenate([b, first.beta]), se)
    k = len(se)
    return table, {"n": first.n, "loglik": ll + first.loglik, "aic": -2 * (ll + first.loglik) + 2 * k}


# --- discrete choice ------------------------------------------------------------------------------------------------


@dataclass
class OrderedFit:
    classes: list
    names: list[str]
    beta: np.ndarray
    cuts: np.ndarray
    vcov: np.ndarray
    loglik: float
    null_loglik: float
    n: int
    dist: str

    def probabilities(self) -> dict[object, Column]:
        eta = sum((F.lit(float(b)) * number(c) for c, b in zip(self.names, self.beta)), F.lit(0.0))
        cdf = [F.lit(0.0), *[_cdf(self.dist, F.lit(float(c)) - eta) for c in self.cuts], F.lit(1.0)]
        return {k: cdf[i + 1] - cdf[i] for i, k in enumerate(self.classes)}

    def predicted(self) -> Column:
        p = self.probabilities()
        best = F.greatest(*p.values())
        out = F.lit(self.classes[-1])
        for k in reversed(self.classes):
            out = F.when(p[k] >= best, F.lit(k)).otherwise(out)
        return out

    def marginal_effects(self, means: dict[str, float]) -> dict[object, dict[str, float]]:
        eta = sum(b * means[c] for c, b in zip(self.names, self.beta))
        pdf = (lambda v: math.exp(-abs(v)) / (1 + math.exp(-abs(v))) ** 2) if self.dist == "logit" else D.norm_pdf
        f = [0.0, *[pdf(c - eta) for c in self.cuts], 0.0]
        return {k: {c: float(b * (f[i] - f[i + 1])) for c, b in zip(self.names, self.beta)} for i, k in enumerate(self.classes)}

    def table(self, spark) -> DataFrame:
        terms = [*self.names, *[f"cut:{a}|{b}" for a, b in zip(self.classes, self.classes[1:])]]
        return coefficients(spark, terms, np.concatenate([self.beta, self.cuts]), np.sqrt(np.diag(self.vcov)))

    @property
    def mcfadden(self) -> float:
        return 1 - self.loglik / self.null_loglik


def _cdf(dist: str, v: Column) -> Column:
    return 1 / (1 + F.exp(-v)) if dist == "logit" else C.norm_cdf(v)


def ordered(df: DataFrame, y: str, x: Sequence[str], dist: str = "logit") -> OrderedFit:
    """Ordered logit or probit with the full Hessian over coefficients and thresholds."""
    xs = list(x)
    own = complete(df, {c: c for c in xs}, [F.col(y).alias("__y")]).where("__y IS NOT NULL")
    counts = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    n = sum(counts.values())
    index = F.lit(0)
    for i, k in enumerate(classes):
        index = F.when(F.col("__y") == F.lit(k), i).otherwise(index)
    own = own.withColumn("__k", index)
    g = gram(own, xs)
    mean, sd = g.mean, np.sqrt(np.diag(g.centred) / g.n)
    own = own.withColumns({c: (F.col(f"`{c}`") - float(m)) / float(s) for c, m, s in zip(xs, mean, sd)})
    share = np.cumsum([counts[k] for k in classes])[:-1] / n
    cuts = np.array([math.log(p / (1 - p)) if dist == "logit" else D.norm_ppf(p) for p in share])
    p, q = len(xs), len(cuts)
    cols, k = [F.col(f"`{c}`") for c in xs], F.col("__k")
    pdf = (lambda v: F.exp(-F.abs(v)) / F.pow(1 + F.exp(-F.abs(v)), 2)) if dist == "logit" else C.norm_pdf
    slope = (lambda v: pdf(v) * (1 - 2 / (1 + F.exp(-v)))) if dist == "logit" else (lambda v: -v * C.norm_pdf(v))

    def terms(t: np.ndarray):
        eta = sum((F.lit(float(b)) * c for c, b in zip(cols, t[:p])), F.lit(0.0))
        cut = lambda shift: F.element_at(F.array(*[F.lit(float(c)) for c in t[p:]]), F.greatest(F.lit(1), F.least(F.lit(q), k + 1 + shift)).cast("int"))
        top, bottom = k == q, k == 0
        u, v = cut(0) - eta, cut(-1) - eta
        fu, fv = F.when(top, 0.0).otherwise(pdf(u)), F.when(bottom, 0.0).otherwise(pdf(v))
        du, dv = F.when(top, 0.0).otherwise(slope(u)), F.when(bottom, 0.0).otherwise(slope(v))
        prob = F.greatest(F.when(top, 1.0).otherwise(_cdf(dist, u)) - F.when(bottom, 0.0).otherwise(_cdf(dist, v)), F.lit(1e-12))
        # How the upper and lower argument move with each parameter.
        a = [-c for c in cols] + [F.when(k == j, 1.0).otherwise(0.0) for j in range(q)]
        b = [-c for c in cols] + [F.when(k - 1 == j, 1.0).otherwise(0.0) for j in range(q)]
        grad = [(fu * i - fv * j) / prob for i, j in zip(a, b)]
        hess = [[(du * a[i] * a[j] - dv * b[i] * b[j]) / prob - grad[i] * grad[j] for j in range(p + q)] for i in range(p + q)]
        return F.log(prob), grad, hess

    t, cov, ll, _ = newton(own, np.concatenate([np.zeros(p), cuts]), terms)
    # Back from standardised columns: b / s, and the cuts shift by what the means took.
    back = np.zeros((p + q, p + q))
    back[:p, :p] = np.diag(1 / sd)
    back[p:, :p], back[p:, p:] = np.tile(mean / sd, (q, 1)), np.eye(q)
    t, cov = back @ t, back @ cov @ back.T
    null = sum(c * math.log(c / n) for c in counts.values())
    return OrderedFit(classes, xs, t[:p], t[p:], cov, ll, null, n, dist)


def multinomial(df: DataFrame, y: str, x: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """(coefficients of each class against the smallest, metrics with McFadden's R^2 and the hit rate)."""
    xs = list(x)
    own = complete(df, {c: c for c in xs}, [F.col(y).alias("__y")]).where("__y IS NOT NULL")
    counts = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    classes, n = sorted(counts), sum(counts.values())
    g = gram(own, xs)
    mean, sd = g.mean, np.sqrt(np.diag(g.centred) / g.n)
    cols = [F.lit(1.0), *[(F.col(f"`{c}`") - float(m)) / float(s) for c, m, s in zip(xs, mean, sd)]]
    k, m = len(cols), len(classes) - 1
    is_ = [(F.col("__y") == F.lit(c)).cast("double") for c in classes]

    def shares(t: np.ndarray) -> list[Column]:
        eta = [F.lit(0.0), *[sum((F.lit(float(b)) * c for c, b in zip(cols, t[j * k : (j + 1) * k])), F.lit(0.0)) for j in range(m)]]
        top = F.greatest(*eta)
        e = [F.exp(v - top) for v in eta]
        s = sum(e[1:], e[0])
        return [v / s for v in e]

    def terms(t: np.ndarray):
        p = shares(t)
        ll = sum((i * F.log(F.greatest(q, F.lit(1e-300))) for i, q in zip(is_, p)), F.lit(0.0))
        grad = [(is_[j + 1] - p[j + 1]) * c for j in range(m) for c in cols]
        hess = [[-p[a // k + 1] * ((1.0 if a // k == b // k else 0.0) - p[b // k + 1]) * cols[a % k] * cols[b % k] for b in range(m * k)] for a in range(m * k)]
        return ll, grad, hess

    start = np.zeros(m * k)
    for j, c in enumerate(classes[1:]):
        start[j * k] = math.log(counts[c] / counts[classes[0]])
    t, cov, ll, _ = newton(own, start, terms)
    p = shares(t)
    best = F.greatest(*p)
    hit = own.agg(F.avg(sum((i * (q >= best).cast("double") for i, q in zip(is_, p)), F.lit(0.0)))).first()[0]
    block = np.eye(k)
    block[1:, 1:] = np.diag(1 / sd)
    block[0, 1:] = -mean / sd
    back = np.kron(np.eye(m), block)
    t, cov = back @ t, back @ cov @ back.T
    null = sum(c * math.log(c / n) for c in counts.values())
    table = coefficients(df.sparkSession, [f"{c}:{v}" for c in classes[1:] for v in [INTERCEPT, *xs]], t, np.sqrt(np.diag(cov)))
    return table, {"n": n, "loglik": ll, "null_loglik": null, "mcfadden_r2": 1 - ll / null, "hit_rate": hit, "aic": -2 * ll + 2 * m * k}


def family_variance(df: DataFrame, mu: str, families: Sequence[str]) -> DataFrame:
    """The variance functions of the families at a column of means."""
    return df.select(mu, *[C.variance(f, F.col(mu), 1.0).alias(f) for f in families])


def metric_rows(spark, metrics: dict[str, float]) -> DataFrame:
    return frame(spark, [(k, float(v)) for k, v in metrics.items()], "metric string, value double")
