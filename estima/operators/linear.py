"""Linear models: all of them work from cross-product matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import coefficients, frame
from ..plans.gram import Gram, complete, gram, grouped, number

INTERCEPT = "intercept"


@dataclass
class Fit:
    """A fitted linear model. terms includes the intercept, first, if there is one."""

    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    df: float
    rss: float
    tss: float
    bread: np.ndarray
    columns: dict[str, str | Column] = field(default_factory=dict)
    y: str | Column = ""

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, np.diag(self.vcov)))

    @property
    def sigma2(self) -> float:
        return self.rss / self.df

    def table(self, spark, level: float = 0.95) -> DataFrame:
        return coefficients(spark, self.terms, self.beta, self.se, self.df, level)

    def metrics(self) -> dict[str, float]:
        k = len(self.terms)
        slopes = k - (INTERCEPT in self.terms)
        r2 = 1 - self.rss / self.tss if self.tss > 0 else math.nan
        loglik = -self.n / 2 * (math.log(2 * math.pi * self.rss / self.n) + 1)
        f = (self.tss - self.rss) / slopes / self.sigma2 if slopes else math.nan
        return {
            "n": self.n, "k": k, "r2": r2, "adj_r2": 1 - (1 - r2) * (self.n - (INTERCEPT in self.terms)) / self.df, "rse": math.sqrt(self.sigma2),
            "f_stat": f, "f_p_value": D.f_sf(f, slopes, self.df) if slopes else math.nan, "loglik": loglik, "aic": -2 * loglik + 2 * (k + 1), "bic": -2 * loglik + math.log(self.n) * (k + 1),
        }

    def prediction(self) -> Column:
        """The fitted value as an expression over the model's columns."""
        out = F.lit(0.0)
        for term, b in zip(self.terms, self.beta):
            out = out + (F.lit(float(b)) if term == INTERCEPT else F.lit(float(b)) * number(self.columns[term]))
        return out

    def leverage(self) -> Column:
        """x (X'X)^-1 x' as an expression: the n x n hat matrix is never formed."""
        x = [F.lit(1.0) if t == INTERCEPT else number(self.columns[t]) for t in self.terms]
        out = F.lit(0.0)
        for i, a in enumerate(x):
            for j in range(i, len(x)):
                c = float(self.bread[i, j]) * (1 if i == j else 2)
                out = out + F.lit(c) * a * x[j]
        return out


def _named(x: Sequence[str] | dict[str, str | Column]) -> dict[str, str | Column]:
    return dict(x) if isinstance(x, dict) else {c: c for c in x}


def design_gram(df: DataFrame, y: str | Column, x, weight: str | None = None) -> Gram:
    columns = {"__y": y, **_named(x)}
    own = complete(df, columns, [F.col(weight).cast("double").alias("__w")] if weight else [])
    return gram(own, list(columns), "__w" if weight else None)


def solve(g: Gram, y: str, x: Sequence[str], intercept: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """(terms, beta, (X'X)^-1, rss, tss) from a Gram; columns are scaled first, and collinear ones share their part."""
    x = list(x)
    terms = ([INTERCEPT] if intercept else []) + x
    j = g.at([y])[0]
    if intercept:
        i = g.at(x)
        a, b = g.centred[np.ix_(i, i)], g.centred[i, j]
        inverse = _inverse(a)
        slope = inverse @ b
        mean = g.mean[i]
        bread = np.empty((len(x) + 1,) * 2)
        bread[0, 0] = 1 / g.w + mean @ inverse @ mean
        bread[0, 1:] = bread[1:, 0] = -inverse @ mean
        bread[1:, 1:] = inverse
        beta = np.concatenate([[g.mean[j] - mean @ slope], slope])
        tss = g.centred[j, j]
        rss = tss - slope @ b
    else:
        a, b = g.raw(x), g.raw(x, [y])[:, 0]
        bread = _inverse(a)
        beta = bread @ b
        tss = g.raw([y])[0, 0]
        rss = tss - beta @ b
    return terms, beta, bread, float(max(rss, 0.0)), float(tss)


def _inverse(a: np.ndarray) -> np.ndarray:
    if not a.size:
        return a
    s = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.pinv(a / np.outer(s, s), rcond=1e-12, hermitian=True) / np.outer(s, s)


def from_gram(g: Gram, y: str, x: Sequence[str], intercept: bool = True, columns: dict | None = None, response: str | Column = "") -> Fit:
    terms, beta, bread, rss, tss = solve(g, y, x, intercept)
    dof = g.n - len(terms)
    if dof <= 0:
        raise ValueError(f"{g.n} complete rows are too few for {len(terms)} terms")
    return Fit(terms, beta, bread * rss / dof, g.n, dof, rss, tss, bread, columns or {}, response)


def ols(df: DataFrame, y: str | Column, x, weight: str | None = None, intercept: bool = True) -> Fit:
    """Ordinary or weighted least squares over the complete rows, in one aggregate. x: column names, or terms by name."""
    columns = _named(x)
    return from_gram(design_gram(df, y, columns, weight), "__y", list(columns), intercept, columns, y)


def predict(df: DataFrame, fit: Fit, into: str = "prediction") -> DataFrame:
    return df.withColumn(into, fit.prediction())


def predict_interval(df: DataFrame, fit: Fit, level: float = 0.95) -> DataFrame:
    """prediction, lower and upper: the interval of a new observation, leverage included."""
    q = D.t_ppf(0.5 + level / 2, fit.df)
    half = q * F.sqrt(fit.sigma2 * (1 + fit.leverage()))
    out = df.withColumn("prediction", fit.prediction())
    return out.withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half})


def compare_models(spark, fits: dict[str, Fit]) -> DataFrame:
    """Models by AIC, with differences and Akaike weights."""
    rows = []
    for name, fit in fits.items():
        m = fit.metrics()
        rows.append((name, m["aic"], m["bic"], m["loglik"], m["r2"]))
    table = frame(spark, rows, "model string, aic double, bic double, loglik double, r2 double")
    return akaike(table)


def akaike(table: DataFrame) -> DataFrame:
    """A small table of models with aic: beside it delta_aic and weight."""
    all_ = Window.partitionBy()
    out = table.withColumn("delta_aic", F.col("aic") - F.min("aic").over(all_))
    return out.withColumn("weight", F.exp(-F.col("delta_aic") / 2) / F.sum(F.exp(-F.col("delta_aic") / 2)).over(all_)).orderBy("aic")


# --- penalties, from the same cross-products -----------------------------------------------------------------


def ridge(df: DataFrame, y: str, x: Sequence[str], penalty: float) -> dict[str, float]:
    """(X'X + penalty I)^-1 X'y without intercept."""
    g = design_gram(df, y, x)
    b = np.linalg.solve(g.raw(list(x)) + penalty * np.eye(len(x)), g.raw(list(x), ["__y"])[:, 0])
    return dict(zip(x, b.tolist()))


def ridge_cv(df: DataFrame, y: str, x: Sequence[str], order: str, k: int = 5, penalties: Sequence[float] | None = None) -> DataFrame:
    """(penalty, cv_mse, gcv) over contiguous folds by an order key: one aggregate gives every fold's cross-products,
    and each training set is the total less a fold. Columns are centred."""
    from .prep import folds

    x = list(x)
    penalties = list(penalties) if penalties is not None else [10 ** (-2 + 0.5 * i) for i in range(10)]
    own = complete(df, {"__y": y, **{c: c for c in x}}, [F.col(order).alias("__o")])
    parts = grouped(folds(own, k, "__o"), ["__y", *x], "fold")
    total = parts[next(iter(parts))]
    for key in list(parts)[1:]:
        total = total + parts[key]
    i, j = total.at(x), 0
    rows = []
    for penalty in penalties:
        error = 0.0
        for part in parts.values():
            train = total - part
            b = np.linalg.solve(train.centred[np.ix_(i, i)] + penalty * np.eye(len(x)), train.centred[i, j])
            shift = (part.mean[j] - train.mean[j]) - (part.mean[i] - train.mean[i]) @ b
            error += part.centred[j, j] - 2 * b @ part.centred[i, j] + b @ part.centred[np.ix_(i, i)] @ b + part.n * shift**2
        a = total.centred[np.ix_(i, i)]
        b = np.linalg.solve(a + penalty * np.eye(len(x)), total.centred[i, j])
        rss = total.centred[j, j] - 2 * b @ total.centred[i, j] + b @ a @ b
        trace = np.trace(np.linalg.solve(a + penalty * np.eye(len(x)), a)) + 1
        rows.append((float(penalty), float(error / total.n), float(rss / total.n / (1 - trace / total.n) ** 2)))
    return frame(df.sparkSession, rows, "penalty double, cv_mse double, gcv double")


def _descend(a: np.ndarray, b: np.ndarray, l1: float, l2: float, sweeps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """min 1/2 w'aw - b'w + l1 |w| + l2/2 |w|^2 by coordinate descent."""
    w = np.zeros(len(b))
    for _ in range(sweeps):
        most = 0.0
        for k in range(len(b)):
            rest = b[k] - a[k] @ w + a[k, k] * w[k]
            new = math.copysign(max(abs(rest) - l1, 0.0), rest) / (a[k, k] + l2) if a[k, k] + l2 > 0 else 0.0
            most = max(most, abs(new - w[k]) * math.sqrt(a[k, k] + 1e-300))
            w[k] = new
        if most < tol * (1 + abs(b).max()):
            break
    return w


def lasso(df: DataFrame, y: str, x: Sequence[str], penalty: float) -> dict[str, float]:
    """1/2 RSS + penalty * sum |b| over standardised columns, with an intercept; coefficients in the columns' measure."""
    g = design_gram(df, y, x)
    i, j = g.at(list(x)), g.at(["__y"])[0]
    s = np.sqrt(np.diag(g.centred)[i] / g.w)
    b = _descend(g.centred[np.ix_(i, i)] / np.outer(s, s), g.centred[i, j] / s, penalty, 0.0) / s
    return {INTERCEPT: float(g.mean[j] - g.mean[i] @ b), **dict(zip(x, b.tolist()))}


def elastic_net(df: DataFrame, y: str, x: Sequence[str], alpha: float, l1_ratio: float = 0.5) -> dict[str, float]:
    """1/2 RSS + alpha n (l1_ratio |b| + (1 - l1_ratio)/2 |b|^2) over centred columns."""
    g = design_gram(df, y, x)
    i, j = g.at(list(x)), g.at(["__y"])[0]
    b = _descend(g.centred[np.ix_(i, i)], g.centred[i, j], alpha * g.w * l1_ratio, alpha * g.w * (1 - l1_ratio))
    return {INTERCEPT: float(g.mean[j] - g.mean[i] @ b), **dict(zip(x, b.tolist()))}


# --- robust and quantile regression ---------------------------------------------------------------------------


def _reweighted(own: DataFrame, names: list[str], weight: Column) -> np.ndarray:
    g = gram(own.withColumn("__w", weight), ["__y", *names], "__w")
    return solve(g, "__y", names)[1]


def _residual(names: list[str], beta: np.ndarray) -> Column:
    out = F.col("__y") - F.lit(float(beta[0]))
    for n, b in zip(names, beta[1:]):
        out = out - F.lit(float(b)) * F.col(f"`{n}`")
    return out


def huber(df: DataFrame, y: str, x: Sequence[str], delta: float = 1.35, rounds: int = 100, tol: float = 1e-9) -> dict[str, float]:
    """Huber's loss without a scale, by reweighted least squares: one aggregate a round."""
    names = list(x)
    own = complete(df, {"__y": y, **{c: c for c in names}})
    beta = solve(gram(own, ["__y", *names]), "__y", names)[1]
    for _ in range(rounds):
        new = _reweighted(own, names, F.least(F.lit(1.0), delta / F.greatest(F.abs(_residual(names, beta)), F.lit(1e-300))))
        done = np.abs(new - beta).max() < tol * (1 + np.abs(beta).max())
        beta = new
        if done:
            break
    return dict(zip([INTERCEPT, *names], beta.tolist()))


def quantile_fit(own: DataFrame, names: list[str], tau: float, rounds: int = 200, tol: float = 1e-7) -> tuple[np.ndarray, Column]:
    """By reweighted least squares on own (columns __y and names); the residual's floor shrinks to 1e-4 of its scale."""
    scale = own.agg(F.stddev_samp("__y")).first()[0] or 1.0
    beta = solve(gram(own, ["__y", *names]), "__y", names)[1]
    floor = 1e-1 * scale
    for _ in range(rounds):
        e = _residual(names, beta)
        side = F.when(e > 0, tau).otherwise(1 - tau)
        new = _reweighted(own, names, side / F.greatest(F.abs(e), F.lit(floor)))
        done = np.abs(new - beta).max() < tol * (1 + np.abs(beta).max())
        beta = new
        if done and floor <= 1e-4 * scale:
            break
        floor = max(floor / 2, 1e-4 * scale)
    return beta, _residual(names, beta)


def quantile(df: DataFrame, y: str, x: Sequence[str], tau: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """(coefficients with the sparsity standard error, {pseudo_r2, sparsity, n})."""
    names = list(x)
    own = complete(df, {"__y": y, **{c: c for c in names}})
    g = gram(own, ["__y", *names])
    beta, e = quantile_fit(own, names, tau)
    h = _hall_sheather(g.n, tau)
    low, high = max(tau - h, 1e-3), min(tau + h, 1 - 1e-3)
    loss = lambda r: F.sum(F.when(r > 0, tau * r).otherwise((tau - 1) * r))
    q = own.agg(F.percentile_approx(e, [low, high], 10000), F.percentile_approx("__y", tau, 10000), loss(e)).first()
    null = own.agg(loss(F.col("__y") - F.lit(float(q[1])))).first()[0]
    sparsity = (q[0][1] - q[0][0]) / (high - low)
    bread = solve(g, "__y", names)[2]
    se = np.sqrt(tau * (1 - tau) * sparsity**2 * np.diag(bread))
    return coefficients(df.sparkSession, [INTERCEPT, *names], beta, se, g.n - len(beta)), {"pseudo_r2": 1 - q[2] / null, "sparsity": sparsity, "n": g.n}


def _hall_sheather(n: int, tau: float, alpha: float = 0.05) -> float:
    z = D.norm_ppf(tau)
    return n ** (-1 / 3) * D.norm_ppf(1 - alpha / 2) ** (2 / 3) * (1.5 * D.norm_pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)


def quantile_process(df: DataFrame, y: str, x: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """(tau, term, estimate, std_error), and by it what quantile ranges need."""
    out = None
    for tau in taus:
        one = quantile(df, y, x, tau)[0].select(F.lit(float(tau)).alias("tau"), "term", "estimate", "std_error")
        out = one if out is None else out.unionByName(one)
    return out


def quantile_wald(process: DataFrame) -> DataFrame:
    """Per term the Wald statistic of equal coefficients over the taus, which it takes as independent."""
    w = 1 / F.pow("std_error", 2)
    g = process.groupBy("term").agg((F.sum(w * F.pow("estimate", 2)) - F.pow(F.sum(w * F.col("estimate")), 2) / F.sum(w)).alias("statistic"), (F.count("*") - 1).alias("df"))
    return frame(process.sparkSession, [(r["term"], r["statistic"], r["df"], D.chi2_sf(r["statistic"], r["df"])) for r in g.collect()], "term string, statistic double, df long, p_value double")


def interquantile_range(process: DataFrame, low: float, high: float) -> DataFrame:
    at = lambda t: F.max(F.when(F.abs(F.col("tau") - t) < 1e-9, F.col("estimate")))
    return process.groupBy("term").agg((at(high) - at(low)).alias("difference"))


def pca(df: DataFrame, columns: Sequence[str], k: int | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """((component, variable, loading, variance, share), scores as expressions). The first large loading is positive."""
    g = gram(complete(df, {c: c for c in columns}), list(columns))
    value, vector = np.linalg.eigh(g.cov())
    order = np.argsort(value)[::-1][: k or len(columns)]
    rows, scores = [], {}
    for n, i in enumerate(order, 1):
        v = vector[:, i] * (1 if vector[np.abs(vector[:, i]).argmax(), i] > 0 else -1)
        rows += [(n, c, x, value[i], value[i] / value.sum()) for c, x in zip(columns, v)]
        score = F.lit(0.0)
        for c, x, m in zip(columns, v, g.mean):
            score = score + F.lit(float(x)) * (number(c) - F.lit(float(m)))
        scores[f"pc{n}"] = score
    return frame(df.sparkSession, rows, "component int, variable string, loading double, variance double, share double"), scores
