"""Regression diagnostics and robust covariances, from cross-products and per-row expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import cell_of
from ..functions.result import TEST, coefficients, frame, test_row
from ..plans.gram import Gram, complete, gram
from ..plans.ranks import quantiles
from .linear import INTERCEPT, Fit, design_gram, from_gram, solve

NAN = math.nan


def _x(fit: Fit) -> list[str]:
    return [t for t in fit.terms if t != INTERCEPT]


def fitted_rows(df: DataFrame, fit: Fit, keep: Sequence[str] = ()) -> DataFrame:
    """__y, the terms, fitted, residual and leverage of the complete rows, beside the columns to keep."""
    own = complete(df, {"__y": fit.y, **fit.columns}, list(keep))
    local = Fit(**{**fit.__dict__, "columns": {t: t for t in fit.columns}})
    own = own.withColumns({"fitted": local.prediction(), "leverage": local.leverage()})
    return own.withColumn("residual", F.col("__y") - F.col("fitted"))


def _test(df: DataFrame, name: str, statistic: float, p: float, dof: float, n: int, effect: float = NAN) -> DataFrame:
    return frame(df.sparkSession, [test_row(name, statistic, p, dof, n, effect)], TEST)


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, vif): the diagonal of the inverse correlation matrix."""
    g = gram(complete(df, {c: c for c in columns}), list(columns))
    return frame(df.sparkSession, list(zip(columns, np.diag(np.linalg.inv(g.corr())))), "variable string, vif double")


def condition_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    g = gram(complete(df, {c: c for c in columns}), list(columns))
    e = np.linalg.eigvalsh(g.corr())
    k = math.sqrt(e.max() / max(e.min(), 1e-300))
    return frame(df.sparkSession, [(k, "severe" if k > 30 else "moderate" if k > 10 else "none")], "condition_number double, severity string")


def _lagged(rows: DataFrame, order: Sequence[str], value: str, lags: int, cells: int = 128) -> DataFrame:
    """rows with value_1 .. value_lags, the values so many rows before in the order of the first key (then the rest).
    Rows are cut into cells at quantiles of that key; the last values of each cell, so many rows, are handed to the
    next, so that no task orders all rows."""
    key = order[0]
    kind = dict(rows.dtypes)[key]
    place = F.unix_micros(F.col(key).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(key)
    rows = rows.withColumn("__place", place.cast("double"))
    cuts = rows.agg(F.percentile_approx("__place", [i / cells for i in range(1, cells)], 10000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    cell = cell_of(F.col("__place"), cuts)
    rows = rows.withColumn("__cell", cell)
    back = Window.partitionBy("__cell").orderBy(*[F.desc(o) for o in order])
    tail = rows.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= lags)
    tails = tail.groupBy("__cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", value))), lambda s: s[value]).alias("__tail")).orderBy("__cell")
    # A tail that is shorter than lags goes on with that of the cell before: a small table, one row a cell.
    before: list = []
    handed = []
    for r in tails.collect():
        handed.append((r["__cell"], list(before)))
        before = (list(r["__tail"]) + before)[:lags]
    heads = rows.sparkSession.createDataFrame(handed, "__cell long, __before array<double>") if handed else None
    own = Window.partitionBy("__cell").orderBy(*order)
    out = rows.withColumn("__n", F.row_number().over(own))
    if heads is not None:
        out = out.join(F.broadcast(heads), "__cell")
    for k in range(1, lags + 1):
        handed_value = F.get("__before", F.lit(k) - F.col("__n")) if heads is not None else F.lit(None)
        out = out.withColumn(f"{value}_{k}", F.when(F.col("__n") > k, F.lag(value, k).over(own)).otherwise(handed_value))
    return out.drop("__n", "__cell", "__place", *(["__before"] if heads is not None else []))


def durbin_watson(df: DataFrame, fit: Fit, order: Sequence[str]) -> DataFrame:
    """By an explicit order; positive below 1.5, negative above 2.5."""
    rows = _lagged(fitted_rows(df, fit, order).select("residual", *order), order, "residual", 1)
    d = rows.agg((F.sum(F.pow(F.col("residual") - F.col("residual_1"), 2)) / F.sum(F.pow("residual", 2))).alias("d")).first()["d"]
    return frame(df.sparkSession, [(d, "positive autocorrelation" if d < 1.5 else "negative autocorrelation" if d > 2.5 else "none")], "statistic double, conclusion string")


def breusch_pagan(df: DataFrame, fit: Fit) -> DataFrame:
    """n R^2 of the squared residuals on the regressors."""
    rows = fitted_rows(df, fit).withColumn("__e2", F.pow("residual", 2))
    x = _x(fit)
    g = gram(rows.select("__e2", *[F.col(f"`{c}`") for c in x]), ["__e2", *x])
    _, _, _, rss, tss = solve(g, "__e2", x)
    lm = g.n * (1 - rss / tss)
    return _test(df, "Breusch-Pagan", lm, D.chi2_sf(lm, len(x)), len(x), g.n)


def white(df: DataFrame, fit: Fit) -> DataFrame:
    """Levels and squares, and products of up to 10 regressors."""
    x = _x(fit)
    rows = fitted_rows(df, fit)
    terms = {"__e2": F.pow("residual", 2), **{c: F.col(f"`{c}`") for c in x}, **{f"{c}^2": F.pow(F.col(f"`{c}`"), 2) for c in x}}
    if len(x) <= 10:
        terms |= {f"{a}:{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for i, a in enumerate(x) for b in x[i + 1 :]}
    g = gram(rows.select(*[c.alias(n) for n, c in terms.items()]), list(terms))
    names = list(terms)[1:]
    _, _, _, rss, tss = solve(g, "__e2", names)
    dof = int(np.linalg.matrix_rank(g.corr(names), tol=1e-9))
    lm = g.n * (1 - rss / tss)
    return _test(df, "White", lm, D.chi2_sf(lm, dof), dof, g.n)


def breusch_godfrey(df: DataFrame, fit: Fit, order: Sequence[str], lags: int = 1) -> DataFrame:
    """LM statistic of residuals on regressors and their own lags; first rows have lags of 0."""
    x = _x(fit)
    rows = _lagged(fitted_rows(df, fit, [o for o in order if o not in x]).drop("fitted", "leverage", "__y"), order, "residual", lags)
    names = [*x, *[f"residual_{k}" for k in range(1, lags + 1)]]
    rows = rows.select("residual", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in names])
    g = gram(rows, ["residual", *names])
    _, _, _, rss, tss = solve(g, "residual", names)
    lm = g.n * (1 - rss / tss)
    return _test(df, "Breusch-Godfrey", lm, D.chi2_sf(lm, lags), lags, g.n, (tss - rss) / lags / (rss / (g.n - len(names) - 1)))


def goldfeld_quandt(df: DataFrame, y: str, x: Sequence[str], order: str, drop: float = 0.2) -> DataFrame:
    """The ratio of residual variances of the last and the first rows by an order key, the middle left out."""
    own = complete(df, {"__y": y, **{c: c for c in x}}, [F.col(order).alias("__o")])
    low, high = quantiles(own.select(F.col("__o").cast("double").alias("o")), ["o"], [0.5 - drop / 2, 0.5 + drop / 2])["o"]
    part = F.when(F.col("__o") <= low, 0).when(F.col("__o") > high, 1)
    from ..plans.gram import grouped

    g = grouped(own.withColumn("__p", part).where("__p IS NOT NULL"), ["__y", *x], "__p")
    a, b = from_gram(g[0], "__y", list(x)), from_gram(g[1], "__y", list(x))
    f = b.sigma2 / a.sigma2
    p = 2 * min(D.f_sf(f, b.df, a.df), D.f_cdf(f, b.df, a.df))
    return _test(df, "Goldfeld-Quandt", f, min(1.0, p), b.df, a.n + b.n)


def reset(df: DataFrame, fit: Fit, powers: Sequence[int] = (2, 3)) -> DataFrame:
    """Ramsey's test: powers of the scaled fitted values as further regressors."""
    rows = fitted_rows(df, fit)
    m, s = rows.agg(F.avg("fitted"), F.stddev_pop("fitted")).first()
    z = (F.col("fitted") - m) / s
    terms = {"__y": F.col("__y"), **{c: F.col(f"`{c}`") for c in _x(fit)}, **{f"__z{p}": F.pow(z, p) for p in powers}}
    g = gram(rows.select(*[c.alias(n) for n, c in terms.items()]), list(terms))
    wide = from_gram(g, "__y", list(terms)[1:])
    f = (fit.rss - wide.rss) / len(powers) / wide.sigma2
    return _test(df, "RESET", f, D.f_sf(f, len(powers), wide.df), len(powers), g.n)


def chow(df: DataFrame, y: str, x: Sequence[str], after: Column) -> DataFrame:
    """Whether rows for which after holds have other coefficients: one aggregate by part, the pooled fit is their sum."""
    from ..plans.gram import grouped

    own = complete(df, {"__y": y, **{c: c for c in x}}, [after.cast("int").alias("__p")]).where("__p IS NOT NULL")
    g = grouped(own, ["__y", *x], "__p")
    a, b, both = (from_gram(v, "__y", list(x)) for v in (g[0], g[1], g[0] + g[1]))
    k = len(x) + 1
    f = (both.rss - a.rss - b.rss) / k / ((a.rss + b.rss) / (both.n - 2 * k))
    return _test(df, "Chow", f, D.f_sf(f, k, both.n - 2 * k), k, both.n)


def durbin_wu_hausman(df: DataFrame, y: str, endogenous: str, exogenous: Sequence[str], instruments: Sequence[str]) -> DataFrame:
    """First-stage residuals are linear in the columns, so the augmented regression follows from one Gram."""
    x, z = list(exogenous), list(instruments)
    g = design_gram(df, y, [endogenous, *x, *z])
    first = from_gram(g, endogenous, [*x, *z])
    names = ["__y", endogenous, *x, *z]
    t = np.zeros((len(names), 3 + len(x)))  # columns: y, endogenous, residual, x
    t[0, 0] = t[1, 1] = t[1, 2] = 1
    for c, b in zip([*x, *z], first.beta[1:]):
        t[names.index(c), 2] -= b
    for i, c in enumerate(x):
        t[names.index(c), 3 + i] = 1
    new = Gram(["y", "e", "v", *x], g.n, g.w, g.mean @ t, t.T @ g.centred @ t)
    wide, narrow = from_gram(new, "y", ["e", "v", *x]), from_gram(new, "y", ["e", *x])
    f = (narrow.rss - wide.rss) / wide.sigma2
    return _test(df, "Durbin-Wu-Hausman", f, D.f_sf(f, 1, wide.df), 1, g.n)


def influence(df: DataFrame, fit: Fit, keep: Sequence[str] = ()) -> DataFrame:
    """Per row leverage, studentised residuals, Cook's distance, DFFITS, COVRATIO and DFBETAS, with flags."""
    k, s2 = len(fit.terms), fit.sigma2
    rows = fitted_rows(df, fit, keep)
    e, h = F.col("residual"), F.col("leverage")
    without = (fit.df * s2 - e * e / (1 - h)) / (fit.df - 1)
    rows = rows.withColumns({"std_residual": e / F.sqrt(s2 * (1 - h)), "student_residual": e / F.sqrt(without * (1 - h)), "cooks_distance": e * e * h / (k * s2 * F.pow(1 - h, 2)), "covratio": F.pow(without / s2, k) / (1 - h)})
    rows = rows.withColumn("dffits", F.col("student_residual") * F.sqrt(h / (1 - h)))
    x = [F.lit(1.0) if t == INTERCEPT else F.col(f"`{t}`") for t in fit.terms]
    for i, t in enumerate(fit.terms):
        part = sum((F.lit(float(fit.bread[i, j])) * c for j, c in enumerate(x)), F.lit(0.0))
        rows = rows.withColumn(f"dfbetas_{t}", part * e / (1 - h) / F.sqrt(without * F.lit(float(fit.bread[i, i]))))
    return rows.withColumns({"outlier": F.abs("std_residual") > 3, "high_leverage": h > 2 * k / fit.n, "influential": F.col("cooks_distance") > 4 / fit.n})


def summary(df: DataFrame, fit: Fit) -> DataFrame:
    """Test rows: Breusch-Pagan, White, Jarque-Bera of the residuals, RESET."""
    from .hypothesis import jarque_bera

    return breusch_pagan(df, fit).unionByName(white(df, fit)).unionByName(jarque_bera(fitted_rows(df, fit), "residual")).unionByName(reset(df, fit))


def influential_rows(df: DataFrame, fit: Fit, keep: Sequence[str]) -> DataFrame:
    return influence(df, fit, keep).where(F.col("influential") | F.col("high_leverage") | (F.abs("std_residual") > 2))


# --- covariances ------------------------------------------------------------------------------------------------


def _scores(rows: DataFrame, fit: Fit, factor: Column) -> tuple[DataFrame, list[str]]:
    """The columns x_j * e * factor, whose raw cross-products are the meat of a sandwich."""
    x = [F.lit(1.0) if t == INTERCEPT else F.col(f"`{t}`") for t in fit.terms]
    names = [f"__s{i}" for i in range(len(x))]
    return rows.withColumns({n: c * F.col("residual") * factor for n, c in zip(names, x)}), names


def robust_vcov(df: DataFrame, fit: Fit, kind: str = "HC1") -> np.ndarray:
    """HC0 to HC3."""
    h = F.col("leverage")
    factor = {"HC0": F.lit(1.0), "HC1": F.lit(math.sqrt(fit.n / fit.df)), "HC2": 1 / F.sqrt(1 - h), "HC3": 1 / (1 - h)}[kind]
    rows, names = _scores(fitted_rows(df, fit), fit, factor)
    return fit.bread @ gram(rows.select(*names), names).raw(names) @ fit.bread


def cluster_vcov(df: DataFrame, fit: Fit, cluster: str) -> np.ndarray:
    """Scores summed by cluster, then crossed, times G/(G-1) (n-1)/(n-k)."""
    rows, names = _scores(fitted_rows(df, fit, [F.col(cluster).alias("__g")]), fit, F.lit(1.0))
    sums = rows.groupBy("__g").agg(*[F.sum(n).alias(n) for n in names])
    g = gram(sums, names)
    return fit.bread @ g.raw(names) @ fit.bread * (g.n / (g.n - 1) * (fit.n - 1) / fit.df)


def newey_west_vcov(df: DataFrame, fit: Fit, order: Sequence[str], lags: int | None = None) -> np.ndarray:
    """Bartlett weights over scores so many rows apart by an explicit order. The scores are linear in residual times
    terms, so one lagged column a term is needed; they are taken in one go."""
    lags = int(4 * (fit.n / 100) ** (2 / 9)) if lags is None else lags
    rows, names = _scores(fitted_rows(df, fit, [o for o in order if o not in fit.columns]), fit, F.lit(1.0))
    meat = gram(rows.select(*names), names).raw(names)
    rows = rows.select(*names, *[F.col(f"`{o}`") for o in order])
    wide = rows
    for n in names:
        wide = _lagged(wide, order, n, lags) if lags else wide
    if lags:
        cross = wide.agg(*[F.sum(F.coalesce(F.col(a) * F.col(f"{b}_{k}"), F.lit(0.0))).alias(f"{i}_{j}_{k}") for k in range(1, lags + 1) for i, a in enumerate(names) for j, b in enumerate(names)]).first()
        for k in range(1, lags + 1):
            c = np.array([[cross[f"{i}_{j}_{k}"] for j in range(len(names))] for i in range(len(names))])
            meat = meat + (1 - k / (lags + 1)) * (c + c.T)
    return fit.bread @ meat @ fit.bread * fit.n / fit.df


def robust_table(df: DataFrame, fit: Fit, vcov: np.ndarray, dof: float | None = None) -> DataFrame:
    return coefficients(df.sparkSession, fit.terms, fit.beta, np.sqrt(np.diag(vcov)), dof or fit.df)


def plot_data(df: DataFrame, fit: Fit, points: int = 200, bins: int = 20) -> dict[str, DataFrame]:
    """What the four usual plots need: a sample of fitted against residual, a histogram, normal quantiles."""
    from .describe import histogram

    rows = fitted_rows(df, fit).select("fitted", "residual")
    share = [i / (points + 1) for i in range(1, points + 1)]
    q = rows.agg(F.percentile_approx("residual", share, 10000)).first()[0]
    qq = frame(df.sparkSession, [(D.norm_ppf(p), v) for p, v in zip(share, q)], "theoretical double, sample double")
    return {"residuals": rows.orderBy(F.xxhash64("fitted", "residual")).limit(points), "histogram": histogram(rows, "residual", bins), "qq": qq}


