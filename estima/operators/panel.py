"""Panel data: fixed and random effects, first differences, dynamic panels, linear GMM, mixed models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import TEST, coefficients, frame, test_row
from ..plans.gram import Gram, complete, gram
from .linear import INTERCEPT, Fit, _inverse, from_gram, solve


def _panel(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str | None = None) -> DataFrame:
    keep = [F.col(unit).alias("__u")] + ([F.col(time).alias("__t")] if time else [])
    return complete(df, {"__y": y, **{c: c for c in x}}, keep).where("__u IS NOT NULL")


def unit_sums(own: DataFrame, names: Sequence[str]) -> DataFrame:
    return own.groupBy("__u").agg(F.count("*").alias("__n"), *[F.avg(f"`{n}`").alias(f"__m_{n}") for n in names])


def between_gram(own: DataFrame, names: list[str]) -> tuple[Gram, int]:
    """(cross-products of unit means, each weighted by its rows; units). Total less between is within: no window and no
    join of rows with their means is needed for one-way effects."""
    means = unit_sums(own, names).select("__n", *[F.col(f"`__m_{n}`").alias(n) for n in names])
    g = gram(means, names, "__n")
    return g, g.n


def within_gram(own: DataFrame, names: list[str]) -> tuple[Gram, int]:
    total = gram(own, names)
    between, units = between_gram(own, names)
    return Gram(names, total.n, total.w, np.zeros(len(names)), total.centred - between.centred), units


def demean(df: DataFrame, columns: Sequence[str], unit: str, time: str | None = None, rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """columns less their unit means; with time, alternately less unit and time means until both vanish (one pass if
    the panel is balanced). Means are joined from aggregates, which holds for units of any size."""
    out = df
    keys = [unit] + ([time] if time else [])
    balanced = False
    if time:
        c = df.groupBy(unit).agg(F.count("*").alias("n"), F.count_distinct(time).alias("d")).agg(F.min("n"), F.max("n"), F.max("d"), F.min("d")).first()
        balanced = c[0] == c[1] == c[2] == c[3] == df.select(time).distinct().count()
    from ..plans.storage import written

    for step in range(rounds if time and not balanced else 1):
        for key in keys:
            means = out.groupBy(key).agg(*[F.avg(f"`{c}`").alias(f"__m_{c}") for c in columns])
            out = out.join(means, key).withColumns({c: F.col(f"`{c}`") - F.col(f"`__m_{c}`") for c in columns}).drop(*[f"__m_{c}" for c in columns])
        if not time or balanced:
            break
        out = written(out)
        worst = out.groupBy(unit).agg(*[F.abs(F.avg(f"`{c}`")).alias(c) for c in columns]).agg(*[F.max(f"`{c}`") for c in columns]).first()
        if max(x or 0.0 for x in worst) < tol * (1 + step):
            break
    return out


def _clustered(rows: DataFrame, names: list[str], beta: np.ndarray, bread: np.ndarray, n: int, k: int) -> tuple[np.ndarray, int]:
    """(clustered covariance, clusters) of rows with __u, __y and names already transformed."""
    e = F.col("__y")
    for c, b in zip(names, beta):
        e = e - F.lit(float(b)) * F.col(f"`{c}`")
    sums = rows.groupBy("__u").agg(*[F.sum(F.col(f"`{c}`") * e).alias(c) for c in names])
    g = gram(sums, names)
    return bread @ g.raw(names) @ bread * (g.n / (g.n - 1) * (n - 1) / (n - k)), g.n


def fixed_effects(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str | None = None, cluster: bool = True) -> tuple[DataFrame, dict[str, float], Fit]:
    """One-way or, with time, two-way effects; standard errors clustered by unit unless asked otherwise."""
    names = list(x)
    own = _panel(df, y, names, unit, time)
    if time:
        rows = demean(own, ["__y", *names], "__u", "__t")
        g = gram(rows, ["__y", *names])
        units, periods = (own.select(c).distinct().count() for c in ("__u", "__t"))
        used = units + periods - 1
    else:
        rows = demean(own, ["__y", *names], "__u") if cluster else own
        g, units = within_gram(own, ["__y", *names])
        used = units
    a, b = g.centred[1:, 1:], g.centred[1:, 0]
    bread = _inverse(a)
    beta = bread @ b
    rss, tss = float(g.centred[0, 0] - beta @ b), float(g.centred[0, 0])
    dof = g.n - used - len(names)
    vcov = _clustered(rows, names, beta, bread, g.n, len(names) + used)[0] if cluster else bread * rss / dof
    fit = Fit(names, beta, vcov, g.n, units - 1 if cluster else dof, rss, tss, bread, {c: c for c in names}, y)
    total = gram(own, ["__y", *names])
    between, _ = between_gram(own, ["__y", *names])

    def squared_corr(h: Gram) -> float:
        v = beta @ h.centred[1:, 1:] @ beta
        return float((beta @ h.centred[1:, 0]) ** 2 / (v * h.centred[0, 0])) if v > 0 and h.centred[0, 0] > 0 else math.nan

    f = (tss - rss) / len(names) / (rss / dof)
    m = {"n": g.n, "units": units, "r2_within": 1 - rss / tss, "r2_between": squared_corr(between), "r2_overall": squared_corr(total), "f_stat": f, "f_p_value": D.f_sf(f, len(names), dof), "sigma": math.sqrt(rss / dof)}
    return fit.table(df.sparkSession), m, fit


def unit_effects(df: DataFrame, y: str, x: Sequence[str], unit: str, fit: Fit) -> DataFrame:
    """(unit, effect): mean of y less the fitted mean."""
    means = unit_sums(_panel(df, y, x, unit), ["__y", *x])
    effect = F.col("__m___y")
    for c, b in zip(fit.terms, fit.beta):
        effect = effect - F.lit(float(b)) * F.col(f"`__m_{c}`")
    return means.select(F.col("__u").alias(unit), effect.alias("effect"))


def random_effects(df: DataFrame, y: str, x: Sequence[str], unit: str) -> tuple[DataFrame, dict[str, float], Fit]:
    """Feasible GLS: variance parts from the within and the between fit; each unit's own theta enters the
    cross-products through its mean, so rows aren't transformed."""
    names = list(x)
    own = _panel(df, y, names, unit)
    w, units = within_gram(own, ["__y", *names])
    bread = _inverse(w.centred[1:, 1:])
    beta = bread @ w.centred[1:, 0]
    dof = w.n - units - len(names)
    s_e = max(0.0, float(w.centred[0, 0] - beta @ w.centred[1:, 0])) / dof
    means = unit_sums(own, ["__y", *names])
    plain = gram(means.select(*[F.col(f"`__m_{c}`").alias(c) for c in ["__y", *names]]), ["__y", *names])
    _, _, _, rss, _ = solve(plain, "__y", names)
    harmonic = means.agg(F.count("*") / F.sum(1 / F.col("__n"))).first()[0]
    s_u = max(0.0, rss / (units - len(names) - 1) - s_e / harmonic)
    theta = 1 - F.sqrt(F.lit(s_e) / (F.lit(s_e) + F.col("__n") * F.lit(s_u)))
    # sum (v - theta m)(v - theta m)' = within + n (1 - theta)^2 m m', with the constant as a column.
    scaled = means.select((F.col("__n") * F.pow(1 - theta, 2)).alias("__w"), theta.alias("theta"), *[F.col(f"`__m_{c}`").alias(c) for c in ["__y", *names]])
    g = gram(scaled, ["__y", *names], "__w")
    all_ = ["1", "__y", *names]
    cross = g.raw(all_)
    cross[1:, 1:] += w.centred
    i = [0, *range(2, len(all_))]
    bread = _inverse(cross[np.ix_(i, i)])
    b = bread @ cross[i, 1]
    rss = float(cross[1, 1] - b @ cross[i, 1])
    n = w.n
    fit = Fit([INTERCEPT, *names], b, bread * rss / (n - len(b)), n, n - len(b), rss, float(cross[1, 1]), bread, {c: c for c in names}, y)
    t = scaled.agg(F.avg("theta"), F.min("theta"), F.max("theta")).first()
    m = {"n": n, "units": units, "sigma2_e": s_e, "sigma2_u": s_u, "rho": s_u / (s_u + s_e) if s_u + s_e else 0.0, "theta_mean": t[0], "theta_min": t[1], "theta_max": t[2]}
    return fit.table(df.sparkSession), m, fit


def hausman(df: DataFrame, y: str, x: Sequence[str], unit: str) -> DataFrame:
    """Fixed against random effects on the unclustered covariances; small or negative eigenvalues are left out."""
    fe = fixed_effects(df, y, x, unit, cluster=False)[2]
    re = random_effects(df, y, x, unit)[2]
    d = fe.beta - re.beta[1:]
    # Both covariances with the within variance: their difference then has no negative part but by rounding.
    value, vector = np.linalg.eigh(fe.vcov - re.bread[1:, 1:] * fe.sigma2)
    ok = value > 1e-10 * max(1e-300, np.abs(value).max())
    h = float(((vector[:, ok].T @ d) ** 2 / value[ok]).sum())
    return frame(df.sparkSession, [test_row("Hausman", h, D.chi2_sf(h, max(1, ok.sum())), int(ok.sum()), fe.n)], TEST)


def first_difference(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str) -> tuple[DataFrame, dict[str, float], Fit]:
    """Differences of consecutive integer periods, without a constant; clustered by unit."""
    names = list(x)
    own = _panel(df, y, names, unit, time)
    w = Window.partitionBy("__u").orderBy("__t")
    rows = own.select("__u", (F.col("__t") - F.lag("__t").over(w)).alias("__gap"), *[(F.col(f"`{c}`") - F.lag(f"`{c}`").over(w)).alias(c) for c in ["__y", *names]]).where("__gap = 1").drop("__gap")
    g = gram(rows, ["__y", *names])
    a = g.raw(names)
    bread = _inverse(a)
    beta = bread @ g.raw(names, ["__y"])[:, 0]
    tss = g.raw(["__y"])[0, 0]
    rss = tss - beta @ g.raw(names, ["__y"])[:, 0]
    vcov, clusters = _clustered(rows, names, beta, bread, g.n, len(names))
    fit = Fit(names, beta, vcov, g.n, clusters - 1, float(rss), float(tss), bread, {c: c for c in names}, y)
    return fit.table(df.sparkSession), {"n": g.n, "units": clusters, "r2": 1 - rss / tss}, fit


# --- GMM ------------------------------------------------------------------------------------------------------------


def linear_gmm(df: DataFrame, y: str, endogenous: Sequence[str], exogenous: Sequence[str], instruments: Sequence[str], optimal: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """Two-stage least squares weights, or the two-step optimal ones; Hansen's J. One aggregate, one more for the second
    step."""
    xs, zs = [*endogenous, *exogenous], [*exogenous, *instruments]
    if len(zs) < len(xs):
        raise ValueError("fewer instruments than regressors")
    own = complete(df, {"__y": y, **{c: c for c in dict.fromkeys([*xs, *zs])}})
    names = ["__y", *dict.fromkeys([*xs, *zs])]
    g = gram(own, names)
    z, x = ["1", *zs], ["1", *xs]
    zz, zx, zy = g.raw(z), g.raw(z, x), g.raw(z, ["__y"])[:, 0]
    weight = _inverse(zz)
    step = lambda w: _inverse(zx.T @ w @ zx) @ zx.T @ w @ zy
    beta = step(weight)
    e = F.col("__y") - F.lit(float(beta[0]))
    for c, b in zip(xs, beta[1:]):
        e = e - F.lit(float(b)) * F.col(f"`{c}`")
    m = own.select(*[(e * (F.lit(1.0) if c == "1" else F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(z)])
    s = gram(m, m.columns).raw(m.columns)
    if optimal:
        weight = _inverse(s)
        beta = step(weight)
        vcov = _inverse(zx.T @ weight @ zx)
    else:
        bread = _inverse(zx.T @ weight @ zx)
        vcov = bread @ zx.T @ weight @ s @ weight @ zx @ bread
    moment = zy - zx @ beta
    j, dof = float(moment @ _inverse(s) @ moment), len(z) - len(x)
    table = coefficients(df.sparkSession, [INTERCEPT, *xs], beta, np.sqrt(np.diag(vcov)))
    return table, {"n": g.n, "j_stat": j, "j_df": dof, "j_p_value": D.chi2_sf(j, dof) if dof else math.nan}


def arellano_bond(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str, two_step: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """Difference GMM of y on its lag and x: levels of y two and more periods back are instruments, a block for each
    period, differences of x their own. Units are processed in groups; only matrices as large as the instruments are
    added up."""
    names = list(x)
    own = _panel(df, y, names, unit, time)
    first, last = own.agg(F.min("__t"), F.max("__t")).first()
    periods = int(last - first + 1)
    blocks, at = {}, 0
    for t in range(2, periods):
        blocks[t] = (at, t - 1)
        at += t - 1
    m, k = at + len(names), 1 + len(names)

    def moments(frames: Iterator[pd.DataFrame], theta: np.ndarray | None) -> np.ndarray:
        zx, zy, zhz, zuz, count, ee = np.zeros((m, k)), np.zeros(m), np.zeros((m, m)), np.zeros((m, m)), 0, 0.0
        for frame_ in frames:
            for _, rows in frame_.groupby("__u"):
                level = np.full(periods, np.nan)
                more = np.full((periods, len(names)), np.nan)
                t = (rows["__t"].to_numpy() - first).astype(int)
                level[t], more[t] = rows["__y"].to_numpy(), rows[names].to_numpy()
                d, dm = np.diff(level), np.diff(more, axis=0)
                use = [s for s in range(2, periods) if np.isfinite(d[s - 1]) and np.isfinite(d[s - 2]) and np.isfinite(dm[s - 1]).all()]
                if not use:
                    continue
                z = np.zeros((len(use), m))
                for i, s in enumerate(use):
                    start, size = blocks[s]
                    z[i, start : start + size] = np.nan_to_num(level[: s - 1])
                    z[i, at:] = dm[s - 1]
                xs = np.column_stack([d[[s - 2 for s in use]], dm[[s - 1 for s in use]]])
                ys = d[[s - 1 for s in use]]
                h = 2.0 * np.eye(len(use))
                for i in range(len(use) - 1):
                    if use[i + 1] == use[i] + 1:
                        h[i, i + 1] = h[i + 1, i] = -1
                zx += z.T @ xs
                zy += z.T @ ys
                zhz += z.T @ h @ z
                count += len(use)
                if theta is not None:
                    u = ys - xs @ theta
                    zu = z.T @ u
                    zuz += np.outer(zu, zu)
                    ee += u @ u
        return np.concatenate([[count, ee], zx.ravel(), zy, zhz.ravel(), zuz.ravel()])

    parts = max(1, min(1024, own.select("__u").distinct().count() // 64))
    dealt = own.withColumn("__part", F.pmod(F.xxhash64("__u"), F.lit(parts)))

    def total(theta: np.ndarray | None) -> tuple:
        def run(frame_: pd.DataFrame) -> pd.DataFrame:
            out = moments(iter([frame_]), theta)
            return pd.DataFrame({"i": np.arange(len(out)), "v": out})

        rows = dealt.groupBy("__part").applyInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(2 + m * k + m + 2 * m * m)
        for r in rows:
            flat[r["i"]] = r["v"]
        c = np.cumsum([2, m * k, m, m * m])
        return int(flat[0]), flat[1], flat[2 : c[1]].reshape(m, k), flat[c[1] : c[2]], flat[c[2] : c[3]].reshape(m, m), flat[c[3] :].reshape(m, m)

    n, _, zx, zy, zhz, _ = total(None)
    a = np.linalg.pinv(zhz, hermitian=True)
    bread = _inverse(zx.T @ a @ zx)
    theta = bread @ zx.T @ a @ zy
    _, ee, _, _, _, zuz = total(theta)
    if two_step:
        a = np.linalg.pinv(zuz, hermitian=True)
        vcov = _inverse(zx.T @ a @ zx)
        theta = vcov @ zx.T @ a @ zy
    else:
        vcov = bread @ zx.T @ a @ zuz @ a @ zx @ bread
    g = zy - zx @ theta
    rank = int(np.linalg.matrix_rank(a))
    # The one-step weight is in units of the errors' variance.
    j = float(g @ a @ g) / (1.0 if two_step else ee / n / 2)
    table = coefficients(df.sparkSession, [f"L.{y}", *names], theta, np.sqrt(np.diag(vcov)))
    return table, {"n": n, "instruments": rank, "sargan": j, "sargan_df": rank - k, "sargan_p_value": D.chi2_sf(j, rank - k) if rank > k else math.nan}


def mixed_model(df: DataFrame, y: str, x: Sequence[str], group: str, slopes: Sequence[str] = (), reml: bool = True) -> tuple[DataFrame, dict[str, float]]:
    """A linear mixed model with a random intercept and random slopes of some of x, by profiled (restricted) likelihood.
    Each group's likelihood needs its cross-products alone; groups whose random part is the same size are evaluated
    on the driver, so groups must be fewer than a hundred thousand."""
    names = list(x)
    own = complete(df, {"__y": y, **{c: c for c in names}}, [F.col(group).alias("__g")])
    all_ = ["1", *names, "__y"]
    expr = {n: F.lit(1.0) if n == "1" else F.col(f"`{n}`") for n in all_}
    sums = own.groupBy("__g").agg(*[F.sum(expr[a] * expr[b]).alias(f"{i}_{j}") for i, a in enumerate(all_) for j, b in enumerate(all_) if i <= j])
    rows = sums.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many groups for a mixed model")
    q = len(all_)
    m = np.zeros((len(rows), q, q))
    for r, row in enumerate(rows):
        for i in range(q):
            for j in range(i, q):
                m[r, i, j] = m[r, j, i] = row[f"{i}_{j}"]
    z = [0, *[all_.index(s) for s in slopes]]
    p, d, n = q - 1, len(z), float(m[:, 0, 0].sum())
    tri = np.tril_indices(d)

    def profile(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        lower = np.zeros((d, d))
        lower[tri] = theta
        zz = m[:, z][:, :, z]
        inner = np.eye(d) + lower.T @ zz @ lower
        half = np.linalg.solve(inner, lower.T @ m[:, z])  # (groups, d, q)
        v = (m - np.einsum("gia,gij->gaj", np.einsum("ij,gja->gia", lower.T, m[:, z]), half)).sum(0)
        bread = _inverse(v[:p, :p])
        beta = bread @ v[:p, p]
        rss = float(v[p, p] - beta @ v[:p, p])
        dof = n - p if reml else n
        s2 = rss / dof
        ll = -0.5 * (dof * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(inner)[1].sum())
        if reml:
            ll -= 0.5 * np.linalg.slogdet(v[:p, :p])[1]
        return ll, beta, bread * s2, s2

    from .optimise import minimise

    start = np.zeros(len(tri[0]))
    start[[i for i, (a, b) in enumerate(zip(*tri)) if a == b]] = 0.5
    theta = minimise(lambda t: -profile(t)[0], start)[0]
    ll, beta, vcov, s2 = profile(theta)
    lower = np.zeros((d, d))
    lower[tri] = theta
    cov = s2 * lower @ lower.T
    table = coefficients(df.sparkSession, [INTERCEPT, *names], beta, np.sqrt(np.diag(vcov)))
    out = {"n": n, "groups": len(rows), "loglik": ll, "sigma2": s2, "var_intercept": cov[0, 0], "icc": cov[0, 0] / (cov[0, 0] + s2)}
    return table, out | {f"var_{s}": cov[i, i] for i, s in enumerate(slopes, 1)}


def period_column(column: Column, unit: str = "month") -> Column:
    """Consecutive integers for the months (or years, quarters) of a timestamp."""
    y, mth = F.year(column), F.month(column)
    return {"year": y, "quarter": y * 4 + F.quarter(column), "month": y * 12 + mth}[unit].cast("int")
