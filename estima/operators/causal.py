"""Causal inference: instruments, differences in differences, matching and weighting, discontinuities, synthetic controls."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import distributions as D
from ..functions.result import coefficients, frame
from ..plans.gram import complete, gram, grouped, number
from . import glm, joins
from .linear import INTERCEPT, Fit, _inverse, from_gram
from .optimise import simplex_weights

EFFECTS = "estimand string, estimate double, std_error double, p_value double, ci_lower double, ci_upper double, n long"


def effect_row(name: str, b: float, se: float, n: int, dof: float = math.inf, level: float = 0.95) -> tuple:
    q = D.t_ppf(0.5 + level / 2, dof) if not math.isinf(dof) else D.norm_ppf(0.5 + level / 2)
    return (name, b, se, D.two_sided(b / se, dof) if se > 0 else math.nan, b - q * se, b + q * se, n)


# --- instruments ----------------------------------------------------------------------------------------------------


def iv(df: DataFrame, y: str, endogenous: Sequence[str], instruments: Sequence[str], exogenous: Sequence[str] = (), robust: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Two-stage least squares with structural residuals, partial first-stage F, Sargan. All from one Gram; the n x n
    projection is never formed. robust adds one pass for the residuals' cross-products."""
    xs, zs = [*endogenous, *exogenous], [*exogenous, *instruments]
    if len(instruments) < len(endogenous):
        raise ValueError("fewer instruments than endogenous columns")
    names = ["__y", *dict.fromkeys([*xs, *zs])]
    own = complete(df, {"__y": y, **{c: c for c in names[1:]}})
    g = gram(own, names)
    z, x = ["1", *zs], ["1", *xs]
    zz, zx, zy, xx, xy = g.raw(z), g.raw(z, x), g.raw(z, ["__y"])[:, 0], g.raw(x), g.raw(x, ["__y"])[:, 0]
    p = _inverse(zz)
    bread = _inverse(zx.T @ p @ zx)
    beta = bread @ zx.T @ p @ zy
    yy = g.raw(["__y"])[0, 0]
    rss = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    dof = g.n - len(x)
    s2 = rss / dof
    vcov = bread * s2
    if robust:
        e = F.col("__y") - F.lit(float(beta[0]))
        for c, b in zip(xs, beta[1:]):
            e = e - F.lit(float(b)) * F.col(f"`{c}`")
        m = own.select(*[(e * (F.lit(1.0) if c == "1" else F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(z)])
        vcov = bread @ zx.T @ p @ gram(m, m.columns).raw(m.columns) @ p @ zx @ bread * g.n / dof
    out = {"n": g.n, "sigma": math.sqrt(s2), "r2": 1 - rss / g.centred[0, 0]}
    for c in endogenous:
        wide, narrow = from_gram(g, c, zs), from_gram(g, c, list(exogenous)) if exogenous else None
        less = narrow.rss if narrow else g.centred[g.at([c])[0], g.at([c])[0]]
        out[f"first_stage_f_{c}"] = (less - wide.rss) / len(instruments) / wide.sigma2
    out["weak_instruments"] = float(min(v for k, v in out.items() if k.startswith("first_stage_f_")) < 10)
    over = len(zs) - len(xs)
    if over:
        ze = zy - zx @ beta
        out["sargan"] = float(ze @ p @ ze) / (rss / g.n)
        out["sargan_p_value"] = D.chi2_sf(out["sargan"], over)
    return coefficients(df.sparkSession, [INTERCEPT, *xs], beta, np.sqrt(np.diag(vcov)), dof), out


def wald_ratio(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """The just-identified estimate cov(z, y) / cov(z, x)."""
    own = complete(df, {"y": y, "x": x, "z": z})
    return own.agg((F.covar_samp("z", "y") / F.covar_samp("z", "x")).alias("estimate"), F.count("*").alias("n"))


# --- differences in differences ---------------------------------------------------------------------------------------


def did_means(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    """The four cell means and the difference of differences."""
    c = number(y)
    cell = lambda t, p: F.avg(F.when((F.col(treated) == t) & (F.col(post) == p), c))
    one = df.agg(cell(1, 1).alias("treated_post"), cell(1, 0).alias("treated_pre"), cell(0, 1).alias("control_post"), cell(0, 0).alias("control_pre"))
    return one.withColumn("att", F.col("treated_post") - F.col("treated_pre") - (F.col("control_post") - F.col("control_pre")))


def did(df: DataFrame, y: str, treated: str, post: str, controls: Sequence[str] = (), robust: bool = False) -> tuple[DataFrame, Fit]:
    """The regression form with controls; robust: HC0 covariance."""
    from . import diagnostics
    from .linear import ols

    terms = {treated: treated, post: post, f"{treated}:{post}": number(treated) * number(post), **{c: c for c in controls}}
    fit = ols(df, y, terms)
    if robust:
        fit.vcov = diagnostics.robust_vcov(df, fit, "HC0")
    return fit.table(df.sparkSession), fit


def did_pretrend(df: DataFrame, y: str, treated: str, time: str, before: float) -> DataFrame:
    """Whether the groups' trends differ before a time: the interaction of time and treatment among earlier rows."""
    from .linear import ols

    own = df.where(F.col(time) < before)
    fit = ols(own, y, {treated: treated, time: time, f"{treated}:{time}": number(treated) * number(time)})
    return fit.table(df.sparkSession).where(F.col("term") == f"{treated}:{time}")


def two_way_effect(df: DataFrame, y: str, d: str, unit: str, time: str, controls: Sequence[str] = ()) -> tuple[DataFrame, dict[str, float]]:
    """The treatment's coefficient under unit and time effects, clustered by unit; cohorts tell staggered adoption."""
    from .panel import fixed_effects

    table, m, _ = fixed_effects(df, y, [d, *controls], unit, time)
    cohorts = df.where(F.col(d) == 1).groupBy(unit).agg(F.min(time).alias("t")).agg(F.count_distinct("t")).first()[0]
    return table, m | {"cohorts": cohorts, "staggered": float(cohorts > 1)}


def event_study(df: DataFrame, y: str, unit: str, time: str, start: str, leads: int = 3, lags: int = 3) -> DataFrame:
    """Coefficients of time relative to a unit's start (null: never treated), the period before it left out."""
    from .panel import fixed_effects

    k = F.col(time) - F.col(start)
    names = {}
    for r in [*range(-leads, -1), *range(0, lags + 1)]:
        hit = (k <= r) if r == -leads else (k >= r) if r == lags else (k == r)
        names[f"rel_{r}"] = F.coalesce(hit.cast("double"), F.lit(0.0))
    wide = df.withColumns(names)
    return fixed_effects(wide, y, list(names), unit, time)[0]


# --- propensity scores --------------------------------------------------------------------------------------------------


def propensity(df: DataFrame, treatment: str, x: Sequence[str], into: str = "ps") -> DataFrame:
    """df with the fitted probability of treatment by an unpenalised logit."""
    fit = glm.logistic(df, treatment, x)
    return df.withColumn(into, fit.prediction())


def match_outcomes(df: DataFrame, id_col: str, y: str, treatment: str, ps: str, caliper: float | None = None) -> DataFrame:
    """(id, t, y, counterfactual) for every row with a match: the nearest row of the other arm, with replacement."""
    own = df.select(F.col(id_col).alias("id"), number(y).alias("y"), F.col(treatment).cast("int").alias("t"), number(ps).alias("ps")).dropna()
    flipped = own.withColumn("t", 1 - F.col("t"))
    att = joins.nearest(own, "id", "ps", "t", caliper)
    atc = joins.nearest(flipped, "id", "ps", "t", caliper)
    other = own.select(F.col("id").alias("match_id"), F.col("y").alias("counterfactual"))
    return att.unionByName(atc).join(other, "match_id").join(own.select("id", "t", "y"), "id").select("id", "t", "y", "counterfactual")


def psm(df: DataFrame, id_col: str, y: str, treatment: str, x: Sequence[str] | None = None, ps: str | None = None, caliper_sd: float | None = None) -> DataFrame:
    """ATT, ATC and ATE by nearest-neighbour matching on the propensity score; caliper in its standard deviations."""
    df, ps = (propensity(df, treatment, x, "__ps"), "__ps") if ps is None else (df, ps)
    caliper = caliper_sd * df.agg(F.stddev_samp(number(ps))).first()[0] if caliper_sd else None
    m = match_outcomes(df, id_col, y, treatment, ps, caliper).withColumn("d", F.when(F.col("t") == 1, F.col("y") - F.col("counterfactual")).otherwise(F.col("counterfactual") - F.col("y")))
    r = m.agg(*[f(F.when(c, F.col("d"))).alias(f"{n}{k}") for k, c in (("att", F.col("t") == 1), ("atc", F.col("t") == 0), ("ate", F.lit(True))) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))]).first()
    rows = [effect_row(k.upper(), r[f"m{k}"], r[f"s{k}"] / math.sqrt(r[f"n{k}"]), r[f"n{k}"]) for k in ("att", "atc", "ate")]
    return frame(df.sparkSession, rows, EFFECTS)


def psm_weighted(df: DataFrame, id_col: str, y: str, treatment: str, ps: str, method: str = "radius", width: float = 0.05) -> DataFrame:
    """ATT with all controls within a radius, averaged equally (radius) or by an Epanechnikov kernel (kernel). Both by
    buckets of the width, one join."""
    pairs = joins.within_radius(df, id_col, ps, treatment, width)
    w = F.lit(1.0) if method == "radius" else C.epanechnikov(F.col("distance") / width)
    values = df.select(F.col(id_col).alias("match_id"), number(y).alias("cy"))
    own = df.select(F.col(id_col).alias("id"), number(y).alias("y"))
    sums = pairs.withColumn("w", w).join(values, "match_id").groupBy("id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("cy")).alias("s")).where("w > 0")
    r = sums.join(own, "id").select((F.col("y") - F.col("s") / F.col("w")).alias("d")).agg(F.avg("d"), F.stddev_samp("d"), F.count("d")).first()
    return frame(df.sparkSession, [effect_row("ATT", r[0], r[1] / math.sqrt(r[2]), r[2])], EFFECTS)


def balance(df: DataFrame, treatment: str, x: Sequence[str], weight: str | None = None) -> DataFrame:
    """(variable, mean_treated, mean_control, smd): the difference over the root of the mean population variance."""
    w = number(weight) if weight else F.lit(1.0)
    out = []
    for c in x:
        v = number(c)
        parts = {}
        for a in (1, 0):
            on = F.when((F.col(treatment) == a) & v.isNotNull(), w)
            m = F.sum(on * v) / F.sum(on)
            parts[a] = (m, F.sum(on * v * v) / F.sum(on) - m * m)
        gap = (parts[1][0] - parts[0][0]) / F.sqrt((parts[1][1] + parts[0][1]) / 2)
        out.append(F.struct(F.lit(c).alias("variable"), parts[1][0].alias("mean_treated"), parts[0][0].alias("mean_control"), gap.alias("smd")))
    return df.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def ipw(df: DataFrame, y: str, treatment: str, ps: str, trim: float = 0.01) -> DataFrame:
    """(estimand, estimate) in one aggregate: ATT and ATC with normalised weights, ATE of Horvitz and Thompson over the
    rows whose score lies within trim of neither end."""
    own = complete(df, {"y": y, "t": treatment, "p": ps}).where((F.col("p") >= trim) & (F.col("p") <= 1 - trim))
    y_, t, p = F.col("y"), F.col("t"), F.col("p")
    c, odds = 1 - t, p / (1 - p)
    att = F.sum(t * y_) / F.sum(t) - F.sum(c * odds * y_) / F.sum(c * odds)
    atc = F.sum(t * y_ / odds) / F.sum(t / odds) - F.sum(c * y_) / F.sum(c)
    ate = F.avg(t * y_ / p - c * y_ / (1 - p))
    one = own.agg(att.alias("ATT"), atc.alias("ATC"), ate.alias("ATE"), F.count("*").alias("n"))
    return one.unpivot(["n"], ["ATT", "ATC", "ATE"], "estimand", "estimate").select("estimand", "estimate", "n")


def ipw_effects(df: DataFrame, y: str, treatment: str, ps: str, trim: float = 0.01) -> DataFrame:
    """ipw() with standard errors from the influence of each row, a second aggregate."""
    e = {r["estimand"]: (r["estimate"], r["n"]) for r in ipw(df, y, treatment, ps, trim).collect()}
    own = complete(df, {"y": y, "t": treatment, "p": ps}).where((F.col("p") >= trim) & (F.col("p") <= 1 - trim))
    y_, t, p = F.col("y"), F.col("t"), F.col("p")
    c, odds = 1 - t, p / (1 - p)
    m = own.agg((F.sum(t * y_) / F.sum(t)).alias("t1"), (F.sum(c * odds * y_) / F.sum(c * odds)).alias("c1"), (F.sum(t * y_ / odds) / F.sum(t / odds)).alias("t0"), (F.sum(c * y_) / F.sum(c)).alias("c0"), F.avg(t).alias("s1"), F.avg(c * odds).alias("so"), F.avg(t / odds).alias("si"), F.avg(c).alias("s0")).first()
    psi = {"ATT": t * (y_ - m["t1"]) / m["s1"] - c * odds * (y_ - m["c1"]) / m["so"], "ATC": t / odds * (y_ - m["t0"]) / m["si"] - c * (y_ - m["c0"]) / m["s0"], "ATE": t * y_ / p - c * y_ / (1 - p) - e["ATE"][0]}
    sd = own.agg(*[F.stddev_samp(v).alias(k) for k, v in psi.items()]).first()
    return frame(df.sparkSession, [effect_row(k, e[k][0], sd[k] / math.sqrt(e[k][1]), e[k][1]) for k in psi], EFFECTS)


def aipw(df: DataFrame, y: str, treatment: str, x: Sequence[str], ps: str, trim: float = 0.01) -> DataFrame:
    """Doubly robust ATE and ATT: an outcome model by arm (one grouped aggregate), then one pass of influence values."""
    names = list(x)
    own = complete(df, {"y": y, "t": treatment, "p": ps, **{c: c for c in names}}).where((F.col("p") >= trim) & (F.col("p") <= 1 - trim))
    g = grouped(own.withColumn("__arm", F.col("t").cast("int")), ["y", *names], "__arm")
    mu = {a: Fit(**{**from_gram(g[a], "y", names).__dict__, "columns": {c: c for c in names}}).prediction() for a in (0, 1)}
    y_, t, p = F.col("y"), F.col("t"), F.col("p")
    ate = mu[1] - mu[0] + t * (y_ - mu[1]) / p - (1 - t) * (y_ - mu[0]) / (1 - p)
    att = t * (y_ - mu[0]) - (1 - t) * p / (1 - p) * (y_ - mu[0])
    r = own.agg(F.avg(ate).alias("a"), F.stddev_samp(ate).alias("s"), F.avg(att).alias("b"), F.avg("t").alias("q"), F.count("*").alias("n")).first()
    b = r["b"] / r["q"]
    s = own.agg(F.stddev_samp((att - t * b) / r["q"])).first()[0]
    return frame(df.sparkSession, [effect_row("ATE", r["a"], r["s"] / math.sqrt(r["n"]), r["n"]), effect_row("ATT", b, s / math.sqrt(r["n"]), r["n"])], EFFECTS)


def covariate_matching(df: DataFrame, id_col: str, y: str, treatment: str, x: Sequence[str], k: int = 1) -> DataFrame:
    """ATT by the k nearest controls in Mahalanobis distance: columns are whitened by the Cholesky factor of their
    covariance, then matched as vectors in cells."""
    names = list(x)
    own = complete(df, {"y": y, "t": treatment, **{c: c for c in names}}, [F.col(id_col).cast("long").alias("id")])
    g = gram(own, names)
    white = np.linalg.inv(np.linalg.cholesky(g.cov()))
    vec = F.array(*[sum((F.lit(float(white[i, j])) * (F.col(f"`{c}`") - float(g.mean[j])) for j, c in enumerate(names)), F.lit(0.0)) for i in range(len(names))])
    v = own.select("id", "y", "t", vec.alias("embedding")).withColumn("vec_id", F.col("id"))
    near = joins.knn_cells(v.where("t = 0"), v.where("t = 1"), k)
    r = near.join(v.select(F.col("id").alias("vec_id"), F.col("y").alias("cy")), "vec_id").groupBy("query_id").agg(F.avg("cy").alias("cy")).join(v.select(F.col("id").alias("query_id"), "y"), "query_id").select((F.col("y") - F.col("cy")).alias("d")).agg(F.avg("d"), F.stddev_samp("d"), F.count("d")).first()
    return frame(df.sparkSession, [effect_row("ATT", r[0], r[1] / math.sqrt(r[2]), r[2])], EFFECTS)


# --- discontinuities ------------------------------------------------------------------------------------------------------


@dataclass
class Jump:
    estimate: float
    se: float
    n: int
    bandwidth: float
    beta: np.ndarray


def _rdd_terms(order: int, controls: Sequence[str]) -> list[str]:
    return ["t", *[f"x{p}" for p in range(1, order + 1)], *[f"tx{p}" for p in range(1, order + 1)], *controls]


def _rdd_rows(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float, kernel: str, order: int, controls: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    own = complete(df, {"__y": y, "__r": number(running) - cutoff, **{c: c for c in controls}}, list(keep)).where(F.abs("__r") <= bandwidth)
    t = (F.col("__r") >= 0).cast("double")
    more = {"t": t, **{f"x{p}": F.pow("__r", p) for p in range(1, order + 1)}, **{f"tx{p}": t * F.pow("__r", p) for p in range(1, order + 1)}, "__w": C.KERNELS[kernel](F.col("__r") / bandwidth)}
    return own.withColumns(more).where("__w > 0")


def rdd(df: DataFrame, y: str, running: str, cutoff: float = 0.0, bandwidth: float | None = None, kernel: str = "triangular", order: int = 1, controls: Sequence[str] = ()) -> Jump:
    """Sharp design: local polynomials on both sides with sandwich standard errors."""
    h = bandwidth or ik_bandwidth(df, y, running, cutoff)
    rows = _rdd_rows(df, y, running, cutoff, h, kernel, order, controls)
    terms = _rdd_terms(order, controls)
    g = gram(rows.select("__y", "__w", *terms), ["__y", *terms], "__w")
    fit = from_gram(g, "__y", terms)
    e = F.col("__y") - Fit(**{**fit.__dict__, "columns": {t: t for t in terms}}).prediction()
    m = rows.select(*[(e * F.col("__w") * (F.lit(1.0) if t == INTERCEPT else F.col(t))).alias(f"m{i}") for i, t in enumerate(fit.terms)])
    vcov = fit.bread @ gram(m, m.columns).raw(m.columns) @ fit.bread * g.n / (g.n - len(fit.terms))
    return Jump(float(fit.beta[1]), float(math.sqrt(vcov[1, 1])), g.n, h, fit.beta)


def rdd_table(df: DataFrame, jump: Jump) -> DataFrame:
    return frame(df.sparkSession, [effect_row("LATE", jump.estimate, jump.se, jump.n, jump.n - len(jump.beta))], EFFECTS)


def ik_bandwidth(df: DataFrame, y: str, running: str, cutoff: float) -> float:
    """A plug-in bandwidth in the manner of Imbens and Kalyanaraman, from a few small aggregates."""
    own = complete(df, {"y": y, "r": number(running) - cutoff})
    r = own.agg(F.count("*").alias("n"), F.stddev_samp("r").alias("s"), F.max("r").alias("hi"), F.min("r").alias("lo")).first()
    pilot = 1.84 * r["s"] * r["n"] ** -0.2
    near = own.where(F.abs("r") <= pilot)
    s = near.groupBy((F.col("r") >= 0).alias("side")).agg(F.count("*").alias("n"), F.var_samp("y").alias("v")).collect()
    density = sum(x["n"] for x in s) / (2 * r["n"] * pilot)
    v = {x["side"]: x["v"] or 0.0 for x in s}
    curve = {}
    for side in (True, False):
        part = own.where((F.col("r") >= 0) == side)
        rows = part.select("y", F.col("r").alias("x1"), F.pow("r", 2).alias("x2"))
        curve[side] = 2 * from_gram(gram(rows, ["y", "x1", "x2"]), "y", ["x1", "x2"]).beta[2]
    gap = (curve[True] - curve[False]) ** 2 + 1e-8
    h = 3.4375 * ((v.get(True, 0.0) + v.get(False, 0.0)) / (density * gap)) ** 0.2 * r["n"] ** -0.2
    return float(min(h, max(r["hi"], -r["lo"])))


def manipulation_test(df: DataFrame, running: str, cutoff: float, width: float) -> DataFrame:
    """Counts within width on either side and the statistic of equal shares."""
    d = number(running) - cutoff
    one = df.agg(F.count_if((d >= -width) & (d < 0)).alias("below"), F.count_if((d >= 0) & (d <= width)).alias("above"))
    return one.withColumn("statistic", (F.col("above") - F.col("below")) / F.sqrt(F.col("above") + F.col("below")))


def fuzzy_rdd(df: DataFrame, y: str, d: str, running: str, cutoff: float, bandwidth: float, kernel: str = "triangular") -> dict[str, float]:
    """The jump of y over the jump of d: kernel-weighted two-stage least squares, one slope."""
    rows = _rdd_rows(df, y, running, cutoff, bandwidth, kernel, 1, [d])
    g = gram(rows.select("__y", "__w", "t", "x1", F.col(d).alias("__d")), ["__y", "t", "x1", "__d"], "__w")
    z, x = ["1", "t", "x1"], ["1", "__d", "x1"]
    zx, zy = g.raw(z, x), g.raw(z, ["__y"])[:, 0]
    beta = np.linalg.solve(zx, zy)
    e = F.col("__y") - float(beta[0]) - F.lit(float(beta[1])) * F.col(d) - F.lit(float(beta[2])) * F.col("x1")
    m = rows.select(*[(e * F.col("__w") * c).alias(f"m{i}") for i, c in enumerate((F.lit(1.0), F.col("t"), F.col("x1")))])
    inv = np.linalg.inv(zx)
    vcov = inv @ gram(m, m.columns).raw(m.columns) @ inv.T
    first = from_gram(g, "__d", ["t", "x1"])
    return {"late": float(beta[1]), "std_error": float(math.sqrt(vcov[1, 1])), "first_stage": float(first.beta[1]), "n": g.n}


def manifold(df: DataFrame, y: str, running: str, cutoff: float, base: float, steps: int = 20, kernel: str = "triangular") -> DataFrame:
    """(bandwidth, estimate, std_error, n) over 0.2 to 3 times a bandwidth, all in one pass: a row adds to the
    cross-products of every bandwidth that holds it. A bandwidth that holds fewer than two values of the running column on
    a side has no such fit and no row."""
    grid = [base * (0.2 + 2.8 * i / (steps - 1)) for i in range(steps)]
    own = complete(df, {"__y": y, "__r": number(running) - cutoff}).where(F.abs("__r") <= grid[-1])
    wide = own.withColumn("__h", F.explode(F.array(*[F.when(F.abs("__r") <= h, F.lit(h)) for h in grid]))).where("__h IS NOT NULL")
    t = (F.col("__r") >= 0).cast("double")
    rows = wide.select("__h", "__y", t.alias("t"), F.col("__r").alias("x1"), (t * F.col("__r")).alias("tx1"), C.KERNELS[kernel](F.col("__r") / F.col("__h")).alias("__w")).where("__w > 0")
    out = []
    for h, g in sorted(grouped(rows, ["__y", "t", "x1", "tx1"], "__h", "__w").items()):
        x = g.centred[1:, 1:]
        d = np.sqrt(np.diag(x))
        if g.n > 4 and d.min() > 0 and np.linalg.matrix_rank(x / np.outer(d, d), tol=1e-10) == 3:
            fit = from_gram(g, "__y", ["t", "x1", "tx1"])
            out.append((h, float(fit.beta[1]), float(fit.se[1]), g.n))
    return frame(df.sparkSession, out, "bandwidth double, estimate double, std_error double, n long")




# --- synthetic control --------------------------------------------------------------------------------------------------------


def outcome_matrix(df: DataFrame, unit: str, time: str, outcome: str) -> tuple[list, list, np.ndarray]:
    """(units, times, T x N means): one number a unit and period, which the driver holds."""
    rows = df.groupBy(F.col(unit).alias("u"), F.col(time).alias("t")).agg(F.avg(number(outcome)).alias("y")).where("y IS NOT NULL").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("over a million unit-periods")
    units, times = sorted({r["u"] for r in rows}), sorted({r["t"] for r in rows})
    at = {u: i for i, u in enumerate(units)}, {t: i for i, t in enumerate(times)}
    y = np.full((len(times), len(units)), np.nan)
    for r in rows:
        y[at[1][r["t"]], at[0][r["u"]]] = r["y"]
    return units, times, y


def _synthetic(y: np.ndarray, treated: int, pre: np.ndarray, donors: list[int]) -> dict:
    if not donors or not pre.any() or pre.all() or not np.isfinite(y[:, treated]).all():
        raise ValueError("a synthetic control needs donors and periods on both sides without gaps")
    a, b = y[pre][:, donors], y[pre, treated]
    w = simplex_weights(a.T @ a, a.T @ b)
    gap = y[:, treated] - y[:, donors] @ w
    pre_r, post_r = math.sqrt((gap[pre] ** 2).mean()), math.sqrt((gap[~pre] ** 2).mean())
    return {"weights": w, "gap": gap, "att": float(gap[~pre].mean()), "pre_rmspe": pre_r, "post_rmspe": post_r, "ratio": post_r / max(pre_r, 1e-12)}


def synthetic_control(df: DataFrame, unit: str, time: str, outcome: str, treated, start) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(donor weights, gaps by period, {att, pre_rmspe, post_rmspe, ratio, pre_r2}); weights are at least 0 and sum to 1."""
    units, times, y = outcome_matrix(df, unit, time, outcome)
    pre = np.array([t < start for t in times])
    donors = [i for i, u in enumerate(units) if u != treated and np.isfinite(y[:, i]).all()]
    i = units.index(treated)
    r = _synthetic(y, i, pre, donors)
    spark = df.sparkSession
    weights = frame(spark, [(str(units[d]), float(w)) for d, w in zip(donors, r["weights"])], "unit string, weight double").orderBy(F.desc("weight"), "unit")
    gaps = frame(spark, [(str(t), float(y[k, i]), float(y[k, i] - r["gap"][k]), float(r["gap"][k])) for k, t in enumerate(times)], "period string, actual double, synthetic double, gap double")
    total = ((y[pre, i] - y[pre, i].mean()) ** 2).sum()
    m = {k: r[k] for k in ("att", "pre_rmspe", "post_rmspe", "ratio")} | {"pre_r2": 1 - (r["gap"][pre] ** 2).sum() / total if total else math.nan}
    return weights, gaps, m


def placebo(df: DataFrame, unit: str, time: str, outcome: str, treated, start, within: float = 5.0) -> tuple[DataFrame, dict[str, float]]:
    """(unit, att, pre_rmspe, ratio, rank) with every unit in the treated's place, and the share of kept placebos whose
    ratio is at least the treated's (itself included); kept: pre-RMSPE below within times the treated's."""
    units, times, y = outcome_matrix(df, unit, time, outcome)
    pre = np.array([t < start for t in times])
    whole = [i for i in range(len(units)) if np.isfinite(y[:, i]).all()]
    rows = []
    for i in whole:
        r = _synthetic(y, i, pre, [d for d in whole if d != i and units[d] != treated])
        rows.append((str(units[i]), r["att"], r["pre_rmspe"], r["ratio"]))
    own = next(r for r in rows if r[0] == str(treated))
    kept = [r for r in rows if r[2] < within * max(own[2], 1e-12) or r is own]
    rank = 1 + sum(r[3] > own[3] for r in kept)
    ranked = sorted(rows, key=lambda r: -r[3])
    table = frame(df.sparkSession, [(*r, k) for k, r in enumerate(ranked, 1)], "unit string, att double, pre_rmspe double, ratio double, rank long")
    return table, {"p_value": sum(r[3] >= own[3] for r in kept) / len(kept), "treated_rank": rank, "kept": len(kept)}


def in_time_placebo(df: DataFrame, unit: str, time: str, outcome: str, treated, start, fake) -> dict[str, float]:
    """The effect at an earlier start, with rows from the true start on left out."""
    return synthetic_control(df.where(F.col(time) < start), unit, time, outcome, treated, fake)[2]


def generalised_synthetic(df: DataFrame, unit: str, time: str, outcome: str, treated: Sequence, start, factors: int = 2, reps: int = 200, seed: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """Interactive fixed effects: factors of the controls' outcomes, loadings of the treated from their periods before
    start; standard errors by resampling control units."""
    units, times, y = outcome_matrix(df, unit, time, outcome)
    pre = np.array([t < start for t in times])
    whole = [i for i in range(len(units)) if np.isfinite(y[:, i]).all()]
    on, off = [i for i in whole if units[i] in treated], [i for i in whole if units[i] not in treated]

    def path(controls: list[int]) -> np.ndarray:
        c = y[:, controls]
        mean = c.mean(1)
        f = np.linalg.svd(c - mean[:, None] - (c - mean[:, None]).mean(0), full_matrices=False)[0][:, :factors]
        f = np.column_stack([np.ones(len(times)), f])
        t = y[:, on] - mean[:, None]
        load = np.linalg.lstsq(f[pre], t[pre], rcond=None)[0]
        return (t - f @ load).mean(1)

    gap, random = path(off), np.random.RandomState(seed)
    reps_ = np.array([path(list(random.choice(off, len(off)))) for _ in range(reps)])
    rows = [(str(t), float(g), float(s)) for t, g, s in zip(times, gap, reps_.std(0, ddof=1))]
    return frame(df.sparkSession, rows, "period string, effect double, std_error double"), {"att": float(gap[~pre].mean()), "std_error": float(reps_[:, ~pre].mean(1).std(ddof=1))}


