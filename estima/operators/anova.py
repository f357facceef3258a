"""Analysis of variance, post-hoc comparisons, covariance, power."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import frame
from ..plans.gram import Gram, complete, gram
from .hypothesis import group_moments
from .prep import levels

ANOVA = "source string, ss double, df long, ms double, f_stat double, p_value double, eta_sq double"


def one_way_table(df: DataFrame, value: str, group: str) -> DataFrame:
    """(source, ss, df, ms, f_stat, eta_sq) for between, within and total, by Spark alone."""
    g = complete(df, {"v": value}, [F.col(group).alias("g")]).where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    s = g.crossJoin(F.broadcast(t.select("grand"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("b"), F.sum("w").alias("w"))
    one = s.crossJoin(F.broadcast(t.select("n", "k")))
    db, dw = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.col("b") / db / (F.col("w") / dw)
    null = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("between").alias("source"), F.col("b").alias("ss"), db.alias("df"), (F.col("b") / db).alias("ms"), f.alias("f_stat"), (F.col("b") / (F.col("b") + F.col("w"))).alias("eta_sq")),
        F.struct(F.lit("within").alias("source"), F.col("w").alias("ss"), dw.alias("df"), (F.col("w") / dw).alias("ms"), null.alias("f_stat"), null.alias("eta_sq")),
        F.struct(F.lit("total").alias("source"), (F.col("b") + F.col("w")).alias("ss"), (F.col("n") - 1).alias("df"), null.alias("ms"), null.alias("f_stat"), null.alias("eta_sq")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def one_way(df: DataFrame, value: str, group: str) -> DataFrame:
    rows = one_way_table(df, value, group).collect()
    dw = next(r["df"] for r in rows if r["source"] == "within")
    return frame(df.sparkSession, [(r["source"], r["ss"], r["df"], r["ms"], r["f_stat"], D.f_sf(r["f_stat"], r["df"], dw) if r["f_stat"] is not None else None, r["eta_sq"]) for r in rows], ANOVA)


def two_way_sums(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Sums of squares from marginal and cell means in one cube: ss_a, ss_b, ss_ab, ss_within, and the counts."""
    cube = complete(df, {"v": value}, [F.col(a).alias("a"), F.col(b).alias("b")]).where("a IS NOT NULL AND b IS NOT NULL").cube("a", "b").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    part = lambda g: cube.where(F.col("g") == g)
    cells = part(0).select("a", "b", F.col("n").alias("nc"), F.col("m").alias("mc"), "w")
    ra, rb = part(1).select("a", F.col("n").alias("na"), F.col("m").alias("ma")), part(2).select("b", F.col("n").alias("nb"), F.col("m").alias("mb"))
    grand = part(3).select(F.col("n").alias("n"), F.col("m").alias("m"))
    full = cells.join(F.broadcast(ra), "a").join(F.broadcast(rb), "b").crossJoin(F.broadcast(grand))
    sab = F.sum(F.col("nc") * F.pow(F.col("mc") - F.col("ma") - F.col("mb") + F.col("m"), 2))
    one = full.agg(sab.alias("ss_ab"), F.sum("w").alias("ss_within"))
    sa = ra.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("na") * F.pow(F.col("ma") - F.col("m"), 2)).alias("ss_a"), F.count("*").alias("levels_a"), F.max("n").alias("n"))
    sb = rb.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("nb") * F.pow(F.col("mb") - F.col("m"), 2)).alias("ss_b"), F.count("*").alias("levels_b"))
    return one.crossJoin(F.broadcast(sa)).crossJoin(F.broadcast(sb))


def two_way(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Main effects and interaction with partial eta squared; for balanced cells the usual table."""
    r = two_way_sums(df, value, a, b).first()
    da, db = r["levels_a"] - 1, r["levels_b"] - 1
    dw = r["n"] - r["levels_a"] * r["levels_b"]
    ms = r["ss_within"] / dw
    rows = []
    for name, ss, d in ((a, r["ss_a"], da), (b, r["ss_b"], db), (f"{a}:{b}", r["ss_ab"], da * db)):
        f = ss / d / ms
        rows.append((name, ss, d, ss / d, f, D.f_sf(f, d, dw), ss / (ss + r["ss_within"])))
    rows.append(("within", r["ss_within"], dw, ms, None, None, None))
    return frame(df.sparkSession, rows, ANOVA)


def tukey_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group1, group2, difference, se, q) of all pairs of groups, q = |difference| / sqrt(MSW / 2 (1/n1 + 1/n2))."""
    g = group_moments(df, value, group)
    msw = g.agg((F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count("*"))).alias("msw"))
    x, y = [g.select(F.col("group").alias(f"group{i}"), F.col("n").alias(f"n{i}"), F.col("mean").alias(f"m{i}")) for i in (1, 2)]
    p = x.join(F.broadcast(y), F.col("group1") < F.col("group2")).crossJoin(F.broadcast(msw))
    se = F.sqrt(F.col("msw") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    return p.select("group1", "group2", (F.col("m1") - F.col("m2")).alias("difference"), se.alias("se"), (F.abs(F.col("m1") - F.col("m2")) / se).alias("q"))


def tukey(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    g = group_moments(df, value, group).agg(F.count("*"), F.sum("n")).first()
    k, dof = g[0], g[1] - g[0]
    crit = D.studentized_range_ppf(1 - alpha, k, dof)
    rows = []
    for r in tukey_pairs(df, value, group).collect():
        p = D.studentized_range_sf(r["q"], k, dof)
        rows.append((str(r["group1"]), str(r["group2"]), r["difference"], r["q"], p, r["difference"] - crit * r["se"], r["difference"] + crit * r["se"], p < alpha))
    return frame(df.sparkSession, rows, "group1 string, group2 string, difference double, q double, p_value double, ci_lower double, ci_upper double, reject boolean")


def _rss(g: Gram, y: str, x: Sequence[str]) -> tuple[float, np.ndarray]:
    i, j = g.at(x), g.at([y])[0]
    a = g.centred[np.ix_(i, i)]
    b = np.linalg.lstsq(a, g.centred[i, j], rcond=None)[0]
    return float(g.centred[j, j] - b @ g.centred[i, j]), b


def ancova(df: DataFrame, value: str, group: str, covariates: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the table: groups adjusted for covariates, covariates, residual; adjusted means at the covariates' means). One
    cross-product aggregate serves both models."""
    names = levels(df, group)
    dummies = {f"__g{i}": (F.col(group) == F.lit(v)).cast("double") for i, v in enumerate(names) if i}
    own = complete(df, {"__y": value, **{c: c for c in covariates}, **dummies})
    g = gram(own, own.columns)
    full, b = _rss(g, "__y", [*covariates, *dummies])
    only_cov, _ = _rss(g, "__y", list(covariates))
    only_groups, _ = _rss(g, "__y", list(dummies))
    k, dof = len(dummies), g.n - 1 - len(covariates) - len(dummies)
    ms = full / dof
    rows = []
    for name, ss, d in ((group, only_cov - full, k), ("covariates", only_groups - full, len(covariates))):
        f = ss / d / ms
        rows.append((name, ss, d, ss / d, f, D.f_sf(f, d, dof), ss / (ss + full)))
    rows.append(("residual", full, dof, ms, None, None, None))
    effect = [0.0, *b[len(covariates) :]]
    base = g.mean[g.at(["__y"])[0]] - sum(e * g.mean[g.at([d])[0]] for e, d in zip(effect[1:], dummies))
    means = [(str(v), base + e) for v, e in zip(names, effect)]
    return frame(df.sparkSession, rows, ANOVA), frame(df.sparkSession, means, "group string, adjusted_mean double")


def power_t(d: float, n: int, alpha: float = 0.05, alternative: str = "two-sided") -> float:
    """Of the two-sample t-test with n rows in each group."""
    dof, nc = 2 * n - 2, d * math.sqrt(n / 2)
    if alternative == "two-sided":
        c = D.t_ppf(1 - alpha / 2, dof)
        return 1 - D.nct_cdf(c, dof, nc) + D.nct_cdf(-c, dof, nc)
    c = D.t_ppf(1 - alpha, dof)
    return 1 - D.nct_cdf(c, dof, nc if alternative == "greater" else -nc)


def sample_size_t(d: float, power: float = 0.8, alpha: float = 0.05) -> int:
    """Rows in each group, from 5 to 9,999."""
    low, high = 5, 9999
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if power_t(d, mid, alpha) < power else (low, mid)
    return low


def power_anova(f: float, groups: int, n: int, alpha: float = 0.05) -> float:
    """n rows in each group, f Cohen's effect size."""
    d1, d2 = groups - 1, groups * (n - 1)
    return 1 - D.ncf_cdf(D.f_ppf(1 - alpha, d1, d2), d1, d2, f * f * groups * n)


def power_proportions(p1: float, p2: float, n: int, alpha: float = 0.05) -> float:
    h = abs(2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2)))
    z = D.norm_ppf(1 - alpha / 2)
    return D.norm_sf(z - h * math.sqrt(n / 2)) + D.norm_cdf(-z - h * math.sqrt(n / 2))


def power_curve(spark: SparkSession, d: float, sizes: Sequence[int], alpha: float = 0.05) -> DataFrame:
    return frame(spark, [(int(n), power_t(d, n, alpha)) for n in sizes], "n long, power double")
