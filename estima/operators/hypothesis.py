"""Hypothesis tests. Spark gathers the sufficient statistics; the driver turns them into statistics and p-values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import TEST, frame, test_row
from ..plans.gram import complete, number
from ..plans.ranks import running_counts, value_ranks

NAN = math.nan


def _one(df: DataFrame, row: tuple) -> DataFrame:
    return frame(df.sparkSession, [row], TEST)


def _interval(mean: float, se: float, df: float, alternative: str, level: float) -> tuple[float, float]:
    if alternative == "two-sided":
        q = D.t_ppf(0.5 + level / 2, df)
        return mean - q * se, mean + q * se
    q = D.t_ppf(level, df)
    return (-math.inf, mean + q * se) if alternative == "less" else (mean - q * se, math.inf)


def t_one_sample(df: DataFrame, column: str, mu: float = 0.0, alternative: str = "two-sided", confidence: float = 0.95) -> DataFrame:
    c = number(column)
    n, m, s = df.agg(F.count(c), F.avg(c), F.stddev_samp(c)).first()
    se = s / math.sqrt(n)
    t = (m - mu) / se
    return _one(df, test_row("one-sample t", t, D.p_of(t, n - 1, alternative), n - 1, n, (m - mu) / s, *_interval(m, se, n - 1, alternative, confidence)))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, mean, var, sd) of complete rows."""
    return complete(df, {"__v": value}, [F.col(group).alias("group")]).where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.var_samp("__v").alias("var"), F.stddev_samp("__v").alias("sd"))


def two_sample_statistics(df: DataFrame, value: str, group: str, first, second, equal_var: bool = True) -> DataFrame:
    """t, its degrees of freedom and Cohen's d, as one row computed by Spark alone."""
    g = group_moments(df, value, group)
    pick = lambda v, c: F.max(F.when(F.col("group") == F.lit(v), F.col(c)))
    one = g.agg(*[pick(v, c).alias(f"{c}{i}") for i, v in ((1, first), (2, second)) for c in ("n", "mean", "var")])
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    a, b = v1 / n1, v2 / n2
    diff = F.col("mean1") - F.col("mean2")
    if equal_var:
        t, dof = diff / F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        t, dof = diff / F.sqrt(a + b), F.pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return one.select(t.alias("statistic"), dof.alias("df"), (diff / F.sqrt(pooled)).alias("effect_size"), (n1 + n2).alias("n"), diff.alias("difference"), F.sqrt(a + b).alias("se"))


def t_two_sample(df: DataFrame, value: str, group: str, first, second, equal_var: bool = True, alternative: str = "two-sided", confidence: float = 0.95) -> DataFrame:
    """Student's or Welch's test; the interval uses the unpooled standard error in both, d the pooled deviation."""
    r = two_sample_statistics(df, value, group, first, second, equal_var).first()
    name = "two-sample t" if equal_var else "Welch t"
    return _one(df, test_row(name, r["statistic"], D.p_of(r["statistic"], r["df"], alternative), r["df"], r["n"], r["effect_size"], *_interval(r["difference"], r["se"], r["df"], alternative, confidence)))


def t_paired(df: DataFrame, x: str, y: str, alternative: str = "two-sided", confidence: float = 0.95) -> DataFrame:
    out = t_one_sample(df.select((number(x) - number(y)).alias("d")), "d", 0.0, alternative, confidence)
    return out.withColumn("test", F.lit("paired t"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected) for all pairs of levels, those without rows included."""
    counts = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    ra, rb = counts.groupBy("a").agg(F.sum("n").alias("na")), counts.groupBy("b").agg(F.sum("n").alias("nb"))
    total = counts.agg(F.sum("n").alias("total"))
    # The levels of two factors: a small table by definition of a contingency table.
    full = ra.crossJoin(F.broadcast(rb)).crossJoin(F.broadcast(total)).join(F.broadcast(counts), ["a", "b"], "left")
    return full.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.col("na") * F.col("nb") / F.col("total")).alias("expected"), "total")


def chi2_statistics(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """statistic (with Yates' correction for two by two tables), df, n, and Cramer's V."""
    t = contingency(df, a, b)
    k = t.agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    gap = F.abs(F.col("n") - F.col("expected"))
    two = (F.col("r") == 2) & (F.col("c") == 2) & F.lit(correction)
    gap = F.when(two, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    t = t.crossJoin(F.broadcast(k))
    out = t.agg(F.sum(gap * gap / F.col("expected")).alias("statistic"), F.max((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), F.max("total").alias("n"), F.max(F.least("r", "c") - 1).alias("m"))
    return out.select("statistic", "df", "n", F.sqrt(F.col("statistic") / (F.col("n") * F.col("m"))).alias("effect_size"))


def chi2_independence(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    r = chi2_statistics(df, a, b, correction).first()
    return _one(df, test_row("chi-square independence", r["statistic"], D.chi2_sf(r["statistic"], r["df"]), r["df"], r["n"], r["effect_size"]))


def chi2_goodness(df: DataFrame, column: str, expected: dict | None = None) -> DataFrame:
    """Counts of the levels against the expected shares (equal by default)."""
    rows = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL").collect()
    n = sum(r["n"] for r in rows)
    share = {r["v"]: 1 / len(rows) for r in rows} if expected is None else {k: v / sum(expected.values()) for k, v in expected.items()}
    seen = {r["v"]: r["n"] for r in rows}
    x = sum((seen.get(k, 0) - n * p) ** 2 / (n * p) for k, p in share.items())
    return _one(df, test_row("chi-square goodness of fit", x, D.chi2_sf(x, len(share) - 1), len(share) - 1, n, math.sqrt(x / n)))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, rank_sum) over average ranks of all rows, and the tie term sum(t^3 - t) beside."""
    own = complete(df, {"v": value}, [F.col(group).alias("group")]).where("group IS NOT NULL")
    # Ranks by value times counts by value and group: rows themselves are never ranked.
    r = value_ranks(own, "v")
    sums = own.groupBy("v", "group").agg(F.count("*").alias("c")).join(r, "v").groupBy("group").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    ties = r.agg(F.sum(F.pow("ties", 3) - F.col("ties")).alias("tie_term"))
    return sums.crossJoin(F.broadcast(ties))


def mann_whitney_statistics(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """U of the first group and the rank-biserial correlation 1 - 2 U / (n1 n2)."""
    own = df.where(F.col(group).isin([first, second]))
    s = rank_sums(own, value, group)
    one = s.agg(*[F.max(F.when(F.col("group") == F.lit(g), F.col(c))).alias(f"{c}{i}") for i, g in ((1, first), (2, second)) for c in ("n", "rank_sum")], F.max("tie_term").alias("tie_term"))
    u = F.col("rank_sum1") - F.col("n1") * (F.col("n1") + 1) / 2
    return one.select(u.alias("statistic"), (1 - 2 * u / (F.col("n1") * F.col("n2"))).alias("effect_size"), "n1", "n2", "tie_term")


def mann_whitney(df: DataFrame, value: str, group: str, first, second, alternative: str = "two-sided") -> DataFrame:
    r = mann_whitney_statistics(df, value, group, first, second).first()
    u, n1, n2 = r["statistic"], r["n1"], r["n2"]
    n = n1 + n2
    if min(n1, n2) <= 8 and not r["tie_term"]:
        p = _exact_u(u, n1, n2, alternative)
    else:
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - r["tie_term"] / (n * (n - 1))))
        gap = u - n1 * n2 / 2
        z = {"two-sided": (abs(gap) - 0.5) / sd, "greater": (gap - 0.5) / sd, "less": (-gap - 0.5) / sd}[alternative]
        p = min(1.0, D.norm_sf(z) * (2 if alternative == "two-sided" else 1))
    return _one(df, test_row("Mann-Whitney U", u, p, NAN, n, r["effect_size"]))


def _exact_u(u: float, n1: int, n2: int, alternative: str) -> float:
    counts = np.zeros((n1 + 1, n1 * n2 + 1))
    counts[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # sums of the ranks of subsets, less the smallest possible
        for k in range(min(j, n1), 0, -1):
            shift = j - k
            counts[k, shift:] += counts[k - 1, : counts.shape[1] - shift] if shift else counts[k - 1]
    p = counts[n1] / counts[n1].sum()
    upper, lower = p[int(math.ceil(u)) :].sum(), p[: int(math.floor(u)) + 1].sum()
    return float({"greater": upper, "less": lower, "two-sided": min(1.0, 2 * min(upper, lower))}[alternative])


def wilcoxon(df: DataFrame, x: str, y: str | None = None, alternative: str = "two-sided") -> DataFrame:
    """Signed ranks of x - y (or x), zeros dropped; exact below 10 rows without ties, else the normal approximation."""
    own = df.select((number(x) - number(y) if y else number(x)).alias("d")).where("d IS NOT NULL AND d <> 0").withColumn("a", F.abs("d"))
    r = value_ranks(own, "a")
    sums = own.groupBy("a").agg(F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("m")).join(r, "a").agg(F.sum(F.col("p") * F.col("rank")).alias("plus"), F.sum(F.col("m") * F.col("rank")).alias("minus"), F.sum("ties").alias("n"), F.sum(F.pow("ties", 3) - F.col("ties")).alias("tie")).first()
    plus, minus, n = sums["plus"] or 0.0, sums["minus"] or 0.0, sums["n"] or 0
    w = min(plus, minus) if alternative == "two-sided" else plus
    if n < 10 and not sums["tie"]:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        ways /= ways.sum()
        low, high = ways[: int(plus) + 1].sum(), ways[int(plus) :].sum()
        p = float({"two-sided": min(1.0, 2 * min(low, high)), "less": low, "greater": high}[alternative])
    else:
        z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sums["tie"] / 48)
        p = D.p_of(z, math.inf, alternative)
    return _one(df, test_row("Wilcoxon signed-rank", w, p, NAN, n, (plus - minus) / (n * (n + 1) / 2) if n else NAN))


def kruskal_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with correction for ties, its degrees of freedom, and epsilon squared H / (n - 1)."""
    s = rank_sums(df, value, group)
    one = s.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.pow("rank_sum", 2) / F.col("n")).alias("q"), F.max("tie_term").alias("tie"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (F.pow(n, 3) - n))
    return one.select(h.alias("statistic"), (F.col("k") - 1).alias("df"), "n", (h / (n - 1)).alias("effect_size"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    r = kruskal_statistics(df, value, group).first()
    return _one(df, test_row("Kruskal-Wallis", r["statistic"], D.chi2_sf(r["statistic"], r["df"]), r["df"], r["n"], r["effect_size"]))


#: The published polynomials of the weights' ends.
SHAPIRO_END, SHAPIRO_NEXT = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """Royston's approximation, for 3 rows and more: up to 4,999 come to the driver, beyond they are ranked in tasks. The
    p-value's published polynomials end at 5,000 rows and fail beyond; from there the logarithm's mean and deviation are
    fitted to our own simulations of 5,000 to 1,000,000 rows."""
    own = complete(df, {"x": column})
    rows = own.limit(5000).collect()
    n = len(rows)
    if n < 3:
        raise ValueError("Shapiro-Wilk needs 3 rows")
    if n == 5000:
        n, w = _shapiro_of_many(own)
        return _one(df, test_row("Shapiro-Wilk", w, _shapiro_p(w, n), NAN, n))
    x = np.sort([r["x"] for r in rows])
    m = np.array([D.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    a = c.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        end = np.polyval([*SHAPIRO_END, c[-1]], u)
        if n > 5:
            next_ = np.polyval([*SHAPIRO_NEXT, c[-2]], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * end**2 - 2 * next_**2)
            a = m / math.sqrt(phi)
            a[[0, 1, -2, -1]] = -end, -next_, next_, end
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * end**2)
            a = m / math.sqrt(phi)
            a[[0, -1]] = -end, end
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    return _one(df, test_row("Shapiro-Wilk", w, _shapiro_p(w, n), NAN, n))


def _shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    ln = math.log(n)
    if n >= 5000:
        # Of ln(1 - W) in 32,000 to 320 normal samples of each size.
        return D.norm_sf((math.log(1 - w) + ln + 0.4936 - 0.51 * math.log(ln)) * math.log(ln) ** 0.75 / 0.653)
    # The published polynomials of the statistic's mean and deviation.
    if n <= 11:
        g = 0.459 * n - 2.273
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(g - math.log(1 - w)) - mu) / sigma
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (math.log(1 - w) - mu) / sigma
    return D.norm_sf(z)


def _shapiro_of_many(own: DataFrame) -> tuple[int, float]:
    """(n, W): the products of normal scores and values are summed over the distinct values, each of which takes up the
    places of its rows; only the two values at either end come to the driver."""
    n, mean, ss = own.agg(F.count("x"), F.avg("x"), F.var_pop("x") * F.count("x")).first()

    def scores(frames):
        inverse = NormalDist().inv_cdf
        for f in frames:
            mm = mx = 0.0
            for x, ties, before in zip(f["x"], f["ties"], f["ties_before"]):
                for at in range(int(before), int(before + ties), 1_000_000):
                    i = np.arange(at + 1, min(at + 1_000_000, int(before + ties)) + 1)
                    m = np.fromiter(map(inverse, ((i - 0.375) / (n + 0.25)).tolist()), float, len(i))
                    mm, mx = mm + float(m @ m), mx + float(m.sum()) * (x - mean)
            yield pd.DataFrame({"mm": [mm], "mx": [mx]})

    mm, mx = running_counts(own, "x", ("ties", F.count(F.lit(1)))).mapInPandas(scores, "mm double, mx double").agg(F.sum("mm"), F.sum("mx")).first()
    low, high = ([r["x"] for r in own.orderBy(o).limit(2).collect()] for o in (F.asc("x"), F.desc("x")))
    last, second = (NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    end = float(np.polyval([*SHAPIRO_END, last / math.sqrt(mm)], 1 / math.sqrt(n)))
    next_ = float(np.polyval([*SHAPIRO_NEXT, second / math.sqrt(mm)], 1 / math.sqrt(n)))
    phi = (mm - 2 * last**2 - 2 * second**2) / (1 - 2 * end**2 - 2 * next_**2)
    inner = mx - last * (high[0] - low[0]) - second * (high[1] - low[1])
    top = inner / math.sqrt(phi) + end * (high[0] - low[0]) + next_ * (high[1] - low[1])
    return n, top * top / ss if ss > 0 else NAN


def kolmogorov_smirnov(df: DataFrame, column: str) -> DataFrame:
    """Against the normal distribution, after standardising with the population deviation. The p-value takes mean
    and deviation as known and is approximate."""
    own = complete(df, {"x": column})
    n, m, s = own.agg(F.count("*"), F.avg("x"), F.stddev_pop("x")).first()
    from ..functions.columns import norm_cdf

    r = running_counts(own, "x", ("c", F.count(F.lit(1))))
    cdf = norm_cdf((F.col("x") - m) / s)
    d = r.agg(F.max(F.greatest((F.col("c_before") + F.col("c")) / n - cdf, cdf - F.col("c_before") / n))).first()[0]
    root = math.sqrt(n)
    return _one(df, test_row("Kolmogorov-Smirnov", d, D.kolmogorov_sf((root + 0.12 + 0.11 / root) * d), NAN, n))


def levene_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """W about the groups' medians, and both degrees of freedom."""
    own = complete(df, {"v": value}, [F.col(group).alias("group")]).where("group IS NOT NULL")
    mid = own.groupBy("group").agg(F.median("v").alias("m"))
    dev = own.join(F.broadcast(mid), "group").select("group", F.abs(F.col("v") - F.col("m")).alias("z"))
    g = dev.groupBy("group").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), (F.var_pop("z") * F.count("*")).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum("ss").alias("ss"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select((between / (F.col("k") - 1) / (F.col("ss") / (F.col("n") - F.col("k")))).alias("statistic"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), "n")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    r = levene_statistics(df, value, group).first()
    return _one(df, test_row("Levene", r["statistic"], D.f_sf(r["statistic"], r["df1"], r["df2"]), r["df1"], r["n"]))


def bartlett_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    g = group_moments(df, value, group)
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum((F.col("n") - 1) * F.col("var")).alias("s"), F.sum((F.col("n") - 1) * F.log("var")).alias("l"), F.sum(1 / (F.col("n") - 1)).alias("i"))
    rest = F.col("n") - F.col("k")
    top = rest * F.log(F.col("s") / rest) - F.col("l")
    return t.select((top / (1 + (F.col("i") - 1 / rest) / (3 * (F.col("k") - 1)))).alias("statistic"), (F.col("k") - 1).alias("df"), "n")


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    r = bartlett_statistics(df, value, group).first()
    return _one(df, test_row("Bartlett", r["statistic"], D.chi2_sf(r["statistic"], r["df"]), r["df"], r["n"]))


def jarque_bera_statistics(df: DataFrame, column: str) -> DataFrame:
    c = number(column)
    s, k = F.skewness(c), F.kurtosis(c)
    return df.agg((F.count(c) / 6.0 * (s * s + k * k / 4)).alias("statistic"), s.alias("skewness"), k.alias("kurtosis"), F.count(c).alias("n"))


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    r = jarque_bera_statistics(df, column).first()
    return _one(df, test_row("Jarque-Bera", r["statistic"], D.chi2_sf(r["statistic"], 2), 2, r["n"]))


def normality(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov and Jarque-Bera, and Shapiro-Wilk where there are few enough rows."""
    out = kolmogorov_smirnov(df, column).unionByName(jarque_bera(df, column))
    n = df.agg(F.count(number(column))).first()[0]
    return out.unionByName(shapiro_wilk(df, column)) if 3 <= n < 5000 else out


def format_result(result: DataFrame) -> str:
    rows = result.collect()
    return "\n".join(f"{r['test']}: statistic = {r['statistic']:.4f}, p = {r['p_value']:.4g}, n = {r['n']}" for r in rows)


def correct_p_values(df: DataFrame, p: str = "p_value", method: str = "holm", alpha: float = 0.05) -> DataFrame:
    """df with p_adjusted and reject: bonferroni, holm or fdr (Benjamini-Hochberg). A table of tests is small; its
    one window is over it alone."""
    m = F.count(p).over(Window.partitionBy())
    order = Window.orderBy(p)
    if method == "bonferroni":
        adjusted = F.least(F.lit(1.0), F.col(p) * m)
    elif method == "holm":
        step = (m - F.row_number().over(order) + 1) * F.col(p)
        df, adjusted = df.withColumn("__a", step), F.least(F.lit(1.0), F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    elif method == "fdr":
        step = m / F.row_number().over(order) * F.col(p)
        df, adjusted = df.withColumn("__a", step), F.least(F.lit(1.0), F.min("__a").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    else:
        raise ValueError("method must be bonferroni, holm or fdr")
    return df.withColumn("p_adjusted", adjusted).withColumn("reject", F.col("p_adjusted") <= alpha).drop("__a")


ttest, anova_ranks, u_test, signed_rank = t_two_sample, kruskal, mann_whitney, wilcoxon
