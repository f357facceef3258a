"""Descriptive statistics: profiles, correlations, weighted moments, histograms, quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D
from ..functions.columns import cell_of
from ..functions.result import frame
from ..plans.gram import complete, number
from ..plans.ranks import quantiles, value_ranks, with_ranks


def _stack(df: DataFrame, columns: Sequence[str], stats: dict, schema: list[str]) -> DataFrame:
    """One aggregate over all columns, unpivoted to a row per column."""
    one = df.agg(*[f(c).alias(f"{c}\x1f{n}") for c in columns for n, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}\x1f{n}`").alias(n) for n in stats]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*").select(*schema)


def adjusted_skew(c: Column) -> Column:
    """The bias-corrected skewness of pandas."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, missing, missing_pct, unique, mean, std, min, median, max, skew, kurtosis. One aggregate of
    sums; distinct values by one shuffle of (column, value) pairs, which are first made distinct within each task; medians
    by narrowing brackets."""
    columns = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])
    own = df.select(*[number(c).alias(c) for c in columns])
    stats = {
        "count": F.count, "missing": lambda c: F.count(F.lit(1)) - F.count(c), "missing_pct": lambda c: 100.0 * (1 - F.count(c) / F.count(F.lit(1))),
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": lambda c: adjusted_skew(F.col(c)), "kurtosis": lambda c: adjusted_kurtosis(F.col(c)),
    }
    sums = _stack(own, columns, stats, ["variable", *stats])
    pairs = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("p")).select("p.*").where("v IS NOT NULL")
    unique = pairs.distinct().groupBy("variable").agg(F.count("*").alias("unique"))
    mid = quantiles(own, columns, [0.5])
    median = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(None if math.isnan(mid[c][0]) else float(mid[c][0])).cast("double"))])
    out = sums.join(unique, "variable", "left").withColumns({"unique": F.coalesce("unique", F.lit(0)), "median": median[F.col("variable")]})
    return out.select("variable", "count", "missing", "missing_pct", "unique", "mean", "std", "min", "median", "max", "skew", "kurtosis")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """(variable, value, n, rank): the k most frequent values of each column, ties to the smaller."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").where("value IS NOT NULL")
    w = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    return long.groupBy("variable", "value").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, rounded. Quartiles are exact, by narrowing brackets."""
    columns = list(columns)
    own = df.select(*[number(c).alias(c) for c in columns])
    r = lambda f: (lambda c: F.round(f(c), digits))
    sums = _stack(own, columns, {"count": F.count, "mean": r(F.avg), "std": r(F.stddev_samp), "min": r(F.min), "max": r(F.max)}, ["variable", "count", "mean", "std", "min", "max"])
    q = quantiles(own, columns, [0.25, 0.5, 0.75])
    of = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(None if math.isnan(v) else float(v)).cast("double") for v in q[c]]))])[F.col("variable")]
    out = sums.withColumns({n: F.round(of[i], digits) for i, n in enumerate(("q1", "median", "q3"))})
    return out.select("variable", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top and freq per column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").where("value IS NOT NULL")
    counts = long.groupBy("variable", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("variable").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = {"missing_share": lambda c: F.avg(F.col(c).isNull().cast("double")), "unique": lambda c: F.count_distinct(F.col(c))}
    return _stack(df, columns, stats, ["variable", *stats])


def is_categorical(df: DataFrame, column: str, most: int = 20) -> bool:
    """Text, or under most distinct values."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return True
    return df.select(column).distinct().limit(most).count() < most


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(x, y, r, n) for all pairs of different columns, pairwise complete. spearman ranks each pair's complete rows
    where columns have holes; kendall is tau-b by counts of distinct values."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        stats = []
        for a, b in pairs:
            both = number(a).isNotNull() & number(b).isNotNull()
            stats += [F.corr(F.when(both, number(a)), F.when(both, number(b))).alias(f"r{len(stats)}"), F.count_if(both).alias(f"n{len(stats)}")]
        one = df.agg(*stats)
        names = one.columns
        return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(names[2 * i]).alias("r"), F.col(names[2 * i + 1]).alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    out = None
    for a, b in pairs:
        own = df.select(number(a).alias("a"), number(b).alias("b")).dropna()
        if method == "spearman":
            ranked = with_ranks(with_ranks(own, "a", "ra"), "b", "rb")
            one = ranked.agg(F.corr("ra", "rb").alias("r"), F.count("*").alias("n"))
        elif method == "kendall":
            one = _kendall(own)
        else:
            raise ValueError("method must be pearson, spearman or kendall")
        one = one.select(F.lit(a).alias("x"), F.lit(b).alias("y"), "r", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _kendall(own: DataFrame, cells: int = 64) -> DataFrame:
    """tau-b from a grid of value ranges: pairs in different cells of both axes are concordant or discordant by the
    cells alone, and only those that share a row or column of cells are compared value by value, in blocks."""
    counts = own.groupBy("a", "b").agg(F.count("*").alias("c"))
    cuts = own.agg(F.percentile_approx("a", [i / cells for i in range(1, cells)], 10000).alias("qa"), F.percentile_approx("b", [i / cells for i in range(1, cells)], 10000).alias("qb")).first()
    bucket = lambda c, q: cell_of(F.col(c), sorted(set(q)))
    cell = counts.withColumns({"i": bucket("a", cuts["qa"]), "j": bucket("b", cuts["qb"])})
    grid = cell.groupBy("i", "j").agg(F.sum("c").alias("c"))
    x, y = grid.select(F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("c").alias("c1")), grid.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("c").alias("c2"))
    far = x.join(F.broadcast(y), F.col("i1") < F.col("i2")).where("j1 <> j2").agg(F.sum(F.when(F.col("j1") < F.col("j2"), F.col("c1") * F.col("c2")).otherwise(-F.col("c1") * F.col("c2"))).alias("s"))
    def near(key: str, extra) -> DataFrame:
        p = cell.select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("c").alias("c1"), F.col(key).alias("k"), F.col("i").alias("i1"))
        q = cell.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"), F.col(key).alias("k"), F.col("i").alias("i2"))
        sign = F.signum((F.col("a2") - F.col("a1")) * (F.col("b2") - F.col("b1")))
        return p.join(q, "k").where(F.col("a1") < F.col("a2")).where(extra).agg(F.sum(sign * F.col("c1") * F.col("c2")).alias("s"))
    same_i = near("i", F.lit(True))
    same_j = near("j", F.col("i1") != F.col("i2"))
    s = far.unionByName(same_i).unionByName(same_j).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    ties = lambda c: counts.groupBy(c).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    n = counts.agg(F.sum("c").alias("n"))
    one = s.crossJoin(F.broadcast(ties("a"))).crossJoin(F.broadcast(ties("b"))).crossJoin(F.broadcast(n))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    return one.select((F.col("s") / F.sqrt((n0 - F.col("ta")) * (n0 - F.col("tb")))).alias("r"), "n")


def correlation_tests(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """correlations() with p-values and stars."""
    rows = []
    for r in correlations(df, columns, method).collect():
        n, c = r["n"], r["r"]
        if c is None or n < 3:
            p = math.nan
        elif method == "kendall":
            p = D.two_sided(c / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))))
        else:
            p = 0.0 if abs(c) >= 1 else D.two_sided(c * math.sqrt((n - 2) / (1 - c * c)), n - 2)
        stars = "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""
        rows.append((r["x"], r["y"], c, n, p, stars))
    return frame(df.sparkSession, rows, "x string, y string, r double, n long, p_value double, stars string")


def weighted_mean(df: DataFrame, column: str, weight: str) -> DataFrame:
    return df.agg((F.sum(number(column) * F.col(weight)) / F.sum(F.when(number(column).isNotNull(), F.col(weight)))).alias("weighted_mean"))


def weighted_std(df: DataFrame, column: str, weight: str) -> DataFrame:
    """The population form, about the weighted mean of a first pass."""
    m = weighted_mean(df, column, weight)
    both = df.select(number(column).alias("x"), F.col(weight).cast("double").alias("w")).crossJoin(F.broadcast(m))
    return both.agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("x") - F.col("weighted_mean"), 2)) / F.sum(F.when(F.col("x").isNotNull(), F.col("w")))).alias("weighted_std"))


def selection_stats(df: DataFrame, column: str) -> DataFrame:
    c = number(column)
    return df.agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def group_means(df: DataFrame, value: str, *factors: str) -> DataFrame:
    return complete(df, {"__v": value}, factors).groupBy(*factors).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"))


def cell_means(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Means of both factors, their cells and all rows in one pass; grouping 0 cells, 1 by a, 2 by b, 3 all."""
    return complete(df, {"__v": value}, (a, b)).cube(a, b).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.avg("__v").alias("mean"))


def histogram(df: DataFrame, column: str, bins: int | None = None, by: str | None = None) -> DataFrame:
    """(bin, low, high, n): equal bins between minimum and maximum, the number by Sturges' rule unless given."""
    own = complete(df, {"x": column}, [F.col(by).alias("g")] if by else [])
    n, low, high = own.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    k = bins or int(math.ceil(math.log2(n) + 1))
    width = (high - low) / k or 1.0
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(k - 1)).cast("int")
    out = own.groupBy(*(["g"] if by else []), at.alias("bin")).agg(F.count("*").alias("n"))
    return out.select(*([F.col("g").alias(by)] if by else []), "bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers' limits and extremes per group."""
    q = complete(df, {"x": value}, [by]).groupBy(by).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("x").alias("min"), F.max("x").alias("max"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(by, "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", (F.col("q")[0] - 1.5 * iqr).alias("low_fence"), (F.col("q")[2] + 1.5 * iqr).alias("high_fence"))


def density(df: DataFrame, column: str, points: int = 64, bins: int = 512) -> DataFrame:
    """(x, density): a normal-kernel estimate with Scott's bandwidth, from a fine histogram."""
    own = complete(df, {"x": column})
    n, sd = own.agg(F.count("*"), F.stddev_samp("x")).first()
    rows = histogram(own, "x", bins).collect()
    h = (sd or 1.0) * n ** (-0.2)
    centre, weight = np.array([(r["low"] + r["high"]) / 2 for r in rows]), np.array([r["n"] for r in rows], float)
    at = np.linspace(centre.min() - 3 * h, centre.max() + 3 * h, points)
    out = (weight * np.exp(-0.5 * ((at[:, None] - centre) / h) ** 2)).sum(1) / (n * h * math.sqrt(2 * math.pi))
    return frame(df.sparkSession, list(zip(at, out)), "x double, density double")


def empirical_quantile(df: DataFrame, column: str, tau: float) -> DataFrame:
    """The value at place floor(tau (n - 1)) in order, from counts of distinct values."""
    own = complete(df, {"x": column})
    place = math.floor(tau * (own.count() - 1))
    from ..plans.ranks import running_counts

    r = running_counts(own, "x", ("c", F.count(F.lit(1))))
    return r.where((F.col("c_before") <= place) & (place < F.col("c_before") + F.col("c"))).select(F.col("x").alias("quantile"))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, and the second to fourth moments about it."""
    c = number(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("m2"), (F.skewness(c) * F.pow(F.var_pop(c), 1.5)).alias("m3"), ((F.kurtosis(c) + 3) * F.pow(F.var_pop(c), 2)).alias("m4"))


def ranks(df: DataFrame, column: str) -> DataFrame:
    return value_ranks(complete(df, {column: column}), column)
