"""Bootstrap and jackknife."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import frame
from ..plans.gram import number
from ..plans.storage import written
from .mediation import poisson_weight

SUMMARY = "estimate double, bias double, std_error double, ci_lower double, ci_upper double, n_reps long"


def bootstrap_mean(df: DataFrame, column: str, key: str, reps: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Mean by Poisson weights of hashed keys: all repetitions in one aggregate, for data of any size. A row isn't
    exploded: each repetition is an aggregate expression of its own."""
    c = number(column)
    own = df.select(c.alias("x"), F.col(key).alias("k")).where("x IS NOT NULL")
    sums = [F.avg("x").alias("m")]
    for rep in range(reps):
        w = poisson_weight(F.col("k"), F.lit(rep), seed)
        sums.append((F.sum(w * F.col("x")) / F.sum(w)).alias(f"r{rep}"))
    row = own.agg(*sums).first()
    return _summary(df, row["m"], np.array([row[f"r{i}"] for i in range(reps)]), level)


def _summary(df: DataFrame, estimate: float, draws: np.ndarray, level: float) -> DataFrame:
    low, high = np.percentile(draws, (100 * (1 - level) / 2, 100 * (1 + level) / 2))
    return frame(df.sparkSession, [(estimate, float(draws.mean() - estimate), float(draws.std(ddof=1)), float(low), float(high), len(draws))], SUMMARY)


def replicates(df: DataFrame, columns: list[str], statistic: Callable[[np.ndarray], float], reps: int, seed: int = 1, block: int | None = None, order: str | None = None, most: int = 32_000_000) -> tuple[float, DataFrame]:
    """(the statistic of all rows, (rep, value)): any function of a matrix. A matrix of up to most numbers (256 MB)
    goes to every task and repetitions are dealt over tasks; beyond, each repetition's rows are joined by their places (see
    _joined), as only one of them need fit a task. block: moving blocks of rows in the order's sequence."""
    rows = df.select(*([F.col(order).alias("__o")] if order else []), *[number(c).alias(c) for c in columns]).dropna()
    data = rows.limit(most // len(columns) + 1).toArrow()
    n = data.num_rows
    if n * len(columns) > most:
        return _joined(rows, columns, statistic, reps, seed, block, bool(order))
    x = np.empty((n, len(columns)))
    at = data.column("__o").to_pandas().sort_values().index.to_numpy() if order else slice(None)
    for i in range(len(columns)):
        x[:, i] = data.column(i + (1 if order else 0)).to_numpy()[at]
    del data

    def run(frames):
        for f in frames:
            out = []
            for rep in f["id"]:
                random = np.random.RandomState((seed * 1_000_003 + int(rep)) % 2**32)
                if block:
                    starts = random.randint(0, n - block + 1, -(-n // block))
                    i = (starts[:, None] + np.arange(block)).ravel()[:n]
                else:
                    i = random.randint(0, n, n)
                out.append(float(statistic(x[i])))
            yield pd.DataFrame({"rep": f["id"], "value": out})

    return float(statistic(x)), df.sparkSession.range(reps).repartition(min(reps, 64)).mapInPandas(run, "rep long, value double")


def _joined(rows: DataFrame, columns: list[str], statistic: Callable[[np.ndarray], float], reps: int, seed: int, block: int | None, ordered: bool) -> tuple[float, DataFrame]:
    """As replicates, without rows on the driver: hashes draw the places of each repetition, which meet the rows there.
    Moves reps times the rows."""
    own = written((rows.orderBy("__o") if ordered else rows).select(F.monotonically_increasing_id().alias("m"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]))
    part = F.shiftright("m", 33)
    sizes = sorted(own.groupBy(part.alias("p")).count().collect())
    starts, n = [], 0
    for p, size in sizes:
        starts.append((p, n))
        n += size
    start = frame(own.sparkSession, starts, "p long, start long")
    own = own.withColumn("p", part).join(F.broadcast(start), "p").select((F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), *[f"x{i}" for i in range(len(columns))])
    own = written(own)
    names = [f"x{i}" for i in range(len(columns))]

    def value(rep: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rep": [rep[0]], "value": [float(statistic(f.sort_values("k")[names].to_numpy(float)))]})

    draw = lambda k, of: F.pmod(F.xxhash64("rep", k, F.lit(seed)), F.lit(of))
    k = F.col("k")
    at = draw(F.floor(k / block), n - block + 1) + k % block if block else draw(k, n)
    places = own.sparkSession.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1)).cast("array<bigint>")).alias("rep")).select("rep", "k", at.alias("at"))
    point = own.select(F.lit(-1).cast("long").alias("rep"), F.col("at").alias("k"), *names).groupBy("rep").applyInPandas(value, "rep long, value double").first()["value"]
    return point, places.join(own, "at").select("rep", "k", *names).groupBy("rep").applyInPandas(value, "rep long, value double")


def bootstrap(df: DataFrame, columns: list[str], statistic: Callable[[np.ndarray], float], reps: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    point, draws = replicates(df, columns, statistic, reps, seed)
    return _summary(df, point, draws.toPandas()["value"].to_numpy(), level)


def block_bootstrap(df: DataFrame, columns: list[str], statistic: Callable[[np.ndarray], float], block: int, order: str, reps: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    point, draws = replicates(df, columns, statistic, reps, seed, block, order)
    return _summary(df, point, draws.toPandas()["value"].to_numpy(), level)


def jackknife_mean_variance(df: DataFrame, column: str) -> DataFrame:
    """(statistic, estimate, bias, std_error, corrected) of the mean and the population variance: each leave-one-out value
    follows from the totals and the row, so two aggregates do."""
    own = df.select(number(column).alias("x")).where("x IS NOT NULL")
    n, m, v = own.agg(F.count("*"), F.avg("x"), F.var_pop("x")).first()
    d = F.col("x") - m
    out_mean = F.lit(m) - d / (n - 1)
    out_var = (F.lit(n * v) - d * d * (n / (n - 1))) / (n - 1)
    r = own.agg(F.avg(out_mean).alias("a"), F.var_pop(out_mean).alias("b"), F.avg(out_var).alias("c"), F.var_pop(out_var).alias("d")).first()
    rows = []
    for name, point, mean, var in (("mean", m, r["a"], r["b"]), ("variance", v, r["c"], r["d"])):
        bias = (n - 1) * (mean - point)
        rows.append((name, point, bias, math.sqrt((n - 1) * var), point - bias))
    return frame(df.sparkSession, rows, "statistic string, estimate double, bias double, std_error double, corrected double")


def jackknife(x: np.ndarray, statistic: Callable[[np.ndarray], float]) -> dict[str, float]:
    """Of any statistic of a small matrix."""
    n, point = len(x), float(statistic(x))
    values = np.array([statistic(np.delete(x, i, 0)) for i in range(n)])
    return {"estimate": point, "bias": float((n - 1) * (values.mean() - point)), "std_error": float(math.sqrt((n - 1) / n * ((values - values.mean()) ** 2).sum())), "values": values}


def bca_interval(point: float, draws: np.ndarray, leave_one_out: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated."""
    draws, jack = np.asarray(draws, float), np.asarray(leave_one_out, float)
    share = min(max((draws < point).mean(), 0.5 / len(draws)), 1 - 0.5 / len(draws))
    z0, d = D.norm_ppf(float(share)), jack.mean() - jack
    a = float((d**3).sum() / (6 * max((d**2).sum(), 1e-300) ** 1.5))
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + D.norm_ppf(p)
        ends.append(float(np.percentile(draws, 100 * D.norm_cdf(z0 + z / (1 - a * z)))))
    return ends[0], ends[1]
