"""Survival: the risk table is one aggregate by time; curves and tests run over it, never over rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import TEST, coefficients, frame, test_row
from ..plans.gram import complete
from ..plans.ranks import running_counts
from .linear import _inverse


def risk_table(df: DataFrame, time: str, event: str) -> DataFrame:
    """(time, n_risk, n_event, n_censor) at every distinct time."""
    own = complete(df, {"time": time, "event": event})
    r = running_counts(own, "time", ("n", F.count(F.lit(1))), ("n_event", F.sum("event").cast("long")))
    total = own.count()
    return r.select("time", (F.lit(total) - F.col("n_before")).alias("n_risk"), "n_event", (F.col("n") - F.col("n_event")).alias("n_censor"))


def kaplan_meier(df: DataFrame, time: str, event: str, level: float = 0.95) -> DataFrame:
    """(time, n_risk, n_event, survival, ci_lower, ci_upper): the product over times is a running sum of logarithms over
    the risk table; Greenwood's plain interval, clipped to 0 and 1."""
    z = D.norm_ppf(0.5 + level / 2)
    r = risk_table(df, time, event)
    w = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = 1 - F.col("n_event") / F.col("n_risk")
    gone = F.max((left <= 0).cast("int")).over(w) == 1
    s = F.when(gone, 0.0).otherwise(F.exp(F.sum(F.when(left > 0, F.log(left))).over(w)))
    g = F.sum(F.when(left > 0, F.col("n_event") / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event"))))).over(w)
    se = s * F.sqrt(g)
    return r.withColumn("survival", s).withColumns({"ci_lower": F.greatest(F.lit(0.0), F.col("survival") - z * se), "ci_upper": F.least(F.lit(1.0), F.col("survival") + z * se)}).select("time", "n_risk", "n_event", "survival", "ci_lower", "ci_upper")


def median_survival(curve: DataFrame) -> float:
    m = curve.where("survival <= 0.5").agg(F.min("time")).first()[0]
    return math.inf if m is None else m


def log_rank_statistics(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Observed and expected events of the larger of two group labels, the hypergeometric variance, and chi-square."""
    own = complete(df, {"time": time, "event": event}, [F.col(group).alias("g")]).where("g IS NOT NULL")
    top = own.agg(F.max("g").alias("top"))
    own = own.crossJoin(F.broadcast(top)).withColumn("a", (F.col("g") == F.col("top")).cast("int"))
    r = running_counts(own, "time", ("n", F.count(F.lit(1))), ("d", F.sum("event")), ("na", F.sum("a").cast("long")), ("da", F.sum(F.col("a") * F.col("event"))))
    totals = own.agg(F.count("*").alias("total"), F.sum("a").alias("total_a"))
    r = r.crossJoin(F.broadcast(totals)).select("d", "da", (F.col("total") - F.col("n_before")).alias("n"), (F.col("total_a") - F.col("na_before")).alias("na"))
    share = F.col("na") / F.col("n")
    v = F.when(F.col("n") > 1, F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = r.agg(F.sum("da").alias("observed"), F.sum(F.col("d") * share).alias("expected"), F.sum(v).alias("variance"))
    return s.withColumn("statistic", F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    r = log_rank_statistics(df, time, event, group).first()
    return frame(df.sparkSession, [test_row("log-rank", r["statistic"], D.chi2_sf(r["statistic"], 1), 1, df.count())], TEST)


def cox(df: DataFrame, time: str, event: str, x: Sequence[str], rounds: int = 25, tol: float = 1e-9) -> tuple[DataFrame, dict[str, float]]:
    """Proportional hazards with Breslow's ties by Newton's method. A round sums exp(xb), x exp(xb) and x x' exp(xb) by
    time, accumulates them from the last time back over the aggregated times, and adds the events' terms."""
    names = list(x)
    own = complete(df, {"__t": time, "__e": event, **{c: c for c in names}})
    m = own.agg(*[F.avg(f"`{c}`") for c in names], *[F.stddev_samp(f"`{c}`") for c in names]).first()
    mean, sd = np.array(m[: len(names)]), np.array([s or 1.0 for s in m[len(names) :]])
    own = own.select((-F.col("__t")).alias("__back"), "__e", *[((F.col(f"`{c}`") - float(a)) / float(b)).alias(f"x{i}") for i, (c, a, b) in enumerate(zip(names, mean, sd))])
    k = len(names)
    cols = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def once(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))
        w: Column = F.exp(eta)
        sums = [("s0", F.sum(w)), *[(f"s{i}", F.sum(w * c)) for i, c in enumerate(cols, 1)], *[(f"q{i}_{j}", F.sum(w * cols[i] * cols[j])) for i, j in pairs]]
        sums += [("d", F.sum("__e")), ("de", F.sum(F.col("__e") * eta)), *[(f"dx{i}", F.sum(F.col("__e") * c)) for i, c in enumerate(cols)]]
        r = running_counts(own, "__back", *sums)
        at = lambda n: F.col(n) + F.col(f"{n}_before")
        s0, s1 = at("s0"), [at(f"s{i}") for i in range(1, k + 1)]
        parts = [F.sum(F.col("de") - F.when(F.col("d") > 0, F.col("d") * F.log(s0)).otherwise(0.0)).alias("l")]
        parts += [F.sum(F.col(f"dx{i}") - F.col("d") * s1[i] / s0).alias(f"g{i}") for i in range(k)]
        parts += [F.sum(F.col("d") * (at(f"q{i}_{j}") / s0 - s1[i] * s1[j] / (s0 * s0))).alias(f"h{i}_{j}") for i, j in pairs]
        row = r.agg(*parts).first()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return row["l"], np.array([row[f"g{i}"] for i in range(k)]), h

    beta = np.zeros(k)
    ll, g, h = once(beta)
    null = ll
    for step in range(1, rounds + 1):
        move = np.linalg.lstsq(h, g, rcond=None)[0]
        while True:
            new = once(beta + move)
            if new[0] >= ll - 1e-9 * (abs(ll) + 1) or np.abs(move).max() < 1e-10:
                break
            move = move / 2
        beta = beta + move
        ll, g, h = new
        if np.abs(move).max() < tol * (1 + np.abs(beta).max()):
            break
    se = np.sqrt(np.diag(_inverse(h))) / sd
    n, d = own.agg(F.count("*"), F.sum("__e")).first()
    lr = 2 * (ll - null)
    return coefficients(df.sparkSession, names, beta / sd, se), {"n": n, "events": d, "loglik": ll, "null_loglik": null, "lr_stat": lr, "lr_p_value": D.chi2_sf(lr, k), "rounds": step}
