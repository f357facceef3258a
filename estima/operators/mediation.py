"""Path models and mediation: one Gram over the union of variables serves every equation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.result import frame
from ..plans.gram import complete, gram
from .linear import from_gram
from .prep import parse_formula


def path_analysis(df: DataFrame, formulas: Sequence[str]) -> DataFrame:
    """(equation, term, estimate, std_error, ...) of least-squares equations over the rows complete in all."""
    parsed = [parse_formula(f) for f in formulas]
    names = list(dict.fromkeys(v for y, x, _, _ in parsed for v in [y, *x]))
    g = gram(complete(df, {c: c for c in names}), names)
    out = None
    for y, x, _, intercept in parsed:
        one = from_gram(g, y, x, intercept).table(df.sparkSession).select(F.lit(y).alias("equation"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _effects(g, y: str, x: str, m: str, covariates: Sequence[str]) -> dict[str, float]:
    first, second, total = from_gram(g, m, [x, *covariates]), from_gram(g, y, [x, m, *covariates]), from_gram(g, y, [x, *covariates])
    a, b = float(first.beta[1]), float(second.beta[2])
    return {"a": a, "b": b, "c": float(total.beta[1]), "c_prime": float(second.beta[1]), "indirect": a * b, "proportion": a * b / float(total.beta[1]) if total.beta[1] else math.nan, "se_a": float(first.se[1]), "se_b": float(second.se[2])}


def poisson_weight(key, rep, seed: int):
    """The count a row has in a bootstrap repetition: Poisson(1), from a hash of its key and the repetition alone."""
    u = (F.pmod(F.xxhash64(key, rep, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)).cast("double")
    out, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        total += p / math.factorial(k)
        out = out + (u >= total).cast("int")
    return out


def mediation(df: DataFrame, y: str, x: str, m: str, key: str, covariates: Sequence[str] = (), reps: int = 0, seed: int = 1) -> DataFrame:
    """(effect, estimate, ci_lower, ci_upper, p_value) of a, b, c, c_prime, indirect, proportion. reps > 0 weights rows by
    hashed Poisson counts, all repetitions in one aggregate; else Sobel's test for the indirect effect."""
    names = [y, x, m, *covariates]
    own = complete(df, {c: c for c in names}, [F.col(key).alias("__k")])
    e = _effects(gram(own.drop("__k"), names), y, x, m, covariates)
    keep = ("a", "b", "c", "c_prime", "indirect", "proportion")
    if not reps:
        se = math.sqrt(e["a"] ** 2 * e["se_b"] ** 2 + e["b"] ** 2 * e["se_a"] ** 2)
        z = D.norm_ppf(0.975)
        rows = [(k, e[k], e[k] - z * se if k == "indirect" else None, e[k] + z * se if k == "indirect" else None, D.two_sided(e[k] / se) if k == "indirect" else None) for k in keep]
        return frame(df.sparkSession, rows, "effect string, estimate double, ci_lower double, ci_upper double, p_value double")
    from ..plans.gram import grouped

    wide = own.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    wide = wide.withColumn("__w", poisson_weight(F.col("__k"), F.col("__rep"), seed).cast("double")).where("__w > 0")
    draws = [_effects(g, y, x, m, covariates) for g in grouped(wide, names, "__rep", "__w").values()]
    rows = []
    for k in keep:
        v = np.array([d[k] for d in draws])
        share = float((v > 0).mean())
        rows.append((k, e[k], *np.percentile(v, (2.5, 97.5)).tolist(), min(1.0, 2 * min(share, 1 - share))))
    return frame(df.sparkSession, rows, "effect string, estimate double, ci_lower double, ci_upper double, p_value double")


