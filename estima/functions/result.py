"""Results: one tidy DataFrame per operator."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import distributions as D

COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double, ci_lower double, ci_upper double"
TEST = "test string, statistic double, p_value double, df double, n long, effect_size double, ci_lower double, ci_upper double"


def plain(x):
    """numpy numbers as Python's; NaN as null."""
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and math.isnan(x) else x


def frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(plain(x) for x in row) for row in rows], schema)


def coefficients(spark: SparkSession, terms: Sequence[str], estimate, se, df: float = math.inf, level: float = 0.95) -> DataFrame:
    """Estimates with t (or, for infinite df, normal) statistics, p-values and intervals."""
    q = D.t_ppf(0.5 + level / 2, df) if not math.isinf(df) else D.norm_ppf(0.5 + level / 2)
    rows = []
    for term, b, s in zip(terms, np.asarray(estimate, float), np.asarray(se, float)):
        z = b / s if s > 0 else math.nan
        rows.append((term, b, s, z, D.two_sided(z, df), b - q * s, b + q * s))
    return frame(spark, rows, COEFFICIENTS)


def test_row(test: str, statistic: float, p: float, df: float = math.nan, n: int = 0, effect: float = math.nan, low: float = math.nan, high: float = math.nan) -> tuple:
    return (test, float(statistic), float(p), float(df), int(n), float(effect), float(low), float(high))


def metrics(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """(metric, value) rows."""
    return frame(spark, [(k, float(v)) for k, v in values.items()], "metric string, value double")
