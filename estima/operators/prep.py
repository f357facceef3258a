"""Cleaning and reshaping: types, missing values, encodings, melt and pivot, what-if columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.gram import gram, number
from ..plans.ranks import quantiles

#: Distinct values that may become columns.
MAX_LEVELS = 1000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The listed columns (all by default) as far as they are numeric, as doubles."""
    own = set(numeric_columns(df))
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns or df.columns if c in own])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is neither null nor NaN."""
    c = F.col(column)
    wrong = c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c.isNull()
    return df.where(~wrong)


def change_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """numeric, string, datetime or category. What can't be read becomes null; nulls stay null."""
    c = F.col(f"`{column}`")
    if kind == "category":
        return df.withColumn(column, c.cast("string")).withMetadata(column, {"category": True})
    new = {"numeric": lambda: F.expr(f"try_cast(`{column}` AS double)"), "string": lambda: c.cast("string"), "datetime": lambda: F.expr(f"try_cast(`{column}` AS timestamp)")}
    if kind not in new:
        raise ValueError("kind must be numeric, string, datetime or category")
    return df.withColumn(column, new[kind]())


def convert(df: DataFrame, column: str, kind: str) -> DataFrame:
    """A cast to any type; raises when the rows are read if a value doesn't fit."""
    return df.withColumn(column, F.col(f"`{column}`").cast(kind))


def impute(df: DataFrame, column: str, strategy: str = "mean", fill_value=None) -> DataFrame:
    """Nulls and NaN replaced by the column's mean, median, smallest mode, or a constant. The statistic is one value."""
    if strategy == "constant":
        return df.withColumn(column, F.coalesce(_present(df, column), F.lit(fill_value)))
    own = _present(df, column)
    if strategy == "median":
        mid = quantiles(df.select(number(column).alias("x")), ["x"], [0.5])["x"][0]
        return df.withColumn(column, F.coalesce(own, F.lit(None if mid != mid else mid)))
    stat = {"mean": F.avg(own), "mode": F.mode(own, True)}
    if strategy not in stat:
        raise ValueError("strategy must be mean, median, mode or constant")
    one = df.agg(stat[strategy].alias("__fill"))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(own, F.col("__fill"))).drop("__fill")


def _present(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return F.nanvl(c, F.lit(None)) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def impute_chained(df: DataFrame, columns: Sequence[str], rounds: int = 5, ridge: float = 1e-6) -> DataFrame:
    """A single chained imputation: holes start at the mean; in each round every column with holes is regressed on
    the others and its holes take the prediction. A round costs one aggregate a column with holes. Imputed values
    are linear in the row's own known values, so that they stay expressions of one plan."""
    columns = list(columns)
    base = df.withColumns({f"__x_{c}": number(c) for c in columns})
    counts = base.agg(*[F.count_if(F.col(f"__x_{c}").isNull()).alias(c) for c in columns], *[F.avg(f"__x_{c}").alias(f"m_{c}") for c in columns]).first()
    holes = [c for c in columns if counts[c]]
    filled = {c: F.coalesce(F.col(f"__x_{c}"), F.lit(counts[f"m_{c}"])) for c in columns}
    fits: dict[str, dict[str, float]] = {}
    for _ in range(rounds):
        for c in holes:
            others = [o for o in columns if o != c]
            known = base.where(F.col(f"__x_{c}").isNotNull()).select(F.col(f"__x_{c}").alias(c), *[filled[o].alias(o) for o in others])
            g = gram(known, columns)
            a = g.centred[np.ix_(g.at(others), g.at(others))]
            b = np.linalg.solve(a + ridge * np.diag(np.diag(a) + 1e-12), g.centred[g.at(others), g.at([c])[0]])
            fits[c] = dict(zip(others, b.tolist())) | {"": float(g.mean[g.at([c])[0]] - g.mean[g.at(others)] @ b)}
        # Holes see one another's values of the round before: one substitution deep, the plan doesn't grow.
        start = {c: F.coalesce(F.col(f"__x_{c}"), F.lit(counts[f"m_{c}"])) for c in columns}
        filled = {c: F.coalesce(F.col(f"__x_{c}"), _linear(fits[c], start)) if c in fits else start[c] for c in columns}
    return base.withColumns(filled).drop(*[f"__x_{c}" for c in columns])


def _linear(fit: dict[str, float], columns: dict[str, Column]) -> Column:
    out = F.lit(fit[""])
    for name, b in fit.items():
        if name:
            out = out + F.lit(b) * columns[name]
    return out


def levels(df: DataFrame, column: str, most: int = MAX_LEVELS) -> list:
    """The sorted distinct values; an error if there are more than could be columns."""
    rows = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has over {most} distinct values")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A boolean column <column>_<value> for each value, beside the original; null is false in all."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(f"`{column}`") == F.lit(v), F.lit(False)) for v in levels(df, column)})


def label_encode(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Sorted values numbered from 0; null is -1. Codes come from the distinct values, not from a window over rows."""
    codes = df.select(F.col(f"`{column}`").alias("__v")).where("__v IS NOT NULL").distinct()
    codes = codes.withColumn("__code", F.row_number().over(Window.orderBy("__v")) - 1)
    out = df.join(codes, F.col(f"`{column}`") == F.col("__v"), "left").drop("__v")
    return out.withColumn(into or column, F.coalesce(F.col("__code"), F.lit(-1))).drop("__code")


def label_values(df: DataFrame, column: str, labels: dict, into: str) -> DataFrame:
    """The label of each code; codes without one as text."""
    mapping = F.create_map(*[F.lit(str(x)) for pair in labels.items() for x in pair])
    text = F.col(f"`{column}`").cast("string")
    return df.withColumn(into, F.coalesce(F.element_at(mapping, text), text))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "variable", "value")


def pivot(df: DataFrame, index: str, columns: str, values: str) -> DataFrame:
    """Long to wide; an error where an (index, column) pair has several rows."""
    if df.groupBy(index, columns).count().where("count > 1").limit(1).count():
        raise ValueError("pivot: an index and column pair occurs more than once")
    return df.groupBy(index).pivot(columns, levels(df, columns)).agg(F.first(values))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the sample standard deviation; the statistics are one row, which is broadcast."""
    stats = df.agg(*[f(number(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: (number(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}).drop(*stats.columns)


def with_row(df: DataFrame, values: dict) -> DataFrame:
    """One more row; columns that values doesn't name are null."""
    row = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema)
    return df.unionByName(row)


def without_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def set_cell(df: DataFrame, condition: Column, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(f"`{column}`")))


def override(df: DataFrame, changes: dict[str, object | Callable[[Column], Column]]) -> DataFrame:
    """A scenario: columns set to a constant or changed by a function of the column."""
    new = {}
    for name, change in changes.items():
        if name not in df.columns:
            raise ValueError(f"no column {name}")
        new[name] = change(F.col(f"`{name}`")) if callable(change) else F.lit(change)
    return df.withColumns(new)


def design(df: DataFrame, numeric: Sequence[str] = (), factors: Sequence[str] = (), interactions: Sequence[tuple[str, str]] = (), squares: Sequence[str] = ()) -> dict[str, Column]:
    """Terms of a design as expressions: numbers, dummies without the first level, products, squares. Nothing is
    materialised."""
    out: dict[str, Column] = {c: number(c) for c in numeric}
    for f in factors:
        for v in levels(df, f)[1:]:
            out[f"{f}_{v}"] = (F.col(f"`{f}`") == F.lit(v)).cast("double")
    out |= {f"{a}:{b}": number(a) * number(b) for a, b in interactions}
    out |= {f"{c}^2": number(c) * number(c) for c in squares}
    return out


def parse_formula(formula: str) -> tuple[str, list[str], list[tuple[str, str]], bool]:
    """(response, terms, interactions, intercept) of y ~ a + b + a:b, a * b, - 1."""
    left, sep, right = formula.partition("~")
    if not sep or not left.strip():
        raise ValueError("a formula is: response ~ term + term")
    terms, products, intercept = [], [], True
    for part in right.replace("-", "+-").split("+"):
        t = part.strip()
        if t in ("-1", "- 1", "0"):
            intercept = False
        elif "*" in t:
            a, b = (x.strip() for x in t.split("*"))
            terms += [x for x in (a, b) if x not in terms]
            products.append((a, b))
        elif ":" in t:
            products.append(tuple(x.strip() for x in t.split(":")))
        elif t and t != "1" and t not in terms:
            terms.append(t)
    return left.strip(), terms, products, intercept


def folds(df: DataFrame, k: int, order: str) -> DataFrame:
    """Contiguous folds 0 .. k-1 by an order key, from its quantiles: no task sees all rows."""
    cuts = quantiles(df.select(number(order).alias("o")), ["o"], [i / k for i in range(1, k)])["o"] if k > 1 else []
    fold = F.lit(0)
    for c in cuts:
        fold = fold + (F.col(order) > F.lit(c)).cast("int")
    return df.withColumn("fold", fold)


def split(df: DataFrame, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([share, 1 - share], seed)
    return train, test
