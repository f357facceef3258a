"""Cross-product matrices of columns: the one aggregate that most estimators need.

Up to MAX_EXPRESSIONS columns it is a single codegen'd aggregate with map-side partial sums; beyond that each task
multiplies its Arrow batches with numpy and only the p x p partial sums are added. Nothing row-sized reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXPRESSIONS = 40


class Gram:
    """n rows, their total weight w, and of the named columns the weighted means and centred cross-products."""

    def __init__(self, names: Sequence[str], n: int, w: float, mean: np.ndarray, centred: np.ndarray, w2: float | None = None):
        self.names, self.n, self.w, self.mean, self.centred = list(names), int(n), float(w), mean, centred
        self.w2 = w if w2 is None else w2

    def at(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.names.index(x) for x in names], int)

    def raw(self, a: Sequence[str], b: Sequence[str] | None = None) -> np.ndarray:
        """The sums of products a'b; the name 1 is the constant."""
        b = a if b is None else b
        mean = lambda x: 1.0 if x == "1" else self.mean[self.names.index(x)]
        out = np.array([[self.w * mean(x) * mean(y) for y in b] for x in a])
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x != "1" and y != "1":
                    out[i, j] += self.centred[self.names.index(x), self.names.index(y)]
        return out

    def cov(self, names: Sequence[str] | None = None, ddof: int = 1) -> np.ndarray:
        i = self.at(names or self.names)
        return self.centred[np.ix_(i, i)] / (self.w - ddof)

    def corr(self, names: Sequence[str] | None = None) -> np.ndarray:
        c = self.cov(names, 0)
        s = np.sqrt(np.diag(c))
        return c / np.outer(s, s)

    def __sub__(self, other: Gram) -> Gram:
        """What is left of the rows when those of other are taken out."""
        return _combine(self, other, -1)

    def __add__(self, other: Gram) -> Gram:
        return _combine(self, other, 1)


def _combine(a: Gram, b: Gram, sign: int) -> Gram:
    w = a.w + sign * b.w
    if w <= 0:
        return Gram(a.names, a.n + sign * b.n, 0.0, np.zeros_like(a.mean), np.zeros_like(a.centred), 0.0)
    if sign > 0:
        d = b.mean - a.mean
        return Gram(a.names, a.n + b.n, w, a.mean + d * b.w / w, a.centred + b.centred + np.outer(d, d) * a.w * b.w / w, a.w2 + b.w2)
    mean = (a.w * a.mean - b.w * b.mean) / w
    d = b.mean - mean
    return Gram(a.names, a.n - b.n, w, mean, a.centred - b.centred - np.outer(d, d) * w * b.w / a.w, a.w2 - b.w2)


def number(column: str | Column) -> Column:
    """A column as double, with NaN taken as null."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def complete(df: DataFrame, columns: dict[str, str | Column], keep: Sequence[str | Column] = ()) -> DataFrame:
    """The named columns as doubles, rows with a null or NaN in any of them left out, beside those to keep."""
    return df.select(*[number(c).alias(n) for n, c in columns.items()], *keep).dropna(subset=list(columns))


def _shift(df: DataFrame, names: Sequence[str]) -> list[float]:
    """A point near the data, from a few of its rows: sums about it don't cancel. Results don't depend on it."""
    rows = df.select(*[F.col(f"`{n}`") for n in names]).take(64)
    return [float(np.mean([r[i] for r in rows if r[i] is not None] or [0.0])) for i in range(len(names))]


def gram(df: DataFrame, names: Sequence[str], weight: str | None = None) -> Gram:
    """Of the columns names (doubles without nulls, see complete()) and, if given, a column of weights."""
    return next(iter(grouped(df, names, None, weight).values()), Gram(names, 0, 0.0, np.zeros(len(names)), np.zeros((len(names),) * 2)))


def grouped(df: DataFrame, names: Sequence[str], by: str | None, weight: str | None = None) -> dict[object, Gram]:
    """A Gram for each value of the column by, of which there must be few: they come to the driver."""
    names = list(names)
    p = len(names)
    shift = _shift(df, names)
    if p > MAX_EXPRESSIONS:
        return _by_arrow(df, names, by, weight, shift)
    x = [F.col(f"`{n}`") - F.lit(c) for n, c in zip(names, shift)]
    w = F.col(f"`{weight}`").cast("double") if weight else None
    times = (lambda e: e * w) if weight else (lambda e: e)
    sums = [F.count(F.lit(1)).alias("n"), (F.sum(w) if weight else F.count(F.lit(1)).cast("double")).alias("w"), (F.sum(w * w) if weight else F.count(F.lit(1)).cast("double")).alias("w2")]
    sums += [F.sum(times(a)).alias(f"s{i}") for i, a in enumerate(x)]
    sums += [F.sum(times(x[i] * x[j])).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for row in (df.groupBy(F.col(f"`{by}`").alias("k")) if by else df.groupBy()).agg(*sums).collect():
        if not row["n"]:
            continue
        s = np.array([row[f"s{i}"] for i in range(p)], float)
        c = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                c[i, j] = c[j, i] = row[f"c{i}_{j}"]
        out[row["k"] if by else None] = _centre(names, row["n"], row["w"], row["w2"], s, c, shift)
    return out


def _centre(names: list[str], n: int, w: float, w2: float, s: np.ndarray, c: np.ndarray, shift: list[float]) -> Gram:
    if w == 0:
        return Gram(names, n, 0.0, np.array(shift), np.zeros_like(c), w2)
    return Gram(names, n, w, s / w + np.array(shift), c - np.outer(s, s) / w, w2)


def _by_arrow(df: DataFrame, names: list[str], by: str | None, weight: str | None, shift: list[float]) -> dict[object, Gram]:
    p, around = len(names), np.array(shift)
    kind = dict(df.dtypes)[by] if by else "int"
    source = df.select((F.col(f"`{by}`") if by else F.lit(0)).alias("k"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"), *[F.col(f"`{n}`") for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(p)]) - around
            for key in {*keys.tolist()}:
                own = np.array([k == key or (k is None and key is None) for k in keys])
                a = np.column_stack([np.ones(own.sum()), x[own]])
                aw = a * w[own, None]
                part = np.concatenate([[own.sum(), (w[own] ** 2).sum()], (aw.T @ a).ravel()])
                held[key] = held.get(key, 0) + part
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]).cast(kinds), pa.array([part], pa.list_(pa.float64()))], names=["k", "part"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(source.schema["k"].dataType)
    parts = source.mapInArrow(run, f"k {kind}, part array<double>").select("k", F.posexplode("part").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    found: dict[object, np.ndarray] = {}
    for row in parts.collect():
        found.setdefault(row["k"], np.zeros(2 + (p + 1) ** 2))[row["i"]] = row["v"]
    out = {}
    for key, part in found.items():
        m = part[2:].reshape(p + 1, p + 1)
        out[key if by else None] = _centre(names, int(part[0]), m[0, 0], part[1], m[0, 1:], m[1:, 1:], shift)
    return out
