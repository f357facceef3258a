"""Global order without one task for all rows: average ranks and running sums over the distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many distinct values a plain window over them is the cheaper plan.
FEW_VALUES = 200_000


def running_counts(df: DataFrame, value: str, *measures: tuple[str, Column], few: int = FEW_VALUES) -> DataFrame:
    """A row per distinct value: the value, then for each measure (name, aggregate) its sum over the value's rows
    as name and over the rows of smaller values as name_before.

    Rows are first aggregated by value. Beyond few values these sums are spread by range of the value; the
    totals of the ranges, one row each, give each range its start, and windows run within ranges only.
    """
    sums = df.groupBy(value).agg(*[m.alias(n) for n, m in measures])
    names = [n for n, _ in measures]
    before = lambda w, n: F.coalesce(F.sum(n).over(w), F.lit(0))
    if sums.limit(few + 1).count() <= few:
        w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumns({f"{n}_before": before(w, n) for n in names})
    parts = sums.repartitionByRange(value).withColumn("__part", F.spark_partition_id())
    totals = parts.groupBy("__part").agg(*[F.sum(n).alias(n) for n in names])
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[before(over, n).alias(f"__{n}") for n in names])
    own = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(starts), "__part")
    return out.withColumns({f"{n}_before": F.col(f"__{n}") + before(own, n) for n in names}).select(value, *names, *[f"{n}_before" for n in names])


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, ties, rank): how many rows hold each value, and their average rank from 1."""
    out = running_counts(df, value, ("ties", F.count(F.lit(1))))
    return out.select(value, "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("rank"))


def with_ranks(df: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """df with the average rank of its column value."""
    return df.join(value_ranks(df, value).select(value, F.col("rank").alias(rank)), value)


def quantiles(df: DataFrame, columns: list[str], shares: list[float], few: int = 50_000) -> dict[str, list[float]]:
    """Exact quantiles, interpolated between neighbours, of columns of doubles (nulls left out; nan if all are).

    Rough quantiles bracket each place; one aggregate counts what lies below the brackets and within them, and
    brackets are narrowed until they hold few distinct values, which alone come to the driver. No task holds the
    values of a column."""
    n = dict(zip(columns, df.agg(*[F.count(f"`{c}`") for c in columns]).first()))
    places = {(c, p): p * (n[c] - 1) for c in columns for p in shares if n[c]}
    inside: dict[tuple[str, float], Column] = {k: F.col(f"`{k[0]}`").isNotNull() for k in places}
    below, held = dict.fromkeys(places, 0), {k: n[k[0]] for k in places}
    out: dict[tuple[str, float], float] = {}
    while len(out) < len(places):
        todo = [k for k in places if k not in out]
        sums = []
        for c, p in todo:
            own, m = inside[c, p], held[c, p]
            at, slack = (places[c, p] - below[c, p]) / max(1, m - 1), 2e-3 + 2 / max(1, m)
            sums.append(F.percentile_approx(F.when(own, F.col(f"`{c}`")), [max(0.0, at - slack), min(1.0, at + slack)], 5000))
        ends = dict(zip(todo, df.agg(*sums).first()))
        counts = []
        for k in todo:
            x, (low, high) = F.col(f"`{k[0]}`"), ends[k]
            # One value to each side, so that a place between two values has both.
            counts += [F.count_if(inside[k] & (x < low)), F.count_if(inside[k] & (x >= low) & (x <= high)), F.min(F.when(inside[k] & (x > high), x)), F.max(F.when(inside[k] & (x < low), x))]
        got = df.agg(*counts).first()
        ready = []
        for i, k in enumerate(todo):
            under, within, above, before = got[4 * i : 4 * i + 4]
            low, high = ends[k]
            start = below[k] + under
            first, last = math.floor(places[k]), math.ceil(places[k])
            if not start <= first or not last < start + within:  # the rough ends were too near: take a neighbour in
                low, high = (before if first < start and before is not None else low), (above if last >= start + within and above is not None else high)
            x = F.col(f"`{k[0]}`")
            more = df.where(inside[k] & (x < low)).count() if low != ends[k][0] else under
            below[k] += more
            inside[k] = (x >= low) & (x <= high)
            new = df.where(inside[k]).count() if (low, high) != tuple(ends[k]) else within
            done = new <= few or new >= held[k]
            held[k] = new
            if done:
                ready.append(k)
        for c, p in ready:
            rows = df.where(inside[c, p]).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("k")).orderBy("v").collect()
            at, total, pick = places[c, p], below[c, p], {}
            for r in rows:
                for place in (math.floor(at), math.ceil(at)):
                    if total <= place < total + r["k"]:
                        pick[place] = r["v"]
                total += r["k"]
            a, b = pick[math.floor(at)], pick[math.ceil(at)]
            out[c, p] = a + (b - a) * (at - math.floor(at))
    return {c: [out.get((c, p), math.nan) for p in shares] for c in columns}
