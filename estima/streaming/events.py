"""Structured Streaming: windowed aggregates with watermarks, cross-products merged batch by batch, and state per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.gram import Gram, complete, gram


def windowed(events: DataFrame, time: str, value: str, keys: Sequence[str] = (), width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """count, sum, mean and sd per window and key; rows later than late behind the newest are dropped. Works on streams and
    tables alike."""
    t = F.col(time).cast("timestamp")
    own = events.withColumn("__t", t).withWatermark("__t", late)
    w = F.window("__t", width, slide) if slide else F.window("__t", width)
    out = own.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean", "sd")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of rows no farther apart than gap."""
    own = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return own.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class RunningGram:
    """Cross-products of a stream: each batch's Gram is one aggregate, and Grams add up."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.total, self.batches = list(columns), None, {}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. A batch that is repeated after a failure replaces itself."""
        self.batches[batch_id] = gram(complete(batch, {c: c for c in self.columns}), self.columns)
        done = sorted(self.batches)
        # All but the newest are settled, so that what is held doesn't grow with the stream.
        for k in done[:-1]:
            g = self.batches.pop(k)
            self.total = g if self.total is None else self.total + g

    def gram(self) -> Gram:
        parts = list(self.batches.values())
        out = self.total
        for g in parts:
            out = g if out is None else out + g
        if out is None:
            raise ValueError("no batch yet")
        return out


def kalman(events: DataFrame, key: str, time: str, value: str, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """(key, time, level, variance) after each measurement of a random walk with noise, with the state (level, variance)
    kept per key. Rows of a batch are taken in the order of time."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("t")
        if state.exists:
            level, var = state.get
        else:
            level, var = float(rows["v"].iloc[0]), r
        out = []
        for t, v in zip(rows["t"], rows["v"]):
            var += q
            gain = var / (var + r)
            level += gain * (v - level)
            var *= 1 - gain
            out.append((name[0], t, level, var))
        state.update((level, var))
        yield pd.DataFrame(out, columns=["k", "t", "level", "variance"])

    kind = dict(events.dtypes)[key]
    own = events.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v")).dropna()
    return own.groupBy("k").applyInPandasWithState(step, f"k {kind}, t timestamp, level double, variance double", "level double, variance double", "append", GroupStateTimeout.NoTimeout).withColumnsRenamed({"k": key, "t": time})


def welford(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance) so far, after each batch, with n, mean and the sum of squares as state per key."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            x = f["v"].to_numpy()
            if len(x):
                d, k = x.mean() - mean, len(x)
                m2 += float(((x - x.mean()) ** 2).sum()) + d * d * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        state.update((n, float(mean), float(m2)))
        yield pd.DataFrame({"k": [name[0]], "n": [n], "mean": [mean], "variance": [m2 / (n - 1) if n > 1 else np.nan]})

    kind = dict(events.dtypes)[key]
    own = events.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).dropna()
    return own.groupBy("k").applyInPandasWithState(step, f"k {kind}, n long, mean double, variance double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("k", key)
