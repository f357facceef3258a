import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from estima.operators import linear
from estima.streaming import events as W


def stream(spark, tmp_path, rows: pd.DataFrame, parts: int):
    for i, at in enumerate(np.array_split(np.arange(len(rows)), parts)):
        rows.iloc[at].to_parquet(tmp_path / f"{i:03d}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(tmp_path / "000.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def rows(n: int = 60) -> pd.DataFrame:
    r = np.random.RandomState(1)
    return pd.DataFrame({"k": np.arange(n) % 3, "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 10, unit="min"), "x": r.randn(n), "v": 5 + r.randn(n)})


def run(query, name: str, mode: str, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_welford_and_kalman(spark, tmp_path):
    data = rows()
    (tmp_path / "a").mkdir()
    run(W.welford(stream(spark, tmp_path / "a", data, 4), "k", "v"), "w", "update", tmp_path / "ca")
    got = spark.table("w").groupBy("k").agg(F.max_by("mean", "n").alias("m"), F.max_by("variance", "n").alias("s"), F.max("n").alias("n")).toPandas().set_index("k")
    want = data.groupby("k")["v"].agg(["mean", "var", "count"])
    assert np.allclose(got["m"], want["mean"].loc[got.index]) and np.allclose(got["s"], want["var"].loc[got.index])
    (tmp_path / "b").mkdir()
    run(W.kalman(stream(spark, tmp_path / "b", data, 4), "k", "t", "v"), "kal", "append", tmp_path / "cb")
    assert spark.table("kal").count() == 60


def test_windows_drop_late_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    data = rows()
    late = data.iloc[:1].assign(t=pd.Timestamp("2023-12-01"))
    data = pd.concat([data, late]).reset_index(drop=True)
    out = W.windowed(stream(spark, tmp_path / "a", data, 61), "t", "v", ["k"], "1 hour", late="10 minutes")
    run(out, "win", "append", tmp_path / "ca")
    got = spark.table("win").toPandas()
    assert got["start"].min() >= pd.Timestamp("2024-01-01") and got["n"].sum() > 0


def test_running_gram(spark, tmp_path):
    (tmp_path / "a").mkdir()
    data = rows()
    g = W.RunningGram(["x", "v"])
    q = stream(spark, tmp_path / "a", data, 3).writeStream.foreachBatch(g).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    fit = linear.from_gram(g.gram(), "v", ["x"])
    assert np.allclose(fit.beta[::-1], np.polyfit(data["x"], data["v"], 1))
