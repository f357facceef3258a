"""Operators beyond the sizes at which they once failed, against plain ways that few rows allow."""

import numpy as np
from pyspark.sql import functions as F
from test_recovery import frame

from estima.operators import hypothesis, joins, resampling, spatial, timeseries


def places(spark, n, seed=3):
    """Points on a few lines, some of them in one place, one without a coordinate and one far from all."""
    r = np.random.RandomState(seed)
    x, y = np.round(r.rand(n) * 100, 1), r.randint(0, 5, n) * 8.0
    x[1], y[1], x[2] = x[0], y[0], 1e6
    p = frame(spark, i=np.arange(n) * 3, x=x, y=y).withColumn("x", F.when(F.col("i") != 9, F.col("x")))
    return p, p.select("i", F.least(F.coalesce("x", F.lit(0.0)), F.lit(99.0)).alias("a"), (F.sin("i") + F.least(F.coalesce("x", F.lit(0.0)), F.lit(99.0)) / 50).alias("v"))


def dense(w, n):
    m = np.zeros((n, n))
    for r in w.collect():
        m[r["i"] // 3, r["j"] // 3] = r["w"]
    return m


def test_implicit_weights_like_their_table(spark, monkeypatch):
    p, rows = places(spark, 150)
    monkeypatch.setattr(spatial, "BLOCK", 16)
    for power, standardise in ((1.0, True), (2.0, False)):
        w = joins.distance_weights(p, "i", ["x", "y"], 20.0, power, standardise)
        own = spatial.DistanceWeights(p, "i", ["x", "y"], 20.0, power, standardise)
        for few in (2500, 0):
            monkeypatch.setattr(spatial, "DENSE_ROWS", few)
            some = rows.where("i % 2 = 0")
            a, b = (spatial.lag(some, k, ["v"]).select("i", "w_v").toPandas().sort_values("i").to_numpy() for k in (w, own))
            assert np.allclose(a, b)
    monkeypatch.setattr(spatial, "DENSE_ROWS", 2500)
    w, own = joins.distance_weights(p, "i", ["x", "y"], 20.0), spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)
    a, b = (spatial.sar(rows, "v", ["a"], k)[0].toPandas() for k in (w, own))
    assert np.allclose(a["estimate"], b["estimate"], atol=1e-5) and np.allclose(a["std_error"], b["std_error"], rtol=1e-4)


def test_log_determinant_of_many_places(spark, monkeypatch):
    p, _ = places(spark, 600, 4)
    own = spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)
    ids = [r[0] for r in p.where("i % 5 > 0").select("i").collect()]
    exact = own.log_determinant(ids)
    monkeypatch.setattr(spatial, "DENSE_ROWS", 0)
    monkeypatch.setattr(spatial, "BLOCK", 128)
    rough = spatial.DistanceWeights(p, "i", ["x", "y"], 20.0).log_determinant(ids)
    for rho in (-0.9, -0.3, 0.4, 0.9, 0.99):
        assert abs(exact(rho) - rough(rho)) < 0.05 * abs(exact(rho))


def test_error_model_by_implicit_weights(spark):
    p, rows = places(spark, 150)
    a, b = (spatial.sem(rows, "v", ["a"], k)[0].toPandas() for k in (joins.distance_weights(p, "i", ["x", "y"], 20.0), spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)))
    assert np.allclose(a["estimate"], b["estimate"], atol=1e-5) and np.allclose(a["std_error"], b["std_error"], rtol=1e-4)


def test_durbin_model_by_implicit_weights(spark):
    p, rows = places(spark, 150)
    a, b = (spatial.sdm(rows, "v", ["a"], k)[0].toPandas() for k in (joins.distance_weights(p, "i", ["x", "y"], 20.0), spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)))
    assert len(a) == 4 and np.allclose(a["estimate"], b["estimate"], atol=1e-5) and np.allclose(a["std_error"], b["std_error"], rtol=1e-4)


def test_effects_by_implicit_weights(spark, monkeypatch):
    p, _ = places(spark, 90)
    w = joins.distance_weights(p, "i", ["x", "y"], 20.0)
    m = dense(w, 90)
    monkeypatch.setattr(spatial, "BLOCK", 16)
    for few in (2500, 0):
        monkeypatch.setattr(spatial, "DENSE_ROWS", few)
        own = spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)
        for most in (3, 7):
            assert np.allclose(own.traces(most), [np.trace(np.linalg.matrix_power(m, k)) for k in range(most + 1)])
        a, b = (spatial.effects(0.3, {"x": 2.0}, k, 90, {"x": 0.5}, terms=4)["x"] for k in (w, own))
        assert np.allclose(list(a.values()), list(b.values()))


def test_moran_by_implicit_weights(spark):
    p, rows = places(spark, 150)
    for some in (rows, rows.where("i % 4 > 0")):
        a, b = (spatial.moran(some, "v", k).first() for k in (joins.distance_weights(p, "i", ["x", "y"], 20.0), spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)))
        assert a["n"] == b["n"] and np.allclose([a["statistic"], a["effect_size"], a["p_value"]], [b["statistic"], b["effect_size"], b["p_value"]])


def test_multipliers_by_implicit_weights(spark):
    p, rows = places(spark, 150)
    a, b = (spatial.lm_tests(rows, "v", ["a"], k) for k in (joins.distance_weights(p, "i", ["x", "y"], 20.0), spatial.DistanceWeights(p, "i", ["x", "y"], 20.0)))
    assert a[1] == b[1] and np.allclose(a[0].toPandas()["statistic"], b[0].toPandas()["statistic"])


def test_garch_of_a_series_that_overflowed(spark):
    own = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id = 535").select("user_id", F.col("event_id").alias("t"), "value")
    r = timeseries.garch(own, "user_id", "t", "value").first()
    assert 0 < r["persistence"] < 1 and r["omega"] > 0 and np.isfinite(r["loglik"])


def test_shapiro_wilk_of_many_rows(spark):
    r = np.random.RandomState(5)
    x = np.round(r.randn(6000), 2)
    got = hypothesis.shapiro_wilk(frame(spark, x=x), "x").first()
    assert got["n"] == 6000 and 0.999 < got["statistic"] < 1 and got["p_value"] > 0.01
    assert hypothesis.shapiro_wilk(frame(spark, x=x**3), "x").first()["p_value"] < 1e-6
    for few in (x[:4000], np.exp(x[:500])):
        own = frame(spark, x=few)
        assert np.isclose(hypothesis._shapiro_of_many(own)[1], hypothesis.shapiro_wilk(own, "x").first()["statistic"], rtol=1e-12)
    # Half of normal samples of a size lie above the median, whose place the simulations gave.
    assert 0.4 < hypothesis._shapiro_p(1 - np.exp(0.639) / 10_000, 10_000) < 0.6 and 0.4 < hypothesis._shapiro_p(1 - np.exp(0.812) / 300_000, 300_000) < 0.6


def test_neighbours_by_cells_like_brute_force(spark):
    r = np.random.RandomState(6)
    for a, b, k in ((r.randn(900, 2), r.randn(80, 2) * 2, 3), (np.round(r.randn(700, 3)), np.round(r.randn(60, 3) * 2), 2), (r.randint(0, 3, (400, 2)) * 1.0, r.randint(0, 4, (300, 2)) * 1.0, 1), (r.randn(3, 2), r.randn(5, 2), 4)):
        d = spark.createDataFrame([(int(i) * 2, x.tolist()) for i, x in enumerate(a)], "vec_id long, embedding array<double>")
        q = spark.createDataFrame([(int(i) * 2 + 1, x.tolist()) for i, x in enumerate(b)], "vec_id long, embedding array<double>")
        got = {(x["query_id"], x["rank"]): (x["vec_id"], x["distance"]) for x in joins.knn_cells(d, q, k, cell=32).collect()}
        dist = ((b[:, None] - a) ** 2).sum(2)
        for i in range(len(b)):
            for rank, j in enumerate(np.lexsort((np.arange(len(a)), dist[i]))[:k], 1):
                assert got.pop((i * 2 + 1, rank)) == (j * 2, dist[i, j])
        assert not got


def test_bootstrap_of_more_than_a_million_rows(spark):
    own = spark.range(1_200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("x"))
    b = resampling.bootstrap(own, ["x"], lambda m: float(np.median(m)), 10).first()
    assert abs(b["estimate"] - own.agg(F.median("x")).first()[0]) < 1e-12 and b["n_reps"] == 10 and 2e-4 < b["std_error"] < 1e-3


def test_bootstrap_by_joined_places(spark):
    x = np.random.RandomState(8).permutation(300) * 1.0
    own = frame(spark, x=x, t=x * 2).repartition(5)
    point, draws = resampling.replicates(own, ["x"], lambda m: float(m.mean()), 200, most=299)
    v = draws.toPandas()
    assert np.isclose(point, 149.5) and sorted(v["rep"]) == list(range(200))
    assert abs(v["value"].std() / (x.std() / np.sqrt(300)) - 1) < 0.2 and abs(v["value"].mean() - 149.5) < 1.5
    # Whole blocks of neighbours in the order: steps of one but where a block begins.
    point, draws = resampling.replicates(own, ["x"], lambda m: float((np.diff(m[:, 0]) == 1).sum() + len(m) / 1000), 20, 3, 20, "t", most=299)
    assert np.isclose(point, 299.3) and all(285 <= r["value"] - 0.3 <= 299 for r in draws.collect())
