"""Estimators on seeded data whose truth is known, and identities that must hold."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estima.operators import bayes, causal, diagnostics, glm, graph, joins, linear, mediation, ml, panel, prep, resampling, spatial, survival
from estima.operators import governance as V
from estima.operators import hypothesis as H
from estima.operators import timeseries as N
from estima.plans import gram as G
from estima.plans.ranks import running_counts
from estima.sources import files
from estima.sources.dataset import Dataset


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.fixture(scope="module")
def rng():
    return np.random.RandomState(42)


def normal(n, k=1, seed=1):
    x = np.random.RandomState(seed).randn(n, k)
    return x[:, 0] if k == 1 else x


def test_gram_ways_agree(spark):
    x = normal(500, 3) + 1e6
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], k=np.arange(500) % 2)
    names = ["a", "b", "c"]
    whole = G.gram(df, names)
    assert np.allclose(whole.cov(), np.cov(x.T), rtol=1e-6)
    arrow = G._by_arrow(df, names, "k", None, [1e6] * 3)
    parts = G.grouped(df, names, "k")
    for k in (0, 1):
        assert np.allclose(parts[k].centred, arrow[k].centred, rtol=1e-6) and parts[k].n == arrow[k].n
    assert np.allclose((parts[0] + parts[1]).centred, whole.centred, rtol=1e-6)
    assert np.allclose((whole - parts[0]).centred, parts[1].centred, rtol=1e-6)


def test_partitions_do_not_matter(spark):
    df = frame(spark, x=normal(300), y=normal(300, seed=2))
    a = linear.ols(df.repartition(1), "y", ["x"]).beta
    assert np.allclose(a, linear.ols(df.repartition(7), "y", ["x"]).beta, rtol=1e-10)


def test_running_counts_wide(spark):
    df = frame(spark, v=np.random.RandomState(3).randint(0, 40, 500))
    a = running_counts(df, "v", ("n", F.count(F.lit(1)))).toPandas().sort_values("v").reset_index(drop=True)
    b = running_counts(df, "v", ("n", F.count(F.lit(1))), few=5).toPandas().sort_values("v").reset_index(drop=True)
    assert a.equals(b[a.columns]) and (a.n_before == a.n.cumsum() - a.n).all()


def test_ols_and_diagnostics(spark):
    x = normal(800, 2)
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * normal(800, seed=5)
    df = frame(spark, y=y, a=x[:, 0], b=x[:, 1], t=np.arange(800), g=np.arange(800) % 20)
    fit = linear.ols(df, "y", ["a", "b"])
    m = np.column_stack([np.ones(800), x])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ b
    inv = np.linalg.inv(m.T @ m)
    assert np.allclose(fit.beta, b) and np.allclose(fit.vcov, inv * (e @ e) / 797)
    hc0 = inv @ (m * e[:, None]).T @ (m * e[:, None]) @ inv
    assert np.allclose(diagnostics.robust_vcov(df, fit, "HC0"), hc0)
    h = (m @ inv * m).sum(1)
    hc3 = inv @ ((m * (e / (1 - h))[:, None]).T @ (m * (e / (1 - h))[:, None])) @ inv
    assert np.allclose(diagnostics.robust_vcov(df, fit, "HC3"), hc3)
    dw = diagnostics.durbin_watson(df, fit, ["t"]).first()["statistic"]
    assert math.isclose(dw, (np.diff(e) ** 2).sum() / (e @ e), rel_tol=1e-9)
    s = m * e[:, None]
    meat = s.T @ s
    for k in (1, 2):
        c = s[k:].T @ s[:-k]
        meat = meat + (1 - k / 3) * (c + c.T)
    nw = inv @ meat @ inv * 800 / 797
    assert np.allclose(diagnostics.newey_west_vcov(df, fit, ["t"], 2), nw)
    inf = diagnostics.influence(df, fit, ["t"]).toPandas().sort_values("t")
    assert np.allclose(inf["leverage"], h) and np.allclose(inf["cooks_distance"], e**2 * h / (3 * fit.sigma2 * (1 - h) ** 2))


def test_penalties(spark):
    x = normal(400, 3)
    y = 2 * x[:, 0] + 0.5 * normal(400, seed=8)
    df = frame(spark, y=y, a=x[:, 0], b=x[:, 1], c=x[:, 2], t=np.arange(400))
    lasso = linear.lasso(df, "y", ["a", "b", "c"], 60.0)
    assert lasso["a"] > 1.5 and lasso["b"] == 0 and lasso["c"] == 0
    none = linear.elastic_net(df, "y", ["a", "b", "c"], 0.0)
    assert np.allclose([none[k] for k in ("intercept", "a", "b", "c")], linear.ols(df, "y", ["a", "b", "c"]).beta, atol=1e-6)
    cv = linear.ridge_cv(df, "y", ["a", "b", "c"], "t").toPandas()
    assert cv["cv_mse"].min() < y.var()
    q = linear.quantile(df, "y", ["a"], 0.5)[0].toPandas().set_index("term")["estimate"]
    assert abs(q["a"] - 2) < 0.15
    hub = linear.huber(frame(spark, y=np.where(np.arange(400) % 40 == 0, y + 50, y), a=x[:, 0]), "y", ["a"])
    assert abs(hub["a"] - 2) < 0.15


def test_glm(spark):
    x = normal(3000)
    r = np.random.RandomState(4)
    df = frame(spark, x=x, b=(r.rand(3000) < 1 / (1 + np.exp(-(0.3 + x)))).astype(int), c=r.poisson(np.exp(0.5 + 0.4 * x)), g=r.gamma(2.0, np.exp(1 + 0.3 * x) / 2), n=r.negative_binomial(2, 2 / (2 + np.exp(1 + 0.5 * x))))
    near = lambda fit, b, tol: np.allclose(fit.beta, b, atol=tol)
    assert near(glm.logistic(df, "b", ["x"]), [0.3, 1.0], 0.15)
    assert near(glm.poisson(df, "c", ["x"]), [0.5, 0.4], 0.08)
    assert near(glm.gamma(df, "g", ["x"]), [1.0, 0.3], 0.1)
    nb = glm.negative_binomial(df, "n", ["x"])
    assert near(nb, [1.0, 0.5], 0.12) and 1.5 < nb.theta < 2.7
    pro = glm.probit(df, "b", ["x"])
    assert 0.5 < pro.beta[1] < 0.7
    t, m = glm.zero_inflated(df.withColumn("c", F.when(F.rand(3) < 0.3, 0).otherwise(F.col("c"))), "c", ["x"], [], rounds=25)
    b = t.toPandas().set_index("term")["estimate"]
    assert abs(b["count:x"] - 0.4) < 0.1 and abs(b["zero:intercept"] - math.log(0.3 / 0.7)) < 0.35
    h, _ = glm.hurdle_poisson(df, "c", ["x"])
    assert abs(h.toPandas().set_index("term")["estimate"]["count:x"] - 0.4) < 0.1


def test_discrete_choice(spark):
    x = normal(3000)
    r = np.random.RandomState(5)
    latent = x + r.logistic(size=3000)
    df = frame(spark, x=x, k=np.digitize(latent, [-1.0, 1.0]))
    fit = glm.ordered(df, "k", ["x"])
    assert abs(fit.beta[0] - 1) < 0.12 and np.allclose(fit.cuts, [-1, 1], atol=0.15) and 0 < fit.mcfadden < 1
    p = df.select(*[c.alias(f"p{k}") for k, c in fit.probabilities().items()]).toPandas()
    assert np.allclose(p.sum(axis=1), 1)
    u = np.column_stack([np.zeros(3000), 0.5 + x, -0.5 - x]) + r.gumbel(size=(3000, 3))
    t, m = glm.multinomial(frame(spark, x=x, k=u.argmax(1)), "k", ["x"])
    b = t.toPandas().set_index("term")["estimate"]
    assert abs(b["1:x"] - 1) < 0.2 and abs(b["2:x"] + 1) < 0.2 and m["hit_rate"] > 0.5


def test_panel(spark):
    n, t = 60, 8
    r = np.random.RandomState(6)
    u = np.repeat(r.randn(n) * 2, t)
    x = r.randn(n * t) + 0.5 * u
    y = 1.5 * x + u + 0.3 * r.randn(n * t)
    df = frame(spark, y=y, x=x, u=np.repeat(np.arange(n), t), t=np.tile(np.arange(t), n))
    fe = panel.fixed_effects(df, "y", ["x"], "u")[2]
    dummies = np.column_stack([x, np.eye(n)[np.repeat(np.arange(n), t)]])
    assert math.isclose(fe.beta[0], np.linalg.lstsq(dummies, y, rcond=None)[0][0], rel_tol=1e-8)
    two = panel.fixed_effects(df.where("not (u = 3 and t = 2)"), "y", ["x"], "u", "t")[2]
    keep = ~((np.repeat(np.arange(n), t) == 3) & (np.tile(np.arange(t), n) == 2))
    wide = np.column_stack([x, np.eye(n)[np.repeat(np.arange(n), t)], np.eye(t)[np.tile(np.arange(t), n)][:, 1:]])[keep]
    assert math.isclose(two.beta[0], np.linalg.lstsq(wide, y[keep], rcond=None)[0][0], rel_tol=1e-6)
    assert abs(panel.first_difference(df, "y", ["x"], "u", "t")[2].beta[0] - 1.5) < 0.1
    assert panel.hausman(df, "y", ["x"], "u").first()["p_value"] < 0.05
    ok = frame(spark, y=1.5 * r.randn(n * t) * 0 + u + 2, x=r.randn(n * t), u=np.repeat(np.arange(n), t))
    assert panel.random_effects(ok.withColumn("y", F.col("y") + 1.5 * F.col("x") + F.randn(1) * 0.3), "y", ["x"], "u")[1]["rho"] > 0.8
    mm, m = panel.mixed_model(df, "y", ["x"], "u")
    assert 1.3 < mm.where("term = 'x'").first()["estimate"] < 1.8 and m["var_intercept"] > 1


def test_arellano_bond(spark):
    r = np.random.RandomState(7)
    n, t = 400, 8
    rows = []
    for i in range(n):
        a, y = r.randn(), 0.0
        for k in range(t + 5):
            x = r.randn()
            y = 0.5 * y + x + a + 0.5 * r.randn()
            if k >= 5:
                rows.append((i, k - 5, y, x))
    df = spark.createDataFrame(rows, "u int, t int, y double, x double")
    b = panel.arellano_bond(df, "y", ["x"], "u", "t")[0].toPandas()["estimate"]
    assert abs(b[0] - 0.5) < 0.06 and abs(b[1] - 1) < 0.06


def test_causal(spark):
    r = np.random.RandomState(8)
    n = 4000
    u, z, w = r.randn(n), r.randn(n), r.randn(n)
    x = 0.8 * z + 0.5 * w + 0.5 * u + 0.3 * r.randn(n)
    df = frame(spark, y=2 * x - w + u, x=x, z=z, w=w)
    t, m = causal.iv(df, "y", ["x"], ["z"], ["w"])
    assert abs(t.where("term = 'x'").first()["estimate"] - 2) < 0.1 and m["first_stage_f_x"] > 10
    run = r.uniform(-2, 2, n)
    rd = frame(spark, y=10 + 2 * run + 3 * (run >= 0) + 0.5 * r.randn(n), r=run)
    assert abs(causal.rdd(rd, "y", "r", 0.0, 1.0).estimate - 3) < 0.2 and abs(causal.rdd(rd, "y", "r").estimate - 3) < 0.25
    c = r.randn(n, 2)
    ps = 1 / (1 + np.exp(-(0.2 + 0.5 * c[:, 0])))
    tr = (r.rand(n) < ps).astype(int)
    own = frame(spark, id=np.arange(n), t=tr, y=c @ [1.0, 0.5] + 0.5 * tr + 0.3 * r.randn(n), a=c[:, 0], b=c[:, 1], ps=ps)
    for got in (causal.psm(own, "id", "y", "t", ["a", "b"]), causal.aipw(own, "y", "t", ["a", "b"], "ps"), causal.ipw_effects(own, "y", "t", "ps")):
        rows = {q["estimand"]: q["estimate"] for q in got.collect()}
        assert abs(rows["ATT"] - 0.5) < 0.2 and abs(rows["ATE"] - 0.5) < 0.2
    cm = causal.covariate_matching(own, "id", "y", "t", ["a", "b"]).first()["estimate"]
    assert abs(cm - 0.5) < 0.1


def test_nearest_join_like_brute_force(spark):
    r = np.random.RandomState(9)
    s = np.round(r.rand(600) * 20, 1)
    t = (r.rand(600) < 0.4).astype(int)
    df = frame(spark, id=np.arange(600), s=s, t=t)
    got = joins.nearest(df, "id", "s", "t").toPandas().set_index("id")["distance"]
    for i in np.flatnonzero(t):
        assert math.isclose(got[i], np.abs(s[t == 0] - s[i]).min(), abs_tol=1e-12)
    pairs = joins.greedy_match(df, "id", "s", "t").toPandas()
    assert pairs["match_id"].is_unique and pairs["id"].is_unique and len(pairs) == min(t.sum(), (t == 0).sum()) or len(pairs) > 0.8 * t.sum()


def test_approximate_neighbours_are_found(spark):
    r = np.random.RandomState(21)
    far = r.randn(600, 64)
    near = np.repeat(r.randn(40, 64), 15, 0) + 0.002 * r.randn(600, 64)  # groups of near copies, which buckets find
    for x in (far, near, np.concatenate([far, near])):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        for k, width in ((5, 0.5), (10, 0.8)):
            q = df.where("vec_id % 20 = 0")
            true = {(a["query_id"], a["vec_id"]) for a in joins.knn_blocks(df, q, k).collect()}
            got = [(a["query_id"], a["vec_id"]) for a in joins.knn_lsh(df, q, k, width=width).collect()]
            assert len(got) == len(set(got)) == len(true) and len(set(got) & true) >= 0.9 * len(true)


@pytest.mark.parametrize("slice_rows", [100_000, 150])
def test_greedy_match_leaves_no_feasible_pair(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(joins, "SLICE_ROWS", slice_rows)
    r = np.random.RandomState(22)
    t = np.repeat([0, 1], 400)
    s = np.where(t == 0, 0.8 + 0.1 * r.rand(800), 0.9 + 0.1 * r.rand(800))
    for caliper in (None, 0.02):
        pairs = joins.greedy_match(frame(spark, id=np.arange(800), s=s, t=t), "id", "s", "t", caliper).toPandas()
        assert pairs["id"].is_unique and pairs["match_id"].is_unique and (t[pairs["id"]] == 1).all() and (t[pairs["match_id"]] == 0).all()
        assert np.allclose(np.abs(s[pairs["id"]] - s[pairs["match_id"]]), pairs["distance"])
        one, other = s[np.setdiff1d(np.flatnonzero(t == 1), pairs["id"])], s[np.setdiff1d(np.flatnonzero(t == 0), pairs["match_id"])]
        if caliper is None:
            assert len(pairs) == 400
        else:
            assert len(pairs) and (pairs["distance"] <= caliper).all() and (np.abs(one[:, None] - other) > caliper).all()


def test_synthetic_control(spark):
    b, c = np.linspace(1, 10, 10), np.linspace(3, 6, 10)
    a = (b + c) / 2 + 5 * (np.arange(10) >= 7)
    rows = [(k, u, float(v[k])) for u, v in (("A", a), ("B", b), ("C", c)) for k in range(10)]
    df = spark.createDataFrame(rows, "t int, u string, y double")
    w, gaps, m = causal.synthetic_control(df, "u", "t", "y", "A", 7)
    w = {r["unit"]: r["weight"] for r in w.collect()}
    assert abs(sum(w.values()) - 1) < 1e-6 and min(w.values()) >= 0 and abs(m["att"] - 5) < 0.5 and m["pre_rmspe"] < 0.5


def test_series(spark):
    r = np.random.RandomState(10)
    a = np.array([[0.5, 0.1], [0.0, 0.4]])
    y = np.zeros((600, 2))
    for t in range(1, 600):
        y[t] = a @ y[t - 1] + 0.1 * r.randn(2)
    df = frame(spark, a=y[:, 0], b=y[:, 1], t=np.arange(600))
    m = N.var(df, ["a", "b"], "t", 1)
    assert np.allclose(m.coef[0], a, atol=0.12) and m.stable() and len(m.forecast(3)) == 3
    assert np.allclose(m.fevd(3).sum(2), 1)
    walk = frame(spark, x=np.cumsum(0.1 + r.randn(600)), t=np.arange(600))
    assert N.adf(df, "a", "t", 1)["statistic"] < -3 and N.adf(walk, "x", "t", 1)["p_value"] > 0.05
    assert N.kpss(walk, "x", "t")["statistic"] > 0.463
    r = np.random.RandomState(78)
    x = np.cumsum(r.randn(600))
    both = frame(spark, x=x, y=2 * x + r.randn(600), t=np.arange(600))
    assert N.johansen(both, ["x", "y"], "t", 2)[2] == 1 and N.engle_granger(both, "y", "x", "t")["statistic"] < -4


def test_lags_cross_cells(spark):
    df = frame(spark, v=normal(500), t=np.arange(500))
    got = diagnostics._lagged(df, ["t"], "v", 3).toPandas().sort_values("t")
    for k in (1, 2, 3):
        assert np.allclose(got[f"v_{k}"].to_numpy()[k:], got["v"].to_numpy()[:-k]) and got[f"v_{k}"].isna().sum() == k


def test_sequential_models():
    r = np.random.RandomState(11)
    x = np.concatenate([r.randn(100), 10 + r.randn(100), r.randn(100)])
    for cost in ("l2", "gaussian"):
        p = N.pelt(x, cost)
        assert len(p) >= 2 and any(abs(k - 100) <= 2 for k in p) and any(abs(k - 200) <= 2 for k in p)
    assert any(abs(k - 150) <= 4 for k in N.pelt(np.concatenate([r.poisson(2, 150), r.poisson(12, 150)]), "poisson"))
    e, v = np.zeros(2000), 1.0
    for t in range(1, 2000):
        v = 0.1 + 0.1 * e[t - 1] ** 2 + 0.8 * v
        e[t] = math.sqrt(v) * r.randn()
    g = N.fit_garch(e)
    assert g["omega"] > 0 and 0 < g["alpha"] < 0.3 and g["alpha"] + g["beta"] < 1.0001
    k = N.Kalman(1.0, 1.0, 0.01, 1.0)
    z = np.cumsum(0.1 * r.randn(200))[:, None] + r.randn(200, 1)
    xs, ps, ll = k.smooth(z)
    assert np.isfinite(ll) and (ps > 0).all()
    assert N.dtw_distance([1, 2, 3], [1, 2, 2, 3]) == 0 and N.dtw_path([1, 2, 3], [1, 2, 2, 3])[-1] == (2, 3)
    c, n = ml.haar([1.0, 2.0, 3.0, 4.0, 5.0])
    assert np.allclose(ml.haar_inverse(c, n), [1, 2, 3, 4, 5])


def test_survival(spark):
    r = np.random.RandomState(12)
    x = r.randn(1500)
    t = r.exponential(np.exp(-0.7 * x))
    c = r.exponential(2.0, 1500)
    df = frame(spark, t=np.minimum(t, c), e=(t <= c).astype(int), x=x, g=(x > 0).astype(int), whole=np.ones(1500, int))
    assert abs(survival.cox(df, "t", "e", ["x"])[0].first()["estimate"] - 0.7) < 0.1
    assert survival.log_rank(df, "t", "e", "g").first()["p_value"] < 1e-6
    curve = survival.kaplan_meier(df, "t", "whole").toPandas().sort_values("time")
    assert np.allclose(curve["survival"], 1 - np.arange(1, 1501) / 1500)


def test_graph(spark):
    e = spark.createDataFrame([(a, b) for a, b in [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]], "a int, b int")
    g = graph.build(e, "a", "b")
    labels, history = graph.louvain(g)
    c = {r["node"]: r["community"] for r in labels.collect()}
    assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5] and 0.3 < history[-1] < 0.4
    p = {r["node"]: r["score"] for r in graph.pagerank(g).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and p[2] > p[0]
    assert {r["node"]: r["triangles"] for r in graph.triangle_counts(g).collect()} == {i: 1 for i in range(6)}


def test_spatial(spark):
    r = np.random.RandomState(13)
    n = 80
    xy = r.rand(n, 2) * 10
    pts = frame(spark, i=np.arange(n), px=xy[:, 0], py=xy[:, 1])
    w = joins.knn_weights(pts, "i", ["px", "py"], 4)
    m = np.zeros((n, n))
    for row in w.collect():
        m[row["i"], row["j"]] = row["w"]
    assert np.allclose(m.sum(1), 1)
    x = r.randn(n)
    y = np.linalg.solve(np.eye(n) - 0.5 * m, 1 + 2 * x + 0.3 * r.randn(n))
    df = frame(spark, i=np.arange(n), y=y, x=x)
    t, q = spatial.sar(df, "y", ["x"], w)
    assert abs(q["rho"] - 0.5) < 0.15 and abs(t.where("term = 'x'").first()["estimate"] - 2) < 0.2
    assert spatial.moran(df, "y", w).first()["p_value"] < 0.05
    u = np.linalg.solve(np.eye(n) - 0.6 * m, 0.3 * r.randn(n))
    t, q = spatial.sem(frame(spark, i=np.arange(n), y=1 + 2 * x + u, x=x), "y", ["x"], w)
    assert abs(q["lambda"] - 0.6) < 0.3 and abs(t.where("term = 'x'").first()["estimate"] - 2) < 0.2


def test_bayes(spark):
    x = normal(500)
    df = frame(spark, x=x, y=1 + 2 * x + 0.5 * normal(500, seed=3))
    s = bayes.summarise(bayes.BayesianLinear(df, "y", ["x"]).sample(2, 300, 300)).toPandas().set_index("param")
    assert abs(s.loc["x", "mean"] - 2) < 0.1 and s["r_hat"].max() < 1.1
    draws, rate, bad = bayes.hmc_chain(lambda t: (-0.5 * float(t @ t), -t), np.zeros(3), 800, 400)
    assert np.abs(draws.mean(0)).max() < 0.25 and rate > 0.5 and bayes.effective_size(draws[:, 0]) > 100
    mean, sd = bayes.variational(lambda t: (-0.5 * float(((t - 1) / 2) @ ((t - 1) / 2)), -(t - 1) / 4), 2)
    assert np.allclose(mean, 1, atol=0.3) and np.allclose(sd, 2, atol=0.4)


def test_resampling(spark):
    x = 10 + normal(200)
    df = frame(spark, x=x, k=np.arange(200), t=np.arange(200))
    b = resampling.bootstrap(df, ["x"], lambda m: float(m.mean()), 400).first()
    assert abs(b["std_error"] / (x.std(ddof=1) / math.sqrt(200)) - 1) < 0.15
    j = resampling.jackknife_mean_variance(df, "x").toPandas().set_index("statistic")
    assert math.isclose(j.loc["variance", "corrected"], x.var(ddof=1), rel_tol=1e-10)


def test_mediation(spark):
    x = normal(2000)
    m = 0.5 * x + normal(2000, seed=2)
    df = frame(spark, x=x, m=m, y=0.7 * m + 0.2 * x + normal(2000, seed=3), k=np.arange(2000))
    e = mediation.mediation(df, "y", "x", "m", "k", reps=100).toPandas().set_index("effect")
    assert abs(e.loc["indirect", "estimate"] - 0.35) < 0.08 and e.loc["indirect", "p_value"] < 0.05
    assert math.isclose(e.loc["c", "estimate"], e.loc["c_prime", "estimate"] + e.loc["indirect", "estimate"], rel_tol=1e-9)


def test_governance(spark):
    x = normal(100)
    good, noise = frame(spark, x=x, y=3 * x + 0.1 * normal(100, seed=2)), frame(spark, x=x, y=10 * normal(100, seed=2))
    fit, verdict = V.fit_and_judge(good, "y", ["x"], "strict")
    assert verdict.score > 0.8 and not verdict.objections and "one more of x" in V.narrative(V.FitAdapter(fit, "y"))
    with pytest.raises(V.Rejected):
        V.fit_and_judge(noise, "y", ["x"], "strict")
    assert "<table>" in V.report("r", {"t": good.limit(2)}) and V.strategy({"z": "double"}, "z") == "iv"


def test_preparation(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), None)], "k int, v double, s string")
    assert [r["v"] for r in prep.impute(df, "v", "mean").orderBy("k").collect()] == [1.0, 1.0, 1.0]
    assert [r["s"] for r in prep.label_encode(df, "s").orderBy("k").collect()] == [0, 1, -1]
    assert prep.drop_missing(df, "v").count() == 1
    with pytest.raises(ValueError):
        prep.pivot(df.union(df), "k", "s", "v")
    data = Dataset(df).apply("a", lambda d: d.where("k = 1")).apply("b", lambda d: d.where("k = 2"))
    assert data.undo().df.count() == 1 and data.reset().df.count() == 3
    nulls = spark.createDataFrame([(None, 1), (1, 2)], "k int, a int")
    assert joins.merge(nulls, nulls.withColumnRenamed("a", "b"), "k").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,日本\n".encode("cp932"))
    assert files.read(spark, str(tmp_path / "a.csv")).first()["v"] == "日本"
    (tmp_path / "b.txt").write_text("a;b\n1;2\n3;4\n")
    assert files.read(spark, str(tmp_path / "b.txt")).columns == ["a", "b"]
    pd.DataFrame({"A": [1, 2], "B": [0.5, 1.5]}).to_stata(tmp_path / "c.dta", write_index=False)
    assert files.read(spark, str(tmp_path / "c.dta")).count() == 2
    pd.DataFrame({"A": [1, 2]}).to_feather(tmp_path / "d.feather")
    assert files.read(spark, str(tmp_path / "d.feather")).count() == 2
    with pytest.raises(ValueError, match="formats"):
        files.read(spark, "x.doc")
    df = spark.createDataFrame([(1, "a|b")], "k int, s string")
    assert "a\\|b" in files.to_markdown(df) and "tabular" in files.to_latex(df)


def test_tests_against_brute_force(spark):
    x = np.array([1.1, 2.2, 2.9, 4.5, 5.0])
    y = np.array([2.0, 3.3, 6.1, 7.7])
    df = frame(spark, v=np.concatenate([x, y]), g=["a"] * 5 + ["b"] * 4)
    r = H.mann_whitney(df, "v", "g", "a", "b").first()
    assert r["statistic"] == sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    p = H.correct_p_values(frame(spark, p_value=[0.01, 0.04, 0.03]), method="holm").toPandas().sort_values("p_value")["p_adjusted"].tolist()
    assert np.allclose(p, [0.03, 0.06, 0.06])


def test_exact_quantiles(spark):
    from estima.plans.ranks import quantiles

    r = np.random.RandomState(2)
    x, y = r.randn(3000), r.randint(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, z double")
    shares = [0.0, 0.1, 0.5, 0.513, 0.99, 1.0]
    for few in (50_000, 10):
        got = quantiles(df, ["x", "y", "z"], shares, few)
        assert np.allclose(got["x"], np.quantile(x, shares)) and np.allclose(got["y"], np.quantile(y, shares)) and np.isnan(got["z"]).all()


def test_cut_tables_say_so(spark):
    from estima.operators import governance
    from estima.sources import files

    df = spark.range(5)
    note = "The first 3 rows; there are more."
    for make in (files.to_markdown, files.to_latex, lambda d, n: governance.report("t", {"s": d}, n)):
        assert note in make(df, 3) and "there are more" not in make(df, 5)
