"""Sinks, functions of the driver, optimisers and streams: operators that the other modules don't reach."""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import polynomials
from ..functions.result import frame, metrics
from ..operators import bayes, causal, describe, diagnostics, glm, graph, linear, ml, optimise
from ..operators import governance as V
from ..operators import timeseries as N
from ..plans.gram import complete, gram
from ..plans.storage import shared_folder
from ..registry import query, table
from ..sources import files
from ..streaming import events as W
from .foundation import line, rounded, shown
from .series import TRADE, trade


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def a7_feather(s, d):
    """A file for one process: it is written and read on the driver alone."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "region.feather")
        table(s, d, "region").toPandas().to_feather(path)
        return files.read(s, path).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def a9_stata(s, d):
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "region.dta")
        table(s, d, "region").toPandas().to_stata(path, write_index=False)
        return files.read(s, path).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("SELECT count(*) AS rows FROM region")
def a14_csv_sink(s, d):
    path = shared_folder(s)
    files.write_csv(table(s, d, "region"), path, one_file=True)
    return files.read_csv(s, path).agg(F.count("*").alias("rows"))


@query()
def a16_markdown_and_latex(s, d):
    small = table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return frame(s, [(files.to_markdown(small), files.to_latex(small))], "markdown string, latex string")


@query()
def a17_report(s, d):
    page = V.report("Regions", {"Text": "All regions.", "Table": table(s, d, "region")})
    return frame(s, [(page,)], "html string")


@query("SELECT 'l_quantity' AS x, 'l_tax' AS y, round(corr(l_quantity, l_tax), 3) AS r FROM lineitem")
def d3_rounded_correlation(s, d):
    return rounded(describe.correlations(line(s, d), ["l_quantity", "l_tax"]).select("x", "y", "r"), 3)


@query("SELECT avg(CAST(l_linestatus = 'F' AS INT)) FILTER (l_returnflag = 'N') AS share FROM lineitem")
def d11_conditional_mean(s, d):
    return line(s, d).agg(F.avg(F.when(F.col("l_returnflag") == "N", (F.col("l_linestatus") == "F").cast("int"))).alias("share"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity * (l_extendedprice - a - b * l_quantity)) / 1e3, 3) AS score FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem) GROUP BY 1")
def d15_cluster_scores(s, d):
    fit = linear.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    rows = diagnostics.fitted_rows(line(s, d), fit, ["l_suppkey"])
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("residual")) / 1e3, 3).alias("score"))


@query("WITH d AS (SELECT l_orderkey % 500 AS time, CAST(l_returnflag <> 'N' AS INT) AS event FROM lineitem), t AS (SELECT time, count(*) AS n, sum(event) AS d FROM d GROUP BY 1) SELECT CAST(time AS DOUBLE) AS time, CAST(sum(n) OVER (ORDER BY time DESC) AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CAST(n - d AS BIGINT) AS n_censor FROM t")
def d16_risk_table(s, d):
    from ..operators import survival

    own = line(s, d).select((F.col("l_orderkey") % 500).alias("time"), (F.col("l_returnflag") != "N").cast("int").alias("event"))
    return survival.risk_table(own, "time", "event")


@query("SELECT c_custkey, c_acctbal FROM customer")
def e1_sort(s, d):
    return table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal")


@query()
def f1_distribution_functions(s, d):
    rows = [("normal", D.norm_cdf(1.96)), ("t", D.t_cdf(2.0, 10)), ("f", D.f_cdf(3.0, 2, 20)), ("chi2", D.chi2_cdf(3.0, 2)), ("beta", D.betainc(2, 3, 0.4)), ("gamma", D.gammainc(2, 1.5)), ("studentized range", 1 - D.studentized_range_sf(3.5, 3, 20)), ("noncentral t", D.nct_cdf(2.0, 10, 1.0)), ("noncentral F", D.ncf_cdf(3.0, 2, 20, 1.5)), ("binomial", D.binom_cdf(3, 10, 0.5))]
    return frame(s, rows, "name string, value double")


@query("SELECT x, round(1 + 2 * x + 3 * x * x, 8)::DOUBLE AS value FROM (SELECT CAST(unnest(range(0, 5)) AS DOUBLE) AS x)")
def f11_newton(s, d):
    nodes, diff = polynomials.newton([0.0, 1.0, 2.0], [1.0, 6.0, 17.0])
    return frame(s, [(float(x), round(polynomials.newton_value(nodes, diff, x), 8)) for x in range(5)], "x double, value double")


@query("SELECT l_orderkey, l_linenumber, round((1 / n + power(l_quantity - m, 2) / sxx) * 1e6, 4) AS leverage_m FROM lineitem, (SELECT avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, CAST(count(*) AS DOUBLE) AS n FROM lineitem)")
def k6_leverage(s, d):
    fit = linear.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    return diagnostics.fitted_rows(line(s, d), fit, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(F.col("leverage") * 1e6, 4).alias("leverage_m"))


@query()
def i11_interquantile_range(s, d):
    p = frame(s, [(0.25, "x", 1.0, 0.1), (0.75, "x", 1.6, 0.1)], "tau double, term string, estimate double, std_error double")
    return linear.interquantile_range(p, 0.25, 0.75)


@query()
def i11_equal_quantiles(s, d):
    p = frame(s, [(0.25, "x", 1.0, 0.1), (0.75, "x", 1.6, 0.1)], "tau double, term string, estimate double, std_error double")
    return linear.quantile_wald(p)


@query()
def j14_ordered_probit(s, d):
    own = table(s, d, "part").select(F.ceil(F.col("p_size") / 17).alias("k"), (F.col("p_partkey") % 11).cast("double").alias("x"))
    return glm.ordered(own, "k", ["x"], "probit").table(s)


@query()
def m23_in_time_placebo(s, d):
    from .causality import regions

    own = regions(s, d)
    low, mid = own.agg(F.percentile("t", F.array(F.lit(0.4), F.lit(0.7)))).first()[0]
    return metrics(s, causal.in_time_placebo(own, "unit", "t", "y", 0, mid, low))


@query()
def n9_news_impact(s, d):
    return frame(s, N.news_impact({"omega": 0.1, "alpha": 0.1, "beta": 0.8, "gamma": 0.05}, [-2.0, -1.0, 0.0, 1.0, 2.0], 1.0), "shock double, variance double")


@query("""WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 AS k FROM embeddings), q AS (SELECT vec_id, CASE WHEN k > 0 THEN k ELSE 1 END AS k, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / CASE WHEN k > 0 THEN k ELSE 1 END)) AS q FROM s)
SELECT a.vec_id, round(list_inner_product(a.q, b.q) * a.k * b.k, 8) AS dot FROM q AS a, q AS b WHERE b.vec_id = 0""")
def q5_quantized_dot(s, d):
    e = table(s, d, "embeddings").select("vec_id", ml.quantize(F.col("embedding")).alias("q"))
    one = e.where("vec_id = 0").select(F.col("q").alias("p"))
    return shown(e.crossJoin(F.broadcast(one)).select("vec_id", ml.quantized_dot(F.col("q"), F.col("p")).alias("dot")), "vec_id", dot=8)


@query()
def q11_posterior_persistence(s, d):
    return metrics(s, ml.posterior_persistence(np.random.RandomState(1).randn(100, 2)))


@query("SELECT 1 AS src, 0 AS dst, 1.0::DOUBLE AS w UNION ALL SELECT 2, 3, 1.0")
def q12_two_cycles(s, d):
    return graph.two_cycles(frame(s, [(0, 1, 2.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 4.0), (5, 6, 1.0)], "src int, dst int, w double"))


@query(f"""WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {TRADE} WHERE a <> b), t AS (SELECT x.a, x.b, y.b AS c FROM e AS x JOIN e AS y ON x.b = y.a JOIN e AS z ON z.a = x.a AND z.b = y.b)
SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node""")
def r_triangles(s, d):
    return graph.triangle_counts(graph.build(trade(s, d), "a", "b"))


@query()
def t7_priors(s, d):
    own = complete(line(s, d), {"y": "l_extendedprice", "x": "l_quantity"})
    f = bayes.linear_density(gram(own, ["y", "x"]), "y", ["x"], 1e6)
    start = np.array([50_000.0, 0.0, 10.0])
    rows = []
    for kind in ("flat", "gaussian", "laplace"):
        prior = bayes.log_prior(kind, 1e5)
        rows.append((kind, float(bayes.map_estimate(f, prior, start)[0][1])))
    return frame(s, rows, "prior string, slope double")


@query()
def t8_minimise(s, d):
    x, value, ok = optimise.minimise(lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2, np.array([-1.2, 1.0]))
    return frame(s, [(float(x[0]), float(x[1]), float(value), ok)], "x double, y double, value double, converged boolean")


@query()
def t9_proximal_gradient(s, d):
    a, b = np.array([[2.0, 0.3], [0.3, 1.0]]), np.array([1.0, 0.05])
    w = optimise.fista(lambda v: a @ v - b, lambda z, t: optimise.prox_l1(z, 0.2 * t), np.zeros(2), 0.4)
    return frame(s, [(float(w[0]), float(w[1]))], "x double, y double")


@query()
def v10_answer(s, d):
    report = {"score": 0.62, "suggestions": ["add columns"], "summary": "fine"}
    return frame(s, [(q, V.answer(q, report)) for q in ("Is it reliable?", "How can I improve it?", "Hm?")], "question string, answer string")


@query()
def v13_step_log(s, d):
    log = V.StepLog()
    log.add("start")
    log.add("complete", "ok")
    return log.frame(s)


@query("SELECT 'iv' AS a, 'did' AS b, 'rdd' AS c")
def v15_strategy(s, d):
    return frame(s, [(V.strategy({"z": "double"}, "z"), V.strategy({}, None, "t", 2), V.strategy({}))], "a string, b string, c string")


def _stream(s, d):
    whole = table(s, d, "events")
    return s.readStream.schema(whole.schema).parquet(f"{d}/events.parquet*")


def _drained(frame_, mode: str):
    """What a stream gives over all that is there now, as a table in the shared folder."""
    path = shared_folder(frame_.sparkSession)
    q = frame_.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame_.sparkSession.read.schema(frame_.schema).parquet(path)


@query()
def w3_stream_kalman(s, d):
    return _drained(W.kalman(_stream(s, d), "user_id", "ts", "value"), "append")


@query("""SELECT start, start + INTERVAL 1 DAY AS "end", event_type, n, round(total, 4) AS total, round(mean, 6) AS mean, round(sd, 6) AS sd FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def w4_stream_windows(s, d):
    return shown(_drained(W.windowed(_stream(s, d), "ts", "value", ["event_type"], "1 day", late="1 hour"), "append"), "start", "end", "event_type", "n", total=4, mean=6, sd=6)


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(regr_slope(value, user_id), 6) AS slope FROM events")
def w5_stream_gram(s, d):
    g = W.RunningGram(["value", "user_id"])
    q = _stream(s, d).writeStream.foreachBatch(g).option("checkpointLocation", shared_folder(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    fit = linear.from_gram(g.gram(), "value", ["user_id"])
    return frame(s, [(float(fit.n), round(float(fit.beta[1]), 6))], "n double, slope double")


@query()
def x2_user_density(s, d):
    f = lambda t: (-0.5 * float(t @ t) - math.log(2 * math.pi), -t)
    return bayes.summarise(bayes.sample(s, f, [0.0, 0.0], ["a", "b"], 2, 200, 200))
