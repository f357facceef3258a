"""Time series, survival, clustering and learning, graphs, space, Bayes, resampling, streams, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.registry import Registry
from ..functions.result import frame, metrics
from ..operators import bayes, graph, ml, resampling, spatial, survival
from ..operators import timeseries as N
from ..operators.optimise import branch_and_bound
from ..registry import query, table
from ..streaming import events as W
from .foundation import KNN, line, points, rounded, shown
from .sqlfit import inverse, residual, swept


def daily(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day")).agg((F.avg("o_totalprice") / 1000).alias("price"), F.count("*").cast("double").alias("n"))


DAILY = "(SELECT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, avg(o_totalprice) / 1000 AS price, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"
LAGS = [f"{c}{k}" for k in range(1, 5) for c in "pq"]
#: Two lags of both series: the fits of each equation (a, b) and the residuals' covariance (s).
VAR = f"""l AS (SELECT day, price AS u, n AS v, lag(price, 1) OVER w AS p1, lag(n, 1) OVER w AS q1, lag(price, 2) OVER w AS p2, lag(n, 2) OVER w AS q2 FROM {DAILY} WINDOW w AS (ORDER BY day) QUALIFY p2 IS NOT NULL), {swept("a", "l", LAGS[:4], "u")}, {swept("b", "l", LAGS[:4], "v")},
x AS (SELECT day, {residual(LAGS[:4], "u")} AS e FROM a_r, a), y AS (SELECT day, {residual(LAGS[:4], "v")} AS e FROM b_r, b), s AS (SELECT sum(x.e * x.e) / (count(*) - 5) AS s11, sum(x.e * y.e) / (count(*) - 5) AS s12, sum(y.e * y.e) / (count(*) - 5) AS s22 FROM x JOIN y USING (day))"""
#: Its moving averages, those before them, and the responses to orthogonal shocks (r).
IMPULSES = f"""c0 AS (SELECT sqrt(s11) AS c11, s12 / sqrt(s11) AS c21, sqrt(s22 - s12 * s12 / s11) AS c22 FROM s),
f AS (SELECT 0::BIGINT AS h, 1.0::DOUBLE AS f11, 0.0::DOUBLE AS f12, 0.0::DOUBLE AS f21, 1.0::DOUBLE AS f22, 0.0::DOUBLE AS g11, 0.0::DOUBLE AS g12, 0.0::DOUBLE AS g21, 0.0::DOUBLE AS g22 UNION ALL
SELECT h + 1, {", ".join(f"f{i}1 * a.b{j} + f{i}2 * b.b{j} + g{i}1 * a.b{j + 2} + g{i}2 * b.b{j + 2}" for i in (1, 2) for j in (1, 2))}, f11, f12, f21, f22 FROM f, a, b WHERE h < 5),
r AS (SELECT h, f11 * c11 + f12 * c21 AS r11, f12 * c22 AS r12, f21 * c11 + f22 * c21 AS r21, f22 * c22 AS r22 FROM f, c0)"""


@query(f"SELECT round(regr_slope(price, p), 6) AS phi, round(regr_intercept(price, p), 4) AS const, count(*) AS n FROM (SELECT price, lag(price) OVER (ORDER BY day) AS p FROM {DAILY}) WHERE p IS NOT NULL")
def n1_autoregression(s, d):
    _, fit = N.ar(daily(s, d), "price", "day", 1)
    return frame(s, [(round(float(fit.beta[1]), 6), round(float(fit.beta[0]), 4), fit.n)], "phi double, const double, n long")


@query(f"""WITH {VAR}, k AS (SELECT 'price' AS equation, a.*, s11 AS s2 FROM a, s UNION ALL SELECT 'n', b.*, s22 FROM b, s), t AS (SELECT equation, unnest(['intercept', 'price_1', 'n_1', 'price_2', 'n_2']) AS term, unnest([b0, b1, b2, b3, b4]) AS b, unnest([1 / n + {" + ".join(f"m{i} * m{j} * {inverse(i, j)}" for i in range(1, 5) for j in range(1, 5))}, {", ".join(inverse(i, i) for i in range(1, 5))}]) * s2 AS v FROM k)
SELECT equation, term, round(b, 6) AS estimate, round(sqrt(v), 6) AS std_error, round(b / sqrt(v), 5) AS statistic FROM t""")
def n2_var(s, d):
    return shown(N.var_table(s, N.var(daily(s, d), ["price", "n"], "day", 2)), "equation", "term", estimate=6, std_error=6, statistic=5)


@query(f"WITH RECURSIVE {VAR}, {IMPULSES} SELECT step, response, shock, round(value, 6) AS value FROM (SELECT h AS step, unnest(['price', 'price', 'n', 'n']) AS response, unnest(['price', 'n', 'price', 'n']) AS shock, unnest([r11, r12, r21, r22]) AS value FROM r)")
def n3_impulse_responses(s, d):
    m = N.var(daily(s, d), ["price", "n"], "day", 2)
    r = m.irf(5)
    return shown(frame(s, [(h, m.names[i], m.names[j], r[h, i, j]) for h in range(6) for i in range(2) for j in range(2)], "step long, response string, shock string, value double"), "step", "response", "shock", value=6)


@query()
def n3_impulse_bands(s, d):
    return N.irf_bands(daily(s, d), ["price", "n"], "day", 1, 3, reps=20)


@query(f"""WITH RECURSIVE {VAR}, {IMPULSES}, c AS (SELECT h, {", ".join(f"sum(r{k} * r{k}) OVER (ORDER BY h) AS c{k}" for k in (11, 12, 21, 22))} FROM r)
SELECT step, variable, shock, round(share, 8) AS share FROM (SELECT h AS step, unnest(['price', 'price', 'n', 'n']) AS variable, unnest(['price', 'n', 'price', 'n']) AS shock, unnest([c11 / (c11 + c12), c12 / (c11 + c12), c21 / (c21 + c22), c22 / (c21 + c22)]) AS share FROM c WHERE h < 4)""")
def n4_variance_decomposition(s, d):
    m = N.var(daily(s, d), ["price", "n"], "day", 2)
    r = m.fevd(4)
    return shown(frame(s, [(h, m.names[i], m.names[j], r[h, i, j]) for h in range(4) for i in range(2) for j in range(2)], "step long, variable string, shock string, share double"), "step", "variable", "shock", share=8)


@query(f"""WITH {VAR}, {swept("c", "l", ["p1", "p2"], "u")}, f AS (SELECT (c.rss - a.rss) / 2 / (a.rss / (a.n - 5)) AS f, a.n - 5 AS df FROM a, c)
SELECT 'f_stat' AS metric, round(f, 6) AS value FROM f UNION ALL SELECT 'df1', 2 FROM f UNION ALL SELECT 'df2', df FROM f UNION ALL SELECT 'p_value', round(power(1 + 2 * f / df, -df / 2), 6) FROM f""")
def n5_granger(s, d):
    return shown(metrics(s, N.var(daily(s, d), ["price", "n"], "day", 2).granger("n", "price")), "metric", value=6)


@query(f"""WITH l AS (SELECT day, price AS u, n AS v, {", ".join(f"lag(price, {k}) OVER w AS p{k}, lag(n, {k}) OVER w AS q{k}" for k in range(1, 5))} FROM {DAILY} WINDOW w AS (ORDER BY day) QUALIFY p4 IS NOT NULL), {", ".join(f"{swept(f'a{p}', 'l', LAGS[: 2 * p], 'u')}, {swept(f'b{p}', 'l', LAGS[: 2 * p], 'v')}, x{p} AS (SELECT day, {residual(LAGS[: 2 * p], 'u')} AS e FROM a{p}_r, a{p}), y{p} AS (SELECT day, {residual(LAGS[: 2 * p], 'v')} AS e FROM b{p}_r, b{p})" for p in range(1, 5))},
d AS ({" UNION ALL ".join(f"SELECT {p} AS lag, CAST(count(*) AS DOUBLE) AS n, sum(x.e * x.e) / count(*) AS a, sum(x.e * y.e) / count(*) AS b, sum(y.e * y.e) / count(*) AS c FROM x{p} AS x JOIN y{p} AS y USING (day)" for p in range(1, 5))}), m AS (SELECT *, ln(a * c - b * b) AS ml, 2 * (2 * lag + 1) AS m FROM d)
SELECT lag, round(ml + 2 * m / n, 7) AS aic, round(ml + ln(n) * m / n, 7) AS bic, round(ml + 2 * ln(ln(n)) * m / n, 7) AS hqc, round(exp(ml) * power((n + m / 2) / (n - m / 2), 2), 3) AS fpe FROM m""")
def n6_lag_selection(s, d):
    return shown(N.var_select(daily(s, d), ["price", "n"], "day", 4), "lag", aic=7, bic=7, hqc=7, fpe=3)


@query(f"""WITH RECURSIVE {VAR}, f AS (SELECT 0::BIGINT AS h, u AS u1, v AS v1, p1 AS u2, q1 AS v2 FROM l WHERE day = (SELECT max(day) FROM l) UNION ALL SELECT h + 1, a.b0 + a.b1 * u1 + a.b2 * v1 + a.b3 * u2 + a.b4 * v2, b.b0 + b.b1 * u1 + b.b2 * v1 + b.b3 * u2 + b.b4 * v2, u1, v1 FROM f, a, b WHERE h < 5)
SELECT h AS step, round(u1, 6) AS price, round(v1, 6) AS n FROM f WHERE h > 0""")
def n7_forecast(s, d):
    f = N.var(daily(s, d), ["price", "n"], "day", 2).forecast(5)
    return shown(frame(s, [(h + 1, f[h, 0], f[h, 1]) for h in range(5)], "step long, price double, n double"), "step", price=6, n=6)


def users(s, d):
    return table(s, d, "events").select("user_id", F.col("event_id").alias("t"), "value")


@query()
def n8_garch(s, d):
    return N.garch(users(s, d), "user_id", "t", "value")


@query()
def n9_garch_forecast(s, d):
    fit = {"omega": 0.1, "alpha": 0.1, "beta": 0.8, "gamma": 0.0}
    return s.createDataFrame(N.garch_forecast(fit, 0.5, 1.0, 5))


@query()
def n10_kalman(s, d):
    return N.local_level(users(s, d), "user_id", "t", "value")


@query()
def n11_change_points(s, d):
    shifted = users(s, d).withColumn("value", F.col("value") + F.when(F.col("t") > 5000, 200.0).otherwise(0.0))
    return N.change_points(shifted, "user_id", "t", "value")


@query()
def n12_warping(s, d):
    e = table(s, d, "embeddings")
    return N.dtw(e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("other")))), "embedding", "other").select("vec_id", "dtw")


@query("WITH " + swept("o", f"(SELECT price - lag(price) OVER w AS y, lag(price) OVER w AS x1, lag(price, 1) OVER w - lag(price, 2) OVER w AS x2, lag(price, 2) OVER w - lag(price, 3) OVER w AS x3 FROM {DAILY} WINDOW w AS (ORDER BY day) QUALIFY x3 IS NOT NULL)", ["x1", "x2", "x3"]) + f"SELECT 'statistic' AS metric, round(b1 / sqrt(rss / (n - 4) * {inverse(1, 1)}), 5) AS value FROM o UNION ALL SELECT 'lags', 2 FROM o UNION ALL SELECT 'n', n FROM o")
def n13_adf(s, d):
    r = N.adf(daily(s, d), "price", "day", 2)
    return shown(metrics(s, {k: r[k] for k in ("statistic", "lags", "n")}), "metric", value=5)


KPSS = f"""WITH e AS (SELECT day, price - avg(price) OVER () AS e FROM {DAILY}), c AS (SELECT day, e, sum(e) OVER (ORDER BY day) AS s, lag(e, 1) OVER (ORDER BY day) AS e1, lag(e, 2) OVER (ORDER BY day) AS e2 FROM e)
SELECT round(sum(s * s) / power(count(*), 2) / ((sum(e * e) + 2 * (2.0 / 3 * sum(e * e1) + 1.0 / 3 * sum(e * e2))) / count(*)), 5) AS statistic, count(*) AS n FROM c"""


@query(KPSS)
def n14_kpss(s, d):
    r = N.kpss(daily(s, d), "price", "day", lags=2)
    return frame(s, [(round(r["statistic"], 5), r["n"])], "statistic double, n long")


@query(f"""WITH o AS (SELECT day, price AS y, n AS x FROM {DAILY}), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o), e AS (SELECT day, y - a - b * x AS e FROM o, f), l AS (SELECT e - lag(e) OVER w AS y, lag(e) OVER w AS p, lag(e, 1) OVER w - lag(e, 2) OVER w AS q FROM e WINDOW w AS (ORDER BY day) QUALIFY q IS NOT NULL),
s AS (SELECT sum(p * p) AS a, sum(p * q) AS b, sum(q * q) AS c, sum(p * y) AS u, sum(q * y) AS v, sum(y * y) AS yy, count(*) AS n FROM l), r AS (SELECT *, (u * c - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2 FROM s)
SELECT 'statistic' AS metric, round(b1 / sqrt((yy - b1 * u - b2 * v) / (n - 2) * c / (a * c - b * b)), 5) AS value FROM r UNION ALL SELECT 'beta', round(b, 5) FROM f UNION ALL SELECT 'n', n FROM r""")
def n15_engle_granger(s, d):
    r = N.engle_granger(daily(s, d), "price", "n", "day")
    return shown(metrics(s, {k: r[k] for k in ("statistic", "beta", "n")}), "metric", value=5)


@query()
def n16_johansen(s, d):
    return N.johansen(daily(s, d), ["price", "n"], "day", 2)[0]


@query()
def n17_vecm(s, d):
    return N.vecm(daily(s, d), ["price", "n"], "day", 1, 2)[0]


@query(f"SELECT day, round(price, 5) AS price FROM {DAILY}")
def n18_series_plot(s, d):
    return rounded(N.series_plot(daily(s, d), "day", ["price"]), 5)


# --- O ---------------------------------------------------------------------------------------------------------------------


def durations(s, d):
    """Days from order to shipment as durations; returned items as events."""
    j = line(s, d).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))) % 120
    return j.select(days.alias("time"), (F.col("l_returnflag") != "N").cast("int").alias("event"), "l_linestatus", "l_quantity", (F.col("l_tax") * 100).alias("tax"))


DURATIONS = "(SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 120 AS time, CAST(l_returnflag <> 'N' AS INT) AS event, l_linestatus, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH t AS (SELECT time, count(*) AS n, sum(event) AS d FROM {DURATIONS} GROUP BY 1), r AS (SELECT time, sum(n) OVER (ORDER BY time DESC) AS n_risk, d AS n_event FROM t)
SELECT CAST(time AS DOUBLE) AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event, round(CASE WHEN min(1 - n_event / n_risk::DOUBLE) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk::DOUBLE) END) OVER w) END, 8) AS survival FROM r WINDOW w AS (ORDER BY time)""")
def o1_kaplan_meier(s, d):
    return survival.kaplan_meier(durations(s, d), "time", "event").select("time", "n_risk", "n_event", F.round("survival", 8).alias("survival"))


@query(f"""WITH t AS (SELECT time, count(*) AS n, sum(event) AS d, count(*) FILTER (l_linestatus = 'O') AS na, sum(event) FILTER (l_linestatus = 'O') AS da FROM {DURATIONS} GROUP BY 1), r AS (SELECT CAST(sum(n) OVER w AS DOUBLE) AS n, CAST(d AS DOUBLE) AS d, CAST(sum(na) OVER w AS DOUBLE) AS na, coalesce(da, 0) AS da FROM t WINDOW w AS (ORDER BY time DESC))
SELECT CAST(sum(da) AS DOUBLE) AS observed, round(sum(d * na / n), 4) AS expected, round(power(sum(da) - sum(d * na / n), 2) / sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END), 4) AS statistic FROM r""")
def o2_log_rank(s, d):
    return survival.log_rank_statistics(durations(s, d), "time", "event", "l_linestatus").select("observed", F.round("expected", 4).alias("expected"), F.round("statistic", 4).alias("statistic"))


@query()
def o3_cox(s, d):
    return survival.cox(durations(s, d), "time", "event", ["l_quantity", "tax"])[0]


# --- Q ---------------------------------------------------------------------------------------------------------------------


@query()
def q1_kmeans(s, d):
    return ml.kmeans(table(s, d, "embeddings"), "embedding", 10)[1]


@query()
def q2_tree(s, d):
    own = line(s, d)
    return ml.fit_quality(ml.predictions(ml.tree(own, "l_extendedprice", ["l_quantity", "l_tax"]), own, "l_extendedprice", ["l_quantity", "l_tax"]))


@query()
def q3_boosted_trees(s, d):
    own = table(s, d, "part")
    return ml.fit_quality(ml.predictions(ml.boosted_trees(own, "p_retailprice", ["p_size", "p_partkey"], 5), own, "p_retailprice", ["p_size", "p_partkey"]))


@query()
def q4_factorization_machine(s, d):
    own = table(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_partkey") % 7 / 7).alias("b"), (F.col("p_retailprice") / 1000).alias("y"))
    return ml.fit_quality(ml.predictions(ml.factorization_machine(own, "y", ["a", "b"], rounds=30), own, "y", ["a", "b"]))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e)
SELECT vec_id, round(scale, 10) AS scale, CAST(list_sum(list_transform(v, lambda x: CAST(round(x / scale) AS BIGINT))) AS BIGINT) AS total FROM s""")
def q5_quantize(s, d):
    q = table(s, d, "embeddings").select("vec_id", ml.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 10).alias("scale"), F.aggregate("q.q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


@query(KNN.replace("rank <= 5", "rank <= 10"))
def q6_approximate_neighbours(s, d):
    from ..operators.joins import knn_lsh

    e = table(s, d, "embeddings")
    return rounded(knn_lsh(e, e.where("vec_id % 50 = 0"), 10, width=0.8))


@query()
def q8_registration(s, d):
    p = points(s, d).select(F.col("i").alias("id"), (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))
    q = p.select("id", (0.995 * F.col("x") - 0.0998 * F.col("y") + 0.05).alias("x"), (0.0998 * F.col("x") + 0.995 * F.col("y")).alias("y"))
    rot, move, rmse = ml.icp(p, q, ["x", "y"], rounds=4)
    return frame(s, [(float(rot[0, 0]), float(rot[0, 1]), float(move[0]), float(move[1]), rmse)], "r00 double, r01 double, t0 double, t1 double, rmse double")


@query("SELECT CAST(event_id // 2 AS BIGINT) AS index, round(sum(value) / sqrt(2), 6) AS approximation, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) / sqrt(2), 6) AS detail FROM events GROUP BY 1")
def q9_haar(s, d):
    return rounded(ml.haar_step(table(s, d, "events"), "event_id", "value"))


@query()
def q10_topology(s, d):
    import numpy as np

    x = np.array([[r["n_nationkey"] % 7, r["n_regionkey"]] for r in table(s, d, "nation").orderBy("n_nationkey").collect()], float)
    a, b = ml.betti_numbers(x, 1.0)
    return metrics(s, ml.posterior_persistence(x) | {"components": a, "loops": b})


@query("SELECT 'x' AS name, -9.0::DOUBLE AS value")
def q13_branch_and_bound(s, d):
    _, value, _ = branch_and_bound([-5, -4, -3], [[2, 3, 1], [4, 1, 2]], [5, 11])
    return frame(s, [("x", value)], "name string, value double")


# --- R ---------------------------------------------------------------------------------------------------------------------


def trade(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(line(s, d), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))


TRADE = "(SELECT s_nationkey AS a, c_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"
GRAPH = f"(SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM {TRADE} UNION ALL SELECT b, a, 1.0 FROM {TRADE}) GROUP BY ALL)"


@query(f"SELECT * FROM {GRAPH}")
def r1_build(s, d):
    return graph.build(trade(s, d), "a", "b")


@query(f"""WITH RECURSIVE g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM {GRAPH}), n AS (SELECT DISTINCT src AS node FROM g),
r(step, node, score) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT count(*) FROM n) FROM n UNION ALL SELECT r.step + 1, g.dst, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85 * sum(g.p * r.score) FROM r JOIN g ON g.src = r.node WHERE r.step < 5 GROUP BY r.step, g.dst)
SELECT node, round(score, 7) AS score FROM r WHERE step = 5""")
def r2_pagerank(s, d):
    return rounded(graph.pagerank_fixed(graph.build(trade(s, d), "a", "b"), 5), 7)


@query(f"""WITH RECURSIVE g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM {GRAPH}), n AS (SELECT src AS node, CASE WHEN src IN (0, 1) THEN 1.0::DOUBLE / 2 ELSE 0.0::DOUBLE END AS r FROM g GROUP BY src),
r(step, node, score) AS (SELECT 0, node, r FROM n UNION ALL SELECT r.step + 1, g.dst, 0.15::DOUBLE * max(n.r) + 0.85 * sum(g.p * r.score) FROM r JOIN g ON g.src = r.node JOIN n ON n.node = g.dst WHERE r.step < 10 GROUP BY r.step, g.dst)
SELECT node, round(score, 7) AS score FROM r WHERE step = 10""")
def r3_personalised(s, d):
    return rounded(graph.pagerank(graph.build(trade(s, d), "a", "b"), seeds=[0, 1], rounds=10, tol=0.0), 7)


@query()
def r4_louvain(s, d):
    return graph.louvain(graph.build(trade(s, d), "a", "b"), levels=3, rounds=8)[0]


@query(f"WITH g AS {GRAPH}, k AS (SELECT src AS node, sum(w) AS k FROM g GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM g) SELECT round((SELECT sum(w) FROM g WHERE src % 5 = dst % 5) / m2 - (SELECT sum(q) FROM (SELECT power(sum(k), 2) AS q FROM k GROUP BY node % 5)) / (m2 * m2), 8) AS modularity FROM m")
def r5_modularity(s, d):
    g = graph.build(trade(s, d), "a", "b")
    labels = g.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node") % 5)
    return rounded(graph.modularity(g, labels), 8)


# --- S ---------------------------------------------------------------------------------------------------------------------

NEAR = "(SELECT a.i, b.i AS j, 1 / sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS w FROM {p} a JOIN {p} b ON a.i <> b.i WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 1500 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) > 0)".replace("{p}", "(SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) * 100 AS y FROM supplier)")


def weights(s, d):
    from ..operators.joins import distance_weights

    return distance_weights(points(s, d), "i", ["x", "y"], 1500.0)


def implicit(s, d):
    """The same weights without their table."""
    return spatial.DistanceWeights(points(s, d), "i", ["x", "y"], 1500.0)


@query(f"SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 8) AS w FROM {NEAR}")
def s1_distance_weights(s, d):
    return rounded(weights(s, d), 8)


def suppliers(s, d):
    return points(s, d).withColumn("v", F.col("x") / 1000 + F.col("i") % 5)


@query()
def s3_sar(s, d):
    return spatial.sar(suppliers(s, d), "v", ["y"], implicit(s, d))[0]


@query()
def s4_sem(s, d):
    return spatial.sem(suppliers(s, d), "v", ["y"], implicit(s, d))[0]


@query()
def s5_sdm(s, d):
    return spatial.sdm(suppliers(s, d), "v", ["y"], implicit(s, d))[0]


@query()
def s7_effects(s, d):
    w = implicit(s, d)
    e = spatial.effects(0.3, {"y": 1.0}, w, len(w.ids), terms=4)["y"]
    return metrics(s, e)


@query(f"WITH w AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {NEAR}), v AS (SELECT s_suppkey AS i, s_acctbal / 1000 + s_suppkey % 5 AS v FROM supplier), z AS (SELECT i, v - (SELECT avg(v) FROM v) AS z FROM v) SELECT round((SELECT count(*) FROM z) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM z), 6) AS statistic FROM w JOIN z a ON a.i = w.i JOIN z b ON b.i = w.j")
def s8_moran(s, d):
    return spatial.moran_statistics(suppliers(s, d), "v", weights(s, d)).select(F.round("statistic", 6).alias("statistic"))


@query()
def s8_moran_test(s, d):
    return spatial.moran(suppliers(s, d), "v", implicit(s, d))


@query()
def s9_lm_tests(s, d):
    return spatial.lm_tests(suppliers(s, d), "v", ["y"], implicit(s, d))[0]


# --- T ---------------------------------------------------------------------------------------------------------------------


@query()
def t1_hmc(s, d):
    model = bayes.BayesianLinear(line(s, d), "l_extendedprice", ["l_quantity"])
    return bayes.summarise(model.sample(2, 200, 200))


@query()
def t3_metropolis(s, d):
    import numpy as np

    x, rate = bayes.metropolis_chain(lambda t: -0.5 * float(t @ t), np.zeros(2), 1000, 500)
    return metrics(s, {"mean": x.mean(), "sd": x.std(), "acceptance": rate})


@query()
def t4_variational(s, d):
    return bayes.BayesianLinear(line(s, d), "l_extendedprice", ["l_quantity"]).fit_vi()


@query()
def t5_map(s, d):
    return bayes.BayesianLinear(line(s, d), "l_extendedprice", ["l_quantity"]).fit_map()


@query()
def t6_bayesian_logistic(s, d):
    own = line(s, d).select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_linenumber") / 7).alias("b"))
    return bayes.summarise(bayes.bayesian_logistic(own, "y", ["a", "b"], 2, 150, 150))


SAMPLES = "(SELECT 'v' AS param, l_linenumber AS chain, l_quantity AS value FROM lineitem)"


@query(f"WITH c AS (SELECT chain, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, var_samp(value) AS v FROM {SAMPLES} GROUP BY 1), g AS (SELECT avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c) SELECT 'v' AS param, round(sqrt(((n - 1) / n * w + b) / w), 8) AS r_hat FROM g")
def t2_r_hat(s, d):
    own = line(s, d).select(F.lit("v").alias("param"), F.col("l_linenumber").alias("chain"), F.col("l_quantity").alias("value"))
    return rounded(bayes.r_hat(own), 8)


# --- U ---------------------------------------------------------------------------------------------------------------------


@query()
def u1_bootstrap(s, d):
    return resampling.bootstrap_mean(line(s, d).withColumn("k", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey")), "l_quantity", "k", 50)


@query()
def u1_bootstrap_any(s, d):
    import numpy as np

    return resampling.bootstrap(table(s, d, "part"), ["p_retailprice"], lambda x: float(np.median(x)), 100)


@query()
def u2_block_bootstrap(s, d):
    import numpy as np

    return resampling.block_bootstrap(daily(s, d), ["price"], lambda x: float(np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1]), 20, "day", 100)


@query("SELECT 'mean' AS statistic, round(avg(l_quantity), 6) AS estimate, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) AS std_error, round(avg(l_quantity), 5) AS corrected FROM lineitem")
def u3_jackknife(s, d):
    r = resampling.jackknife_mean_variance(line(s, d), "l_quantity").where("statistic = 'mean'")
    return r.select("statistic", F.round("estimate", 6).alias("estimate"), F.round("std_error", 8).alias("std_error"), F.round("corrected", 5).alias("corrected"))


@query()
def u4_bca(s, d):
    import numpy as np

    x = table(s, d, "supplier").orderBy("s_suppkey").toPandas()["s_acctbal"].to_numpy()
    j = resampling.jackknife(x, np.mean)
    draws = np.array([np.random.RandomState(i).choice(x, len(x)).mean() for i in range(200)])
    low, high = resampling.bca_interval(j["estimate"], draws, j["values"])
    return frame(s, [(j["estimate"], low, high)], "estimate double, lower double, upper double")


# --- W and X --------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def w1_windowed(s, d):
    out = W.windowed(table(s, d, "events"), "ts", "value", ["event_type"], "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def w2_sessions(s, d):
    return W.sessions(table(s, d, "events"), "ts", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS value FROM lineitem GROUP BY 1")
def x1_user_aggregate(s, d):
    r = Registry()
    r.aggregate("middle", "double")(lambda x: float(x.median()))
    return r.group(line(s, d), "l_returnflag", "middle", "l_quantity")


@query("SELECT p_partkey, round(p_retailprice * 2, 4) AS v FROM part")
def x5_user_function(s, d):
    r = Registry()

    @r.scalar("twice", "double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    r.install(s)
    return table(s, d, "part").select("p_partkey", F.round(F.call_function("twice", F.col("p_retailprice")), 4).alias("v"))
