"""Causal inference, mediation, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.result import frame, metrics
from ..operators import causal as M
from ..operators import governance as V
from ..operators import linear, mediation, panel
from ..registry import query, table
from .foundation import BALANCES, line, rounded, shown
from .sqlfit import inverse, residual, shares, swept

#: Two-stage least squares: the first stage (x1, x2 instruments, x3 exogenous), the second on its fitted values z, and the rows
#: with structural residuals e and what they add to a coefficient.
FIRST = swept("f", "(SELECT l_discount AS x1, l_linenumber AS x2, l_tax AS x3, l_quantity AS x4, l_extendedprice AS y FROM lineitem)", ["x1", "x2", "x3"], "x4")
SECOND = swept("s", "(SELECT f_r.*, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS z FROM f_r, f)", ["z", "x3"]) + f", u AS (SELECT x1, x2, x3, b0, b1, b2, {residual(['x4', 'x3'])} AS e, {', '.join(f'{c} AS c{i}' for i, c in enumerate(shares(['z', 'x3'])))} FROM s_r, s)"


@query("SELECT round(covar_samp(l_discount, l_extendedprice) / covar_samp(l_discount, l_quantity) / 1e6, 6) AS estimate_m, count(*) AS n FROM lineitem")
def m1_iv_wald(s, d):
    return M.wald_ratio(line(s, d), "l_extendedprice", "l_quantity", "l_discount").select(F.round(F.col("estimate") / 1e6, 6).alias("estimate_m"), "n")


@query("SELECT round(covar_samp(l_discount, l_extendedprice) / covar_samp(l_discount, l_quantity) / 1e6, 6) AS estimate_m FROM lineitem")
def m1_two_stage(s, d):
    t, _ = M.iv(line(s, d), "l_extendedprice", ["l_quantity"], ["l_discount"])
    return t.where("term = 'l_quantity'").select(F.round(F.col("estimate") / 1e6, 6).alias("estimate_m"))


@query(f"""WITH {FIRST}, {SECOND}, {swept("g", "(SELECT x3, x4 FROM f_r)", ["x3"], "x4")}, {swept("a", "(SELECT x1, x2, x3, e AS y FROM u)", ["x1", "x2", "x3"])}, k AS (SELECT sum(e * e) AS rss, count(*) AS n FROM u), i AS (SELECT (g.rss - f.rss) / 2 / (f.rss / (f.n - 4)) AS f FROM f, g)
SELECT 'n' AS metric, CAST(n AS DOUBLE) AS value FROM k UNION ALL SELECT 'sigma', round(sqrt(rss / (n - 3)), 3) FROM k UNION ALL SELECT 'r2', round(1 - k.rss / s.tss, 6) FROM k, s UNION ALL SELECT 'first_stage_f_l_quantity', round(f, 6) FROM i UNION ALL SELECT 'weak_instruments', CAST(f < 10 AS DOUBLE) FROM i UNION ALL SELECT 'sargan', round(n * (1 - rss / tss), 6) FROM a""")
def m2_first_stage(s, d):
    m = M.iv(line(s, d), "l_extendedprice", ["l_quantity"], ["l_discount", "l_linenumber"], ["l_tax"])[1]
    return metrics(s, {k: round(float(v), 3 if k == "sigma" else 6) for k, v in m.items() if k != "sargan_p_value"})


@query(f"""WITH {FIRST}, {SECOND}, k AS (SELECT unnest(['intercept', 'l_quantity', 'l_tax']) AS term, unnest([max(b0), max(b1), max(b2)]) AS b, unnest([{", ".join(f"sqrt(sum(power(c{i} * e, 2)) * count(*) / (count(*) - 3))" for i in range(3))}]) AS se FROM u)
SELECT term, round(b, 1) AS estimate, round(se, 1) AS std_error, round(b / se, 4) AS statistic FROM k""")
def m3_two_stage_robust(s, d):
    return shown(M.iv(line(s, d), "l_extendedprice", ["l_quantity"], ["l_discount", "l_linenumber"], ["l_tax"], robust=True)[0], "term", estimate=1, std_error=1, statistic=4)


def events(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "value", "user_id", (F.col("user_id") % 2).alias("treated"), (F.dayofmonth("ts") > 15).cast("int").alias("post"), F.dayofmonth("ts").alias("day"))


EVENTS = "(SELECT value, user_id % 2 AS treated, CAST(day(ts) > 15 AS INT) AS post, day(ts) AS day FROM events)"
DID = f"SELECT round(avg(value) FILTER (treated = 1 AND post = 1) - avg(value) FILTER (treated = 1 AND post = 0) - avg(value) FILTER (treated = 0 AND post = 1) + avg(value) FILTER (treated = 0 AND post = 0), 6) AS att FROM {EVENTS}"


@query(DID)
def m4_did_means(s, d):
    return M.did_means(events(s, d), "value", "treated", "post").select(F.round("att", 6).alias("att"))


@query(DID)
def m5_did_regression(s, d):
    t, _ = M.did(events(s, d), "value", "treated", "post")
    return t.where("term = 'treated:post'").select(F.round("estimate", 6).alias("att"))


@query("WITH " + swept("o", f"(SELECT treated, day, treated * day AS td, value AS y FROM {EVENTS} WHERE day < 15)", ["treated", "day", "td"]) + f"SELECT 'treated:day' AS term, round(b3, 6) AS estimate, round(sqrt(rss / (n - 4) * {inverse(3, 3)}), 6) AS std_error, round(b3 / sqrt(rss / (n - 4) * {inverse(3, 3)}), 5) AS statistic FROM o")
def m6_did_pretrend(s, d):
    return shown(M.did_pretrend(events(s, d), "value", "treated", "day", 15), "term", estimate=6, std_error=6, statistic=5)


def user_days(s, d):
    e = events(s, d).groupBy("user_id", "day").agg(F.avg("value").alias("value"))
    start = F.when(F.col("user_id") % 3 == 0, 10).when(F.col("user_id") % 3 == 1, 20)
    return e.withColumn("start", start).withColumn("d", F.coalesce((F.col("day") >= F.col("start")).cast("int"), F.lit(0)))


@query()
def m7_two_way_effect(s, d):
    return M.two_way_effect(user_days(s, d), "value", "d", "user_id", "day")[0]


@query()
def m8_event_study(s, d):
    return M.event_study(user_days(s, d), "value", "user_id", "day", "start", 3, 3)


def treated(s, d):
    """Orders: urgent ones as treated, a given score between 0.2 and 0.8."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("t"), (0.2 + 0.6 * (F.col("o_custkey") % 101) / 101.0).alias("ps"), (F.col("o_custkey") % 101).cast("double").alias("x"))


TREATED = "(SELECT o_orderkey, o_totalprice / 1000 AS y, CAST(o_orderpriority = '1-URGENT' AS INT) AS t, 0.2 + 0.6 * (o_custkey % 101) / 101.0::DOUBLE AS ps, CAST(o_custkey % 101 AS DOUBLE) AS x FROM orders)"


@query(f"SELECT count(*) AS n, 0.0::DOUBLE AS score_0, 0.0::DOUBLE AS score_x FROM {TREATED}")
def m9_propensity(s, d):
    """The maximum of the likelihood, by its score equations: residuals sum to 0, and so do their products with x."""
    e = F.col("t") - F.col("ps")
    r = M.propensity(treated(s, d).drop("ps"), "t", ["x"]).agg(F.count("*").alias("n"), F.avg(e).alias("score_0"), F.avg(e * F.col("x")).alias("score_x"))
    return r.select("n", *[F.abs(F.round(c, 6)).alias(c) for c in ("score_0", "score_x")])


@query(f"""WITH o AS (SELECT * FROM {TREATED}), c AS (SELECT ps, min(o_orderkey) AS id FROM o WHERE t = 0 GROUP BY ps), m AS (SELECT a.o_orderkey, a.y, (SELECT id FROM c WHERE abs(c.ps - a.ps) < 1e-12) AS id FROM o a WHERE t = 1)
SELECT count(*) AS n, round(avg(m.y - o.y), 5) AS att FROM m JOIN o ON o.o_orderkey = m.id""")
def m10_matching_att(s, d):
    m = M.match_outcomes(treated(s, d), "o_orderkey", "y", "t", "ps").where("t = 1")
    return m.agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("counterfactual")), 5).alias("att"))


@query()
def m10_psm(s, d):
    return M.psm(treated(s, d), "o_orderkey", "y", "t", ["x"])


@query(f"""WITH o AS (SELECT *, s / 100 + 2 * t + id % 7 AS y FROM {BALANCES}), p AS (SELECT a.id, a.y, b.y AS cy, 1.0::DOUBLE AS w FROM o AS a JOIN o AS b ON a.t = 1 AND b.t = 0 AND abs(a.s - b.s) <= 50), k AS (SELECT max(y) - sum(w * cy) / sum(w) AS d FROM p GROUP BY id HAVING sum(w) > 0)
SELECT 'ATT' AS estimand, round(avg(d), 7) AS estimate, round(stddev_samp(d) / sqrt(count(*)), 7) AS std_error, count(*) AS n FROM k""")
def m11_radius_matching(s, d):
    return shown(M.psm_weighted(balances_outcome(s, d), "id", "y", "t", "s", "radius", 50.0), "estimand", "n", estimate=7, std_error=7)


@query(f"""WITH o AS (SELECT *, s / 100 + 2 * t + id % 7 AS y FROM {BALANCES}), p AS (SELECT a.id, a.y, b.y AS cy, 0.75::DOUBLE * (1 - power((a.s - b.s) / 50, 2)) AS w FROM o AS a JOIN o AS b ON a.t = 1 AND b.t = 0 AND abs(a.s - b.s) <= 50), k AS (SELECT max(y) - sum(w * cy) / sum(w) AS d FROM p GROUP BY id HAVING sum(w) > 0)
SELECT 'ATT' AS estimand, round(avg(d), 7) AS estimate, round(stddev_samp(d) / sqrt(count(*)), 7) AS std_error, count(*) AS n FROM k""")
def m11_kernel_matching(s, d):
    return shown(M.psm_weighted(balances_outcome(s, d), "id", "y", "t", "s", "kernel", 50.0), "estimand", "n", estimate=7, std_error=7)


def balances_outcome(s, d):
    from .foundation import balances

    return balances(s, d).withColumn("y", F.col("s") / 100 + 2 * F.col("t") + F.col("id") % 7)


@query(f"SELECT 'y' AS variable, round(avg(y) FILTER (t = 1), 6) AS mean_treated, round(avg(y) FILTER (t = 0), 6) AS mean_control, round((avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0)) / sqrt((var_pop(y) FILTER (t = 1) + var_pop(y) FILTER (t = 0)) / 2), 6) AS smd FROM {TREATED}")
def m12_balance(s, d):
    return rounded(M.balance(treated(s, d), "t", ["y"]))


@query(f"""WITH o AS (SELECT *, ps / (1 - ps) AS o FROM {TREATED}), r AS (SELECT sum(t * y) / sum(t) - sum((1 - t) * o * y) / sum((1 - t) * o) AS att, sum(t * y / o) / sum(t / o) - sum((1 - t) * y) / sum(1 - t) AS atc, avg(t * y / ps - (1 - t) * y / (1 - ps)) AS ate, count(*) AS n FROM o)
SELECT 'ATT' AS estimand, round(att, 5) AS estimate, n FROM r UNION ALL SELECT 'ATC', round(atc, 5), n FROM r UNION ALL SELECT 'ATE', round(ate, 5), n FROM r""")
def m13_ipw(s, d):
    return rounded(M.ipw(treated(s, d), "y", "t", "ps"), 5)


@query(f"""WITH o AS (SELECT *, 1 - t AS c, ps / (1 - ps) AS o FROM {TREATED}), m AS (SELECT sum(t * y) / sum(t) AS t1, sum(c * o * y) / sum(c * o) AS c1, sum(t * y / o) / sum(t / o) AS t0, sum(c * y) / sum(c) AS c0, avg(t) AS s1, avg(c * o) AS so, avg(t / o) AS si, avg(c) AS s0, avg(t * y / ps - c * y / (1 - ps)) AS ate FROM o),
p AS (SELECT stddev_samp(t * (y - t1) / s1 - c * o * (y - c1) / so) AS a, stddev_samp(t / o * (y - t0) / si - c * (y - c0) / s0) AS b, stddev_samp(t * y / ps - c * y / (1 - ps)) AS e, max(t1 - c1) AS att, max(t0 - c0) AS atc, max(ate) AS ate, count(*) AS n FROM o, m), k AS (SELECT unnest(['ATT', 'ATC', 'ATE']) AS estimand, unnest([att, atc, ate]) AS b, unnest([a, b, e]) / sqrt(n) AS se, n FROM p)
SELECT estimand, round(b, 5) AS estimate, round(se, 5) AS std_error, round(b - 1.959963984540054 * se, 5) AS ci_lower, round(b + 1.959963984540054 * se, 5) AS ci_upper, n FROM k""")
def m13_ipw_effects(s, d):
    return shown(M.ipw_effects(treated(s, d), "y", "t", "ps"), "estimand", "n", estimate=5, std_error=5, ci_lower=5, ci_upper=5)


@query(f"""WITH o AS (SELECT *, ps / (1 - ps) AS o FROM {TREATED}), f AS (SELECT regr_slope(y, x) FILTER (t = 1) AS b1, regr_intercept(y, x) FILTER (t = 1) AS a1, regr_slope(y, x) FILTER (t = 0) AS b0, regr_intercept(y, x) FILTER (t = 0) AS a0, avg(t) AS q FROM o),
i AS (SELECT *, a1 + b1 * x - a0 - b0 * x + t * (y - a1 - b1 * x) / ps - (1 - t) * (y - a0 - b0 * x) / (1 - ps) AS e, (t - (1 - t) * o) * (y - a0 - b0 * x) AS g FROM o, f), a AS (SELECT avg(g) / max(q) AS att FROM i),
k AS (SELECT 'ATE' AS estimand, avg(e) AS b, stddev_samp(e) / sqrt(count(*)) AS se, count(*) AS n FROM i UNION ALL SELECT 'ATT', max(att), stddev_samp((g - t * att) / q) / sqrt(count(*)), count(*) FROM i, a)
SELECT estimand, round(b, 5) AS estimate, round(se, 5) AS std_error, round(b - 1.959963984540054 * se, 5) AS ci_lower, round(b + 1.959963984540054 * se, 5) AS ci_upper, n FROM k""")
def m14_aipw(s, d):
    return shown(M.aipw(treated(s, d), "y", "t", ["x"], "ps"), "estimand", "n", estimate=5, std_error=5, ci_lower=5, ci_upper=5)


@query()
def m15_covariate_matching(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("t"), F.col("c_nationkey").cast("double").alias("a"), (F.col("c_custkey") % 37).cast("double").alias("b"))
    return M.covariate_matching(own, "id", "y", "t", ["a", "b"])


@query("""WITH o AS (SELECT p_size - 25 AS x, p_retailprice AS y FROM part WHERE abs(p_size - 25) <= 15), f AS (SELECT x >= 0 AS side, regr_intercept(y, x) AS a FROM o GROUP BY 1) SELECT round((SELECT a FROM f WHERE side) - (SELECT a FROM f WHERE NOT side), 5) AS estimate""")
def m16_rdd(s, d):
    j = M.rdd(table(s, d, "part"), "p_retailprice", "p_size", 25, 15.0, "uniform")
    return frame(s, [(round(j.estimate, 5),)], "estimate double")


@query()
def m17_rdd_bandwidth(s, d):
    p = table(s, d, "part")
    return M.rdd_table(p, M.rdd(p, "p_retailprice", "p_size", 25, order=2))


@query("SELECT count(*) FILTER (p_size BETWEEN 20 AND 24) AS below, count(*) FILTER (p_size BETWEEN 25 AND 30) AS above FROM part")
def m18_manipulation(s, d):
    return M.manipulation_test(table(s, d, "part"), "p_size", 25, 5).select("below", "above")


@query("WITH p AS (SELECT p_retailprice AS y, CAST(p_size >= 25 AND p_partkey % 5 <> 0 AS DOUBLE) AS d, CAST(p_size >= 25 AS DOUBLE) AS t, p_size - 25 AS x, 1 - abs(p_size - 25) / 15.0::DOUBLE AS w FROM part WHERE abs(p_size - 25) < 15), " + swept("o", "p", ["t", "x"], weight="w") + ", " + swept("f", "p", ["t", "x"], "d", weight="w") + f""", j AS (SELECT o.b1 / f.b1 AS late, f.b1 AS first, o.b0 - o.b1 / f.b1 * f.b0 AS c0, o.b2 - o.b1 / f.b1 * f.b2 AS c2 FROM o, f),
e AS (SELECT w * {shares(["t", "x"])[1]} * (y - c0 - late * d - c2 * x) / first AS u, late, first FROM o_r, j, o)
SELECT unnest(['late', 'std_error', 'first_stage', 'n']) AS metric, round(unnest([max(late), sqrt(sum(u * u)), max(first), count(*)]), 6) AS value FROM e""")
def m19_fuzzy_rdd(s, d):
    p = table(s, d, "part").withColumn("d", ((F.col("p_size") >= 25) & (F.col("p_partkey") % 5 != 0)).cast("double"))
    return shown(metrics(s, M.fuzzy_rdd(p, "p_retailprice", "d", "p_size", 25, 15.0)), "metric", value=6)


def regions(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("unit"), panel.period_column(F.col("o_orderdate"), "year").alias("t"), (F.col("o_totalprice") / 1000).alias("y"))


@query()
def m20_synthetic_control(s, d):
    own = regions(s, d)
    mid = own.agg(F.percentile("t", 0.6)).first()[0]
    return M.synthetic_control(own, "unit", "t", "y", 0, mid)[0]


@query()
def m21_placebo(s, d):
    own = regions(s, d)
    mid = own.agg(F.percentile("t", 0.6)).first()[0]
    return M.placebo(own, "unit", "t", "y", 0, mid)[0]


@query()
def m22_generalised_synthetic(s, d):
    own = regions(s, d)
    mid = own.agg(F.percentile("t", 0.6)).first()[0]
    return M.generalised_synthetic(own, "unit", "t", "y", [0, 1], mid, reps=50)[0]


@query("WITH h AS (SELECT 8.0::DOUBLE * (0.2::DOUBLE + 2.8::DOUBLE * i / 19.0::DOUBLE) AS h FROM range(20) AS t(i)), r AS (SELECT h, p_size - 25 AS x, CAST(p_size >= 25 AS DOUBLE) AS t, CAST(p_size >= 25 AS DOUBLE) * (p_size - 25) AS tx, p_retailprice AS y, 1 - abs(p_size - 25) / h AS w FROM part, h WHERE abs(p_size - 25) < h QUALIFY min(p_size) FILTER (p_size >= 25) OVER (PARTITION BY h) < max(p_size) FILTER (p_size >= 25) OVER (PARTITION BY h) AND min(p_size) FILTER (p_size < 25) OVER (PARTITION BY h) < max(p_size) FILTER (p_size < 25) OVER (PARTITION BY h)), " + swept("o", "r", ["t", "x", "tx"], by="h", weight="w") + f" SELECT round(h, 6) AS bandwidth, round(b1, 5) AS estimate, round(sqrt(rss / (n - 4) * {inverse(1, 1)}), 5) AS std_error, CAST(n AS BIGINT) AS n FROM o")
def m24_manifold(s, d):
    return shown(M.manifold(table(s, d, "part"), "p_retailprice", "p_size", 25, 8.0), "n", bandwidth=6, estimate=5, std_error=5)


# --- P ---------------------------------------------------------------------------------------------------------------------


@query("SELECT 'l_extendedprice' AS equation, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_tax', round(regr_slope(l_tax, l_quantity) * 1e6, 4) FROM lineitem")
def p1_path_analysis(s, d):
    t = mediation.path_analysis(line(s, d), ["l_extendedprice ~ l_quantity", "l_tax ~ l_quantity"]).where("term = 'l_quantity'")
    return t.select("equation", F.round(F.col("estimate") * F.when(F.col("equation") == "l_tax", 1e6).otherwise(1.0), 4).alias("estimate"))


@query("SELECT round(regr_slope(l_discount, l_quantity) * 1e6, 4) AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS c FROM lineitem")
def p2_mediation(s, d):
    t = {r["effect"]: r["estimate"] for r in mediation.mediation(line(s, d), "l_extendedprice", "l_quantity", "l_discount", "l_orderkey").collect()}
    return frame(s, [(round(t["a"] * 1e6, 4), round(t["c"], 4))], "a double, c double")


@query()
def p2_mediation_bootstrap(s, d):
    return mediation.mediation(line(s, d), "l_extendedprice", "l_quantity", "l_discount", "l_orderkey", reps=40)


# --- V ---------------------------------------------------------------------------------------------------------------------


@query("SELECT 0.9::DOUBLE AS fit, 0.96::DOUBLE AS topology, 1.0::DOUBLE AS geometry, round(0.4 * 0.9 + 0.3 * 0.96 + 0.3, 6)::DOUBLE AS score")
def v1_credibility(s, d):
    one = s.range(1).select(V.credibility(F.lit(0.9), F.lit(5.0), F.lit(0.1), F.lit(1.0)).alias("c")).select("c.*")
    return one.select("fit", F.round("topology", 6).alias("topology"), "geometry", F.round("score", 6).alias("score"))


@query()
def v3_critique(s, d):
    fit = linear.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    v = V.critique(V.ols_metrics(fit))
    return frame(s, [(v.score, v.accepted, "; ".join(v.messages), v.next_action)], "score double, accepted boolean, messages string, next_action string")


@query("SELECT id, CASE WHEN r2 < 0.3 THEN 'the model explains little of the outcome' WHEN r2 < 0.6 THEN 'the model explains part of the outcome' ELSE '' END AS message FROM (VALUES (1, 0.1), (2, 0.5), (3, 0.9)) AS t(id, r2)")
def v4_messages(s, d):
    return frame(s, [(1, 0.1), (2, 0.5), (3, 0.9)], "id int, r2 double").select("id", V.messages_column(F.col("r2")).alias("message"))


@query("SELECT step, round(score - lag(score) OVER (ORDER BY step), 6)::DOUBLE AS change, step >= 4 AS stagnant FROM (VALUES (1, 0.2), (2, 0.5), (3, 0.505), (4, 0.507)) AS t(step, score)")
def v5_history(s, d):
    h = frame(s, [(1, 0.2), (2, 0.5), (3, 0.505), (4, 0.507)], "step int, score double")
    return V.stagnation(h, "step", "score").select("step", F.round("change", 6).alias("change"), "stagnant")


@query()
def v6_counter_intuitive(s, d):
    found = V.counter_intuitive({"r2": 0.9, "invariant_ratio": 0.3}, [1.0, 0.4, -0.2])
    return frame(s, [(x,) for x in found], "finding string")


@query("SELECT h, round((lead(e) OVER (ORDER BY h) - e) / (lead(h) OVER (ORDER BY h) - h), 6)::DOUBLE AS slope FROM (VALUES (1.0::DOUBLE, 2.0), (2.0, 2.5), (4.0, 1.0)) AS t(h, e)")
def v7_gradients(s, d):
    m = frame(s, [(1.0, 2.0), (2.0, 2.5), (4.0, 1.0)], "h double, e double")
    return V.gradients(m, "h", "e").select("h", F.round("slope", 6).alias("slope"))


@query("SELECT l_orderkey, l_linenumber, round(b * 5, 4) AS delta FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)")
def v8_what_if(s, d):
    fit = linear.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    out = V.what_if(line(s, d), fit.prediction(), {"l_quantity": lambda c: c + 5}, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("delta", 4).alias("delta"))


@query()
def v9_narrative(s, d):
    fit = linear.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    return frame(s, [(V.narrative(V.FitAdapter(fit, "l_extendedprice")),)], "text string")


@query()
def v11_quickstart(s, d):
    fit, verdict = V.quickstart(line(s, d).select("l_extendedprice", "l_quantity", "l_tax"), "l_extendedprice")
    return frame(s, [(verdict.score, fit.n)], "score double, n long")


@query()
def v14_script(s, d):
    return frame(s, [(V.script("ols", y="l_extendedprice", x=["l_quantity"]),)], "script string")
