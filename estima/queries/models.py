"""Linear, generalized linear and panel models, and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.result import frame, metrics
from ..operators import diagnostics as K
from ..operators import glm as J
from ..operators import linear as I
from ..operators import panel as L
from ..registry import query, table
from .foundation import line, rounded, shown
from .sqlfit import inverse, leverage, residual, shares, swept

X = ["l_quantity", "l_discount", "l_tax"]


def ols(s, d):
    return I.ols(line(s, d), "l_extendedprice", X)


def coefficient(fit, digits: int = 4):
    return [(t, round(float(b), digits)) for t, b in zip(fit.terms, fit.beta)]


#: The normal equations of three centred regressors by cofactors, with the residual variance; z and the first terms of its
#: expansion in 1 / df give the t quantile.
THREE_X = """WITH m AS (SELECT covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, covar_pop(x3, y) AS r, var_pop(y) AS v, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem)),
g AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
i AS (SELECT *, (d * f - e * e) / det AS i11, (c * e - b * f) / det AS i12, (b * e - c * d) / det AS i13, (a * f - c * c) / det AS i22, (b * c - a * e) / det AS i23, (a * d - b * b) / det AS i33 FROM g),
s AS (SELECT *, i11 * p + i12 * q + i13 * r AS b1, i12 * p + i22 * q + i23 * r AS b2, i13 * p + i23 * q + i33 * r AS b3, CAST(1.959963984540054 AS DOUBLE) AS z FROM i),
o AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, (v - b1 * p - b2 * q - b3 * r) * n AS rss, (v - b1 * p - b2 * q - b3 * r) * n / (n - 4) AS s2,
  z + (z * z * z + z) / (4 * (n - 4)) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * power(n - 4, 2)) AS t,
  m1 * (i11 * m1 + i12 * m2 + i13 * m3) + m2 * (i12 * m1 + i22 * m2 + i23 * m3) + m3 * (i13 * m1 + i23 * m2 + i33 * m3) AS h0 FROM s),
k AS (SELECT 'intercept' AS term, b0 AS b, sqrt(s2 * (1 + h0) / n) AS se, t FROM o UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * i11 / n), t FROM o UNION ALL SELECT 'l_discount', b2, sqrt(s2 * i22 / n), t FROM o UNION ALL SELECT 'l_tax', b3, sqrt(s2 * i33 / n), t FROM o)
"""


@query(THREE_X + "SELECT term, round(b, 2) AS estimate, round(se, 4) AS std_error, round(b / se, 4) AS statistic, round(b - t * se, 2) AS ci_lower, round(b + t * se, 2) AS ci_upper FROM k")
def i1_ols(s, d):
    t = ols(s, d).table(s)
    return t.select("term", *[F.round(c, k).alias(c) for c, k in (("estimate", 2), ("std_error", 4), ("statistic", 4), ("ci_lower", 2), ("ci_upper", 2))])


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*) AS n FROM lineitem")
def i1_simple_regression(s, d):
    fit = I.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    m = fit.metrics()
    return frame(s, [(round(float(fit.beta[1]), 4), round(float(fit.beta[0]), 2), round(m["r2"], 8), fit.n)], "slope double, intercept double, r2 double, n long")


#: The normal equations of two centred regressors, solved by Cramer's rule.
TWO_X = """WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, covar_pop(l_tax, l_tax) AS d, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_tax, l_extendedprice) AS q, avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_extendedprice) AS my, var_pop(l_extendedprice) AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem),
s AS (SELECT *, (p * d - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2 FROM c)
"""


@query(TWO_X + "SELECT round(my - b1 * mq - b2 * mt, 2) AS intercept, round(b1, 4) AS quantity, round(b2, 2) AS tax, round((v - b1 * p - b2 * q) * n / (n - 3) / 1e6, 4) AS sigma2_m FROM s")
def i1_two_regressors(s, d):
    fit = I.ols(line(s, d), "l_extendedprice", ["l_quantity", "l_tax"])
    b = fit.beta
    return frame(s, [(round(float(b[0]), 2), round(float(b[1]), 4), round(float(b[2]), 2), round(fit.sigma2 / 1e6, 4))], "intercept double, quantity double, tax double, sigma2_m double")


@query(THREE_X + """, w AS (SELECT n, 1 - rss / (v * n) AS r2, sqrt(s2) AS rse, (v * n - rss) / 3 / s2 AS f, -n / 2 * (ln(2 * pi() * rss / n) + 1) AS ll FROM o)
SELECT n, 4.0::DOUBLE AS k, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 4), 8) AS adj_r2, round(rse, 4) AS rse, round(f, 2) AS f_stat, round(ll, 2) AS loglik, round(-2 * ll + 10, 2) AS aic, round(-2 * ll + ln(n) * 5, 2) AS bic FROM w""")
def i1_ols_metrics(s, d):
    m = ols(s, d).metrics()
    digits = {"n": 0, "k": 0, "r2": 8, "adj_r2": 8, "rse": 4, "f_stat": 2, "loglik": 2, "aic": 2, "bic": 2}
    return frame(s, [tuple(round(float(m[c]), k) for c, k in digits.items())], ", ".join(f"{c} double" for c in digits))


@query("SELECT round((sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / (sum(w * x * x) * sum(w) - power(sum(w * x), 2)), 3) AS slope FROM (SELECT l_quantity AS w, l_tax * 100 AS x, l_extendedprice AS y FROM lineitem)")
def i3_weighted(s, d):
    fit = I.ols(line(s, d), "l_extendedprice", {"x": F.col("l_tax") * 100}, "l_quantity")
    return frame(s, [(round(float(fit.beta[1]), 3),)], "slope double")


@query("SELECT l_orderkey, l_linenumber, round(regr_intercept + regr_slope * l_quantity, 3) AS prediction FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS regr_intercept, regr_slope(l_extendedprice, l_quantity) AS regr_slope FROM lineitem)")
def i4_predict(s, d):
    fit = I.ols(line(s, d), "l_extendedprice", ["l_quantity"])
    return I.predict(line(s, d), fit).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(THREE_X + """, h AS (SELECT l_orderkey, l_linenumber, b0 + b1 * l_quantity + b2 * l_discount + b3 * l_tax AS prediction, l_quantity - m1 AS u1, l_discount - m2 AS u2, l_tax - m3 AS u3, o.* FROM lineitem, o),
j AS (SELECT *, t * sqrt(s2 * (1 + (1 + u1 * u1 * i11 + u2 * u2 * i22 + u3 * u3 * i33 + 2 * (u1 * u2 * i12 + u1 * u3 * i13 + u2 * u3 * i23)) / n)) AS half FROM h)
SELECT l_orderkey, l_linenumber, round(prediction, 2) AS prediction, round(prediction - half, 2) AS lower, round(prediction + half, 2) AS upper FROM j""")
def i5_predict_interval(s, d):
    out = I.predict_interval(line(s, d), ols(s, d))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in ("prediction", "lower", "upper")])


@query("WITH c AS (SELECT sum(x * x) + 10 AS a, sum(x * z) AS b, sum(z * z) + 10 AS d, sum(x * y) AS p, sum(z * y) AS q FROM (SELECT l_quantity AS x, l_tax * 100 AS z, l_extendedprice AS y FROM lineitem)) SELECT round((p * d - b * q) / (a * d - b * b), 4) AS x, round((a * q - b * p) / (a * d - b * b), 4) AS z FROM c")
def i6_ridge(s, d):
    own = line(s, d).select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("z"), F.col("l_extendedprice").alias("y"))
    b = I.ridge(own, "y", ["x", "z"], 10.0)
    return frame(s, [(round(b["x"], 4), round(b["z"], 4))], "x double, z double")


@query()
def i7_ridge_cv(s, d):
    return I.ridge_cv(line(s, d), "l_extendedprice", X, "l_orderkey")


@query()
def i8_lasso(s, d):
    return metrics(s, I.lasso(line(s, d), "l_extendedprice", X, 1e6))


@query()
def i9_elastic_net(s, d):
    return metrics(s, I.elastic_net(line(s, d), "l_extendedprice", X, 0.1))


@query()
def i10_quantile(s, d):
    return I.quantile(table(s, d, "part"), "p_retailprice", ["p_size"], 0.5)[0]


@query()
def i11_quantile_process(s, d):
    return I.quantile_process(table(s, d, "part"), "p_retailprice", ["p_size"], [0.25, 0.75])


@query()
def i12_huber(s, d):
    return metrics(s, I.huber(table(s, d, "part"), "p_retailprice", ["p_size"]))


@query("SELECT round((c11 + c22) / 2 + sqrt(power((c11 - c22) / 2, 2) + c12 * c12), 5) AS first FROM (SELECT covar_samp(l_quantity, l_quantity) AS c11, covar_samp(z, z) AS c22, covar_samp(l_quantity, z) AS c12 FROM (SELECT l_quantity, l_tax * 100 AS z FROM lineitem))")
def i13_pca(s, d):
    own = line(s, d).select("l_quantity", (F.col("l_tax") * 100).alias("z"))
    return I.pca(own, ["l_quantity", "z"])[0].where("component = 1").groupBy().agg(F.round(F.max("variance"), 5).alias("first"))


@query("SELECT model, aic, aic - min(aic) OVER () AS delta_aic, round(exp(-(aic - min(aic) OVER ()) / 2) / sum(exp(-(aic - m) / 2)) OVER (), 8) AS weight FROM (SELECT *, min(aic) OVER () AS m FROM (VALUES ('a', 10.0::DOUBLE), ('b', 12.0::DOUBLE), ('c', 15.5::DOUBLE)) AS t(model, aic))")
def i14_compare(s, d):
    return I.akaike(frame(s, [("a", 10.0), ("b", 12.0), ("c", 15.5)], "model string, aic double")).withColumn("weight", F.round("weight", 8))


# --- J -------------------------------------------------------------------------------------------------------------------


def returned(s, d):
    return line(s, d).select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", (F.col("l_tax") * 100).alias("tax"), (F.col("l_linestatus") == "F").cast("double").alias("f"))


@query("WITH " + swept("o", "(SELECT l_tax * 100 AS x1, l_quantity AS y FROM lineitem)", ["x1"]) + f""", k AS (SELECT 'intercept' AS term, b0 AS b, sqrt(rss / (n - 2) * (1 / n + m1 * m1 * {inverse(1, 1)})) AS se FROM o UNION ALL SELECT 'tax', b1, sqrt(rss / (n - 2) * {inverse(1, 1)}) FROM o)
SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 4) AS statistic FROM k""")
def j3_glm_gaussian(s, d):
    return shown(J.glm(returned(s, d), "l_quantity", ["tax"], "gaussian").table(s), "term", estimate=6, std_error=6, statistic=4)


@query("SELECT round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5) AS slope, round(ln(p0 / (1 - p0)), 5) AS intercept FROM (SELECT avg(CAST(l_returnflag = 'R' AS INT)) FILTER (l_quantity > 25) AS p1, avg(CAST(l_returnflag = 'R' AS INT)) FILTER (l_quantity <= 25) AS p0 FROM lineitem)")
def j5_logistic(s, d):
    own = line(s, d).select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("x"))
    b = J.logistic(own, "y", ["x"]).beta
    return frame(s, [(round(float(b[1]), 5), round(float(b[0]), 5))], "slope double, intercept double")


@query("SELECT round(ln(m1 / m0), 6) AS slope, round(ln(m0), 6) AS intercept FROM (SELECT avg(l_quantity) FILTER (l_linestatus = 'F') AS m1, avg(l_quantity) FILTER (l_linestatus = 'O') AS m0 FROM lineitem)")
def j6_poisson(s, d):
    b = J.poisson(returned(s, d), "l_quantity", ["f"]).beta
    return frame(s, [(round(float(b[1]), 6), round(float(b[0]), 6))], "slope double, intercept double")


@query()
def j7_negative_binomial(s, d):
    return J.negative_binomial(returned(s, d), "l_quantity", ["tax"]).table(s)


@query("SELECT round(ln(m1 / m0), 6) AS slope, round(ln(m0), 6) AS intercept FROM (SELECT avg(l_extendedprice) FILTER (l_linestatus = 'F') AS m1, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS m0 FROM lineitem)")
def j8_gamma(s, d):
    own = line(s, d).withColumn("f", (F.col("l_linestatus") == "F").cast("int"))
    b = J.gamma(own, "l_extendedprice", ["f"]).beta
    return frame(s, [(round(float(b[1]), 6), round(float(b[0]), 6))], "slope double, intercept double")


@query()
def j9_probit(s, d):
    return J.probit(returned(s, d), "y", ["l_quantity", "tax"]).table(s)


@query()
def j4_proximal(s, d):
    return metrics(s, J.proximal(returned(s, d), "y", ["l_quantity", "tax"], l1=0.001))


def counts(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), (F.first("c_acctbal") / 1000).alias("balance"))


@query()
def j11_zero_inflated_poisson(s, d):
    own = counts(s, d).withColumn("n", F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("n")))
    return J.zero_inflated(own, "n", ["balance"], ["balance"], rounds=15)[0]


@query()
def j12_zero_inflated_nb(s, d):
    own = counts(s, d).withColumn("n", F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("n")))
    return J.zero_inflated(own, "n", ["balance"], ["balance"], "negative_binomial", rounds=6)[0]


@query()
def j13_hurdle(s, d):
    own = counts(s, d).withColumn("n", F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(F.col("n")))
    return J.hurdle_poisson(own, "n", ["balance"])[0]


@query()
def j14_ordered_logit(s, d):
    own = table(s, d, "part").select(F.ceil(F.col("p_size") / 17).alias("k"), (F.col("p_retailprice") / 1000).alias("price"))
    return J.ordered(own, "k", ["price"]).table(s)


@query()
def j15_multinomial(s, d):
    return J.multinomial(returned(s, d).withColumn("k", F.col("y")), "k", ["l_quantity", "tax"])[0]


@query("SELECT mu, 1.0::DOUBLE AS gaussian, mu AS poisson, mu * mu AS gamma, mu + mu * mu AS negative_binomial FROM (SELECT DISTINCT l_quantity AS mu FROM lineitem)")
def j1_families(s, d):
    return J.family_variance(line(s, d).select(F.col("l_quantity").alias("mu")).distinct(), "mu", ["gaussian", "poisson", "gamma", "negative_binomial"])


# --- K -------------------------------------------------------------------------------------------------------------------


@query("SELECT 'l_quantity' AS variable, round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 8) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - power(corr(l_quantity, l_extendedprice), 2)), 8) FROM lineitem")
def k1_vif(s, d):
    return rounded(K.vif(line(s, d), ["l_quantity", "l_extendedprice"]), 8)


SIMPLE = "f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, CAST(count(*) AS DOUBLE) AS n FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_extendedprice - a - b * l_quantity AS e, 1 / n + power(l_quantity - m, 2) / sxx AS h, n FROM lineitem, f)"


def simple(s, d):
    return I.ols(line(s, d), "l_extendedprice", ["l_quantity"])


X3 = ["x1", "x2", "x3"]
#: The fit of three regressors, its rows with residual, leverage and what they add to a coefficient, and White's auxiliary fit.
FULL = swept("o", "(SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem)", X3)
FULL_E = f"e AS (SELECT o_r.*, n, {', '.join(f'b{i}' for i in range(4))}, {', '.join(f'{c} AS c{i}' for i, c in enumerate(shares(X3)))}, {inverse(1, 1)} AS i11, rss / (n - 4) AS s2, {residual(X3)} AS e, {leverage(X3)} AS h FROM o_r, o)"
WHITE = swept("u", f"(SELECT x1, x2, x3, x1 * x1 AS x11, x2 * x2 AS x22, x3 * x3 AS x33, x1 * x2 AS x12, x1 * x3 AS x13, x2 * x3 AS x23, power({residual(X3)}, 2) AS y FROM o_r, o)", ["x1", "x2", "x3", "x11", "x22", "x33", "x12", "x13", "x23"])

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"WITH {SIMPLE}, l AS (SELECT e, lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM r) SELECT round(sum(power(e - p, 2)) / sum(e * e), 6) AS statistic FROM l")
def k2_durbin_watson(s, d):
    return K.durbin_watson(line(s, d), simple(s, d), ORDER).select(F.round("statistic", 6).alias("statistic"))


@query(f"WITH {SIMPLE} SELECT round(count(*) * power(corr(e * e, x), 2), 5) AS statistic, count(*) AS n FROM r")
def k3_breusch_pagan(s, d):
    return K.breusch_pagan(line(s, d), simple(s, d)).select(F.round("statistic", 5).alias("statistic"), "n")


@query(f"WITH {FULL}, {WHITE} SELECT 'White' AS test, round(n * (1 - rss / tss), 4) AS statistic, 9.0::DOUBLE AS df, CAST(n AS BIGINT) AS n FROM u")
def k4_white(s, d):
    return shown(K.white(line(s, d), ols(s, d)), "test", "df", "n", statistic=4)


@query(f"WITH {SIMPLE}, g AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM r) SELECT l_orderkey, l_linenumber, round(e * e * h / (2 * s2 * power(1 - h, 2)) * 1e6, 4) AS cooks_m, round(h * 1e6, 4) AS leverage_m FROM r, g")
def k5_influence(s, d):
    r = K.influence(line(s, d), simple(s, d), ["l_orderkey", "l_linenumber"])
    return r.select("l_orderkey", "l_linenumber", F.round(F.col("cooks_distance") * 1e6, 4).alias("cooks_m"), F.round(F.col("leverage") * 1e6, 4).alias("leverage_m"))


@query(f"WITH {SIMPLE} SELECT count(*) FILTER (h > 4 / n) AS high FROM r")
def k8_flags(s, d):
    return K.influence(line(s, d), simple(s, d)).agg(F.count_if("high_leverage").alias("high"))


@query(f"""WITH {FULL}, {FULL_E}, i AS (SELECT *, e / sqrt(s2 * (1 - h)) AS std_residual, e / sqrt(((n - 4) * s2 - e * e / (1 - h)) / (n - 5) * (1 - h)) AS t, e * e * h / (4 * s2 * power(1 - h, 2)) AS cooks FROM e)
SELECT l_orderkey, l_linenumber, round(t, 5) AS student_residual, round(cooks * 1e6, 4) AS cooks_m, round(t * sqrt(h / (1 - h)), 7) AS dffits, round(c1 * e / (1 - h) / sqrt(((n - 4) * s2 - e * e / (1 - h)) / (n - 5) * i11), 7) AS dfbetas_l_quantity, abs(std_residual) > 3 AS outlier, h > 8 / n AS high_leverage, cooks > 4 / n AS influential
FROM i WHERE cooks > 4 / n OR h > 8 / n OR abs(std_residual) > 2""")
def k7_influence_all(s, d):
    r = K.influential_rows(line(s, d), ols(s, d), ["l_orderkey", "l_linenumber"]).withColumn("cooks_m", F.col("cooks_distance") * 1e6)
    return shown(r, "l_orderkey", "l_linenumber", "outlier", "high_leverage", "influential", student_residual=5, cooks_m=4, dffits=7, dfbetas_l_quantity=7)


@query(f"""WITH {FULL}, {FULL_E}, {WHITE}, {swept('p', "(SELECT x1, x2, x3, e * e AS y FROM e)", ["x1", "x2", "x3"])}, {swept('q', "(SELECT x1, x2, x3, z * z AS z2, z * z * z AS z3, y FROM (SELECT *, (y - e - avg(y - e) OVER ()) / stddev_pop(y - e) OVER () AS z FROM e))", ["x1", "x2", "x3", "z2", "z3"])},
j AS (SELECT avg(e * e) AS v2, avg(e * e * e) AS v3, avg(e * e * e * e) AS v4, count(*) AS n FROM e)
SELECT 'Breusch-Pagan' AS test, round(n * (1 - rss / tss), 4) AS statistic, 3.0::DOUBLE AS df, CAST(n AS BIGINT) AS n FROM p UNION ALL SELECT 'White', round(n * (1 - rss / tss), 4), 9, CAST(n AS BIGINT) FROM u
UNION ALL SELECT 'Jarque-Bera', round(n / 6.0 * (v3 * v3 / power(v2, 3) + power(v4 / (v2 * v2) - 3, 2) / 4), 3), 2, n FROM j UNION ALL SELECT 'RESET', round((o.rss - q.rss) / 2 / (q.rss / (q.n - 6)), 4), 2, CAST(q.n AS BIGINT) FROM q, o""")
def k9_summary(s, d):
    return K.summary(line(s, d), ols(s, d)).select("test", "df", "n", F.when(F.col("test") == "Jarque-Bera", F.round("statistic", 3)).otherwise(F.round("statistic", 4)).alias("statistic"))


@query(f"""WITH {SIMPLE}, l AS (SELECT x, e AS y, coalesce(lag(e, 1) OVER w, 0) AS p, coalesce(lag(e, 2) OVER w, 0) AS q FROM r WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)), {swept('o', 'l', ['x', 'p', 'q'])}
SELECT round(n * (1 - rss / tss), 5) AS statistic, round(exp(-n * (1 - rss / tss) / 2), 7) AS p_value, 2.0::DOUBLE AS df, CAST(n AS BIGINT) AS n, round((tss - rss) / 2 / (rss / (n - 4)), 5) AS effect_size FROM o""")
def k10_breusch_godfrey(s, d):
    return shown(K.breusch_godfrey(line(s, d), simple(s, d), ORDER, 2), "df", "n", statistic=5, p_value=7, effect_size=5)


@query("WITH c AS (SELECT quantile_cont(l_orderkey, 0.4) AS low, quantile_cont(l_orderkey, 0.6) AS high FROM lineitem), r AS (SELECT l_orderkey > high AS late, l_quantity AS x1, l_extendedprice AS y FROM lineitem, c WHERE l_orderkey <= low OR l_orderkey > high), " + swept("o", "r", ["x1"], by="late") + """
SELECT round(b.rss / (b.n - 2) / (a.rss / (a.n - 2)), 7) AS statistic, b.n - 2 AS df, CAST(a.n + b.n AS BIGINT) AS n FROM o AS a, o AS b WHERE b.late AND NOT a.late""")
def k11_goldfeld_quandt(s, d):
    return shown(K.goldfeld_quandt(line(s, d), "l_extendedprice", ["l_quantity"], "l_orderkey"), "df", "n", statistic=7)


@query(f"""WITH {SIMPLE}, {swept('o', "(SELECT (x - avg(x) OVER ()) / 10 AS x1, power((x - avg(x) OVER ()) / 10, 2) AS x2, power((x - avg(x) OVER ()) / 10, 3) AS x3, l_extendedprice AS y FROM r)", ["x1", "x2", "x3"])}, t AS (SELECT (q.rss - o.rss) / 2 / (o.rss / (o.n - 4)) AS f, o.n FROM o, (SELECT sum(e * e) AS rss FROM r) AS q)
SELECT round(f, 6) AS statistic, round(power(1 + 2 * f / (n - 4), (4 - n) / 2), 6) AS p_value, 2.0::DOUBLE AS df, CAST(n AS BIGINT) AS n FROM t""")
def k12_reset(s, d):
    return shown(K.reset(line(s, d), simple(s, d)), "df", "n", statistic=6, p_value=6)


@query("""WITH p AS (SELECT *, l_orderkey >= 700 AS k FROM lineitem), q AS (SELECT regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity) AS rss FROM p GROUP BY k), t AS (SELECT regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity) AS rss, count(*) AS n FROM p)
SELECT round((t.rss - (SELECT sum(rss) FROM q)) / 2 / ((SELECT sum(rss) FROM q) / (t.n - 4)), 5) AS statistic FROM t""")
def k13_chow(s, d):
    return K.chow(line(s, d), "l_extendedprice", ["l_quantity"], F.col("l_orderkey") >= 700).select(F.round("statistic", 5).alias("statistic"))


@query("""WITH c AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c), f AS (SELECT p, acos(a * b * c / power(p, 3)) / 3 AS f FROM p)
SELECT round(sqrt((1 + 2 * p * cos(f)) / (1 + 2 * p * cos(f + 2 * pi() / 3))), 8) AS condition_number, 'none' AS severity FROM f""")
def k14_condition_number(s, d):
    return shown(K.condition_number(line(s, d), X), "severity", condition_number=8)


@query("WITH " + swept("f", "(SELECT l_tax, l_discount, l_quantity, l_extendedprice FROM lineitem)", ["l_tax", "l_discount"], "l_quantity") + f""", v AS (SELECT l_quantity AS x1, l_tax AS x2, {residual(["l_tax", "l_discount"], "l_quantity")} AS x3, l_extendedprice AS y FROM f_r, f), {swept("w", "v", ["x1", "x2", "x3"])}
SELECT 'Durbin-Wu-Hausman' AS test, round(b3 * b3 / (rss / (n - 4) * {inverse(3, 3)}), 6) AS statistic, 1.0::DOUBLE AS df, CAST(n AS BIGINT) AS n FROM w""")
def k15_durbin_wu_hausman(s, d):
    return shown(K.durbin_wu_hausman(line(s, d), "l_extendedprice", "l_quantity", ["l_tax"], ["l_discount"]), "test", "df", "n", statistic=6)


@query(f"WITH {SIMPLE} SELECT round(sqrt(sum(power(x - m, 2) * e * e)) / max(sxx), 6) AS hc0 FROM r, f")
def k16_robust(s, d):
    fit = simple(s, d)
    v = K.robust_vcov(line(s, d), fit, "HC0")
    return frame(s, [(round(float(v[1, 1] ** 0.5), 6),)], "hc0 double")


@query(f"""WITH {FULL}, {FULL_E}, k AS (SELECT unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, unnest([max(b0), max(b1), max(b2), max(b3)]) AS b, unnest([sqrt(sum(power(c0 * e / (1 - h), 2))), sqrt(sum(power(c1 * e / (1 - h), 2))), sqrt(sum(power(c2 * e / (1 - h), 2))), sqrt(sum(power(c3 * e / (1 - h), 2)))]) AS se FROM e)
SELECT term, round(b, 3) AS estimate, round(se, 4) AS std_error, round(b / se, 5) AS statistic FROM k""")
def k16_robust_hc3(s, d):
    fit = ols(s, d)
    return shown(K.robust_table(line(s, d), fit, K.robust_vcov(line(s, d), fit, "HC3")), "term", estimate=3, std_error=4, statistic=5)


@query(f"""WITH {SIMPLE}, u AS (SELECT *, (1 / n - m * (x - m) / sxx) * e AS u0, (x - m) / sxx * e AS u1 FROM r, (SELECT m, sxx FROM f)), l AS (SELECT n, u0, u1, {", ".join(f"coalesce(lag(u{i}, {k}) OVER w, 0) AS u{i}_{k}" for i in (0, 1) for k in (1, 2, 3))} FROM u WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
k AS (SELECT {", ".join(f"sqrt(sum(u{i} * (u{i} + 1.5 * u{i}_1 + u{i}_2 + 0.5 * u{i}_3)) * max(n) / (max(n) - 2)) AS se{i}" for i in (0, 1))} FROM l)
SELECT 'intercept' AS term, round(a, 3) AS estimate, round(se0, 4) AS std_error, round(a / se0, 4) AS statistic FROM f, k UNION ALL SELECT 'l_quantity', round(b, 3), round(se1, 4), round(b / se1, 4) FROM f, k""")
def k17_newey_west(s, d):
    fit = simple(s, d)
    return shown(K.robust_table(line(s, d), fit, K.newey_west_vcov(line(s, d), fit, ORDER, 3)), "term", estimate=3, std_error=4, statistic=4)


@query(f"WITH {SIMPLE}, c AS (SELECT l_suppkey, sum((x - m) * e) AS s FROM r, f GROUP BY 1), g AS (SELECT CAST(count(*) AS DOUBLE) AS g, sum(s * s) AS q FROM c) SELECT round(sqrt(q * g / (g - 1) * (n - 1) / (n - 2)) / sxx, 6) AS se FROM g, f")
def k18_cluster(s, d):
    v = K.cluster_vcov(line(s, d), simple(s, d), "l_suppkey")
    return frame(s, [(round(float(v[1, 1] ** 0.5), 6),)], "se double")


@query()
def k19_plot_data(s, d):
    return K.plot_data(line(s, d), ols(s, d))["qq"]


# --- L -------------------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT l_suppkey AS u, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y FROM lineitem), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, CAST(count(*) AS DOUBLE) AS n FROM w), c AS (SELECT u, sum(x * (y - b * x)) AS s FROM w, b GROUP BY u), g AS (SELECT CAST(count(*) AS DOUBLE) AS g, sum(s * s) AS q FROM c)
SELECT round(b, 5) AS estimate, round(sqrt(q * g / (g - 1) * (n - 1) / (n - 1 - g)) / sxx, 5) AS std_error FROM b, g""")
def l1_fixed_effects(s, d):
    return L.fixed_effects(line(s, d), "l_extendedprice", ["l_quantity"], "l_suppkey")[0].select(F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


def monthly(s, d):
    o = table(s, d, "orders")
    return o.withColumn("month", L.period_column(F.col("o_orderdate"))).withColumn("unit", F.col("o_custkey") % 200).groupBy("unit", "month").agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"))


@query()
def l1_two_way_effects(s, d):
    return L.fixed_effects(monthly(s, d), "price", ["n"], "unit", "month")[0]


@query("""WITH g AS (SELECT l_suppkey AS u, CAST(count(*) AS DOUBLE) AS c, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS xx, covar_pop(l_quantity, l_extendedprice) * count(*) AS xy, var_pop(l_extendedprice) * count(*) AS yy FROM lineitem GROUP BY 1),
w AS (SELECT (sum(yy) - sum(xy) * sum(xy) / sum(xx)) / (sum(c) - count(*) - 1) AS se, count(*) / sum(1 / c) AS harmonic, (regr_syy(my, mx) - power(regr_sxy(my, mx), 2) / regr_sxx(my, mx)) / (count(*) - 2) AS between FROM g),
t AS (SELECT g.*, sqrt(se / (se + c * greatest(0, between - se / harmonic))) AS k FROM g, w),
z AS (SELECT sum(c * k * k) AS a, sum(c * k * k * mx) AS b, sum(xx + c * k * k * mx * mx) AS e, sum(c * k * k * my) AS p, sum(xy + c * k * k * mx * my) AS q, sum(yy + c * k * k * my * my) AS r, sum(c) AS n FROM t),
o AS (SELECT *, (p * e - b * q) / (a * e - b * b) AS b0, (a * q - b * p) / (a * e - b * b) AS b1 FROM z), v AS (SELECT *, (r - b0 * p - b1 * q) / (n - 2) / (a * e - b * b) AS s FROM o)
SELECT 'intercept' AS term, round(b0, 3) AS estimate, round(sqrt(s * e), 4) AS std_error FROM v UNION ALL SELECT 'l_quantity', round(b1, 3), round(sqrt(s * a), 4) FROM v""")
def l2_random_effects(s, d):
    return shown(L.random_effects(line(s, d), "l_extendedprice", ["l_quantity"], "l_suppkey")[0], "term", estimate=3, std_error=4)


@query()
def l3_hausman(s, d):
    return L.hausman(line(s, d), "l_extendedprice", ["l_quantity", "l_tax"], "l_suppkey")


MONTHLY = "(SELECT o_custkey % 200 AS unit, year(o_orderdate) * 12 + month(o_orderdate) AS month, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL)"


@query(f"SELECT round(sum(dx * dy) / sum(dx * dx), 3) AS estimate, count(*) AS n FROM (SELECT price - lag(price) OVER w AS dy, n - lag(n) OVER w AS dx, month - lag(month) OVER w AS gap FROM {MONTHLY} WINDOW w AS (PARTITION BY unit ORDER BY month)) WHERE gap = 1")
def l4_first_difference(s, d):
    table_, m, fit = L.first_difference(monthly(s, d), "price", ["n"], "unit", "month")
    return frame(s, [(round(float(fit.beta[0]), 3), fit.n)], "estimate double, n long")


def yearly(s, d):
    o = table(s, d, "orders")
    return o.groupBy((F.col("o_custkey") % 300).alias("unit"), F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1000).alias("price"), F.count("*").cast("double").alias("n"))


@query()
def l5_arellano_bond(s, d):
    return L.arellano_bond(yearly(s, d), "price", ["n"], "unit", "year")[0]


@query()
def l6_linear_gmm(s, d):
    return L.linear_gmm(line(s, d), "l_extendedprice", ["l_quantity"], ["l_tax"], ["l_discount", "l_linenumber"])[0]


@query()
def l7_mixed_model(s, d):
    return L.mixed_model(table(s, d, "customer"), "c_acctbal", ["c_custkey"], "c_nationkey")[0]
