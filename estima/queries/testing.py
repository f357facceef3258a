"""Hypothesis tests, analysis of variance, multiple comparison, power."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.result import frame
from ..operators import anova
from ..operators import hypothesis as H
from ..registry import query, table
from .foundation import line, rounded, shown
from .sqlfit import swept


def orders(s, d):
    return table(s, d, "orders")


@query("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 5) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df, count(*) AS n, round((avg(l_quantity) - 25) / stddev_samp(l_quantity), 6) AS effect_size FROM lineitem")
def g1_t_one_sample(s, d):
    return H.t_one_sample(line(s, d), "l_quantity", 25.0).select(F.round("statistic", 5).alias("statistic"), "df", "n", F.round("effect_size", 6).alias("effect_size"))


TWO = """WITH g AS (SELECT avg(l_extendedprice) FILTER (l_linestatus = 'F') AS m1, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS m2, var_samp(l_extendedprice) FILTER (l_linestatus = 'F') AS v1, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS v2,
 CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS n2 FROM lineitem), p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM g)
"""


@query(TWO + "SELECT round((m1 - m2) / sqrt(pooled * (1 / n1 + 1 / n2)), 5) AS statistic, n1 + n2 - 2 AS df, round((m1 - m2) / sqrt(pooled), 6) AS effect_size FROM p")
def g2_t_student(s, d):
    return H.two_sample_statistics(line(s, d), "l_extendedprice", "l_linestatus", "F", "O").select(F.round("statistic", 5).alias("statistic"), "df", F.round("effect_size", 6).alias("effect_size"))


@query(TWO + "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS statistic, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 3) AS df FROM p")
def g2_t_welch(s, d):
    return H.two_sample_statistics(line(s, d), "l_extendedprice", "l_linestatus", "F", "O", False).select(F.round("statistic", 5).alias("statistic"), F.round("df", 3).alias("df"))


@query(TWO + "SELECT 'two-sample t' AS test, round((m1 - m2) / sqrt(pooled * (1 / n1 + 1 / n2)), 5) AS statistic, n1 + n2 - 2 AS df, CAST(n1 + n2 AS BIGINT) AS n, round((m1 - m2) / sqrt(pooled), 6) AS effect_size FROM p")
def g2_t_table(s, d):
    return shown(H.t_two_sample(line(s, d), "l_extendedprice", "l_linestatus", "F", "O"), "test", "df", "n", statistic=5, effect_size=6)


@query("SELECT round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS statistic, count(*) AS n FROM (SELECT l_discount - l_tax AS x FROM lineitem)")
def g3_t_paired(s, d):
    return H.t_paired(line(s, d), "l_discount", "l_tax").select(F.round("statistic", 4).alias("statistic"), "n")


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT a, sum(n) AS na FROM c GROUP BY a), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
e AS (SELECT coalesce(c.n, 0) AS n, na * nb / t::DOUBLE AS e, t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b))
SELECT round(sum(power(n - e, 2) / e), 4) AS statistic, CAST((SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM k) AS BIGINT) AS df, CAST(max(t) AS BIGINT) AS n, round(sqrt(sum(power(n - e, 2) / e) / max(t)), 6) AS effect_size FROM e""")
def g4_chi2_independence(s, d):
    r = H.chi2_statistics(line(s, d), "l_returnflag", "l_linestatus")
    return r.select(F.round("statistic", 4).alias("statistic"), "df", "n", F.round("effect_size", 6).alias("effect_size"))


@query("SELECT round(sum(power(n - t / 5.0, 2) / (t / 5.0)), 4)::DOUBLE AS statistic, CAST(max(t) AS BIGINT) AS n FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY o_orderpriority)")
def g5_chi2_goodness(s, d):
    return H.chi2_goodness(orders(s, d), "o_orderpriority").select(F.round("statistic", 4).alias("statistic"), "n")


RANKS = "SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM"


@query(f"WITH a AS ({RANKS} (SELECT l_quantity AS v, l_linestatus AS g FROM lineitem)), t AS (SELECT sum(r) FILTER (g = 'F') AS r1, CAST(count(*) FILTER (g = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'O') AS DOUBLE) AS n2 FROM a) SELECT r1 - n1 * (n1 + 1) / 2 AS statistic, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 8) AS effect_size FROM t")
def g6_mann_whitney(s, d):
    return H.mann_whitney_statistics(line(s, d), "l_quantity", "l_linestatus", "F", "O").select("statistic", F.round("effect_size", 8).alias("effect_size"))


@query(f"WITH a AS ({RANKS} (SELECT abs(x) AS v, x FROM (SELECT round(l_discount - l_tax, 4) AS x FROM lineitem) WHERE x <> 0)) SELECT least(sum(r) FILTER (x > 0), sum(r) FILTER (x < 0)) AS statistic, count(*) AS n FROM a")
def g7_wilcoxon(s, d):
    own = line(s, d).withColumn("x", F.round(F.col("l_discount") - F.col("l_tax"), 4))
    return H.wilcoxon(own, "x").select("statistic", "n")


@query(f"WITH a AS ({RANKS} (SELECT c_acctbal AS v, c_mktsegment AS g FROM customer)), g AS (SELECT count(*) AS n, sum(r) AS s FROM a GROUP BY g), t AS (SELECT sum(power(c, 3) - c) AS tie FROM (SELECT count(*) AS c FROM a GROUP BY v)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM a) SELECT round((12 / (n.n * (n.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (n.n + 1)) / (1 - tie / (power(n.n, 3) - n.n)), 5) AS statistic, (SELECT count(*) - 1 FROM g) AS df FROM t, n")
def g8_kruskal(s, d):
    return H.kruskal_statistics(table(s, d, "customer"), "c_acctbal", "c_mktsegment").select(F.round("statistic", 5).alias("statistic"), "df")


@query()
def g9_shapiro_wilk(s, d):
    return H.shapiro_wilk(table(s, d, "supplier"), "s_acctbal")


@query()
def g10_kolmogorov_smirnov(s, d):
    return H.kolmogorov_smirnov(line(s, d), "l_extendedprice")


@query("WITH z AS (SELECT c_mktsegment AS g, abs(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS z FROM customer), g AS (SELECT g, count(*) AS n, avg(z) AS m, sum(z * z) AS q FROM z GROUP BY g), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m) / sum(n) AS gm FROM g) SELECT round((n - k) / (k - 1) * (SELECT sum(n * power(m - gm, 2)) FROM g) / (SELECT sum(q - n * m * m) FROM g), 6) AS statistic FROM t")
def g11_levene(s, d):
    return H.levene_statistics(table(s, d, "customer"), "c_acctbal", "c_mktsegment").select(F.round("statistic", 6).alias("statistic"))


@query("WITH g AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), t AS (SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS k, sum((n - 1) * v) AS s, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS i FROM g) SELECT round(((n - k) * ln(s / (n - k)) - l) / (1 + (i - 1 / (n - k)) / (3 * (k - 1))), 6) AS statistic FROM t")
def g12_bartlett(s, d):
    return H.bartlett_statistics(table(s, d, "customer"), "c_acctbal", "c_mktsegment").select(F.round("statistic", 6).alias("statistic"))


@query()
def g13_normality(s, d):
    return H.normality(table(s, d, "customer"), "c_acctbal")


@query("WITH m AS (SELECT avg(l_quantity) AS m FROM lineitem), c AS (SELECT avg(power(l_quantity - m, 2)) AS m2, avg(power(l_quantity - m, 3)) AS m3, avg(power(l_quantity - m, 4)) AS m4, count(*) AS n FROM lineitem, m) SELECT round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 3) AS statistic FROM c")
def g14_jarque_bera(s, d):
    return H.jarque_bera_statistics(line(s, d), "l_quantity").select(F.round("statistic", 3).alias("statistic"))


ONE_WAY = """WITH g AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY l_returnflag), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m) / sum(n) AS gm FROM g),
s AS (SELECT (SELECT sum(g.n * power(g.m - t.gm, 2)) FROM g) AS b, (SELECT sum(w) FROM g) AS w, n, k FROM t)
"""


@query(ONE_WAY + "SELECT 'between' AS source, round(b / 1e6, 3) AS ss, CAST(k - 1 AS BIGINT) AS df, round(b / (k - 1) / (w / (n - k)), 5) AS f_stat, round(b / (b + w), 8) AS eta_sq FROM s UNION ALL SELECT 'within', round(w / 1e6, 3), CAST(n - k AS BIGINT), NULL, NULL FROM s UNION ALL SELECT 'total', round((b + w) / 1e6, 3), CAST(n - 1 AS BIGINT), NULL, NULL FROM s")
def h1_one_way(s, d):
    t = anova.one_way_table(line(s, d), "l_extendedprice", "l_returnflag")
    return t.select("source", F.round(F.col("ss") / 1e6, 3).alias("ss"), "df", F.round("f_stat", 5).alias("f_stat"), F.round("eta_sq", 8).alias("eta_sq"))


@query(ONE_WAY + "SELECT 'between' AS source, round(b / (k - 1) / 1e6, 3) AS ms, round(b / (k - 1) / (w / (n - k)), 5) AS f_stat, round(power(1 + 2 * b / (k - 1) / w, (k - n) / 2), 6) AS p_value FROM s UNION ALL SELECT 'within', round(w / (n - k) / 1e6, 3), NULL, NULL FROM s UNION ALL SELECT 'total', NULL, NULL, NULL FROM s")
def h1_one_way_table(s, d):
    t = anova.one_way(line(s, d), "l_extendedprice", "l_returnflag").withColumn("ms", F.col("ms") / 1e6)
    return shown(t, "source", ms=3, f_stat=5, p_value=6)


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY ALL), a AS (SELECT o_orderstatus AS a, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), g AS (SELECT avg(o_totalprice) AS m FROM orders)
SELECT round((SELECT sum(a.n * power(a.m - g.m, 2)) FROM a, g) / 1e6, 3) AS ss_a, round((SELECT sum(b.n * power(b.m - g.m, 2)) FROM b, g) / 1e6, 3) AS ss_b, round((SELECT sum(c.n * power(c.m - a.m - b.m + g.m, 2)) FROM c JOIN a ON a.a = c.a JOIN b ON b.b = c.b, g) / 1e6, 3) AS ss_ab, round((SELECT sum(w) FROM c) / 1e6, 2) AS ss_within""")
def h2_two_way(s, d):
    t = anova.two_way_sums(orders(s, d), "o_totalprice", "o_orderstatus", "o_orderpriority")
    return t.select(*[F.round(F.col(c) / 1e6, k).alias(c) for c, k in (("ss_a", 3), ("ss_b", 3), ("ss_ab", 3), ("ss_within", 2))])


@query("""WITH g AS (SELECT c_mktsegment AS g, CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM g)
SELECT a.g AS group1, b.g AS group2, round(a.m - b.m, 5) AS difference, round(abs(a.m - b.m) / sqrt(msw / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM g a JOIN g b ON a.g < b.g, w""")
def h3_tukey_pairs(s, d):
    return anova.tukey_pairs(table(s, d, "customer"), "c_acctbal", "c_mktsegment").select("group1", "group2", F.round("difference", 5).alias("difference"), F.round("q", 6).alias("q"))


@query()
def h3_tukey(s, d):
    return anova.tukey(table(s, d, "customer"), "c_acctbal", "c_mktsegment")


ANCOVA = "(SELECT l_quantity AS q, l_tax AS t, CAST(l_returnflag = 'N' AS DOUBLE) AS g1, CAST(l_returnflag = 'R' AS DOUBLE) AS g2, l_extendedprice AS y FROM lineitem)"


@query("WITH " + swept("f", ANCOVA, ["q", "t", "g1", "g2"]) + ", " + swept("c", ANCOVA, ["q", "t"]) + ", " + swept("g", ANCOVA, ["g1", "g2"]) + """, k AS (SELECT 'l_returnflag' AS source, c.rss - f.rss AS ss, f.rss AS w, f.n - 5 AS m FROM c, f UNION ALL SELECT 'covariates', g.rss - f.rss, f.rss, f.n - 5 FROM g, f)
SELECT source, round(ss / 1e6, 3) AS ss, 2::BIGINT AS df, round(ss / 2 / (w / m), 5) AS f_stat, round(power(1 + ss / w, -m / 2), 6) AS p_value, round(ss / (ss + w), 9) AS eta_sq FROM k UNION ALL SELECT 'residual', round(rss / 1e6, 3), CAST(n - 5 AS BIGINT), NULL, NULL, NULL FROM f""")
def h4_ancova(s, d):
    t = anova.ancova(line(s, d), "l_extendedprice", "l_returnflag", ["l_quantity", "l_tax"])[0].withColumn("ss", F.col("ss") / 1e6)
    return shown(t, "source", "df", ss=3, f_stat=5, p_value=6, eta_sq=9)


P_VALUES = "(VALUES (1, 0.001::DOUBLE), (2, 0.04::DOUBLE), (3, 0.03::DOUBLE), (4, 0.2::DOUBLE), (5, 0.011::DOUBLE)) AS t(id, p_value)"


def p_values(s):
    return frame(s, [(1, 0.001), (2, 0.04), (3, 0.03), (4, 0.2), (5, 0.011)], "id int, p_value double")


def _adjusted(s, method: str):
    return H.correct_p_values(p_values(s), method=method).select("id", F.round("p_adjusted", 10).alias("p_adjusted"), "reject")


@query(f"SELECT id, round(least(1, p_value * 5), 10) AS p_adjusted, p_value * 5 <= 0.05 AS reject FROM {P_VALUES}")
def h5_bonferroni(s, d):
    return _adjusted(s, "bonferroni")


@query(f"SELECT id, round(least(1, max(a) OVER (ORDER BY p_value)), 10) AS p_adjusted, max(a) OVER (ORDER BY p_value) <= 0.05 AS reject FROM (SELECT *, (5 - row_number() OVER (ORDER BY p_value) + 1) * p_value AS a FROM {P_VALUES})")
def h6_holm(s, d):
    return _adjusted(s, "holm")


@query(f"SELECT id, round(least(1, min(a) OVER (ORDER BY p_value DESC)), 10) AS p_adjusted, min(a) OVER (ORDER BY p_value DESC) <= 0.05 AS reject FROM (SELECT *, 5.0::DOUBLE / row_number() OVER (ORDER BY p_value) * p_value AS a FROM {P_VALUES})")
def h7_fdr(s, d):
    return _adjusted(s, "fdr")


@query()
def h8_power(s, d):
    return frame(s, [("t", anova.power_t(0.5, 64)), ("n for 0.8", float(anova.sample_size_t(0.5))), ("anova", anova.power_anova(0.25, 3, 53)), ("proportions", anova.power_proportions(0.5, 0.6, 400))], "what string, value double")


@query()
def h8_power_curve(s, d):
    return anova.power_curve(s, 0.5, range(10, 110, 20))


def _check(s, d):
    return rounded(H.group_moments(line(s, d), "l_quantity", "l_returnflag"))


@query("SELECT l_returnflag AS \"group\", count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def g_group_moments(s, d):
    return _check(s, d)
