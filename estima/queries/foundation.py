"""Sources, preparation, joins, description, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import polynomials
from ..functions.result import frame
from ..operators import describe, joins, prep
from ..plans.ranks import running_counts, with_ranks
from ..plans.storage import shared_folder
from ..registry import query, table
from ..sources import files
from ..sources.dataset import Dataset

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def shown(df, *keep: str, **digits: int):
    """The columns kept, and others rounded to so many digits."""
    return df.select(*keep, *[F.round(c, k).alias(c) for c, k in digits.items()])


def rounded(df, digits: int = 6):
    """Doubles rounded, so that sums in another order give the same value."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def line(s, d):
    return table(s, d, "lineitem")


# --- A: sources and sinks --------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def a6_parquet_scan(s, d):
    return files.read(s, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def _text_round_trip(s, d, sep: str):
    path = shared_folder(s)
    table(s, d, "nation").write.option("sep", sep).csv(path, header=True)
    return files.read_csv(s, path, sep).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


NATION = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"


@query(NATION)
def a1_csv_round_trip(s, d):
    return _text_round_trip(s, d, ",")


@query(NATION)
def a2_tsv_round_trip(s, d):
    return _text_round_trip(s, d, "\t")


@query(NATION)
def a3_sniffed_text(s, d):
    path = shared_folder(s)
    table(s, d, "nation").write.option("sep", ";").csv(path, header=True)
    return files.read_csv(s, path, files.sniff(s, path)).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query(NATION)
def a5_json_round_trip(s, d):
    path = shared_folder(s)
    table(s, d, "nation").write.json(path)
    return s.read.json(path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT count(*) AS rows, 'nation' AS name, 'w' AS weight FROM nation")
def a18_project_round_trip(s, d):
    path = shared_folder(s)
    files.save_project(path, {"nation": table(s, d, "nation")}, ["loaded"], {}, "w")
    tables, meta = files.load_project(s, path)
    return tables["nation"].agg(F.count("*").alias("rows"), F.lit(meta["tables"][0]).alias("name"), F.lit(meta["weight"]).alias("weight"))


@query("SELECT count(*) AS rows FROM nation")
def a20_reset(s, d):
    data = Dataset(table(s, d, "nation")).apply("filter", lambda df: df.where("n_regionkey = 0")).reset()
    return data.df.agg(F.count("*").alias("rows"))


@query()
def a22_synthetic_data(s, d):
    return files.synthetic(s, 1000, "causal")


@query()
def a23_normal_noise(s, d):
    return files.normal_noise(s, 1000)


# --- B: preparation ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')")
def b1_filter_expression(s, d):
    return C.filter_rows(table(s, d, "orders"), '(o_totalprice > 100000) & ((o_orderstatus == "F") | (o_orderpriority == "1-URGENT"))').select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice) + power(l_quantity, 2), 6) AS v FROM lineitem")
def b2_derived_column(s, d):
    return C.derive(line(s, d), "v", "np.log(l_extendedprice) + l_quantity ** 2").select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def b3_numeric_matrix(s, d):
    return prep.numeric_matrix(table(s, d, "part"))


@query("SELECT n_name AS name, n_nationkey FROM nation")
def b5_rename_drop(s, d):
    return table(s, d, "nation").withColumnRenamed("n_name", "name").drop("n_regionkey").select("name", "n_nationkey")


def holes():
    """The discount with its zeros as nulls."""
    return F.when(F.col("l_discount") != 0, F.col("l_discount"))


@query("SELECT count(*) AS n FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def b7_drop_missing(s, d):
    return prep.drop_missing(line(s, d).withColumn("x", holes()), "x").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS v FROM part")
def b8_change_type(s, d):
    return prep.change_type(table(s, d, "part").withColumn("v", F.expr("substr(p_brand, 7)")), "v", "numeric").select("p_partkey", "v")


@query("SELECT CAST(p_size AS VARCHAR) AS p_size, p_partkey FROM part")
def b9_convert(s, d):
    return prep.convert(table(s, d, "part"), "p_size", "string").select("p_size", "p_partkey")


def _imputed(strategy: str, fill: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), {fill}), 8) AS x FROM lineitem"


def _impute(s, d, strategy: str, value=None):
    return prep.impute(line(s, d).withColumn("x", holes()), "x", strategy, value).select("l_orderkey", "l_linenumber", F.round("x", 8).alias("x"))


@query(_imputed("mean", "(SELECT avg(nullif(l_discount, 0)) FROM lineitem)"))
def b10_impute_mean(s, d):
    return _impute(s, d, "mean")


@query(_imputed("median", "(SELECT median(nullif(l_discount, 0)) FROM lineitem)"))
def b10_impute_median(s, d):
    return _impute(s, d, "median")


@query(_imputed("mode", "(SELECT x FROM (SELECT nullif(l_discount, 0) AS x, count(*) AS n FROM lineitem GROUP BY 1) WHERE x IS NOT NULL ORDER BY n DESC, x LIMIT 1)"))
def b10_impute_mode(s, d):
    return _impute(s, d, "mode")


@query(_imputed("constant", "-1.0"))
def b10_impute_constant(s, d):
    return _impute(s, d, "constant", -1.0)


@query()
def b11_impute_chained(s, d):
    return prep.impute_chained(line(s, d).withColumn("x", holes()), ["x", "l_quantity", "l_extendedprice"], 3).select("l_orderkey", "l_linenumber", "x")


@query('SELECT l_orderkey, l_linenumber, l_returnflag = \'A\' AS "l_returnflag_A", l_returnflag = \'N\' AS "l_returnflag_N", l_returnflag = \'R\' AS "l_returnflag_R" FROM lineitem')
def b12_one_hot(s, d):
    return prep.one_hot(line(s, d), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def b13_label_encode(s, d):
    return prep.label_encode(table(s, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label FROM orders")
def b14_value_labels(s, d):
    return prep.label_values(table(s, d, "orders"), "o_orderstatus", {"F": "filled", "O": "open"}, "label").select("o_orderkey", "label")


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def b15_melt(s, d):
    return prep.melt(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def b16_pivot(s, d):
    counts = table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    wide = prep.pivot(counts, "o_orderstatus", "o_orderpriority", "n")
    return wide.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, 'NEW'")
def b17_row_edits(s, d):
    out = prep.without_rows(table(s, d, "nation"), F.col("n_nationkey") == 5)
    out = prep.set_cell(out, F.col("n_nationkey") == 3, "n_name", "X")
    return prep.with_row(out, {"n_nationkey": 99, "n_name": "NEW"}).select("n_nationkey", "n_name")


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def b18_weight_column(s, d):
    data = Dataset(line(s, d)).with_weight("l_quantity")
    w = F.col(data.weight)
    return data.df.groupBy("l_returnflag").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.sum(w), 4).alias("weighted"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(l_returnflag = 'N' AS INTEGER) * 1.0::DOUBLE AS dn, CAST(l_returnflag = 'R' AS INTEGER) * 1.0::DOUBLE AS dr, round(l_quantity * l_tax, 8) AS qt, l_quantity * l_quantity AS q2 FROM lineitem")
def b19_design(s, d):
    df = line(s, d)
    t = prep.design(df, ["l_quantity"], ["l_returnflag"], [("l_quantity", "l_tax")], ["l_quantity"])
    return df.select("l_orderkey", "l_linenumber", t["l_quantity"].alias("q"), t["l_returnflag_N"].alias("dn"), t["l_returnflag_R"].alias("dr"), F.round(t["l_quantity:l_tax"], 8).alias("qt"), t["l_quantity^2"].alias("q2"))


@query("SELECT 'y' AS response, 'a,b' AS terms, 'a:b' AS products, TRUE AS intercept")
def b20_formula(s, d):
    y, terms, products, intercept = prep.parse_formula("y ~ a * b")
    return frame(s, [(y, ",".join(terms), ",".join(":".join(p) for p in products), intercept)], "response string, terms string, products string, intercept boolean")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 8) AS l_quantity FROM lineitem")
def b21_standardise(s, d):
    return prep.standardise(line(s, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_quantity", 8).alias("l_quantity"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity, 0.0::DOUBLE AS l_tax FROM lineitem")
def b22_override(s, d):
    return prep.override(line(s, d), {"l_quantity": lambda c: c + 1, "l_tax": 0.0}).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query("SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n FROM (SELECT (o_orderkey > (SELECT quantile_cont(o_orderkey, 0.25) FROM orders))::INT + (o_orderkey > (SELECT quantile_cont(o_orderkey, 0.5) FROM orders))::INT + (o_orderkey > (SELECT quantile_cont(o_orderkey, 0.75) FROM orders))::INT AS fold FROM orders) GROUP BY 1")
def b23_folds(s, d):
    return prep.folds(table(s, d, "orders"), 4, "o_orderkey").groupBy("fold").agg(F.count("*").alias("n"))


# --- C: joins ------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def c1_merge(s, d):
    region = table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.merge(table(s, d, "nation"), region, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a FULL JOIN (SELECT r_regionkey * 10 AS k, r_name AS v FROM region) b ON a.k = b.k")
def c1_merge_outer(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return joins.merge(n, table(s, d, "region").select((F.col("r_regionkey") * 10).alias("k"), F.col("r_name").alias("v")), "k", "outer")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def c1_merge_anti(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.merge(table(s, d, "customer"), orders, "c_custkey", "anti").select("c_custkey")


@query("SELECT 'n_regionkey' AS key")
def c2_common_keys(s, d):
    region = table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return frame(s, [(k,) for k in joins.common_keys(table(s, d, "nation"), region)], "key string")


#: Customers as treated rows, suppliers as controls, by account balance.
BALANCES = "(SELECT c_custkey * 2 AS id, c_acctbal AS s, 1 AS t FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_acctbal, 0 FROM supplier)"


def balances(s, d):
    a = table(s, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_acctbal").alias("s"), F.lit(1).alias("t"))
    return a.unionAll(table(s, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_acctbal").alias("s"), F.lit(0).alias("t")))


@query(f"SELECT a.id, round(min(abs(a.s - b.s)), 6) AS distance FROM {BALANCES} a JOIN {BALANCES} b ON a.t = 1 AND b.t = 0 GROUP BY a.id")
def c3_nearest_join(s, d):
    return joins.nearest(balances(s, d), "id", "s", "t").select("id", F.round("distance", 6).alias("distance"))


@query()
def c3_greedy_join(s, d):
    return joins.greedy_match(balances(s, d), "id", "s", "t", 200.0)


@query(f"SELECT a.id, b.id AS match_id FROM {BALANCES} a JOIN {BALANCES} b ON a.t = 1 AND b.t = 0 AND abs(a.s - b.s) <= 25")
def c4_radius_join(s, d):
    return joins.within_radius(balances(s, d), "id", "s", "t", 25.0).select("id", "match_id")


KNN = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5
"""


@query(KNN)
def c5_knn_lsh(s, d):
    e = table(s, d, "embeddings")
    return rounded(joins.knn_lsh(e, e.where("vec_id % 50 = 0"), 5))


@query(KNN)
def c6_knn_exact(s, d):
    e = table(s, d, "embeddings")
    return rounded(joins.knn_exact(e, e.where("vec_id % 50 = 0"), 5))


@query(KNN)
def c6_knn_blocks(s, d):
    e = table(s, d, "embeddings")
    return rounded(joins.knn_blocks(e, e.where("vec_id % 50 = 0"), 5))


POINTS = "(SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) * 100 AS y FROM supplier)"


def points(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))


@query(f"SELECT i, j, 0.25::DOUBLE AS w FROM (SELECT a.i, b.i AS j, row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.i) AS r FROM {POINTS} a JOIN {POINTS} b ON a.i <> b.i) WHERE r <= 4")
def c7_knn_weights(s, d):
    return joins.knn_weights(points(s, d), "i", ["x", "y"], 4)


@query("SELECT b.n_name AS dst, count(*) AS n FROM customer JOIN nation b ON c_nationkey = n_nationkey GROUP BY 1")
def c9_neighbour_sum(s, d):
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("dst")).agg(F.count("*").alias("n"))


# --- D: description --------------------------------------------------------------------------------------------------------


def _per_column(stats: str, columns=NUMBERS, source: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {stats.replace('@', c)} FROM {source}" for c in columns)


@query(_per_column("count(@) AS count, count(*) - count(@) AS missing, round(100.0 * (1 - count(@) / count(*)), 4) AS missing_pct, count(DISTINCT @) AS unique, round(avg(@), 4) AS mean, round(stddev_samp(@), 4) AS std, round(min(@), 4) AS min, round(median(@), 4) AS median, round(max(@), 4) AS max, round(skewness(@), 4) AS skew, round(kurtosis(@), 4) AS kurtosis"))
def d1_profile(s, d):
    return rounded(describe.profile(line(s, d), NUMBERS), 4)


@query("SELECT variable, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rank FROM (SELECT 'l_returnflag' AS variable, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2)) WHERE rank <= 3")
def d8_top_values(s, d):
    return describe.top_values(line(s, d), ["l_returnflag", "l_linestatus"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def d2_correlation_pearson(s, d):
    return rounded(describe.correlations(line(s, d), NUMBERS))




@query("""WITH a AS (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(ra, rb), 6) AS r, count(*) AS n FROM a""")
def d2_correlation_spearman(s, d):
    return rounded(describe.correlations(line(s, d), ["l_quantity", "l_extendedprice"], "spearman"))


@query("""WITH a AS (SELECT p_size AS x, p_retailprice AS y FROM part),
p AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y))) / 2 AS s FROM a, a b),
n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM a), tx AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM a GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM a GROUP BY y))
SELECT 'p_size' AS x, 'p_retailprice' AS y, round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS r, (SELECT count(*) FROM a) AS n FROM p, n, tx, ty""")
def d2_correlation_kendall(s, d):
    return rounded(describe.correlations(table(s, d, "part"), ["p_size", "p_retailprice"], "kendall"))


@query()
def d2_correlation_tests(s, d):
    return describe.correlation_tests(line(s, d), NUMBERS)


@query(_per_column("count(@) AS count, round(avg(@), 3) AS mean, round(stddev_samp(@), 3) AS std, round(min(@), 3) AS min, round(quantile_cont(@, 0.25), 3) AS q1, round(quantile_cont(@, 0.5), 3) AS median, round(quantile_cont(@, 0.75), 3) AS q3, round(max(@), 3) AS max"))
def d4_describe(s, d):
    return describe.describe_numeric(line(s, d), NUMBERS)


@query("SELECT 'l_returnflag' AS variable, count(*) AS count, count(DISTINCT l_returnflag) AS unique, (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, (SELECT count(*) FROM lineitem GROUP BY l_returnflag ORDER BY 1 DESC LIMIT 1) AS freq FROM lineitem")
def d4_describe_categorical(s, d):
    return describe.describe_categorical(line(s, d), ["l_returnflag"])


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 5) AS weighted_mean FROM lineitem")
def d5_weighted_mean(s, d):
    return rounded(describe.weighted_mean(line(s, d), "l_extendedprice", "l_quantity"), 5)


@query("SELECT round(sqrt(sum(l_quantity * power(l_extendedprice - m, 2)) / sum(l_quantity)), 5) AS weighted_std FROM lineitem, (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem)")
def d6_weighted_std(s, d):
    return rounded(describe.weighted_std(line(s, d), "l_extendedprice", "l_quantity"), 5)


@query("SELECT count(p_retailprice) AS count, round(sum(p_retailprice), 4) AS sum, round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part")
def d7_selection_stats(s, d):
    return rounded(describe.selection_stats(table(s, d, "part"), "p_retailprice"), 4)


@query(_per_column("avg(CASE WHEN @ IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_share, count(DISTINCT @) AS unique", ["p_brand", "p_size"], "part"))
def d9_missing_report(s, d):
    return describe.missing_report(table(s, d, "part"), ["p_brand", "p_size"])


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS grouping, count(*) AS n, round(avg(o_totalprice), 5) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def d10_cell_means(s, d):
    return rounded(describe.cell_means(table(s, d, "orders"), "o_totalprice", "o_orderstatus", "o_orderpriority"), 5)


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def d10_group_means(s, d):
    return rounded(describe.group_means(line(s, d), "l_quantity", "l_returnflag"))


@query("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 5) AS m2, round(avg(power(x - m, 3)), 2) AS m3, round(avg(power(x - m, 4)), 2) AS m4 FROM (SELECT l_quantity AS x, (SELECT avg(l_quantity) FROM lineitem) AS m FROM lineitem)")
def d12_moments(s, d):
    r = describe.moments(line(s, d), "l_quantity")
    return r.select("n", F.round("mean", 6).alias("mean"), F.round("m2", 5).alias("m2"), F.round("m3", 2).alias("m3"), F.round("m4", 2).alias("m4"))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(sum(l_quantity * l_quantity), 3) AS qq, round(sum(l_quantity * l_extendedprice), 0) AS qp, round(sum(l_tax * l_extendedprice), 1) AS tp FROM lineitem")
def d13_gram(s, d):
    from ..plans.gram import complete, gram

    g = gram(complete(line(s, d), {c: c for c in NUMBERS}), NUMBERS)
    m = g.raw(["l_quantity", "l_extendedprice", "l_tax"])
    return frame(s, [(float(g.n), round(m[0, 0], 3), float(round(m[0, 1])), round(m[2, 1], 1))], "n double, qq double, qp double, tp double")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS l_quantity FROM lineitem")
def d14_demean(s, d):
    from ..operators.panel import demean

    return rounded(demean(line(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_quantity"], "l_suppkey").select("l_orderkey", "l_linenumber", "l_quantity"))


@query("SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def d17_histogram(s, d):
    return describe.histogram(line(s, d), "l_quantity", 10).select("bin", "n")


@query("SELECT l_returnflag, round(min(l_extendedprice), 5) AS min, round(quantile_cont(l_extendedprice, 0.25), 5) AS q1, round(quantile_cont(l_extendedprice, 0.5), 5) AS median, round(quantile_cont(l_extendedprice, 0.75), 5) AS q3, round(max(l_extendedprice), 5) AS max FROM lineitem GROUP BY 1")
def d18_box_stats(s, d):
    return rounded(describe.box_stats(line(s, d), "l_extendedprice", "l_returnflag").select("l_returnflag", "min", "q1", "median", "q3", "max"), 5)


@query()
def d18_density(s, d):
    return describe.density(line(s, d), "l_extendedprice")


@query("SELECT l_extendedprice AS quantile FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem) WHERE r = floor(0.3 * (n - 1))")
def d19_empirical_quantile(s, d):
    return describe.empirical_quantile(line(s, d), "l_extendedprice", 0.3)


# --- E: order -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def e3_head(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank FROM orders) WHERE rank <= 3")
def e4_top_k(s, d):
    from ..operators.ml import top_by_heap

    return top_by_heap(table(s, d, "orders"), "o_custkey", "o_totalprice", 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def e5_average_ranks(s, d):
    return with_ranks(line(s, d), "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def e6_lag(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query("SELECT l_quantity, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM lineitem GROUP BY 1")
def e7_running_counts(s, d):
    return running_counts(line(s, d), "l_quantity", ("n", F.count(F.lit(1))))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def e10_concat(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def e11_distinct(s, d):
    return line(s, d).select("l_returnflag", "l_linestatus").distinct()


@query()
def e12_shuffle(s, d):
    return table(s, d, "part").select("p_partkey", F.xxhash64("p_partkey", F.lit(7)).alias("place")).orderBy("place")


# --- F: functions ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN abs(u) <= 1 THEN 1 - abs(u) ELSE 0 END, 8) AS triangular, round(CASE WHEN abs(u) <= 1 THEN 0.5 ELSE 0 END::DOUBLE, 8) AS uniform, round(CASE WHEN abs(u) <= 1 THEN 0.75 * (1 - u * u) ELSE 0 END, 8) AS epanechnikov FROM (SELECT event_id, value / 100.0::DOUBLE AS u FROM events)")
def f7_kernels(s, d):
    u = F.col("value") / 100.0
    return table(s, d, "events").select("event_id", *[F.round(C.KERNELS[k](u), 8).alias(k) for k in ("triangular", "uniform", "epanechnikov")])


@query("SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-p)), 8) AS expit, round(p * (1 - p), 8) AS v FROM (SELECT *, l_quantity / 51.0::DOUBLE AS p FROM lineitem)")
def f8_links(s, d):
    p = F.col("l_quantity") / 51.0
    return line(s, d).select("l_orderkey", "l_linenumber", F.round(C.link("logit", p), 6).alias("logit"), F.round(C.inverse_link("logit", p), 8).alias("expit"), F.round(C.variance("binomial", p), 8).alias("v"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS ip FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def f10_distances(s, d):
    e = table(s, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(C.inner_product(F.col("embedding"), F.col("b")), 6).alias("ip"))


@query("SELECT p_partkey, round(1 + 2 * x + 3 * x * x, 6) AS v FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x FROM part)")
def f11_polynomial(s, d):
    c = polynomials.lagrange([0.0, 1.0, 2.0], [1.0, 6.0, 17.0])
    return table(s, d, "part").select("p_partkey", F.round(polynomials.value(c, F.col("p_size") / 10.0), 6).alias("v"))


@query("SELECT event_id, round(sign(value) * greatest(abs(value) - 10, 0), 6) AS v FROM events")
def f12_soft_threshold(s, d):
    return table(s, d, "events").select("event_id", F.round(C.soft_threshold(F.col("value"), 10.0), 6).alias("v"))
