"""The operators' queries over the driver's tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, licenses, media, mixing, ngram_join, sharding, topk, toxicity, warc

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = [f"shard-{i:02d}" for i in range(40)]
TABLE_SIZE = 4099

MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 3, "de": 3, "fr": 2, "es": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_levels() -> dict:
    """The tree of the mixture: a domain (by the source's name), then language, then source."""
    domain = F.concat(F.lit("d"), F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 4), 16, 10).cast("int") % 4)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(media.pictures_of(table(spark, sf_dir, "embeddings")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return rows.select("doc_id", F.col("__l1").alias("domain"), F.col("__l2").alias("lang_group"), F.col("__l3").alias("source_group"), F.col("__epoch").alias("epoch"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sharding.assign_shards(docs, "doc_id", SHARDS, TABLE_SIZE)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep_ids=False, keep_decoded=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_topk, op3_media, op4_mixing, op5_sharding, op6_html, op7_toxicity, op8_ngram_join, op9_bpe, op10_licenses)}


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _op4_sql() -> str:
    def weight(level: str, column: str) -> str:
        cases = " ".join(f"WHEN {column} = '{v}' THEN {w}" for v, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    steps, names = [], ["l1", "l2", "l3"]
    for depth, (level, name) in enumerate(zip(("domain", "lang", "source"), names), 1):
        keys, upper = names[:depth], names[: depth - 1]
        above = "g0" if depth == 1 else f"g{depth - 1}"
        on = " AND ".join(f"n.{k} = a.{k}" for k in upper) or "TRUE"
        part = "PARTITION BY " + ", ".join(upper) if upper else ""
        steps.append(f"""
n{depth} AS (SELECT {", ".join(f"n.{k}" for k in keys)}, c, w, a.given, CAST(c AS DOUBLE) / w AS ratio
  FROM (SELECT {", ".join(keys)}, CAST(sum(cap) AS BIGINT) AS c, {weight(level, name)} AS w FROM leaf GROUP BY {", ".join(keys)}) n
  JOIN {above} a ON {on} WHERE c > 0 AND w > 0),
r{depth} AS (SELECT *, CAST(given - coalesce(sum(c) OVER before, 0) AS HUGEINT) AS rest, CAST(sum(w) OVER ({part}) - coalesce(sum(w) OVER before, 0) AS HUGEINT) AS ws,
    row_number() OVER ({part} ORDER BY ratio, {name}) AS turn
  FROM n{depth} WINDOW before AS ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, min(CASE WHEN rest * w < c * ws THEN turn END) OVER ({part}) AS short FROM r{depth}),
g{depth} AS (SELECT {", ".join(keys)}, CASE WHEN short IS NULL OR turn < short THEN c
    ELSE least(c, CAST(max(CASE WHEN turn = short THEN rest END) OVER ({part}) * w // max(CASE WHEN turn = short THEN ws END) OVER ({part}) AS BIGINT)) END AS given FROM f{depth})""")
    return f"""
WITH doc AS (
  SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INTEGER) % 4) AS l1,
         coalesce(lang, '<null>') AS l2, coalesce(source, '<null>') AS l3,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS t
  FROM documents),
leaf AS (SELECT l1, l2, l3, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(t) AS BIGINT) * {MIX_EPOCHS} AS cap FROM doc GROUP BY ALL),
g0 AS (SELECT CAST(least(CAST(floor(sum(tokens) * CAST({MIX_SHARE} AS DOUBLE)) AS BIGINT), sum(cap)) AS BIGINT) AS given FROM leaf),{",".join(steps)},
plan AS (SELECT leaf.l1, leaf.l2, leaf.l3, given // tokens AS whole, given % tokens AS rest FROM leaf JOIN g3 USING (l1, l2, l3) WHERE given > 0),
keyed AS (SELECT doc.*, whole, rest, md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM doc JOIN plan USING (l1, l2, l3)),
run AS (SELECT *, sum(t) OVER (PARTITION BY l1, l2, l3 ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
n AS (SELECT *, whole + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS times FROM run)
SELECT doc_id, l1 AS domain, l2 AS lang_group, l3 AS source_group, CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM n
"""


def _op5_sql() -> str:
    slots = ",".join(map(str, sharding.lookup_table(SHARDS, TABLE_SIZE)))
    return f"""
WITH t AS (SELECT [{slots}] AS slots),
d AS (SELECT doc_id, lang, source, n_chars, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT d.*, 'shard-' || lpad(CAST(slots[slot + 1] AS VARCHAR), 2, '0') AS shard FROM d, t
"""


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))
    WHEN len(ws) > 0 THEN [len(ws) || '|' || list_aggregate(ws, 'string_agg', ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS c FROM r GROUP BY node) m ON m.node = d.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) k ON k.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_topk": OP2_SQL, "op4_mixing": _op4_sql(), "op5_sharding": _op5_sql(), "op8_ngram_join": OP8_SQL}
