"""A training corpus from documents: toxic rows go, of near duplicates one stays, sources are mixed to target weights,
and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.llm import bpe, mixing, ngram_join, toxicity
from estima.llm.common import join_small
from estima.llm.queries import BPE_RANKS, MIX_SEED, MIX_WEIGHTS, mix_levels, table

MIX_SHARE, MIX_EPOCHS = 0.8, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold. The classifier learns from the labels of rows not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(f"`{scored.columns[-1]}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id. Rows without an id stay; of rows that repeat an
    id one stays."""
    found = ngram_join.join(docs, count_links=False)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    rows, ids = found.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    kept = join_small(docs, gone, ["doc_id"], gone.count(), "left_anti")
    if rows != ids:
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights; a group short of text may repeat its rows in a second epoch."""
    rows = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text with digests of them and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep_decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    from estima.llm.common import written

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
