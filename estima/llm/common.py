"""What the operators share: tables in the shared folder, heavy-hitter joins, edges to components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.plans.storage import scratch, shared_folder, written

__all__ = ["MAX_BROADCAST_ROWS", "components", "free_names", "join_small", "scratch", "shared_folder", "small_batches", "union_all", "written"]

#: Rows of at most a few dozen bytes each; under 100 MB, so that a broadcast is safe.
MAX_BROADCAST_ROWS = 500_000


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no taken name equals it, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """From now on Arrow batches of this session have at most so many rows and bytes. Rows of texts are large: a batch of
    Spark's usual 10,000 holds tens of MB in the JVM and again in each Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """big joined with a table of distinct keys. It is broadcast only if its counted rows are within
    MAX_BROADCAST_ROWS; beyond that both sides shuffle and the big side's hot keys are dealt over 64 salts."""
    if rows <= MAX_BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salts = 64
    (salt,) = free_names([*big.columns, *small.columns], "__salt")
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, salt], how).drop(salt)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that a path of edges (a, b) reaches, for every node with an edge.

    Alternates large-star and small-star steps: each node hooks its larger (then smaller) neighbours to the
    smallest node it knows. The number of edges never grows and the rounds are logarithmic. Minima are taken by
    partial aggregates, so a node of very many edges costs no task more than its share of rows; the join that
    brings a node its minimum is one that adaptive execution may split.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: u keeps only smaller neighbours, all of which and u itself hook to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = written(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
