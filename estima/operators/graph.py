"""Graphs as edge tables: ranks by iterated joins, communities by distributed moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written


def build(edges: DataFrame, source: str, target: str, weight: str | None = None, directed: bool = False) -> DataFrame:
    """(src, dst, w): weights of repeated edges are summed; undirected graphs hold both directions, self loops twice."""
    e = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna()
    if not directed:
        e = e.union(e.select("dst", "src", "w"))
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(graph: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, seeds: Sequence | None = None, personal: DataFrame | None = None) -> DataFrame:
    """(node, score), sum 1: mass flows from src to dst, that of nodes without edges out goes where restarts go. seeds or a
    table (node, p): personalised restarts. Edges are partitioned by src and written once; a round shuffles the
    ranks and the messages, which partial sums combine."""
    out = graph.groupBy("src").agg(F.sum("w").alias("total"))
    share = written(graph.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    if seeds is not None:
        keep = F.col("node").isin(list(seeds))
        restart = nodes.withColumn("r", F.when(keep, 1.0 / len(set(seeds))).otherwise(0.0))
    elif personal is not None:
        total = personal.agg(F.sum("p")).first()[0]
        restart = nodes.join(personal, "node", "left").select("node", (F.coalesce("p", F.lit(0.0)) / total).alias("r"))
    else:
        restart = nodes.withColumn("r", F.lit(1.0 / nodes.count()))
    dangling = out.select(F.col("src").alias("node"), F.lit(True).alias("out"))
    base = written(restart.join(dangling, "node", "left").select("node", "r", F.col("out").isNull().alias("ends")))
    rank = base.select("node", "r", "ends", F.col("r").alias("score"))
    for step in range(1, rounds + 1):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("score"))), F.lit(0.0))).first()[0]
        sent = share.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        new = rank.join(sent, "node", "left").select("node", "r", "ends", (damping * F.coalesce("got", F.lit(0.0)) + (damping * lost + 1 - damping) * F.col("r")).alias("next"), "score")
        new = written(new)
        gap = new.agg(F.sum(F.abs(F.col("next") - F.col("score")))).first()[0]
        rank = new.select("node", "r", "ends", F.col("next").alias("score"))
        if gap < tol:
            break
    total = rank.agg(F.sum("score")).first()[0]
    return rank.select("node", (F.col("score") / total).alias("score"))


def pagerank_fixed(graph: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    return pagerank(graph, damping, rounds, 0.0)


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Of (node, community) on an undirected graph from build(), self loops included: inner weights less what degrees
    alone would give."""
    own = labels.select("node", "community")
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    m2 = graph.agg(F.sum("w").alias("m2"))
    inner = graph.join(own.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
    spread = degree.join(own, "node").groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("q"))
    one = inner.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(m2))
    return one.select((F.col("inner") / F.col("m2") - resolution * F.col("q") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def _move(graph: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(node, community) after rounds of best moves. In a round the nodes of one parity of a seeded hash move at once, so
    that neighbours don't swap for ever; a move must gain."""
    m2 = graph.agg(F.sum("w")).first()[0]
    degree = written(graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    label = degree.select("node", "k", F.col("node").alias("community"))
    quiet = 0
    for step in range(rounds):
        sums = label.groupBy("community").agg(F.sum("k").alias("total"))
        near = graph.where("src <> dst").join(label.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("to"))
        mine = label.select("node", "k", F.col("community").alias("now"))
        options = near.join(mine, "node").join(sums, "community")
        own = F.col("community") == F.col("now")
        gain = F.col("to") - resolution * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) / m2
        best = options.select("node", "community", gain.alias("gain"), own.alias("own")).groupBy("node").agg(F.max(F.struct(F.col("gain"), F.col("community"))).alias("b"), F.max(F.when(F.col("own"), F.col("gain"))).alias("stay"))
        alone = label.join(sums, "community").select("node", "k", "community", "total")
        joined = alone.join(best, "node", "left")
        stay = F.coalesce("stay", -resolution * F.col("k") * (F.col("total") - F.col("k")) / m2)
        turn = F.pmod(F.xxhash64("node", F.lit(step // 2)), F.lit(2)) == step % 2
        go = turn & (F.col("b.gain") > stay + 1e-12)
        new = written(joined.select("node", "k", F.when(go, F.col("b.community")).otherwise(F.col("community")).alias("community"), F.coalesce(go, F.lit(False)).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("node", "k", "community")
        quiet = 0 if moved else quiet + 1
        if quiet >= 2:
            break
    return label.select("node", "community")


def louvain(graph: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 16) -> tuple[DataFrame, list[float]]:
    """((node, community, level sizes follow from it), modularity by level): moves, then communities become nodes, until
    nothing gains. A valid optimum of its own order of moves; modularity is of the original graph."""
    base = written(graph)
    work, label, history = base, None, []
    for _ in range(levels):
        step = _move(work, resolution, rounds)
        new = step if label is None else label.join(step.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community"))
        new = written(new)
        q = modularity(base, new, resolution).first()[0]
        if history and q <= history[-1] + 1e-9:
            break
        label = new
        history.append(q)
        merged = work.join(step.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        before, work = work, written(merged)
        if work.select("src").distinct().count() == before.select("src").distinct().count():
            break
    return label, history


def community_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("community").agg(F.count("*").alias("size"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """Of pairs of opposite edges the weaker (ties: the one from the larger node), which a repair would remove."""
    e = edges.select("src", "dst", "w")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    both = e.join(back, ["src", "dst"]).where("src <> dst")
    return both.where((F.col("w") < F.col("v")) | ((F.col("w") == F.col("v")) & (F.col("src") > F.col("dst")))).select("src", "dst", "w")


def triangle_counts(graph: DataFrame) -> DataFrame:
    """(node, triangles) of an undirected graph, edges turned from the smaller degree to the larger so that hubs make no
    squares of their neighbours."""
    e = graph.where("src < dst").select("src", "dst")
    deg = graph.where("src <> dst").groupBy("src").agg(F.count("*").alias("d"))
    both = e.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    turned = written(both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    two = turned.join(turned.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = two.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    long = closed.select(F.explode(F.array("a", "b", "c")).alias("node"))
    return long.groupBy("node").agg(F.count("*").alias("triangles"))


