"""Mixing sources to target weights: hierarchical budgets over a tree of groups, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, join_small, scratch, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(column == value, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with a column budget.

    From the root down, each node's budget is dealt among its children in proportion to their weights (1 where
    none is given). A child can use its tokens times max_epochs at most; what it cannot use goes to its siblings,
    again by weight, and only if all of them are full does it stay unused in their parent, whose own limit (the
    sum of its leaves') has by then sent it to the parent's siblings. Budgets are whole tokens, rounded down.
    """
    leaves = leaves.withColumn("__cap", F.col("tokens") * F.lit(int(max_epochs)))
    above = leaves.agg(F.least(F.lit(int(total)), F.coalesce(F.sum("__cap"), F.lit(0))).alias("__given")).withColumn("__root", F.lit(0))
    for depth, level in enumerate(levels, 1):
        upper = levels[: depth - 1] or ["__root"]
        nodes = leaves.withColumn("__root", F.lit(0)).groupBy("__root", *levels[:depth]).agg(F.sum("__cap").alias("__c"))
        nodes = nodes.withColumn("__w", _weight(F.col(level), weights.get(level, {}))).where("__c > 0 AND __w > 0")
        nodes = nodes.drop("__root").join(above, upper) if depth > 1 else nodes.join(F.broadcast(above), upper)
        nodes = nodes.withColumn("__ratio", F.col("__c").cast("double") / F.col("__w"))
        group = Window.partitionBy(*upper)
        first = group.orderBy("__ratio", level).rowsBetween(Window.unboundedPreceding, -1)
        # In whole numbers: what is left for a node and those after it, and their weights.
        exact = lambda c: c.cast("decimal(28,0)")
        nodes = nodes.withColumns({"__left": F.col("__given") - F.coalesce(F.sum("__c").over(first), F.lit(0)), "__ws": F.sum("__w").over(group) - F.coalesce(F.sum("__w").over(first), F.lit(0))})
        nodes = nodes.withColumn("__full", exact(F.col("__left")) * exact(F.col("__w")).cast("decimal(10,0)") >= exact(F.col("__c")) * F.col("__ws").cast("decimal(10,0)"))
        # All after the first that isn't full deal what is left there.
        short = F.min(F.when(~F.col("__full"), F.struct("__ratio", level, "__left", "__ws"))).over(group)
        nodes = nodes.withColumns({"__sl": short["__left"], "__sw": short["__ws"]})
        dealt = F.expr("cast((cast(__sl as decimal(28,0)) * cast(__w as decimal(10,0))) div cast(__sw as decimal(10,0)) as bigint)")
        nodes = nodes.withColumn("__b", F.when(F.col("__full"), F.col("__c")).otherwise(F.least(F.col("__c"), dealt)))
        above = nodes.select(*levels[:depth], F.col("__b").alias("__given"))
    return leaves.join(above, levels, "left").select(*levels, "tokens", F.coalesce("__given", F.lit(0)).cast("long").alias("budget"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A row's place in an epoch's permutation: the md5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float = 0.6, max_epochs: int = 2, seed: int = 1, digits: tuple[int, ...] = (2, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs chosen to meet the weights, once for every epoch that takes them: all columns of docs,
    then the levels as __l1, __l2, ... and __epoch (from 0); a name that docs has gets underscores added.

    total is share of all words, rounded down. A leaf of t words and budget b gives b // t whole epochs and, of
    the next epoch, the longest prefix of its seeded permutation with at most b % t words; rows with equal keys
    (repeated ids) come or stay together. A level that is null counts as the text <null>, null or empty texts
    have no words and come with their epoch or prefix, a leaf without words gives nothing, and an empty table
    gives an empty table.

    The permutation of a leaf is never sorted in one task: words are summed by leaf and the first of the
    key's hex digits, the sums are accumulated, the one bucket in which the budget ends is summed by further digits,
    and only what is left, one part in 65,536, is ordered row by row. Texts are not
    shuffled as long as the budgets, one row a leaf, are few enough to be broadcast after they are counted (500,000); the
    children of one node are ordered in one task, a row for each.
    """
    *names, epoch, whole, cut_, times = free_names(docs.columns, *[f"__l{i}" for i in range(1, len(levels) + 1)], "__epoch", "__whole", "__cut", "__n")
    keyed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("<null>")) for n, c in zip(names, levels.values())})
    with scratch(docs.sparkSession):
        slim = written(keyed.select(F.col(f"`{id_col}`").alias("__id"), *names, n_words(F.col(f"`{text_col}`")).alias("__tokens")))
        plan, n_leaves = _plan(slim, names, levels, weights, share, max_epochs, seed, digits)
    out = join_small(keyed, plan.select(*names, F.col("__whole").alias(whole), F.col("__cut").alias(cut_)), names, n_leaves)
    taken = F.col(whole) + F.when(order_key(F.col(f"`{id_col}`"), F.col(whole), seed) <= F.col(cut_), 1).otherwise(0)
    out = out.withColumn(times, taken.cast("int")).where(F.col(times) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *names, epoch)


def _plan(slim: DataFrame, names: list[str], levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int, digits: tuple[int, ...]) -> tuple[DataFrame, int]:
    """(of each leaf the whole epochs that it gives and the last key of the one that it gives in part, leaves)."""
    leaves = written(slim.groupBy(*names).agg(F.sum("__tokens").alias("tokens")))
    n_leaves, total = leaves.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    by_level = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    plan = written(budgets(leaves, names, by_level, int(total * share), max_epochs).where("budget > 0").select(*names, F.expr("budget div tokens").alias("__whole"), F.expr("budget % tokens").alias("__rest")))
    cut = _cuts(slim, plan, names, n_leaves, seed, digits)
    return written(plan.join(cut, names, "left"), keep=True), n_leaves


def _cuts(slim: DataFrame, plan: DataFrame, names: list[str], n_leaves: int, seed: int, digits: tuple[int, ...]) -> DataFrame:
    """(names, __cut): of each leaf with a part of an epoch, the last key that the part holds. Each round narrows the
    place where the budget ends to one bucket of the round before, by sums over its 256 or so parts."""
    rows = join_small(slim, plan.where("__rest > 0").select(*names, "__whole"), names, n_leaves).withColumn("__key", order_key(F.col("__id"), F.col("__whole"), seed)).select(*names, "__key", "__tokens")
    at = plan.where("__rest > 0").select(*names, F.lit("").alias("__at"), F.col("__rest").alias("__left"))
    for n, width in enumerate(digits):
        if n:
            rows = rows.withColumn("__at", F.substring("__key", 1, digits[n - 1]))
        own = join_small(rows, at, [*names, "__at"] if n else names, n_leaves).withColumn("__part", F.substring("__key", 1, width))
        sums = own.groupBy(*names, "__part", "__left").agg(F.sum("__tokens").alias("__s"))
        run = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = sums.withColumn("__to", F.sum("__s").over(run)).where("__to > __left").groupBy(*names)
        at = ends.agg(F.min(F.struct("__part", (F.col("__left") - F.col("__to") + F.col("__s")).alias("__l"))).alias("__f"))
        at = written(at.select(*names, F.col("__f.__part").alias("__at"), F.col("__f.__l").alias("__left")))
    inner = join_small(rows.withColumn("__at", F.substring("__key", 1, digits[-1])), at, [*names, "__at"], n_leaves)
    peers = Window.partitionBy(*names).orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("__to", F.sum("__tokens").over(peers)).groupBy(*names).agg(F.max(F.when(F.col("__to") <= F.col("__left"), F.col("__key"))).alias("__k"))
    return at.join(inner, names, "left").select(*names, F.coalesce("__k", "__at").alias("__cut"))
