"""Joins beyond equality: nearest, within a radius, k nearest vectors, spatial neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DISTANCES, cell_of
from ..plans.storage import written

#: Rows of a side that may be broadcast (of numbers and keys, not texts).
MAX_BROADCAST_ROWS = 100_000
#: Rows that greedy matching holds in one task.
SLICE_ROWS = 100_000


def common_keys(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def merge(a: DataFrame, b: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join in which null keys match each other and clashing columns get suffixes. on: shared keys by default.
    how: inner, left, right, outer, semi or anti."""
    keys = common_keys(a, b) if on is None else [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("no key in common")
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    if how in ("semi", "anti"):
        condition = [a[k].eqNullSafe(b[k]) for k in keys]
        return a.join(b, condition, f"left_{how}")
    left = a.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else f"__l_{c}" if c in keys else c) for c in a.columns])
    right = b.select(*[F.col(f"`{c}`").alias(c + suffixes[1] if c in clash else f"__r_{c}" if c in keys else c) for c in b.columns])
    condition = None
    for k in keys:
        own = left[f"__l_{k}"].eqNullSafe(right[f"__r_{k}"])
        condition = own if condition is None else condition & own
    out = left.join(right, condition, {"outer": "full"}.get(how, how))
    return out.select(*[F.coalesce(f"__l_{k}", f"__r_{k}").alias(k) for k in keys], *[F.col(f"`{c}`") for c in [*left.columns, *right.columns] if not c.startswith(("__l_", "__r_"))])


def nearest_below_above(rows: DataFrame, id_col: str, score: str, treated: str, cells: int = 128) -> DataFrame:
    """(id, score, below_id, below, above_id, above): of each treated row the nearest controls on either side.

    A backward and a forward as-of join on one score. The score's range is cut into cells at quantiles; each
    cell's last and first control are carried over to its neighbours in a table of one row a cell, and the
    windows run within cells, so no task orders all rows."""
    own = rows.select(F.col(id_col).alias("id"), F.col(score).cast("double").alias("s"), F.col(treated).cast("int").alias("t")).dropna()
    cuts = own.agg(F.percentile_approx("s", [i / cells for i in range(1, cells)], 10000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    own = own.withColumn("cell", cell_of(F.col("s"), cuts))
    # Controls of one score are told apart by their id: the smaller is the nearer.
    controls = own.where("t = 0").groupBy("cell", "s").agg(F.min("id").alias("id"))
    ends = controls.groupBy("cell").agg(F.min(F.struct("s", "id")).alias("first"), F.max(F.struct("s", F.col("id"))).alias("last"))
    every = own.select("cell").distinct().join(ends, "cell", "left")
    order = Window.orderBy("cell")
    carried = every.select("cell", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("lo"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("hi"))
    both = controls.select("cell", "s", "id", F.lit(0).alias("t")).unionByName(own.where("t = 1").select("cell", "s", "id", "t"))
    point = F.when(F.col("t") == 0, F.struct("s", "id"))
    back = Window.partitionBy("cell").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("cell").orderBy("s").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumns({"b": F.max(point).over(back), "a": F.min(point).over(ahead)}).where("t = 1").join(F.broadcast(carried), "cell")
    low, high = F.coalesce("b", "lo"), F.coalesce("a", "hi")
    return seen.select("id", "s", low["id"].alias("below_id"), low["s"].alias("below"), high["id"].alias("above_id"), high["s"].alias("above"))


def nearest(rows: DataFrame, id_col: str, score: str, treated: str, caliper: float | None = None) -> DataFrame:
    """(id, match_id, distance): the control of nearest score for each treated row, with replacement; ties to the lower."""
    n = nearest_below_above(rows, id_col, score, treated)
    below, above = F.col("s") - F.col("below"), F.col("above") - F.col("s")
    lower = F.col("above").isNull() | (below <= above)
    out = n.select("id", F.when(lower, F.col("below_id")).otherwise(F.col("above_id")).alias("match_id"), F.when(lower, below).otherwise(above).alias("distance")).where("match_id IS NOT NULL")
    return out if caliper is None else out.where(F.col("distance") <= caliper)


def within_radius(rows: DataFrame, id_col: str, score: str, treated: str, radius: float) -> DataFrame:
    """(id, match_id, distance): all controls within radius of each treated row, by buckets as wide as the radius."""
    own = rows.select(F.col(id_col).alias("id"), F.col(score).cast("double").alias("s"), F.col(treated).cast("int").alias("t")).dropna()
    t = own.where("t = 1").select("id", "s", F.explode(F.array(*[F.floor(F.col("s") / radius) + d for d in (-1, 0, 1)])).alias("b"))
    c = own.where("t = 0").select(F.col("id").alias("match_id"), F.col("s").alias("cs"), F.floor(F.col("s") / radius).alias("b"))
    return t.join(c, "b").where(F.abs(F.col("s") - F.col("cs")) <= radius).select("id", "match_id", F.abs(F.col("s") - F.col("cs")).alias("distance"))


def knn_exact(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of data for each query. Queries that are few enough
    are broadcast; otherwise they meet the data in blocks by numpy (see knn_blocks)."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"))
    if q.limit(MAX_BROADCAST_ROWS // 100 + 1).count() > MAX_BROADCAST_ROWS // 100:
        return knn_blocks(data, queries, k, metric, id_col, vector_col)
    d = data.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("dv"))
    pairs = d.join(F.broadcast(q), F.col("vec_id") != F.col("query_id"))
    scored = pairs.select("query_id", "vec_id", DISTANCES[metric](F.col("qv"), F.col("dv")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def knn_blocks(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """As knn_exact, for many queries: blocks of queries meet blocks of data, each pair one matrix product."""
    n_q, n_d = queries.count(), data.count()
    qs, ds = max(1, -(-n_q // block)), max(1, -(-n_d // block))
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(qs)).alias("qb")).withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ds - 1).cast("long"))))
    d = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(ds)).alias("db")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qs - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
        a, b = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
        dot = a @ b.T
        if metric in ("l2", "euclidean"):
            dist = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * dot)
            dist = np.sqrt(dist) if metric == "euclidean" else dist
        else:
            dist = -dot if metric == "ip" else 1 - dot / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1)) + 1e-10)
        ids, own = right["id"].to_numpy(), left["id"].to_numpy()
        dist[own[:, None] == ids] = np.inf
        order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(own, order.shape[1]), "vec_id": ids[order].ravel(), "distance": np.take_along_axis(dist, order, 1).ravel()})
        return out[np.isfinite(out["distance"])]

    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(meet, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _halves(x: np.ndarray, size: int) -> list[tuple[int, float, int, int]]:
    """Cuts of a k-d tree: (dimension, value, node below it, node from it on) of each node, or dimension -1 and its leaf."""
    nodes: list[tuple[int, float, int, int]] = []

    def add(own: np.ndarray, leaves: list[int]) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, len(leaves), 0))
        side = int(np.argmax(own.max(0) - own.min(0)))
        cut = float(np.median(own[:, side]))
        if len(own) <= size or not 0 < (low := own[:, side] < cut).sum() < len(own):
            leaves.append(at)
            return at
        a = add(own[low], leaves)
        nodes[at] = (side, cut, a, add(own[~low], leaves))
        return at

    add(x, [])
    return nodes


def knn_cells(data: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 2048, fit: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, distance): as knn_blocks by squared distances, for vectors of few components; exact, ties
    to the smaller id. No row may be in both sides.

    Equal vectors are met once: of each vector of data its k smallest ids count, of the queries one. A k-d tree, whose
    cuts are fitted to some of the rows and decide the cost only, deals data into cells. A query meets the nearest cell
    first, then those that reach within its k-th distance."""
    v, own = F.col(vector_col).cast("array<double>"), Window.partitionBy("v").orderBy("id")
    d = data.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v IS NOT NULL")
    d = d.groupBy("v").agg(F.min("id").alias("id")) if k == 1 else d.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r")
    d = written(d)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), v.alias("v")).where("v IS NOT NULL")
    q = asked.groupBy("v").agg(F.min("query_id").alias("q"))
    n = d.count()
    some = d.orderBy(F.xxhash64("v")).limit(fit).select("v").collect()
    if not some:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("distance")).where("false")
    nodes = _halves(np.array([r["v"] for r in some], float), max(1, round(cell * len(some) / n)))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, at = np.stack(f["v"]).astype(float), np.zeros(len(f), int)
                for node, (side, cut, a, b) in enumerate(nodes):  # a node comes before those below it
                    here = at == node
                    if side >= 0 and here.any():
                        at[here] = np.where(x[here, side] < cut, a, b)
                yield f.assign(cell=at)

    d = written(d.mapInPandas(deal, "v array<double>, id long, cell int" if k == 1 else "id long, v array<double>, cell int"))
    p = len(some[0]["v"])
    ends = d.groupBy("cell").agg(*[f(F.col("v")[i]).alias(f"{m}{i}") for i in range(p) for m, f in (("a", F.min), ("b", F.max))]).collect()
    cells = np.array([r["cell"] for r in ends])
    low, high = (np.array([[r[f"{m}{i}"] for i in range(p)] for r in ends], float) for m in "ab")

    def go(first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), 1000):
                    g = f.iloc[at : at + 1000]
                    x = np.stack(g["v"]).astype(float)[:, None]
                    gap = (np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum(2)
                    near = gap.argmin(1)
                    if first:
                        yield g[["q", "v"]].assign(cell=cells[near])
                    else:
                        take = gap <= g["far"].to_numpy()[:, None] * (1 + 1e-9)
                        take[np.arange(len(g)), near] = False
                        i, c = np.nonzero(take)
                        yield g[["q", "v"]].iloc[i].assign(cell=cells[c])

        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            b, ids = np.stack(right["v"]).astype(float), right["id"].to_numpy()
            for at in range(0, len(left), 512):
                g = left.iloc[at : at + 512]
                a = np.stack(g["v"]).astype(float)
                dist = sum((a[:, i : i + 1] - b[:, i]) ** 2 for i in range(p))
                order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :k]
                out.append(pd.DataFrame({"q": np.repeat(g["q"].to_numpy(), order.shape[1]), "vec_id": ids[order].ravel(), "distance": np.take_along_axis(dist, order, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "distance": []})

    met = lambda x: x.groupBy("cell").cogroup(d.groupBy("cell")).applyInPandas(meet, "q long, vec_id long, distance double")
    one = written(met(q.select("q", "v").mapInPandas(go(True), "q long, v array<double>, cell int")))
    far = one.groupBy("q").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(math.inf).alias("far"))
    two = met(q.join(far, "q").select("q", "v", "far").mapInPandas(go(False), "q long, v array<double>, cell int"))
    best = one.unionByName(two).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return asked.join(q, "v").join(best, "q").select("query_id", "rank", "vec_id", "distance")


def reach(tables: int, projections: int, width: float, recall: float) -> float:
    """Up to which distance two vectors share a bucket in some table with a chance of at least recall."""
    def chance(distance: float) -> float:
        u = width / distance
        one = math.erf(u / math.sqrt(2)) - math.sqrt(2 / math.pi) / u * (1 - math.exp(-u * u / 2))
        return 1 - (1 - one**projections) ** tables

    low, high = 0.0, width
    while chance(high) >= recall:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(mid) >= recall else (low, mid)
    return low


def knn_lsh(data: DataFrame, queries: DataFrame, k: int, tables: int = 16, width: float = 0.5, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 8, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest by bucketed random projections, each true neighbour with a
    chance of at least recall. What shares a bucket in any table is compared. A neighbour that was missed is no
    farther than the k-th found, so a query stands if buckets hold pairs of that distance with a chance of recall
    (see reach); every other query meets all rows (knn_blocks). Rows without a vector are left out."""
    some = [rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), vector_col) for rows in (data, queries)]
    first = some[0].select(vector_col).first()
    if first is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    random, n = np.random.RandomState(seed), tables * projections
    planes, shifts, mix = random.randn(len(first[0]), n), random.rand(n), random.randint(1, 1 << 62, n)

    def hashes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        places = np.floor(np.stack(v).astype(float) @ planes / width + shifts).astype(np.int64)
        return pd.Series(list((places * mix).reshape(len(v), tables, projections).sum(2)))

    held = F.pandas_udf(hashes, "array<long>")
    d = some[0].select(F.col(id_col).alias("vec_id"), F.posexplode(held(vector_col)).alias("t", "h"))
    q = some[1].select(F.col(id_col).alias("query_id"), F.posexplode(held(vector_col)).alias("t", "h"))
    pairs = q.join(d, ["t", "h"]).where("query_id <> vec_id").select("query_id", "vec_id").distinct()
    both = pairs.join(some[0].select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("dv")), "vec_id").join(some[1].select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv")), "query_id")
    scored = both.select("query_id", "vec_id", DISTANCES["l2"](F.col("qv"), F.col("dv")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    found = written(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance"))
    sure = found.where((F.col("rank") == k) & (F.col("distance") <= reach(tables, projections, width, recall) ** 2)).select("query_id")
    rest = some[1].join(sure, F.col(id_col) == F.col("query_id"), "left_anti")
    return found.join(sure, "query_id", "left_semi").unionByName(knn_blocks(some[0], rest, k, "l2", id_col, vector_col))


def greedy_match(rows: DataFrame, id_col: str, score: str, treated: str, caliper: float | None = None, slices: int = 64) -> DataFrame:
    """(id, match_id, distance): matching without replacement, until no unmatched treated row has a free control
    within the caliper. Scores are cut into slices at quantiles; within a slice treated rows, by score then id, each
    take the nearest control that is left. Treated rows and controls that still have each other within the caliper
    go on to a next round: in one slice once they are at most SLICE_ROWS, before that in slices by chance and by
    score in turn, so that no task holds more than a slice. Distances may differ from those of one pass over all rows."""
    left = written(rows.select(F.col(id_col).cast("long").alias("id"), F.col(score).cast("double").alias("s"), F.col(treated).cast("int").alias("t")).dropna())
    found, turn = [], 0
    while True:
        pairs = written(_in_slices(left, caliper, slices, turn))
        if turn and not pairs.limit(1).count():
            # Slices parted all that could match: of the treated rows nearest to a control, the nearest has it.
            best = near.groupBy("match_id").agg(F.min(F.struct("distance", "id")).alias("b"))
            pairs = written(best.select("b.id", "match_id", "b.distance"))
        found.append(pairs)
        left = written(left.join(pairs.select(F.explode(F.array("id", "match_id")).alias("id")), "id", "left_anti"))
        near = written(nearest(left, "id", "s", "t", caliper))
        if not near.limit(1).count():
            return reduce(DataFrame.unionAll, found)
        # Controls only grow fewer: who has none within the caliper now never will.
        sought = nearest(left.withColumn("t", 1 - F.col("t")), "id", "s", "t", caliper)
        left = written(left.join(near.select("id").union(sought.select("id")), "id", "left_semi"))
        turn += 1


def _in_slices(rows: DataFrame, caliper: float | None, slices: int, turn: int) -> DataFrame:
    """(id, match_id, distance) of a round of greedy_match."""
    need = -(-rows.count() // SLICE_ROWS)
    n = max(slices, need) if turn == 0 else max(1, need)
    if turn % 2 or n == 1:
        own = rows.withColumn("cell", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(n))).withColumn("part", F.lit(0).cast("long"))
    else:
        cuts, times = np.unique(rows.agg(F.percentile_approx("s", [i / n for i in range(1, n)], 10000).alias("q")).first()["q"] or [], return_counts=True)

        def place(s: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, s.to_numpy(), "right"), dtype="int64")

        def parts(s: pd.Series) -> pd.Series:
            """Among how many slices the rows of a score are dealt: a frequent one is a cut several times."""
            at = np.searchsorted(cuts, s.to_numpy())
            same = np.append(cuts, np.nan)[at] == s.to_numpy()
            return pd.Series(np.where(same, np.append(times, 1)[at], 1), dtype="int64")

        own = rows.withColumn("cell", F.pandas_udf(place, "long")("s")).withColumn("part", F.pmod(F.xxhash64("id"), F.pandas_udf(parts, "long")("s")))

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        controls = frame[frame.t == 0].sort_values(["s", "id"])
        s, ids = controls.s.to_numpy(), controls.id.to_numpy()
        left, right = np.arange(-1, len(s) + 1), np.arange(1, len(s) + 3)  # linked lists over free controls, with ends
        out = []

        def free(links: np.ndarray, i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        below, above = np.arange(len(s) + 2), np.arange(len(s) + 2)  # place i stands for control i - 1; ends are always free
        del left, right
        for row in frame[frame.t == 1].sort_values(["s", "id"]).itertuples(index=False):
            at = int(np.searchsorted(s, row.s, "right"))
            lo, hi = free(below, at), free(above, at + 1)
            d_lo = row.s - s[lo - 1] if lo >= 1 else np.inf
            d_hi = s[hi - 1] - row.s if hi <= len(s) else np.inf
            pick, d = (lo, d_lo) if d_lo <= d_hi else (hi, d_hi)
            if np.isfinite(d) and (caliper is None or d <= caliper):
                out.append((row.id, int(ids[pick - 1]), float(d)))
                below[pick], above[pick] = pick - 1, pick + 1
        return pd.DataFrame(out, columns=["id", "match_id", "distance"]).astype({"id": "int64", "match_id": "int64", "distance": "float64"})

    return own.groupBy("cell", "part").applyInPandas(take, "id long, match_id long, distance double")


def knn_weights(points: DataFrame, id_col: str, coords: Sequence[str], k: int) -> DataFrame:
    """(i, j, w): w = 1 / k for the k nearest other points of each (ties to the smaller id)."""
    vec = F.array(*[F.col(c).cast("double") for c in coords])
    p = points.select(F.col(id_col).alias("vec_id"), vec.alias("embedding"))
    near = knn_blocks(p, p, k)
    return near.select(F.col("query_id").alias("i"), F.col("vec_id").alias("j"), F.lit(1.0 / k).alias("w"))


def distance_weights(points: DataFrame, id_col: str, coords: Sequence[str], bandwidth: float, power: float = 1.0, standardise: bool = True) -> DataFrame:
    """(i, j, w): inverse distance to the power for points nearer than bandwidth, through a grid of cells of that
    width; rows sum to 1 if standardised."""
    own = points.select(F.col(id_col).alias("i"), *[F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate(coords)])
    cells = [F.floor(F.col(f"x{n}") / bandwidth) for n in range(len(coords))]
    shifts = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(coords)), -1).reshape(-1, len(coords))
    around = F.explode(F.array(*[F.struct(*[(c + int(s)).alias(f"c{n}") for n, (c, s) in enumerate(zip(cells, shift))]) for shift in shifts]))
    a = own.withColumn("cell", around)
    b = own.select(F.col("i").alias("j"), *[F.col(f"x{n}").alias(f"y{n}") for n in range(len(coords))], F.struct(*[c.alias(f"c{n}") for n, c in enumerate(cells)]).alias("cell"))
    d = F.sqrt(sum((F.pow(F.col(f"x{n}") - F.col(f"y{n}"), 2) for n in range(len(coords))), F.lit(0.0)))
    w = a.join(b, "cell").where("i <> j").select("i", "j", d.alias("d")).where((F.col("d") > 0) & (F.col("d") < bandwidth)).select("i", "j", (1 / F.pow("d", power)).alias("w"))
    return row_standardise(w) if standardise else w


def row_standardise(w: DataFrame) -> DataFrame:
    """Weights (i, j, w) divided by their row's sum."""
    sums = w.groupBy("i").agg(F.sum("w").alias("__s"))
    return w.join(sums, "i").select("i", "j", (F.col("w") / F.col("__s")).alias("w"))
