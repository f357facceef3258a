"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of the bounded, documented sample from which pivots are picked and each query's first bound comes.
SAMPLE_ROWS = 2048
PIVOTS = 24
#: Vectors in one chunk of a pivot's cell, in one annulus of a chunk, and queries in one block.
CHUNK_ROWS, ANNULUS_ROWS, QUERY_ROWS = 8192, 512, 8192
#: Sums below this are exact in doubles.
EXACT = float(2**52)


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null if the vector or a component is null or not finite."""
    wrong = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNull() | wrong, None).otherwise(F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


LAST = np.iinfo(np.int64).max
NONE = -LAST


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pick(sample: np.ndarray, lift: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first pivots in the lifted space."""
    chosen, far = [0], _distance(sample, lift, sample[:1], lift[:1])[:, 0]
    while len(chosen) < min(k, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(sample, lift, sample[chosen[-1:]], lift[chosen[-1:]])[:, 0])
    return sample[chosen], lift[chosen]


def _distance(a: np.ndarray, a_lift: np.ndarray, b: np.ndarray, b_lift: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (a_lift**2)[:, None] + (b * b).sum(1) + b_lift**2 - 2 * (a @ b.T + np.outer(a_lift, b_lift))
    return np.sqrt(np.maximum(square, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, in Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    wide = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(wide, NONE + 1, LAST - 1).astype(np.int64)


def _keep(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of both sets of columns the k largest scores a row, ties to the smaller id."""
    s, i = np.concatenate([scores, more], 1), np.concatenate([ids, more_ids], 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)




def _search(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, top: float, ids: np.ndarray, x: np.ndarray, lift: np.ndarray, to_pivot: np.ndarray, pivot: np.ndarray, pivot_lift: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of a chunk's rows for each query. The rows are sorted by their distance to the pivot and cut into
    annuli. Each query takes the annuli in the order of their lower bound and stops at the first that lies, by the
    triangle inequality, farther than its k-th best so far (or than bound, a score that k rows are known to reach)."""
    order = np.lexsort((ids, to_pivot))
    ids, x, to_pivot = ids[order], x[order], to_pivot[order]
    starts = np.arange(0, len(ids), ANNULUS_ROWS)
    low, high = to_pivot[starts], to_pivot[np.minimum(starts + ANNULUS_ROWS, len(ids)) - 1]
    zero = np.zeros(len(q))
    d = _distance(q, zero, pivot[None], np.array([pivot_lift]))
    gap = np.maximum(0, np.maximum(low[None] - d, d - high[None]))
    turn = np.argsort(gap, axis=1, kind="stable")
    gap = np.take_along_axis(gap, turn, 1)
    length = (q * q).sum(1) + top
    slack = 1e-6 * (1 + np.sqrt(length))
    best, who = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), LAST, np.int64)
    open_ = np.arange(len(q))
    for step in range(len(starts)):
        known = np.maximum(best[open_, -1].astype(float), bound[open_])
        reach = np.sqrt(np.maximum(0, length[open_] - 2 * known)) + slack[open_]  # infinite while k are not known
        open_ = open_[gap[open_, step] <= reach]
        if not len(open_):
            break
        ring = turn[open_, step]
        for r in np.unique(ring):
            own = open_[ring == r]
            part = slice(starts[r], starts[r] + ANNULUS_ROWS)
            score = _scores(q[own], x[part])
            candidates = np.broadcast_to(ids[part], score.shape).copy()
            self_ = candidates == q_ids[own, None]
            score[self_], candidates[self_] = NONE, LAST
            if score.shape[1] > 4 * k:
                # Of equal scores at the edge the smaller ids must stay: cut by score and id together.
                edge = np.partition(score, -k, axis=1)[:, -k]
                keep = int((score >= edge[:, None]).sum(1).max())
                pick = np.argsort(-score, axis=1, kind="stable")[:, :keep] if keep <= score.shape[1] // 2 else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                score, candidates = np.take_along_axis(score, pick, 1), np.take_along_axis(candidates, pick, 1)
            best[own], who[own] = _keep(best[own], who[own], score, candidates, k)
    return best, who


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query marks, the k other rows of largest integer
    inner product of the quantised vectors, ties to the smaller id; all of them if there are fewer.

    A vector is lifted by a component that brings all to one length (0 for queries), so that a larger inner
    product is a smaller distance. Rows are keyed by their nearest pivot and distance. A cell is dealt over chunks
    of about CHUNK_ROWS by the hash of the id, so that a vector which many rows share fills no task; the queries
    come to each chunk in blocks of about QUERY_ROWS, and only those whose bound reaches the cell. The pivots and
    the first bounds come from SAMPLE_ROWS rows of smallest id hash, a fixed size that is broadcast; every row is
    indexed and results are exact whatever the sample.

    Rows whose id or vector is null, or whose vector holds null or non-finite components, take no part. Shorter
    vectors count as filled with zeros. Scores beyond 64 bits end at their limits. Of rows of equal id the one of the smallest vector, component by component,
    counts. An empty table, or one without queries, gives an empty table. No other column is read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")))
    rows = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "v").toPandas()
    top, width, n, n_queries = rows.agg(F.max("sq"), F.max(F.size("v")), F.count("*"), F.count_if("q")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return df.sparkSession.createDataFrame([], result)
    lift_of = lambda m: np.sqrt(np.maximum(0, top - (m * m).sum(1)))
    s_ids, s = sample["id"].to_numpy(), _matrix(sample["v"], width)
    pivots, pivot_lifts = _pick(s, lift_of(s), PIVOTS)

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = _matrix(frame["v"], width)
            d = _distance(m, lift_of(m), pivots, pivot_lifts)
            near = d.argmin(1)
            yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "cell": near.astype("i4"), "d": d[np.arange(len(d)), near]})

    index = written(rows.select("id", "v").mapInPandas(key, "id long, v array<long>, cell int, d double"))
    cells = index.groupBy("cell").agg(F.count("*").alias("rows"), F.min("d").alias("low"), F.max("d").alias("high")).toPandas()
    chunks = {int(c): max(1, -(-int(r) // CHUNK_ROWS)) for c, r in zip(cells["cell"], cells["rows"])}
    bounds = {int(c): (lo, hi) for c, lo, hi in zip(cells["cell"], cells["low"], cells["high"])}
    blocks = max(1, -(-int(n_queries) // QUERY_ROWS))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            q_ids, q = frame["id"].to_numpy(), _matrix(frame["v"], width)
            score = _scores(q, s).astype(float)
            score[s_ids[None] == q_ids[:, None]] = -np.inf
            bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
            reach = np.sqrt(np.maximum(0, (q * q).sum(1) + top - 2 * bound))
            d = _distance(q, np.zeros(len(q)), pivots, pivot_lifts)
            block = pd.util.hash_array(q_ids.astype("u8")) % np.uint64(blocks)
            for cell, (low, high) in bounds.items():
                gap = np.maximum(low - d[:, cell], d[:, cell] - high)
                hit = np.flatnonzero(gap <= reach + 1e-6 * (1 + reach + d[:, cell]))
                for chunk in range(chunks[cell]):
                    if len(hit):
                        yield pd.DataFrame({"id": q_ids[hit], "v": frame["v"].to_numpy()[hit], "bound": bound[hit], "cell": np.int32(cell), "chunk": np.int32(chunk), "block": block[hit].astype("i4")})

    asked = rows.where("q").select("id", "v").mapInPandas(ask, "id long, v array<long>, bound double, cell int, chunk int, block int")
    sizes = F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair])
    dealt = index.withColumn("chunk", F.pmod(F.xxhash64("id"), sizes[F.col("cell")]).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="i8")
        cell = key_[0]
        x = _matrix(right["v"], width)
        best, who = _search(left["id"].to_numpy(), _matrix(left["v"], width), left["bound"].to_numpy(), top, right["id"].to_numpy(), x, lift_of(x), right["d"].to_numpy(), pivots[cell], pivot_lifts[cell], k)
        there = who != LAST
        return pd.DataFrame({"query_id": np.broadcast_to(left["id"].to_numpy()[:, None], who.shape)[there], "vec_id": who[there], "score": best[there]})

    by = ["cell", "chunk", "block"]
    found = asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score long")
    # A limit within each group before the shuffle: k rows a query and task move.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
