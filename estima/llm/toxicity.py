"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic rows plus unlabelled text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, scratch, small_batches, written

WORDS = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7)
#: The bounds of what the classifier is fitted on: rows of confirmed toxic text, of unlabelled text, and features.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 5000, 20000, 4096
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str) -> tuple[Counter[str], int]:
    """(how often each word in lower case, behind a =, and each beginning of words, behind a ^, occurs; words)."""
    words, out = Counter(WORDS.findall(text.lower())), Counter()
    for word, n in words.items():
        out["=" + word] += n
        for k in PREFIXES:
            if len(word) >= k:
                out["^" + word[:k]] += n
    return out, sum(words.values())


def value(count: float, n_words: int) -> float:
    """What a feature of so many places counts in a text of so many words: chance finds grow with the length, their
    spread with its root."""
    return 5 * count / math.sqrt(n_words + 10)


def length(n_words: int) -> float:
    return math.log1p(n_words) - 5


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    by_length: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, more: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, those of the dense columns) of a linear classifier, fitted by the non-negative risk estimator

        prior * mean over positives of loss(+) + max(0, mean over unlabelled of loss(-) - prior * mean over positives of loss(-))

    with the sigmoid loss, which is bounded. Where the second part is below 0 the step goes against its gradient,
    which undoes over-fitting of unlabelled rows. rows, columns, values: the sparse matrix; more: dense columns, the
    first of ones; positive: by row, whether it is confirmed, else it is unlabelled.
    """
    n, k = len(positive), more.shape[1]
    w, e = np.zeros(width), np.zeros(k)
    e[0] = math.log(prior / (1 - prior))
    m, v = np.zeros(width + k), np.zeros(width + k)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    for step in range(1, steps + 1):
        s = sigmoid(np.bincount(rows, w[columns] * values, n) + more @ e)
        slope = s * (1 - s)
        negative = s[u].sum() / n_u - prior * s[p].sum() / n_p
        g_negative = np.where(u, slope / n_u, -prior * slope / n_p)
        g = np.where(p, -prior * slope / n_p, 0) + g_negative if negative >= 0 else -g_negative
        grad = np.concatenate([np.bincount(columns, g[rows] * values, width) + decay * w, more.T @ g])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, e = w - move[:width], e - move[width:]
    return w, e


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", prior: float | None = None, seed: int = 0) -> Model:
    """A model learnt from labels of rows that are not held out.

    At most MAX_POSITIVE confirmed ids and MAX_UNLABELLED others, those of smallest seeded hash, are
    read, of rows that repeat an id that with the smallest text; their features are counted by a distributed aggregate, the MAX_FEATURES that most favour confirmed rows
    are kept, and only the rows' numbers of these features reach the driver. prior, the share of toxic rows, is by
    default that of the labelled rows.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    by_hash = lambda frame, n: frame.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    prior = prior if prior is not None else min(0.5, max(0.001, share or 0.0))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").where(~held_out(F.col("id"))).distinct()
    toxic = by_hash(known.where("y = 1").select("id"), MAX_POSITIVE).withColumn("p", F.lit(True))
    # Confirmed rows may be drawn among the unlabelled too; there they count as what they are, a draw from all text.
    drawn = by_hash(ids, MAX_UNLABELLED).withColumn("p", F.lit(False))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(toxic.unionByName(drawn).distinct()), "id")
    with scratch(docs.sparkSession):
        return _fitted(written(sample.groupBy("id", "p").agg(F.min("t").alias("t")).select("t", "p")), prior)


def _fitted(sample: DataFrame, prior: float) -> Model:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            marks: list[bool] = []
            for i, (text, p) in enumerate(zip(batch.column(0), batch.column(1).to_pylist()), 1):
                own = features(text.as_py())[0]
                names += own
                marks += [p] * len(own)
                if len(names) > 100_000 or i == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.bool_())], names=["f", "p"])
                    names, marks = [], []

    n_p, n_u = sample.agg(F.count_if("p"), F.count_if(~F.col("p"))).first()
    if not n_p or not n_u:
        return Model({}, math.log(prior / (1 - prior)), 0.0)
    counts = sample.mapInArrow(listed, "f string, p boolean").groupBy("f").agg(F.count_if("p").alias("k"), F.count_if(~F.col("p")).alias("n")).where("k >= 3")
    in_p, in_u = (F.col("k") + 0.5) / (n_p + 1), (F.col("n") + 0.5) / (n_u + 1)
    best = counts.withColumn("lift", in_p / in_u).where("lift >= 2.5").orderBy(F.desc(F.col("k") * F.log("lift")), "f").limit(MAX_FEATURES).select("f").toPandas()["f"]
    names = sorted(best)
    if not names:
        return Model({}, math.log(prior / (1 - prior)), 0.0)
    number = {f: i for i, f in enumerate(names)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, values, n = [], [], []
            for text in batch.column(0):
                found, words = features(text.as_py())
                own = sorted((number[f], value(c, words)) for f, c in found.items() if f in number)
                x.append([i for i, _ in own])
                values.append([a for _, a in own])
                n.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(n, pa.int64()), batch.column(1)], names=["x", "v", "n", "p"])

    # Ordered, so that the sums, and with them the weights, come out the same whatever the order of tasks.
    rows = sorted(sample.mapInArrow(numbers, "x array<int>, v array<double>, n long, p boolean").toPandas().itertuples(index=False), key=lambda r: (r.p, r.n, list(r.x), list(r.v)))
    flat = lambda parts, kind: np.concatenate([np.asarray(x, kind) for x in parts])
    at = np.repeat(np.arange(len(rows)), [len(r.x) for r in rows])
    more = np.array([[1.0, length(r.n)] for r in rows])
    weights, (bias, by_length) = nnpu(at, flat([r.x for r in rows], np.int64), flat([r.v for r in rows], float), more, np.array([r.p for r in rows], bool), len(names), prior)
    return Model({f: float(w) for f, w in zip(names, weights) if w}, float(bias), float(by_length))


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    words = {f[1:]: w for f, w in model.weights.items() if f[0] == "="}
    starts = {k: {f[1:]: w for f, w in model.weights.items() if f[0] == "^" and len(f) == k + 1} for k in PREFIXES}
    z = np.empty(len(texts))
    for i, text in enumerate(texts):
        counts = Counter(WORDS.findall((text or "").lower()))
        n, found = sum(counts.values()), []
        for word, count in counts.items():
            weight = words.get(word, 0.0)
            for k, own in starts.items():
                if len(word) >= k:
                    weight += own.get(word[:k], 0.0)
            if weight:
                found.append(weight * count)
        z[i] = model.bias + model.by_length * length(n) + value(math.fsum(found), n)
    return sigmoid(z)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, then __score (0 to 1) and __predicted (1 if the score reaches the threshold, else 0), with
    underscores added to a name that docs has.

    The whole of every text counts, by its words and their beginnings, and nothing but the text. A null
    text scores like an empty one: by the bias alone. Rows keep their number and may repeat; columns of any name
    stay; an empty table gives an empty table; without confirmed rows all score the prior.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # A part of a batch at a time, so that its texts are not all held twice.
            parts = [score_texts(batch.slice(at, 256).to_pylist(), model) for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    small_batches(docs.sparkSession)
    scorer = F.arrow_udf(run, "double")
    own, predicted = free_names(docs.columns, "__score", "__predicted")
    return docs.withColumn(own, scorer(F.col(f"`{text_col}`"))).withColumn(predicted, (F.col(own) >= threshold).cast("int"))

