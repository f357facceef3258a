"""Jaccard join on word n-grams by vertical partitioning: the global n-gram order is cut into fragments, overlaps are
counted in each fragment by itself and summed per pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_small, scratch, small_batches, written

#: 2 ** ORDER_BITS counters, dealt over blocks of BLOCK, say roughly how frequent an n-gram is. A fixed size.
ORDER_BITS, BLOCK = 20, 16384
FRAGMENTS = 8
#: So many rows of one n-gram, above the mean of a counter, make a salt of their own.
HOT_ROWS = 20_000
#: Texts are hashed in pieces of so many bytes, so that work space stays small beside a long text.
PIECE = 1 << 18
SPACES = (9, 10, 11, 12, 13, 32)
#: Where all pairs of a component are counted, blocks of classes have about so many n-grams and rows at most (a class
#: with more n-grams is a block of its own), and so many columns of their overlaps are counted at a time.
BLOCK_GRAMS, BLOCK_ROWS, COLUMNS = 1 << 19, 256, 4096

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash (xxh3) of each word of a lower-case text, which is split a piece at a time. split() parts bytes at
    space and tab to carriage return, no others."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = max(text.rfind(bytes([c]), at, end) for c in SPACES)
            # Without white space the word goes on, as far as its own end.
            end = cut + 1 if cut >= 0 else min([k for c in SPACES if (k := text.find(bytes([c]), end)) >= 0], default=len(text))
        words = text[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams, A-Z in lower case; of fewer words, one of them all."""
    h = word_hashes((text or b"").lower())
    if not len(h):
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _MIX[i % 5]
        out ^= out >> np.uint64(29)
        out *= _MIX[(i + 2) % 5]
    return _distinct(out)


def _signature(grams: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return tuple(np.frombuffer(digest, np.int64).tolist())


def _parity(grams: np.ndarray) -> np.ndarray:
    """A bit map of the set, each n-gram flipping one of 2,048 bits, of 16,384 for large sets. Maps of two sets differ in
    no more bits than the sets have n-grams of their own."""
    bits = 11 if len(grams) <= 2048 else 14
    flips = np.bincount((grams & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(flips.astype(bool)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(a row (doc_id, n, s1, s2, bits) for each document, with the two halves of its set's signature and its bit
    map; the counters of how often n-grams occur, summed by task and block)."""
    names = ["doc_id", "n", "s1", "s2", "bits", "block", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in _slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = shingles(text.as_py(), words)
                rows.append((key, len(grams), *_signature(grams), _parity(grams)))
                # A text's n-grams are sorted, and so are their counters: equal ones stand together.
                slots = (grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else slots
                counts[slots[first]] += np.diff(np.append(first, len(slots)))
            if rows:
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), *(pa.array(none, t) for t in types[5:])], names=names)
        part, blocks = TaskContext.get().partitionId(), counts.reshape(-1, BLOCK)
        some = [i for i in range(len(blocks)) if blocks[i].any()]
        for at in range(0, len(some), 32):
            own = some[at : at + 32]
            none = [None] * len(own)
            yield pa.RecordBatch.from_arrays([*(pa.array(none, t) for t in types[:5]), pa.array(own, types[5]), pa.array([part] * len(own), types[6]), pa.array([blocks[i].tobytes() for i in own], types[7])], names=names)

    both = written(docs.select("doc_id", F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits array<long>, block int, part int, counts binary"))
    return both.where("block IS NULL").select("doc_id", "n", "s1", "s2", "bits"), both.where("block IS NOT NULL").select("block", "part", "counts")


def _order(counts: DataFrame) -> np.ndarray:
    """All counters, 2 ** ORDER_BITS of them whatever the input, summed in two steps so that no task holds many."""

    def add(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for own in frames["counts"]:
            total += np.frombuffer(own, np.int64)
        return pd.DataFrame({"block": [key[0]], "part": np.array([0], "i4"), "counts": [total.tobytes()]})

    schema = "block int, part int, counts binary"
    some = counts.withColumn("part", F.pmod("part", F.lit(64))).groupBy("block", "part").applyInPandas(add, schema)
    out = np.zeros((1 << ORDER_BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for row in some.groupBy("block").applyInPandas(add, schema).toPandas().itertuples(index=False):
        out[row.block] = np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(gram, salt, at, n, s1): the n-grams of each set, rarest first, of which a set that overlaps enough must hold
    one among its own; at is the place in that order. A task gives each set once. salt is -1 but for n-grams whose
    counter is far above the others."""
    level = np.round(8 * np.log2(1 + counts)).astype(np.uint8)
    mean = max(1.0, counts.mean())
    salts = np.where(counts > 16 * mean + HOT_ROWS, np.ceil((counts - mean) / HOT_ROWS), 1).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((level, salts if salts.max() > 1 else None))
    names = ["gram", "salt", "at", "n", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, own_salts = shared.value
        seen: set[tuple[int, int]] = set()
        parts: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            grams = np.concatenate([p[0] for p in parts])
            k = [len(p[0]) for p in parts]
            spread = [np.repeat(np.array([p[i] for p in parts], np.int64), k) for i in (1, 2)]
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
            n_salts = np.ones(len(grams), np.int32) if own_salts is None else own_salts[(grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
            salt = np.where(n_salts > 1, spread[1] % n_salts, -1).astype(np.int32)
            columns = [grams.view(np.int64), salt, at, spread[0].astype(np.int32), spread[1]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in _slices(batches):
            for text in batch.column(0):
                grams = shingles(text.as_py(), words)
                n = len(grams)
                if not n:
                    continue
                key = _signature(grams)
                if key in seen:
                    continue
                seen.add(key)
                first = n - -(-percent * n // 100) + 1
                rank = levels[(grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                # grams are sorted, so a stable sort by level is the order by (level, gram)
                parts.append((grams[np.argsort(rank, kind="stable")[:first]], n, key[0]))
                size += first
                if size > 100_000:
                    yield pack()
                    parts, size = [], 0
        if parts:
            yield pack()

    return docs.select(F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "gram long, salt int, at int, n int, s1 long")


def _may(n: Column, at: Column, m: Column, bt: Column, percent: int) -> Column:
    """Whether two sets of n and m grams, whose first common gram has these places in them, can overlap enough:
    by their sizes, and by what is left in both from there on."""
    sizes = (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))
    return sizes & (F.lit(100 + percent) * F.least(n - at, m - bt) >= F.lit(percent) * (n + m))


def _segments(docs: DataFrame, ids: DataFrame, n_ids: int, sets: DataFrame, words: int) -> DataFrame:
    """(s1, s2, fragment, grams): of each set in sets its part in each fragment of the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for batch in _slices(batches, 256):
            rows = []
            for text in batch.column(0):
                grams = shingles(text.as_py(), words)
                key = _signature(grams)
                cuts = np.searchsorted((grams >> shift), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                rows += [(*key, i, grams[cuts[i] : cuts[i + 1]].view(np.int64)) for i in range(FRAGMENTS) if cuts[i] < cuts[i + 1]]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["s1", "s2", "fragment", "grams"])

    chosen = join_small(docs, ids, ["doc_id"], n_ids, "left_semi") if n_ids else docs.limit(0)
    out = chosen.select(F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "s1 long, s2 long, fragment int, grams array<long>")
    return out.join(sets, ["s1", "s2"], "left_semi").groupBy("s1", "s2", "fragment").agg(F.first("grams").alias("grams"))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links (a1, a2, b1, b2) among the candidate pairs (a, b) of halves of signatures, the segments of the sets that
    were looked at): the bit maps rule out most of what can't reach the threshold; for the rest partial overlaps are
    counted in each fragment by itself and summed."""
    end = lambda e: classes.select(F.col("s1").alias(e), F.col("s2").alias(f"{e}2"), F.col("n").alias(f"{e}n"), F.col("bits").alias(f"{e}bits"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    apart = F.aggregate(F.zip_with("abits", "bbits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    may = (F.size("abits") != F.size("bbits")) | _near(F.col("an") + F.col("bn"), apart, percent)
    near = written(both.where(may).select(F.col("a").alias("a1"), "a2", "an", F.col("b").alias("b1"), "b2", "bn"))
    ends = written(near.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(near.select("b1", "b2")).distinct())
    ids = written(classes.join(ends, ["s1", "s2"]).select(F.col("rep").alias("doc_id")).distinct())
    segments = written(_segments(docs, ids, ids.count(), ends, words))
    left = segments.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), "fragment", F.col("grams").alias("x"))
    right = segments.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), "fragment", F.col("grams").alias("y"))
    partial = near.join(left, ["a1", "a2"]).join(right, ["b1", "b2", "fragment"]).select("a1", "a2", "an", "b1", "b2", "bn", F.size(F.array_intersect("x", "y")).alias("common"))
    total = partial.groupBy("a1", "a2", "an", "b1", "b2", "bn").agg(F.sum("common").alias("o"))
    return written(total.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("an") + F.col("bn") - F.col("o"))).select("a1", "a2", "b1", "b2")), segments


def _near(n: Column, apart: Column, percent: int) -> Column:
    """Whether two sets of n grams together, of which at least apart are in one alone, can reach the threshold."""
    return F.lit(100 + percent) * (n - apart) >= F.lit(2 * percent) * n


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many n-grams each set of a shares with each of b (with each other of a, if None). The n-grams that several sets hold are cut
    into fragments of COLUMNS; in each the overlaps of all pairs are one product of matrices, and these are summed."""
    sets = a if b is None else a + b
    grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    column = np.cumsum(np.concatenate([[False], grams[1:] != grams[:-1]])[: len(grams)])
    common = np.bincount(column, minlength=1) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column][keep], owner[keep]
    out = np.zeros((len(a), len(sets) - len(a) if b is not None else len(a)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        held[owner[part], column[part] - at] = 1
        out += (held[: len(a)] @ held[len(a) if b is not None else 0 :].T).astype(np.int64)
    return out


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """members (c, s1, s2, n, ids) once for each pair of blocks in which it is to meet others: l and r name the pair,
    and second says whether the row is in its second block.

    Components of up to BLOCK_GRAMS n-grams and BLOCK_ROWS sets are packed whole. The sets of larger ones are dealt
    over bands of size, of which only neighbours can reach the threshold, and within a band over blocks by hash."""
    whole = written(members.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("grams")))
    small = (F.col("k") <= BLOCK_ROWS) & (F.col("grams") <= BLOCK_GRAMS)
    packs = 1 + int((whole.where(small).agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]) // BLOCK_GRAMS)
    # Two sets that reach the threshold differ in size by 100 / percent at most, which is less than a band.
    rows = members.join(whole, "c").withColumn("band", F.floor(F.log("n") / F.log(F.lit(101 / percent))).cast("long"))
    packed = rows.where(small).withColumns({"l": F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.pmod(F.xxhash64("c"), F.lit(packs))), "second": F.lit(False)}).withColumn("r", F.col("l"))
    large = rows.where(~small)
    counts = large.groupBy("c", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("long").alias("blocks"))
    near = lambda step, name: counts.select("c", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
    dealt = large.join(counts, ["c", "band"]).join(near(-1, "above"), ["c", "band"], "left").join(near(1, "below"), ["c", "band"], "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")))
    own = F.array("c", "band", "block")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    there = lambda n, f: F.when(F.col(n) > 0, F.transform(upto(n), f)).otherwise(F.array().cast("array<struct<l:array<bigint>,r:array<bigint>,second:boolean>>"))
    meet = lambda x, y, second: F.struct(x.alias("l"), y.alias("r"), second.alias("second"))
    same = there("blocks", lambda t: meet(F.array("c", "band", F.least("block", t)), F.array("c", "band", F.greatest("block", t)), F.col("block") > t))
    above = there("above", lambda t: meet(own, F.array(F.col("c"), F.col("band") + 1, t), F.lit(False)))
    below = there("below", lambda t: meet(F.array(F.col("c"), F.col("band") - 1, t), own, F.lit(True)))
    dealt = dealt.withColumn("p", F.explode(F.concat(same, above, below)))
    names = ["c", "s1", "s2", "n", "ids", "second"]
    return packed.select(*names, "l", "r").unionByName(dealt.select(*names[:-1], "p.*").select(*names, "l", "r"))


def _partners(classes: DataFrame, parts: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, others): of each class in a component the ids in the classes that it links with, all pairs of different
    sets of a component being counted, in blocks."""
    members = classes.join(parts.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep")
    pairs = members.groupBy("c").agg(F.count("*").alias("k"), F.sum("ids").alias("all"))
    members = written(members.join(pairs, "c").select("c", "s1", "s2", "n", "ids", "k", "all"))
    # Two classes in a component by themselves are linked, or they weren't in it.
    alone = members.where("k = 2").select("s1", "s2", (F.col("all") - F.col("ids")).alias("others"))
    asked = written(_blocks(members.where("k > 2").drop("k", "all"), percent))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("c", sort=False):
            sets = [g.reset_index(drop=True) for _, g in part.groupby(["second", "s1", "s2"], sort=False)]
            first, second = ([x for x in sets if bool(x["second"][0]) == side] for side in (False, True))
            cross = part["l"].iloc[0].tolist() != part["r"].iloc[0].tolist()
            if not first or (cross and not second):
                continue
            grams = lambda side: [np.concatenate([np.asarray(g, np.int64) for g in x["grams"]]) for x in side]
            number = lambda side, name: np.array([x[name][0] for x in side], np.int64)
            common = overlaps(grams(first), grams(second) if cross else None)
            other = second if cross else first
            n, m = number(first, "n"), number(other, "n")
            link = 100 * common >= percent * (n[:, None] + m - common)
            if not cross:
                np.fill_diagonal(link, False)
            for side, found in ((first, link @ number(other, "ids")), (second, number(first, "ids") @ link)):
                if len(side) and len(found) == len(side):
                    out.append(pd.DataFrame({"s1": number(side, "s1"), "s2": number(side, "s2"), "others": found}))
        return pd.concat(out) if out else pd.DataFrame({"s1": [], "s2": [], "others": []}, dtype="i8")

    full = asked.join(segments.select("s1", "s2", "grams"), ["s1", "s2"])
    found = full.groupBy("l", "r").applyInPandas(count, "s1 long, s2 long, others long")
    return found.unionByName(alone).groupBy("s1", "s2").agg(F.sum("others").alias("others"))


def join(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with count_links, n_links per row: documents link if the Jaccard similarity
    of their sets of word n-grams is percent / 100 or more; component_id is the smallest id that links reach, n_links
    the number of other documents that the row's text links with.

    Words are runs of anything but white space (space, tab to carriage return), A-Z in lower case. Shorter texts have one n-gram of all
    their words. Null texts and texts without words have none, link with nothing and are their own component. Rows
    without an id have a null component and null n_links. Rows may repeat; rows of one id are one document, whose links are those
    of all its texts; an id with several texts counts once for each in the n_links of others. An empty table gives an
    empty table; other columns are not read.

    Equal sets are one class, however many rows it has, and only classes are compared. N-grams are ordered by
    rough frequency, then by hash; classes that reach the threshold share one of their first n-grams. Of the
    classes that share one, each is compared with that which has it earliest, then any that are still in different
    components with each other, as far as sizes, places and small bit maps allow a link: so the components of a group
    of near copies cost about one comparison a member. Within the components so found all pairs of classes of fitting
    sizes are then counted, in blocks. Nothing is capped or sampled.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        out = _joined(own, words, percent, count_links)
        names = [F.col("doc_id").alias(id_col), "n_shingles", "component_id"] + ["n_links"] * count_links
        return written(out.select(*names), keep=True)


def _joined(own: DataFrame, words: int, percent: int, count_links: bool) -> DataFrame:
    sets, counts = _sets(own, words)
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    entries = some.select("doc_id", "s1", "s2").distinct()
    classes = written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    order = _order(counts)
    with_id = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # From here to the links a class goes by the first half of its signature. Where two classes share it, both
    # are candidates wherever one is, and of each other.
    group = Window.partitionBy("gram", "salt")
    rows = _prefixes(with_id, order, words, percent).withColumns({"lo": F.min("s1").over(group), "hi": F.max("s1").over(group)})
    shared = written(rows.where("salt >= 0 OR lo <> hi").select("gram", "at", "n", "s1").distinct())
    first = written(shared.groupBy("gram").agg(F.min(F.struct("at", "n", "s1")).alias("f"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("f.at").alias("fat"), F.col("f.n").alias("fn"), F.col("f.s1").alias("f1")))
    met = shared.join(first, "gram").where("s1 <> f1")
    stars = met.where(_may(F.col("fn"), F.col("fat"), F.col("n"), F.col("at"), percent)).select(F.col("f1").alias("a"), F.col("s1").alias("b"))
    twins = classes.groupBy("s1").agg(F.count("*").alias("k")).where("k > 1").select(F.col("s1").alias("a"), F.col("s1").alias("b"))
    links, segments = _linked(written(stars.union(twins).distinct()), own, classes, words, percent)
    parts = written(components(_named(links, classes)))

    # Classes that share a first half are rare enough to have one label here: it only saves comparisons of the same
    # component, and such classes are kept apart by the smaller label, which compares too much rather than too little.
    # Folded to 256 bits, a set's map still differs from another's in no more bits than the sets have n-grams of their own.
    fold = F.expr("transform(sequence(0, 3), i -> aggregate(sequence(i, size(bits) - 1, 4), 0L, (t, j) -> t ^ bits[j]))")
    label = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").groupBy("s1").agg(F.min(F.coalesce("component", "rep")).alias("c"), F.max(F.coalesce("component", "rep")).alias("d"), F.count("*").alias("k"), F.first(fold).alias("w"))
    label = label.select("s1", F.when(F.col("c") == F.col("d"), F.col("c")).alias("c"), F.when(F.col("k") == 1, F.col("w")).alias("w"))
    first = first.join(label.select(F.col("s1").alias("f1"), F.col("c").alias("fc")), "f1")
    held = written(shared.join(label, "s1").join(first, "gram").where("s1 <> f1"))
    apart = lambda x, y: ~F.coalesce(F.col(x) == F.col(y), F.lit(False))
    band = F.floor(F.log("n") / F.log(F.lit(101 / percent))).cast("int")
    stray = held.where(apart("c", "fc")).select("gram", F.col("s1").alias("a"), F.col("n").alias("an"), F.col("at").alias("aat"), F.col("c").alias("ac"), F.col("w").alias("aw"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    rest = held.select("gram", F.col("s1").alias("b"), F.col("n").alias("bn"), F.col("at").alias("bat"), F.col("c").alias("bc"), F.col("w").alias("bw"), apart("c", "fc").alias("bstray"), band.alias("band"))
    once = ~F.col("bstray") | (F.col("a") < F.col("b"))
    flipped = sum((F.bit_count(F.col("aw")[i].bitwiseXOR(F.col("bw")[i])) for i in range(1, 4)), F.bit_count(F.col("aw")[0].bitwiseXOR(F.col("bw")[0])))
    over = stray.join(rest, ["gram", "band"]).where(apart("ac", "bc") & (F.col("a") != F.col("b")) & once & _may(F.col("an"), F.col("aat"), F.col("bn"), F.col("bat"), percent) & F.coalesce(_near(F.col("an") + F.col("bn"), flipped, percent), F.lit(True)))
    more, others = _linked(written(over.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), own, classes, words, percent)
    if more.limit(1).count():
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_named(more, classes))))
        segments = segments.union(others).dropDuplicates(["s1", "s2", "fragment"])
    if count_links:
        ids = entries.groupBy("s1", "s2").agg(F.count("*").alias("ids"))
        sized = written(classes.join(ids, ["s1", "s2"]).select("s1", "s2", "rep", "n", "ids"))
        partners = written(sized.join(_partners(sized, parts, segments, percent), ["s1", "s2"], "left").select("s1", "s2", (F.coalesce("others", F.lit(0)) + F.col("ids") - 1).alias("links")))
    # An id whose rows have several texts is one document: its classes belong together.
    doubles = entries.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    if doubles.limit(1).count():
        tied = entries.join(doubles, "doc_id").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tied)))
    label = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    if count_links:
        label = label.join(partners, ["s1", "s2"])
    out = sets.drop("bits").join(label, ["s1", "s2"], "left")
    mine = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("c", "doc_id"))
    out = out.withColumns({"n_shingles": F.col("n"), "component_id": mine})
    return out.withColumn("n_links", F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0)))) if count_links else out


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the smallest ids of classes."""
    a = classes.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("rep").alias("a"))
    b = classes.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("rep").alias("b"))
    return links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a", "b")
