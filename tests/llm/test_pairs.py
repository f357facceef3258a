"""Top-k search, n-gram join and images against brute force, and the pipeline's stages."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from estima.llm import common, media, ngram_join, topk

# --- top-k ---------------------------------------------------------------------------------------------------------------


def brute_top(rows, is_query, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        ok[i] = min(ok.get(i, q), q)
    width = max(map(len, ok.values()), default=0)
    m = {i: np.array(q + [0] * (width - len(q)), object) for i, q in ok.items()}
    out = []
    for i in m:
        if is_query(i):
            scores = sorted((-int(m[i] @ m[j]), j) for j in m if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 512), (40, 7)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CHUNK_ROWS", sizes[0])
    monkeypatch.setattr(topk, "ANNULUS_ROWS", sizes[1])
    monkeypatch.setattr(topk, "QUERY_ROWS", 8 if sizes[0] == 40 else 8192)
    r = np.random.RandomState(1)
    rows = [(i, r.randn(8).tolist()) for i in range(300)]
    rows += [(i, [0.25] * 8) for i in range(300, 420)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [3.0, 1.0]), (505, []), (None, [1.0] * 8), (10, rows[10][1]), (20, [9.0] * 8), (506, [1000.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0


def test_large_integers():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 3.0]])
    assert topk._scores(b, b)[0, 0] == 2**60 + 9 and topk._scores(a, a)[0, 0] == 2**63 - 2


# --- n-gram join ------------------------------------------------------------------------------------------------------------


def brute_join(docs):
    sets, order = {}, []
    for i, text in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        order.append((i, s))
        if i is not None:
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    like = lambda s, t: bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(like(s, t) for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    links = lambda i, s: None if i is None else sum(like(s, t) for j in sets for t in set(sets[j])) - bool(s)
    return sorted(((i, len(s), None if i is None else root(i), links(i, s)) for i, s in order), key=str)


def joined(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs).collect()), key=str)


def corpus(seed: int, n: int = 150, words: int = 60):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = r.choice(docs)[1].split()
            for _ in range(r.randint(0, 6)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            w = w[: len(w) - r.randint(0, 8)] if r.random() < 0.4 else w
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(0, words))]
            if r.random() < 0.5:
                w[len(w) // 2 : len(w) // 2] = passage
        docs.append((i, (" \n" if r.random() < 0.2 else " ").join(x.upper() if r.random() < 0.05 else x for x in w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_like_brute_force(spark, monkeypatch, seed):
    if seed == 3:  # salts for frequent n-grams, and shuffled joins in place of broadcasts
        monkeypatch.setattr(ngram_join, "HOT_ROWS", -10)
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
        monkeypatch.setattr(ngram_join, "COLUMNS", 16)
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    docs = corpus(seed)
    docs += [(900, None), (901, ""), (902, " \t "), (903, "a b"), (904, "A  B"), (905, "b a"), (907, "a b c d e"), (906, "A b c D e"), (None, docs[0][1]), (3, docs[3][1]), (910, docs[5][1]), (910, docs[9][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    assert joined(df) == brute_join(docs)


def test_join_large_sets_and_near_group(spark):
    r = random.Random(7)
    base = [f"x{r.randrange(10**6)}" for _ in range(2100)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 90)):
            w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(100, "z" * 600000 + " b c d e f"), (101, "z" * 600000 + " b c d e f"), (102, " ".join(base[:1300]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert joined(df) == brute_join(docs)


def test_word_hashes():
    """Words that agree modulo 2 ** 64 as digits of any odd base (Thue-Morse words and their complements) differ."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
        b = a.translate(str.maketrans("ab", "ba"))
        one, other = (ngram_join.word_hashes(x.encode())[0] for x in (a, b))
        assert one != other
    text = b"x y  z" + b"w" * 1000 + b"\t\x0bq\n"
    assert ngram_join.word_hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in text.split()] and not len(ngram_join.word_hashes(b" \t"))


@pytest.mark.parametrize("piece", [4, 7])
def test_words_in_pieces(monkeypatch, piece):
    text = b"ab cde f  ghijklmnop q\nrs " * 3
    whole = ngram_join.word_hashes(text).tolist()
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    assert ngram_join.word_hashes(text).tolist() == whole


def test_overlaps():
    r = np.random.RandomState(2)
    sets = [np.unique(r.randint(0, 60, r.randint(1, 50))) for _ in range(9)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, np.diag(want))
    assert got.tolist() == want
    assert ngram_join.overlaps(sets[:4], sets[4:]).tolist() == [row[4:] for row in want[:4]]


def test_form_letters(spark):
    """Texts that share three quarters of their words and aren't linked, a chain of linked ones, and sizes at the edge."""
    r = random.Random(11)
    letter = [f"f{i}" for i in range(60)]
    docs = [(i, " ".join([f"o{i}x{k}" for k in range(r.randint(10, 22))] + letter)) for i in range(60)]
    chain = [f"c{i}" for i in range(200)]
    docs += [(100 + i, " ".join(chain[i * 5 : i * 5 + 60])) for i in range(28)]
    docs += [(200 + i, " ".join(f"s{k}" for k in range(4 + n))) for i, n in enumerate((75, 100, 101, 74, 133, 134))]
    assert joined(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute_join(docs)


def test_join_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.join(one).collect()] == [(1, 0, 1, 0)]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, 150 + i) for i in range(20)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


# --- images -----------------------------------------------------------------------------------------------------------------


def png(pixels: np.ndarray, kind: int = 0) -> bytes:
    lines = b""
    for y in range(len(pixels)):
        row, up = pixels[y].astype(int), pixels[y - 1].astype(int) if y else np.zeros(pixels.shape[1], int)
        left = np.concatenate([[0], row[:-1]])
        upleft = np.concatenate([[0], up[:-1]])
        p = left + up - upleft
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - upleft)), left, np.where(abs(p - up) <= abs(p - upleft), up, upleft))
        guess = [0, left, up, (left + up) // 2, near][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png(kind):
    pixels = np.random.RandomState(kind).randint(0, 256, (9, 13), dtype=np.uint8)
    assert (media.read_image(png(pixels, kind)) == pixels).all() and (media.read_image(media.write_pgm(pixels)) == pixels).all()
    with pytest.raises(media.ImageError):
        media.read_image(png(pixels)[:-30])


def meet(a, b):
    beside = {}
    for key, more in zip(*(x.tolist() for x in a)):
        beside.setdefault(key, []).append(more)
    return any(bin((x ^ y) & (2**64 - 1)).count("1") <= media.MAX_BESIDE for key, y in zip(*(x.tolist() for x in b)) for x in beside.get(key, ()))


@pytest.mark.parametrize("kind", media.EDITS)
def test_recall_of_edits(kind):
    """Copies are found by a comparison of all corners and share a place in the tables."""
    found = agreed = 0
    for i in range(30):
        own = media.picture([float(i)] * 8)
        a, b = media.describe(own), media.describe(media.edited(own, kind, i))
        other = media.describe(media.picture([float(i), 1.0]))
        agree = media.consensus(*a, *b) > 0
        agreed += agree
        found += agree and meet(media.keys(*a), media.keys(*b))
        assert media.consensus(*a, *other) == 0
    least = 25 if kind in ("half", "turn") else 27
    assert agreed >= least and found >= least


def test_descriptors():
    r = np.random.RandomState(1)
    for shape in ((1, 1), (24, 24), (25, 400), (900, 1100)):
        corners, words = media.describe(r.randint(0, 256, shape).astype(np.uint8))
        assert len(corners) == len(words) and (media._unpack(media._pack(corners)) - corners <= 1 / 16).all() if len(corners) else min(shape) <= 24
    for flat in (np.zeros((60, 60), np.uint8), np.tile(np.array([0, 255], np.uint8), (60, 30))):
        assert len(media.describe(flat)[0]) == 0 and len(media.keys(*media.describe(flat))[0]) == 0
    board = np.kron(np.indices((8, 8)).sum(0) % 2 * 255, np.ones((12, 12))).astype(np.uint8)  # corners of equal strength
    assert [x.tolist() for x in media.describe(board)] == [x.tolist() for x in media.describe(board)]
    aw, bw = r.randint(-(2**62), 2**62, (300, 4)), r.randint(-(2**62), 2**62, (280, 4))
    bw[:50] = aw[:50] ^ 5
    i, j = media._matches(aw, bw)
    assert sorted(zip(i.tolist(), j.tolist())) == [(k, k) for k in range(50)]


def test_copies(spark):
    base = [media.picture([float(i)] * 8) for i in range(30)]
    rows = [(i, media.write_pgm(p)) for i, p in enumerate(base)]
    rows += [(100 + i, media.write_pgm(media.edited(base[i], media.EDITS[i % len(media.EDITS)], i))) for i in range(28)]
    images = {i: media.describe(media.read_image(image)) for i, image in rows}
    parent = {i: i for i in images}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in images:  # all pairs
        for b in images:
            if a < b and media.consensus(*images[a], *images[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    rows += [(200, png(base[0])), (201, None), (202, None), (203, b"junk"), (204, b"junk"), (205, media.write_pgm(np.zeros((50, 50)))), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "media_id long, image binary").withColumn("class_id", F.lit("clash")).repartition(4)
    out = [tuple(r) for r in media.find_copies(df).collect()]
    assert len(out) == len(rows)
    got = {r[0]: r for r in out}
    assert sum(got[i][1] == root(i) for i in images) >= 0.95 * len(images) and all(got[i][1] == i for i in range(30))
    assert got[200][1] == 0 and got[201][1] == 201 and got[202][1] == 202 and got[204][1] == 203 and got[205][1] == 205 and not got[203][3]
    assert media.find_copies(df.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    frames = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, frames[-1], folder)
        out.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
        if stage is not C.encode:
            assert out.columns == docs.columns
    rows = [[tuple(r) for r in f.collect()] for f in frames]
    kept = {r[0] for r in rows[1]}
    toxic = {r[0] for r in rows[0] if labels.get(r[0]) == 1}
    clean = {r[0] for r in rows[0] if labels.get(r[0]) == 0}
    assert len(toxic & kept) <= 0.2 * len(toxic) and len(clean - kept) <= 0.05 * len(clean)
    component = {i: c for i, _, c, _ in brute_join([(r[0], r[1]) for r in rows[1]])}
    assert sorted(r[0] for r in rows[2]) == sorted(i for i, c in component.items() if c == i)
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert {r[0] for r in rows[3]} <= {r[0] for r in rows[2]} and 0.7 * words(rows[2]) <= words(rows[3]) <= 0.8 * words(rows[2])
    assert len(rows[4]) == len(rows[3]) and frames[4].agg(F.min("n_tokens")).first()[0] > 0
