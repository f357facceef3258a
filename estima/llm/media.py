"""Copies among images: multiscale corners, orientation-normalised binary tests, Hamming tables, geometric consensus."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, scratch, small_batches, written

#: One corner for so many pixels is described, over levels of the image each smaller by STEP, as far as LEVELS go; an
#: image of more than MAX_PIXELS is shrunk by steps to that many first, so that work space is bounded.
CORNER_PIXELS, STEP, LEVELS, MAX_PIXELS = 256, 2 ** (-1 / 5), 8, 1 << 19
#: Radius of the patch of a corner's tests, and the side of the cells over which the corners of a level are spread.
RADIUS, CELL = 10, 24
MARGIN = RADIUS + 2
#: A corner's two nearest neighbours in its level make pairs with it. In each of TABLES tables pairs are held by KEY_BITS
#: tests of either corner, other ones in each table: a pair whose corners differ in a few tests stays together in some.
NEIGHBOURS, TABLES, KEY_BITS = 2, 4, 20
#: Matches are corners at most MAX_BITS tests apart; MIN_MATCHES of them, and MIN_SHARE of all, must agree to MAX_ERROR pixels.
MAX_BITS, MIN_MATCHES, MIN_SHARE, MAX_ERROR = 64, 6, 0.25, 3.0
#: Pictures that share a place are compared if at most so many of the 64 tests beside it differ.
MAX_BESIDE = 9
_grid = np.arange(-RADIUS, RADIUS + 1).astype(np.float32)
_square = _grid[:, None] ** 2 + _grid[None] ** 2
_DISC = np.where(_square <= RADIUS**2, np.exp(-_square / (2 * (RADIUS / 1.8) ** 2)), 0).astype(np.float32)


class ImageError(ValueError):
    """Bytes that are no image this module reads."""


def _tests() -> np.ndarray:
    """Pairs of places (y1, x1, y2, x2) in a patch of RADIUS, seeded. A patch is turned so that it brightens along
    x, so places at about the same x are as likely brighter as darker, which spreads descriptors evenly."""
    random, out, r = np.random.RandomState(20240101), [], RADIUS
    while len(out) < 256:
        x, y1, y2 = np.clip(random.normal(0, (r / 2, r / 2 + 0.5, r / 2 + 0.5)), -r, r)
        x2 = x + random.uniform(-1, 1) * r / 7
        if abs(y1 - y2) >= 0.43 * r and x * x + y1 * y1 <= r * r and x2 * x2 + y2 * y2 <= r * r:
            out.append((y1, x, y2, x2))
    return np.array(out, np.float32)


_TESTS = _tests()
_KEYS = [np.random.RandomState(7 + t).permutation(256)[:KEY_BITS] for t in range(TABLES)]
#: Tests in no table, by which chance meetings are told from copies before descriptors move.
_REST = np.random.RandomState(7).permutation(np.setdiff1d(np.arange(256), np.concatenate(_KEYS)))[:32]


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def read_image(data: bytes) -> np.ndarray:
    """Grey levels (height, width) of a binary PGM or PPM of 8 bits, or a PNG of 8 bits a channel, not interlaced."""
    if data[:2] in (b"P5", b"P6"):
        head = re.match(rb"P[56](?:\s+(?:#[^\n]*\n\s*)*(\d+))(?:\s+(?:#[^\n]*\n\s*)*(\d+))(?:\s+(?:#[^\n]*\n\s*)*(\d+))\s", data)
        if not head or int(head[3]) > 255:
            raise ImageError("not a PNM header of 8 bits")
        width, height, channels = int(head[1]), int(head[2]), 1 if data[1:2] == b"5" else 3
        raw = np.frombuffer(data, np.uint8, offset=head.end())
        if len(raw) < width * height * channels:
            raise ImageError("the image is cut off")
        return _grey(raw[: width * height * channels].reshape(height, width, channels))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _grey(_png(data))
    raise ImageError("neither PNM nor PNG")


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] in (1, 2):
        return pixels[:, :, 0].copy()
    return np.round(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, packed, shape = 8, b"", None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
                if depth != 8 or interlace or colour not in (0, 2, 4, 6):
                    raise ImageError("a kind of PNG that isn't read")
                shape = (height, width, {0: 1, 2: 3, 4: 2, 6: 4}[colour])
            elif kind == b"IDAT":
                packed += body
            at += 12 + size
        height, width, channels = shape
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    except (struct.error, zlib.error, TypeError, ValueError) as error:
        raise ImageError(f"a broken PNG: {error}") from error
    out = np.zeros((height, width * channels), np.int64)
    for y in range(height):
        line, kind, up = raw[y, 1:].astype(np.int64), raw[y, 0], out[y - 1] if y else np.zeros(width * channels, np.int64)
        if kind in (0, 2):
            out[y] = (line + up * (kind == 2)) & 255
            continue
        for x in range(width * channels):
            a = out[y, x - channels] if x >= channels else 0
            c = up[x - channels] if x >= channels else 0
            b = up[x]
            if kind == 1:
                guess = a
            elif kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (line[x] + guess) & 255
    return out.reshape(height, width, channels).astype(np.uint8)


def resize(pixels: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    h, w = max(1, int(round(pixels.shape[0] * scale))), max(1, int(round(pixels.shape[1] * scale)))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, pixels.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, pixels.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, pixels.shape[0] - 1), np.minimum(x0 + 1, pixels.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    p = pixels.astype(np.float32)
    return (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy


def _smooth(a: np.ndarray) -> np.ndarray:
    """Weights 1, 4, 6, 4, 1 along both axes, edges repeated."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (2, 2)
        b = np.pad(a, pad, mode="edge")
        part = lambda i: b[i : i + a.shape[0]] if axis == 0 else b[:, i : i + a.shape[1]]  # noqa: B023, E731
        a = (part(0) + part(4) + 4 * (part(1) + part(3)) + 6 * part(2)) * np.float32(1 / 16)
    return a


def _corners(smooth: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of about n corners of a level, between pixels: the strongest of each cell, then the second of each, ..."""
    h, w = smooth.shape
    gy, gx = np.gradient(smooth)
    xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    strength = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    most = strength
    for axis in (0, 1):  # the largest within two pixels
        pad = [(0, 0), (0, 0)]
        pad[axis] = (2, 2)
        b = np.pad(most, pad, mode="edge")
        most = np.maximum.reduce([b[i : i + h] if axis == 0 else b[:, i : i + w] for i in range(5)])
    inner = (slice(MARGIN, h - MARGIN), slice(MARGIN, w - MARGIN))
    y, x = np.nonzero((strength[inner] >= most[inner]) & (strength[inner] > 1))
    y, x = y + MARGIN, x + MARGIN
    own = strength[y, x]
    cell = y // CELL * (w // CELL + 1) + x // CELL
    order = np.lexsort((x, y, -own, cell))
    new = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])[: len(order)]
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    best = np.lexsort((x, y, -own, turn))[:n]
    y, x, own = y[best], x[best], own[best]
    shift = lambda a, b: np.clip((a - b) / 2 / np.maximum(1e-6, 2 * own - a - b), -0.5, 0.5)
    return y + shift(strength[y + 1, x], strength[y - 1, x]), x + shift(strength[y, x + 1], strength[y, x - 1])


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners: x, y, level; their 256 tests as 4 signed 64-bit numbers), places in pixels of the image that MAX_PIXELS
    allows. Tests are read between pixels, in a frame turned to the angle in which the patch brightens."""
    image = pixels.astype(np.float32)
    while image.size > MAX_PIXELS:
        image = resize(image, STEP)
    flat, where, base = [], [], 0
    areas = STEP ** (2.0 * np.arange(LEVELS))
    for level in range(LEVELS):
        scale = STEP**level
        smooth = _smooth(image if level == 0 else resize(image, scale))
        h, w = smooth.shape
        if min(h, w) <= 2 * MARGIN:
            break
        y, x = _corners(smooth, max(3, int(round(image.size / CORNER_PIXELS * areas[level] / areas.sum()))))
        # Bounded by MARGIN, a patch and the pixel after it lie within the level.
        where.append(np.stack([y, x, np.full(len(y), level), np.full(len(y), base), np.full(len(y), w)], 1))
        flat.append(smooth.ravel())
        base += smooth.size
    where = np.concatenate(where) if where else np.zeros((0, 5))
    if not len(where):
        return np.zeros((0, 3)), np.zeros((0, 4), np.int64)
    level, flat = where[:, 2], np.concatenate(flat)
    row, column, first, width = (where[:, i, None] for i in (0, 1, 3, 4))

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y, x = row + y, column + x
        low, left = y.astype(np.int64), x.astype(np.int64)
        fy, fx = (y - low).astype(np.float32), (x - left).astype(np.float32)
        i, w = (first + low * width + left).astype(np.int64), width.astype(np.int64)
        return (flat[i] * (1 - fx) + flat[i + 1] * fx) * (1 - fy) + (flat[i + w] * (1 - fx) + flat[i + w + 1] * fx) * fy

    inside = np.flatnonzero(_DISC.ravel())
    dy, dx = np.repeat(_grid, len(_grid))[inside], np.tile(_grid, len(_grid))[inside]
    patch = at(dy[None], dx[None]) * _DISC.ravel()[inside]
    angle = np.arctan2(patch @ dy, patch @ dx)[:, None]
    c, s = np.cos(angle), np.sin(angle)
    turned = lambda y, x: at(s * x + c * y, c * x - s * y)
    bits = turned(_TESTS[:, 0], _TESTS[:, 1]) < turned(_TESTS[:, 2], _TESTS[:, 3])
    scale = STEP**level
    return np.stack([(where[:, 1] + 0.5) / scale, (where[:, 0] + 0.5) / scale, level], 1), np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def keys(corners: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the Hamming tables, 64 tests beside each): for each pair of a corner and one of its nearest neighbours
    in its level, and each table, the table's number and the two corners' tests of that table, the smaller first; then 32
    tests of either that no table uses, in the same order."""
    if len(corners) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second = [], []
    for level in np.unique(corners[:, 2]):
        own = np.flatnonzero(corners[:, 2] == level)
        place = corners[own, 0] + 1j * corners[own, 1]
        for start in range(0, len(own), 256):
            apart = np.abs(place[start : start + 256, None] - place[None])
            apart[np.arange(len(apart)), start + np.arange(len(apart))] = np.inf
            near = np.argsort(apart, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(own) - 1)]
            first.append(np.repeat(own[start : start + 256], near.shape[1]))
            second.append(own[near.ravel()])
    a, b = np.concatenate(first), np.concatenate(second)
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(len(words), -1), axis=1).astype(np.int64)
    out, beside = [], []
    rest = bits[:, _REST] @ (1 << np.arange(32, dtype=np.int64))
    for t, tests in enumerate(_KEYS):
        code = bits[:, tests] @ (1 << np.arange(KEY_BITS, dtype=np.int64))
        low, high = np.where(code[a] <= code[b], a, b), np.where(code[a] <= code[b], b, a)
        out.append((t << 2 * KEY_BITS) | (code[low] << KEY_BITS) | code[high])
        beside.append((rest[low] << 32) | rest[high])
    pairs = np.unique(np.stack([np.concatenate(out), np.concatenate(beside)]), axis=1)
    return pairs[0], pairs[1]


def _matches(aw: np.ndarray, bw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners that are each other's nearest by Hamming distance and at most MAX_BITS apart."""
    near, least = np.zeros(len(aw), np.int64), np.zeros(len(aw), np.int64)
    back, low = np.zeros(len(bw), np.int64), np.full(len(bw), 1 << 20)
    for at in range(0, len(aw), 256):
        d = np.bitwise_count(aw[at : at + 256, None] ^ bw[None]).sum(2, dtype=np.int64)
        near[at : at + 256], least[at : at + 256] = d.argmin(1), d.min(1)
        better = d.min(0) < low
        back[better], low[better] = at + d.argmin(0)[better], d.min(0)[better]
    i = np.flatnonzero((back[near] == np.arange(len(aw))) & (least <= MAX_BITS))
    return i, near[i]


def consensus(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> int:
    """How many matches agree on one shift, turn and scale, 0 if fewer than are needed. Any two matches give a transform
    by their places, against which the others are held; the first that enough agree with decides."""
    if not len(a) or not len(b):
        return 0
    i, j = _matches(aw, bw)
    enough = max(MIN_MATCHES, int(np.ceil(MIN_SHARE * len(i))))
    if len(i) < enough:
        return 0
    za, zb = a[i, 0] + 1j * a[i, 1], b[j, 0] + 1j * b[j, 1]
    for k in range(len(i) - enough + 1):  # of those that agree one has so many after it
        da, db = za - za[k], zb - zb[k]
        far = k + 1 + np.flatnonzero(np.abs(da[k + 1 :]) > 8)
        turn = db[far] / da[far]
        turn = turn[(np.abs(turn) > 0.3) & (np.abs(turn) < 3.3)]
        if len(turn):
            agree = (np.abs(da[None] * turn[:, None] - db[None]) <= MAX_ERROR * np.maximum(1, np.abs(turn))[:, None]).sum(1)
            if agree.max() >= enough:
                return int(agree.max())
    return 0


def _described(media: DataFrame, id_col: str, image_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, d1, d2, readable) of each row, by the digest of its pixels; (d1, d2, corners, words) of each picture, once
    a task, a corner's place and level packed into one number."""
    names = ["id", "d1", "d2", "readable", "corners", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py() or b""
                try:
                    pixels = read_image(raw)
                    digest = hashlib.blake2b(repr(pixels.shape).encode() + pixels.tobytes(), digest_size=16).digest()
                except ImageError:
                    pixels, digest = None, hashlib.blake2b(raw, digest_size=16, person=b"no image").digest()
                own = tuple(np.frombuffer(digest, np.int64).tolist())
                out.append((key, *own, pixels is not None, None, None))
                if pixels is not None and own not in seen:
                    seen.add(own)
                    corners, words = describe(pixels)
                    if len(words):
                        out.append((None, *own, None, _pack(corners), words.ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("i"))
    both = written(rows.mapInArrow(run, "id long, d1 long, d2 long, readable boolean, corners array<long>, words array<long>"))
    return both.where("words IS NULL").select("id", "d1", "d2", "readable"), both.where("words IS NOT NULL").select("d1", "d2", "corners", "words")


def _pack(corners: np.ndarray) -> np.ndarray:
    x, y, level = corners.T
    return (level.astype(np.int64) << 56) | (np.round(y * 16).astype(np.int64) << 28) | np.round(x * 16).astype(np.int64)


def _unpack(packed: np.ndarray) -> np.ndarray:
    part = (1 << 28) - 1
    return np.stack([(packed & part) / 16, ((packed >> 28) & part) / 16, packed >> 56], 1)


def _shaped(corners, words) -> tuple[np.ndarray, np.ndarray]:
    return _unpack(np.asarray(corners, np.int64)), np.asarray(words, np.int64).reshape(-1, 4)


def _buckets(pictures: DataFrame) -> DataFrame:
    """(key, beside, d1): the places of each picture in the tables, by the first half of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [keys(*_shaped(c, w)) for c, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if own:
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k, _ in own])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*own)), pa.array(ids, pa.int64())], names=["key", "beside", "d1"])

    return pictures.select("d1", "corners", "words").mapInArrow(run, "key long, beside long, d1 long")


def _agreeing(pairs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of first halves of digests whose corners agree on a transform, as (a1, a2, b1, b2)."""
    ends = pairs.select(F.col("a").alias("d1")).union(pairs.select("b")).distinct()
    some = written(pictures.join(ends, "d1", "left_semi").dropDuplicates(["d1", "d2"]))
    left = some.select(F.col("d1").alias("a"), F.col("d2").alias("a2"), F.col("corners").alias("ac"), F.col("words").alias("aw"))
    right = some.select(F.col("d1").alias("b"), F.col("d2").alias("b2"), F.col("corners").alias("bc"), F.col("words").alias("bw"))

    def count(ac: pd.Series, aw: pd.Series, bc: pd.Series, bw: pd.Series) -> pd.Series:
        return pd.Series([consensus(*_shaped(a, b), *_shaped(c, d)) for a, b, c, d in zip(ac, aw, bc, bw)], dtype="int64")

    agree = F.pandas_udf(count, "long")
    return written(pairs.join(left, "a").join(right, "b").select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2", agree("ac", "aw", "bc", "bw").alias("agree")).where("agree > 0").drop("agree"))


def find_copies(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """media_id, class_id, n_same and readable per row: class_id is the smallest id among the rows that links reach;
    n_same counts rows of just the same pixels, itself included.

    Pictures of equal pixels are one class and are compared once. Corners of eight levels, spread over cells, are described
    by 256 tests in a frame turned to the patch's own angle. Tables hold pairs of neighbouring corners by some of their
    tests, other ones in each, so that flipped tests leave most places equal. Of the pictures that share a place, and most of 64 tests beside it, each is
    compared with the first, then any that are still in different components with each other; two are linked if
    6 corners, and a quarter of those that are each other's nearest, agree on one shift, turn and scale from 0.3 to
    3.3. Buckets aren't capped. Copies cropped to half, shrunk or enlarged by up to 2, turned by any angle, noisy, blurred
    or coded again are found; a crop that leaves too few corners isn't.

    Null or unreadable bytes have readable false and a class by equal bytes alone (nulls and empty ones: all their
    own). Pictures without corners are linked by equal pixels alone. Rows without an id have a null class. Rows may
    repeat; an empty table gives an empty table; other columns are not read.
    """
    small_batches(media.sparkSession)
    with scratch(media.sparkSession):
        return written(_classed(media, id_col, image_col), keep=True)


def _classed(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    rows, pictures = _described(media, id_col, image_col)
    some = rows.where("id IS NOT NULL")
    classes = written(some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n_same")))
    group = Window.partitionBy("key")
    alike = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MAX_BESIDE
    held = _buckets(pictures).withColumns({"f": F.min(F.struct("d1", "beside")).over(group), "l": F.max("d1").over(group)}).where("f.d1 <> l")
    met = written(held.select("key", "beside", "d1", F.col("f.d1").alias("f"), F.col("f.beside").alias("fb")))
    others = met.where("d1 <> f")
    links = _named(_agreeing(written(others.where(alike("beside", "fb")).select(F.col("f").alias("a"), F.col("d1").alias("b")).distinct()), pictures), classes)
    parts = written(components(links))

    # Pictures that share a first half are kept apart by no label, which compares too much rather than too little.
    label = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").groupBy("d1").agg(F.min(F.coalesce("component", "rep")).alias("c"), F.max(F.coalesce("component", "rep")).alias("d"))
    label = label.select("d1", F.when(F.col("c") == F.col("d"), F.col("c")).alias("c"))
    held = written(others.distinct().join(label, "d1").join(label.select(F.col("d1").alias("f"), F.col("c").alias("fc")), "f"))
    apart = lambda x, y: ~F.coalesce(F.col(x) == F.col(y), F.lit(False))
    stray = held.where(apart("c", "fc")).select("key", F.col("d1").alias("a"), F.col("c").alias("ac"), F.col("beside").alias("ab"))
    rest = held.select("key", F.col("d1").alias("b"), F.col("c").alias("bc"), F.col("beside").alias("bb"), apart("c", "fc").alias("bstray"))
    once = ~F.col("bstray") | (F.col("a") < F.col("b"))
    over = stray.join(rest, "key").where(apart("ac", "bc") & (F.col("a") != F.col("b")) & once & alike("ab", "bb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _named(_agreeing(written(over), pictures), classes)
    if more.limit(1).count():
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    label = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_same", F.coalesce("component", "rep").alias("c"))
    nothing = np.frombuffer(hashlib.blake2b(b"", digest_size=16, person=b"no image").digest(), np.int64).tolist()
    blank = (F.col("d1") == nothing[0]) & (F.col("d2") == nothing[1])
    mine = F.when(F.col("id").isNull(), None).when(blank, F.col("id")).otherwise(F.col("c"))
    return rows.join(label, ["d1", "d2"], "left").select(F.col("id").alias(id_col), mine.alias("class_id"), F.when(blank, 1).otherwise(F.col("n_same")).alias("n_same"), "readable")


def _named(links: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("rep").alias("a"))
    b = classes.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("rep").alias("b"))
    return links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a", "b")


EDITS = ("crop", "half", "brighten", "contrast", "shrink", "halve", "enlarge", "double", "quarter turn", "turn", "tilt", "noise", "blur", "recode")


def picture(vector: list[float], size: int = 96) -> np.ndarray:
    """A picture that a vector stands for: seeded noise of four octaves, the same for equal vectors."""
    seed = zlib.crc32(np.asarray([np.nan if x is None else x for x in vector], "<f4").tobytes())
    random, out = np.random.RandomState(seed), np.float32(128)
    for cells in (6, 12, 24, 48):
        out = out + 0.45 * (resize(random.rand(cells, cells).astype(np.float32) * 255, size / cells) - 127.5)
    return np.clip(out, 0, 255).astype(np.uint8)


def turned(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle, on a black ground that holds it whole."""
    h, w = pixels.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    height, width = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s)))
    dy, dx = np.mgrid[:height, :width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    y, x = c * dy - s * dx + (h - 1) / 2, s * dy + c * dx + (w - 1) / 2
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    y, x = np.clip(y, 0, h - 1.001), np.clip(x, 0, w - 1.001)
    low, left = y.astype(int), x.astype(int)
    fy, fx, p = y - low, x - left, pixels.astype(float)
    out = (p[low, left] * (1 - fx) + p[low, left + 1] * fx) * (1 - fy) + (p[low + 1, left] * (1 - fx) + p[low + 1, left + 1] * fx) * fy
    return np.where(inside, out, 0)


def recoded(pixels: np.ndarray, step: float = 24) -> np.ndarray:
    """Cosine transforms of blocks of 8 x 8, rounded to multiples of step, as lossy formats do."""
    k = np.arange(8)
    basis = 0.5 * np.cos(np.pi * (k[None] + 0.5) * k[:, None] / 8)
    basis[0] /= np.sqrt(2)
    h, w = pixels.shape[0] // 8, pixels.shape[1] // 8
    blocks = pixels[: h * 8, : w * 8].astype(float).reshape(h, 8, w, 8).transpose(0, 2, 1, 3)
    coded = np.round(basis @ blocks @ basis.T / step) * step
    return (basis.T @ coded @ basis).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)


def edited(pixels: np.ndarray, kind: str, seed: int = 0) -> np.ndarray:
    h, w = pixels.shape
    out = {
        "crop": lambda: pixels[h // 12 : h - h // 16, w // 8 : w - w // 24],
        "half": lambda: pixels[h // 4 : h - h // 24, w // 20 : w - w // 4],
        "brighten": lambda: pixels.astype(float) + 18,
        "contrast": lambda: (pixels.astype(float) - 128) * 0.8 + 128,
        "shrink": lambda: resize(pixels, 0.75),
        "halve": lambda: resize(pixels, 0.5),
        "enlarge": lambda: resize(pixels, 1.3),
        "double": lambda: resize(pixels, 2),
        "quarter turn": lambda: np.rot90(pixels),
        "turn": lambda: turned(pixels, 45),
        "tilt": lambda: turned(pixels, 15),
        "noise": lambda: pixels + np.random.RandomState(seed).normal(0, 8, pixels.shape),
        "blur": lambda: _smooth(pixels.astype(np.float32)),
        "recode": lambda: recoded(pixels),
    }[kind]()
    return np.ascontiguousarray(np.clip(np.round(out), 0, 255).astype(np.uint8))


def pictures_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 10) -> DataFrame:
    """Media rows (media_id, image) for a table of vectors, as the tables have no images: the picture of each row
    under twice its id, and of every tenth an edited copy under the number after that."""

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                ids, images = [], []
                for key, vector in zip(frame["id"][at : at + 256], frame["v"][at : at + 256]):
                    if vector is None:
                        ids.append(2 * key)
                        images.append(None)
                        continue
                    own = picture(vector)
                    ids.append(2 * key)
                    images.append(write_pgm(own))
                    if key % every == 0:
                        ids.append(2 * key + 1)
                        images.append(write_pgm(edited(own, EDITS[key // every % len(EDITS)], key % 2**32)))
                yield pd.DataFrame({"media_id": ids, "image": images})

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL").mapInPandas(render, "media_id long, image binary")
