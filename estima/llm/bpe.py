"""Byte-level BPE: the tokenizers library over Arrow batches, exact ids and a round trip to bytes."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Texts are encoded together up to so many characters, longer ones by themselves; and so many rows are read at once.
BATCH_CHARS, BATCH_ROWS = 1 << 18, 256


def byte_to_char() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that join to a token, by its rank. A rank file lets any such pair merge, so every split
    of a token is listed and not only the one that made it."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        out += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return out


class Codec:
    """Encodes and decodes by a rank file whose 256 single bytes are tokens."""

    def __init__(self, path: str, pattern: str):
        # One thread a task: the executor's cores have tasks of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_to_char()
        as_text = lambda token: "".join(chars[b] for b in token)
        model = models.BPE(vocab={as_text(t): r for t, r in ranks.items()}, merges=[(as_text(a), as_text(b)) for a, b in merges_of(ranks)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        # What lies between the matches of the pattern is left out, as by a search for all matches.
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "removed", invert=True),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.chars = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.chars[rank] = as_text(token)
        #: The byte table reversed: from the character that stands for a byte to the byte.
        self.byte_of = {ord(c): b for b, c in enumerate(chars)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_with_offsets(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids of each text, from and to which of its characters each token reaches). Tokens that hold parts of one
        character all span that character."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found], [np.array(e.offsets, np.int32).reshape(-1, 2) for e in found]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, by the reversed byte table. The tokens are joined before any bytes are read as
        characters, which tokens may split."""
        return "".join([self.chars[i] for i in ids.tolist()]).translate(self.byte_of).encode("latin-1")

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > BATCH_CHARS:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True, keep_offsets: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that the ids decode to) and, if they are to be kept, token_ids, decoded, token_starts and token_ends (the characters of the text that each token
    reaches from and to; tokens that split a character all span it).

    path is a rank file that every executor can open. Each match of pattern is encoded by itself, no special
    tokens are made, and their strings in a text are ordinary text. Null and empty texts have no tokens. Rows
    keep their number and may repeat; no other column of docs is read; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    fields = [("id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("token_ids", "array<int>")] * keep_ids + [("decoded", "binary")] * keep_decoded
    fields += [("token_starts", "array<int>"), ("token_ends", "array<int>")] * keep_offsets
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in stream:
            for at in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = batch.column(1).to_pylist()
                for start, end in _groups(texts):
                    ids, spans = own.encode_with_offsets(texts[start:end]) if keep_offsets else (own.encode(texts[start:end]), [])
                    decoded = [own.decode_bytes(x) for x in ids]
                    columns = [
                        batch.column(0).slice(start, end - start),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ]
                    columns += [pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))] if keep_ids else []
                    columns += [pa.array(decoded, pa.binary())] if keep_decoded else []
                    columns += [pa.array([x[:, side] for x in spans], pa.list_(pa.int32())) for side in (0, 1)] if keep_offsets else []
                    yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    return source.mapInArrow(batches, ", ".join(f"{n} {t}" for n, t in fields)).withColumnRenamed("id", id_col)
