"""Placing keys on shards through a permutation-filled lookup table (Maglev hashing), DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int = 65537) -> list[int]:
    """slot -> index of its shard. Shard s prefers the slots offset + j * skip (mod size), j = 0, 1, ...; size is
    prime, so that is a permutation. The shards take turns, each claiming the first slot of its order that is
    free, until none is. Shares differ by one slot at most, and a lost shard moves few slots of the others.
    The table has a fixed size, whatever the data, and is built once on the driver in O(size log size) steps."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime number, not below the number of shards")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, claimed = [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    """The first 8 hex digits of the key's md5, modulo size; null counts as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = 65537, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the columns slot and shard, which replace columns of these names.

    The placement of a row depends on its key and the shard names alone: repeated rows and ties land together, a
    null key goes where the empty text goes, an empty table gives an empty table. The lookup table (size rows of
    a number and a name, a fixed bound) is broadcast; no row is shuffled.
    """
    kept = [c for c in df.columns if c not in (slot, shard)]
    own_slot, index, own_shard = free_names([*df.columns, slot, shard], "__slot", "__index", "__shard")
    names = F.array(*[F.lit(s) for s in shards])
    table = df.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")).alias(own_slot, index)
    ).select(own_slot, F.element_at(names, F.col(index).cast("int") + 1).alias(own_shard))
    placed = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), size).alias(own_slot))
    return placed.join(F.broadcast(table), own_slot, "left").select(*[F.col(f"`{c}`") for c in kept], F.col(own_slot).alias(slot), F.col(own_shard).alias(shard))
