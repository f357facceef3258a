"""Sharding and mixing against brute force."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from estima.llm import mixing, sharding

SHARDS = [f"s{i}" for i in range(7)]


def test_table_is_fair_and_steady():
    t = sharding.lookup_table(SHARDS, 1009)
    counts = [t.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1 and -1 not in t
    fewer = sharding.lookup_table(SHARDS[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer) if a != 6)
    assert moved < 0.2 * 1009  # a lost shard moves few slots of the others
    # by the rule: each turn claims the first free slot of the shard's order
    claimed: dict[int, int] = {}
    order = {i: [(sharding._number(f"offset:{s}") + j * (sharding._number(f"skip:{s}") % 1008 + 1)) % 1009 for j in range(1009)] for i, s in enumerate(SHARDS)}
    turn = 0
    while len(claimed) < 1009:
        slot = next(x for x in order[turn % 7] if x not in claimed)
        claimed[slot] = turn % 7
        turn += 1
    assert [claimed[i] for i in range(1009)] == t


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_assign(spark):
    rows = [(i, f"x{i}", 1) for i in range(500)] + [(None, "n", 1), (3, "again", 2)]
    df = spark.createDataFrame(rows, "id long, slot string, __x int")
    out = sharding.assign_shards(df, "id", SHARDS, 101).collect()
    table = sharding.lookup_table(SHARDS, 101)
    assert len(out) == 502
    for r in out:
        want = int(hashlib.md5(("" if r["id"] is None else str(r["id"])).encode()).hexdigest()[:8], 16) % 101
        assert r["slot"] == want and r["shard"] == SHARDS[table[want]]
    assert sharding.assign_shards(df.limit(0), "id", SHARDS, 101).count() == 0
    plan = sharding.assign_shards(df, "id", SHARDS, 101)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Broadcast" in plan


def fill(children: list[tuple], given: int) -> dict:
    """(name, cap, weight) -> tokens, in fractions: the common rate rises to where the next child is full, as long as the
    budget lasts, and then as far as it lasts."""
    live = [(n, c, w) for n, c, w in children if c > 0 and w > 0]
    spent = lambda rate: sum(min(Fraction(c), rate * w) for _, c, w in live)
    low = Fraction(0)
    for rate in sorted({Fraction(c, w) for _, c, w in live}):
        if spent(rate) > given:
            open_ = sum(w for _, c, w in live if Fraction(c, w) > low)
            low += (given - spent(low)) / open_
            break
        low = rate
    return {n: min(Fraction(c), low * w) for n, c, w in live}


def brute(docs, levels, weights, share, epochs, seed):
    words = lambda t: len(t.split()) if t else 0
    key = lambda d: tuple("<null>" if v is None else str(v) for v in levels(d))
    leaves: dict = {}
    for d in docs:
        leaves.setdefault(key(d), []).append(d)
    tokens = {k: sum(words(d[1]) for d in v) for k, v in leaves.items()}
    budget = {(): min(int(sum(tokens.values()) * share), epochs * sum(tokens.values()))}
    for depth in range(1, 4):
        new = {}
        for parent, given in budget.items():
            names = {k[:depth] for k in leaves if k[: depth - 1] == parent}
            kids = [(n, epochs * sum(t for k, t in tokens.items() if k[:depth] == n), weights[depth - 1].get(n[-1], 1)) for n in sorted(names)]
            new |= {n: int(v) for n, v in fill(kids, given).items()}
        budget = new
    out = []
    for leaf, own in leaves.items():
        b, t = budget.get(leaf, 0), tokens[leaf]
        if not b or not t:
            continue
        whole, rest = divmod(b, t)
        order = sorted((hashlib.md5(f"{seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), i) for i, d in enumerate(own))
        cut, total = None, 0
        for k in sorted({k for k, _ in order}):
            total += sum(words(own[i][1]) for kk, i in order if kk == k)
            if total > rest or not rest:
                break
            cut = k
        for i, d in enumerate(own):
            k = next(k for k, j in order if j == i)
            out += [(d[0], e) for e in range(whole + (cut is not None and k <= cut))]
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.4, 9.0])
def test_mix_like_brute_force(spark, share):
    r = random.Random(5)
    docs = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en"] * 6 + ["de", "fr", None]), r.choice(["hot"] * 5 + ["a", "b", None, "c"])) for i in range(400)]
    docs += [docs[3], (None, "one two three", "en", "hot"), (1000, None, "en", "a"), (1001, "", "xx", "only empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("__epoch2", F.lit(1)).withColumn("tokens", F.lit(2))
    levels = {"domain": F.when(F.col("source") == "hot", "big").otherwise("small"), "lang": F.col("lang"), "source": F.col("source")}
    weights = {"domain": {"big": 2, "small": 3}, "lang": {"en": 4, "de": 2, "fr": 0}, "source": {"a": 5}}
    got = mixing.mix(df, levels, weights, share, 2, 9)
    assert [c for c in got.columns if c in df.columns] == df.columns
    got = sorted(((r["doc_id"], r["__epoch"]) for r in got.collect()), key=str)
    want = brute(docs, lambda d: ("big" if d[3] == "hot" else "small", d[2], d[3]), [weights["domain"], weights["lang"], weights["source"]], share, 2, 9)
    assert got == want


def test_clashing_names(spark):
    rows = [(i, "a b c", "en", "s", 1, 2, 3, 4, 5, 6) for i in range(20)]
    names = ["__l1", "__EPOCH", "__cut", "__whole", "__rest", "__n"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(df, {"lang": F.col("lang")}, {}, 0.5, 1, 3)
    assert out.columns == [*df.columns, "__l1_", "__epoch_"] and out.count() == 10 and out.agg(F.sum("__cut")).first()[0] == 30
    odd = spark.createDataFrame([(1, 2, 3, 4)], "id long, __slot int, __shard int, __index int")
    placed = sharding.assign_shards(odd, "id", SHARDS, 101)
    assert placed.columns == [*odd.columns, "slot", "shard"] and placed.first()[:4] == (1, 2, 3, 4)


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df, {"lang": F.col("lang")}, {}, 0.5).count() == 0
