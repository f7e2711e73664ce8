"""Prefix trie and tree contraction against brute force, with nulls, ties, repeats, long chains and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeline.llm import contraction, prefix_trie
from lodeline.llm.prefix_trie import as_they_are, ordered_turns, rebuilt_trie
from lodeline.session import stored

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), role, text))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}


def trie_brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (
            sum(totals[k][0] for k in kids[node]) or 1,
            saved + sum(totals[k][1] for k in kids[node]),
        )
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(kids[node]), *totals[node], sha(ends)))
    return sorted(out, key=repr)


def rebuilt_brute(rows, share=100, heads=6):
    own = turns_of(rows)
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    return {c: own.get(c - c % share, [])[: h[c]] + own[c][h[c] :] for c in own}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 300, 399, 1000]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "long text"])))
    out += [(7, None, "user", "no number"), (7, None, None, None), (7, 3, "user", "same number"), (7, 3, "bot", "same number")]
    out += [(None, 1, "user", "nobody"), (301, 0, "user", "x"), (301, 0, "user", "x"), (302, 0, None, None)]
    out += [(c, t, "user", f"common {t}") for c in range(400, 460) for t in range(3)]
    out += [(500, t, "user", f"deep {t}" + "x" * (t % 7)) for t in range(300)]
    out += [(501, 0, "user", "y" * 200_000)]
    # Their first turns belong to a conversation that does not exist, and they have no others.
    out += [(c, 0, "user", "gone") for c in range(601, 640) if zlib.crc32(str(c).encode()) % 6]
    rng.shuffle(out)
    return out


def test_rebuilt_trie(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = trie_brute(rebuilt_brute(rows))
    assert got(rebuilt_trie(df)) == want
    assert any(len(ts) == 0 for ts in rebuilt_brute(rows).values())
    clashing = df.withColumns({c: F.lit("c") for c in ("pos", "depth", "id", "parent", "k1", "_blk", "digest", "n", "a.b")})
    assert got(rebuilt_trie(clashing)) == want


def test_long_conversations_and_lists_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 2)
    monkeypatch.setattr(prefix_trie, "PIECES", 2)
    spark.conf.set("spark.lodeline.maxGroupRows", "5")
    try:
        assert got(rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == trie_brute(rebuilt_brute(rows))
    finally:
        spark.conf.unset("spark.lodeline.maxGroupRows")


def test_own_turns(spark, rows):
    turns = stored(ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert got(prefix_trie.prefix_trie(stored(as_they_are(turns)))) == trie_brute(turns_of(rows))


def test_no_conversations(spark):
    assert rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(rebuilt_trie(spark.createDataFrame([(9, 0, None, None)], SCHEMA)))[0][:2] == (9, 0)


def forest(kind, n, rng):
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "star":
        return [None, *[0] * (n - 1)]
    if kind == "comb":
        return [None, *[i - 1 if i % 2 else max(0, i - 2) for i in range(1, n)]]
    return [None if i % 50 == 0 else rng.randrange(max(0, i - 6), i) for i in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "comb", "random"])
def test_subtree_totals(spark, kind):
    rng, n = random.Random(3), 400
    parents = forest(kind, n, rng)
    names = rng.sample(range(10**12), n)
    value = [rng.randrange(1000) for _ in range(n)]
    rows = [(names[i], None if p is None else names[p], value[i]) for i, p in enumerate(parents)]
    tree = stored(contraction.with_children(spark.createDataFrame(rows, "id long, parent long, w long")))
    leaf, total = [int(i not in parents) for i in range(n)], list(value)
    for i in reversed(range(n)):
        if parents[i] is not None:
            leaf[parents[i]] += leaf[i]
            total[parents[i]] += total[i]
    assert got(contraction.subtree_totals(tree, ["w"])) == sorted(((names[i], leaf[i], total[i]) for i in range(n)), key=repr)


def test_a_missing_parent_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(contraction, "MAX_ROUNDS", 4)
    tree = stored(contraction.with_children(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "id long, parent long, w long")))
    with pytest.raises(RuntimeError):
        contraction.subtree_totals(tree, ["w"])
