from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.functions.scalar import classify_threshold, flag_threshold
from lodeline.operators import context as ctx
from lodeline.operators import knapsack
from lodeline.operators import vectors as vec
from lodeline.operators.checks import expect
from lodeline.operators.reports import position_accuracy


def test_threshold_labels(spark):
    df = spark.createDataFrame([(19.99,), (20.0,), (49.99,), (50.0,), (None,)], "d double")
    got = [r[0] for r in df.select(classify_threshold(F.col("d"))).collect()]
    assert got == ["obstacle_near", "obstacle_moderate", "obstacle_moderate", "clear", "clear"]
    named = df.select(classify_threshold(F.col("d"), null_label="unknown")).collect()
    assert named[-1][0] == "unknown"
    assert [r[0] for r in df.select(flag_threshold(F.col("d"), 20)).collect()] == [False, False, True, True, False]


def items(spark, rows_):
    return spark.createDataFrame(rows_, "g string, id long, s double, t long, b long")


def test_greedy_skips_and_goes_on(spark):
    df = items(spark, [("x", 1, 9.0, 5, 8), ("x", 2, 8.0, 7, 8), ("x", 3, 7.0, 2, 8), ("y", 4, 1.0, 9, 8)])
    made = ctx.budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b")
    assert rows(made, "g", "id", "rank") == [("x", 1, 1), ("x", 3, 3)]
    first = ctx.budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b", k_max=2)
    assert rows(first, "id") == [(1,)]


def greedy_walk(data):
    out = []
    for g in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == g), key=lambda d: (d[2] is None, -(d[2] or 0), d[1]))
        left = mine[0][4]
        for rank, (_, i, _, t, _) in enumerate(mine, 1):
            if left is not None and t is not None and max(t, 0) <= left:
                left -= max(t, 0)
                out.append((g, i, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [None, 1, 3, 10])
def test_greedy_equals_the_walk(spark, limit):
    rnd = random.Random(6)
    data = [("steps", i, 1000.0 - i, t, 100) for i, t in enumerate([40, 70, 10, 55, 1, 50, 49, 3, 60, 46, 0, 2, 1, 1])]
    for g in ("a", "b", None):
        b = rnd.randint(30, 90)
        data += [(g, i, rnd.choice([None, rnd.randint(0, 9) / 8, rnd.random()]), rnd.choice([None, -2, 0, 1, 7, rnd.randint(1, 40)]), b) for i in range(60)]
    data += [("none", 1, 1.0, 1, None), ("much", 1, 1.0, 9, 5), ("zero", 1, 1.0, 0, 0)]
    df = items(spark, data).withColumns({c: F.lit("c") for c in ("need", "left", "nth", "a.b")})
    got = ctx.budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b", max_group_rows=limit)
    assert rows(got, "g", "id", "rank") == greedy_walk(data)
    assert got.columns == [*df.columns, "rank"]


def test_exact_is_best_and_falls_back_when_large(spark):
    rnd = random.Random(4)
    data = [(g, i, round(rnd.random(), 3), rnd.randint(1, 20), 30) for g in "abc" for i in range(9)]
    data += [("big", i, float(i), 1, 5) for i in range(40)]
    kw = dict(group=["g"], score="s", id="id", tokens="t", budget="b")
    exact = ctx.budget_select(items(spark, data), exact=True, **kw).groupBy("g").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    greedy = {r["g"]: r["s"] for r in ctx.budget_select(items(spark, data), **kw).groupBy("g").agg(F.sum("s").alias("s")).collect()}
    for r in exact:
        assert r["t"] <= 30 and r["s"] >= greedy[r["g"]] - 1e-9
        if r["g"] != "big":
            mine = [d for d in data if d[0] == r["g"]]
            best = max(
                sum(d[2] for d in c) for n in range(10) for c in itertools.combinations(mine, n) if sum(d[3] for d in c) <= 30
            )
            assert r["s"] == pytest.approx(best)
    assert {r["g"]: r["s"] for r in exact}["big"] == 39 + 38 + 37 + 36 + 35


def best_by_states(worth, need, limit):
    """Places of the best choice: one state per reachable number of tokens, ties keep the earlier items."""
    n, states = len(worth), {0: (0, 0)}
    for i, (value, tokens) in enumerate(zip(worth, need)):
        for used, (total, picks) in sorted(states.items(), reverse=True):
            after, new = used + tokens, (total + value, picks | 1 << (n - 1 - i))
            if after <= limit and new > states.get(after, (new[0] - 1, 0)):
                states[after] = new
    picks = max(states.values())[1]
    return [i for i in range(n) if picks >> (n - 1 - i) & 1]


@pytest.mark.parametrize("block_items,span", [(256, 8192), (3, 4), (2, 8192), (1, 5)])
def test_exact_by_blocks(spark, monkeypatch, block_items, span):
    monkeypatch.setattr(knapsack, "RANGE", span)
    rnd = random.Random(5)
    data, want = [], []
    for case in range(60):
        n, top = rnd.randint(1, 14), rnd.choice((2, 9, 30))
        scores = sorted((rnd.choice((rnd.randint(-3, 9) / 8, rnd.random())) for _ in range(n)), reverse=True)
        need = [rnd.randint(0, top) for _ in range(n)]
        limit = rnd.choice((None, 0, rnd.randint(1, sum(need) + 2)))
        data += [(f"g{case}" if case else None, i, s, t, limit) for i, (s, t) in enumerate(zip(scores, need))]
        worth = [round(s * 1e9) for s in scores]
        want += [(f"g{case}" if case else None, i, i + 1) for i in best_by_states(worth, need, limit or 0)]
    data += [("none", 1, None, 1, 5), ("none", 2, 1.0, None, 5), ("only null", 1, None, 1, 5)]
    want += [("none", 2, 1)]
    df = items(spark, data).withColumns({c: F.lit("c") for c in ("node", "need", "worth", "a.b")})
    got = knapsack.exact_budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b", block_items=block_items)
    assert rows(got, "g", "id", "rank") == sorted(want, key=repr)
    assert got.columns == [*df.columns, "rank"]


def test_exact_in_a_long_group(spark):
    rnd = random.Random(5)
    data = [("mixed", i, round(rnd.random(), 3), rnd.randint(1, 400), 4_000) for i in range(2_000)]
    data += [("alike", i, 1.0, 7, 3_000) for i in range(6_000)]
    kw = dict(group=["g"], score="s", id="id", tokens="t", budget="b")
    got = ctx.budget_select(items(spark, data), exact=True, **kw)
    sums = {r["g"]: r for r in got.groupBy("g").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.max("id").alias("top")).collect()}
    assert (sums["alike"]["s"], sums["alike"]["t"], sums["alike"]["top"]) == (428.0, 2_996, 427)
    table = np.zeros(4_001, np.int64)
    for _, _, s, t, _ in data[:2_000]:
        table[t:] = np.maximum(table[t:], table[: len(table) - t] + round(s * 1e9))
    assert round(sums["mixed"]["s"] * 1e9) == table[-1] and sums["mixed"]["t"] <= 4_000


def fold(data):
    """The rule, item by item."""
    winner, out, last = {}, {}, {}
    for id_, k, conf, ts in sorted(data, key=lambda d: (d[3], d[0])):
        old = winner.get(k)
        won = old is None or ((conf > old[0]) if abs(conf - old[0]) > 0.1 else ts >= old[1])
        if won:
            winner[k] = (conf, ts, (old[2] if old else 0) + 1)
            last[k] = id_
        out[id_] = [k, won, winner[k][2] if won else 1, conf if won else min(conf, 0.5)]
    return sorted(
        (i, "kept" if not won else ("current" if last[k] == i else "replaced"), v, c) for i, (k, won, v, c) in out.items()
    )


def test_winners_after_any_winner():
    rnd = random.Random(3)
    for _ in range(2_000):
        conf = [rnd.choice([round(rnd.random(), 1), rnd.random(), float("nan")]) for _ in range(rnd.randint(1, 12))]
        before = rnd.choice([None, rnd.random(), float("nan"), 2.0])
        state, want = before, []
        for c in conf:
            won = state is None or c != c or state != state or ctx.beats(c, 1, state, 0)
            state = c if won else state
            want.append(won)
        assert ctx.arrivals(np.array(conf), before, 0.1).tolist() == want


@pytest.mark.parametrize("limit", [10**6, 25, 2])
def test_upserts_equal_the_item_by_item_rule(spark, limit):
    rnd = random.Random(9)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", round(rnd.random(), 2), rnd.randrange(400)) for i in range(420)]
    df = spark.createDataFrame(data, "id long, key string, confidence double, ts long")
    df = df.withColumn("ts", F.timestamp_seconds("ts")).withColumn("type", F.lit("fact")).withColumn("text", F.lit("x"))
    made = ctx.memory_upsert(df, limit=limit)
    assert rows(made, "id", "state", "version", "confidence") == sorted(fold(data), key=repr)


@pytest.mark.parametrize("scope", [None, "label"])
def test_shared_and_blocked_search_agree(spark, scope):
    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(6)], i % 4) for i in range(200)]
    c = spark.createDataFrame(data, "id long, embedding array<float>, label int").repartition(5)
    q = c.filter("id < 40").withColumnRenamed("id", "query")
    a, b = (vec.cosine_topk(c, q, k=3, scope=scope, max_shared_values=m) for m in (10**6, 60))
    assert rows(a, "query", "id", "sim", "rank") == rows(b, "query", "id", "sim", "rank")
    assert a.filter("rank = 1 and query = id").count() == 40


@pytest.mark.parametrize("piece_rows", [10**6, 7])
def test_scoped_search_meets_its_own_scope_only(spark, piece_rows):
    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(6)], i % 3 and i % 5, None if i % 7 else "x") for i in range(200)]
    c = spark.createDataFrame(data, "id long, embedding array<float>, u int, w string").repartition(5)
    q = c.filter("id < 40").withColumnRenamed("id", "query")
    got = vec.filtered_memory_search(c, q, scope=["u", "w"], k=3, piece_rows=piece_rows)
    tag = F.to_json(F.struct("u", F.coalesce("w", F.lit("none"))))
    want = vec.cosine_topk(c.withColumn("tag", tag), q.withColumn("tag", tag), k=3, scope="tag")
    assert rows(got, "query", "id", "sim", "rank") == rows(want, "query", "id", "sim", "rank")


def test_checks_share_one_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (7, "z")], "n int, s string")
    made = expect(df, [("not_null", "s"), ("accepted_values", "s", ["a"]), ("range", "n", (0, 5)), ("unique", "n")])
    assert rows(made) == sorted(
        [("not_null", "s", 3, 1, False), ("accepted_values", "s", 3, 1, False), ("range", "n", 3, 1, False), ("unique", "n", 3, 1, False)], key=repr
    )


def test_position_accuracy_has_an_overall_row(spark):
    df = spark.createDataFrame([(5, True), (5, False), (25, True)], "position int, correct boolean")
    assert rows(position_accuracy(df), "position", "accuracy_pct") == sorted([(5, 50.0), (25, 100.0), (None, 2 / 3 * 100)], key=repr)


def test_exact_settles_items_by_their_price(spark):
    """Loose budgets are taken whole and wide ones leave few open items, with the same choice as a whole search."""
    rnd = random.Random(11)
    data, want = [], []
    for case in range(12):
        n, top = 400, rnd.choice((50, 3_000))
        scores = sorted((rnd.choice((rnd.randint(0, 8) / 8, rnd.random())) for _ in range(n)), reverse=True)
        need = [rnd.randint(0, top) for _ in range(n)]
        limit = sum(need) // rnd.choice((1, 2, 12))
        data += [(f"g{case}", i, s, t, limit) for i, (s, t) in enumerate(zip(scores, need))]
        worth = np.array([round(s * 1e9) for s in scores])
        picks = []
        knapsack._walk(worth, np.array(need), np.zeros(limit + 1, np.int64), np.array([limit]), picks)
        want += [(f"g{case}", i) for i in picks]
    df = items(spark, data)
    got = knapsack.exact_budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b")
    assert rows(got, "g", "id") == sorted(want, key=repr)
    shaped = df.selectExpr("g", "id AS rank", "cast(round(s * 1e9) AS long) AS worth", "t AS need", "b AS limit").where("need > 0")
    sure, open_ = knapsack._settled(shaped)
    sizes = {r["g"]: (r["n"], r["l"]) for r in open_.groupBy("g").agg(F.count("*").alias("n"), F.max("limit").alias("l")).collect()}
    assert all(n < 100 and left < 60_000 for n, left in sizes.values()), sizes
    assert sure.count() > 400


def test_exact_rows_stay_short(spark, monkeypatch):
    """No row holds the table of a budget, and a table ends where all items behind its block are taken."""
    monkeypatch.setattr(knapsack, "RANGE", 40)
    monkeypatch.setattr(knapsack, "ROW", 10)
    kept, keep = [], knapsack.stored

    def spy(df, name):
        made = keep(df, name)
        if name == "tables":
            kept.append(made.agg(F.max(F.size("t")).alias("row"), F.max(F.col("u") * 10 + F.size("t")).alias("end"), F.min("u").alias("u")).first())
        return made

    monkeypatch.setattr(knapsack, "stored", spy)
    data = [("a", i, 1.0 + (i * 7 % 11) / 1000, 20 + i * 5 % 7, 400) for i in range(40)]
    df = spark.createDataFrame(data, "g string, id long, s double, t long, b long")
    monkeypatch.setattr(knapsack, "_settled", lambda items: (items.select("g", "rank").limit(0), items))
    got = knapsack.exact_budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b", block_items=4)
    ranked = sorted(data, key=lambda r: (-r[2], r[1]))
    picks = []
    need = np.array([r[3] for r in ranked])
    knapsack._walk(np.array([round(r[2] * 1e9) for r in ranked]), need, np.zeros(401, np.int64), np.array([400]), picks)
    assert sorted(r["rank"] - 1 for r in got.collect()) == picks
    assert len(kept) > 4 and max(k["row"] for k in kept) <= 10 and kept[0]["end"] < 150 and kept[0]["u"] == 0
