"""Splitting long groups must not change any result."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.plans.hot_groups import row_frames, row_positions, running, split_groups

WHOLE, SMALL = 10**9, 40


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, another group of NULL keys, times with ties, NULL values."""
    rnd = random.Random(5)
    data = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else (None if i % 3 == 1 and i % 2 else f"k{rnd.randrange(60)}")
        data.append((i, key, rnd.randrange(300), None if rnd.random() < 0.3 else round(rnd.uniform(-9, 9), 2)))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id long, key string, t int, v double").repartition(5).cache()


def test_long_groups_are_split_into_small_blocks(skewed):
    s = split_groups(skewed, ["key"], ["t", "id"], SMALL)
    sizes = [r["count"] for r in s.hot.groupBy("key", "_blk").count().collect()]
    assert sum(sizes) + s.cold.count() == 1200
    assert len(sizes) > 8 and max(sizes) < 6 * SMALL
    assert {r["key"] for r in s.hot.select("key").distinct().collect()} == {"hot", None}


def test_blocks_follow_the_order(skewed):
    s = split_groups(skewed, [], ["t", "id"], SMALL)
    ends = s.hot.groupBy("_blk").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("z")).orderBy("_blk").collect()
    assert len(ends) > 10
    assert all(x["z"] < y["a"] for x, y in zip(ends, ends[1:]))


@pytest.mark.parametrize("keys", [["key"], []])
def test_positions(skewed, keys):
    want, got = (rows(row_positions(skewed, keys, ["t", "id"], total="n", limit=lim), "id", "pos", "n") for lim in (WHOLE, SMALL))
    assert got == want


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("strict", [False, True])
def test_running(skewed, keys, strict):
    aggs = {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "v")}
    cols = ["id", F.round("s", 6), "c", "lo", "hi", "last"]
    want, got = (rows(running(skewed, keys, ["t", "id"], aggs, strict=strict, limit=lim), *cols) for lim in (WHOLE, SMALL))
    fix = lambda rs: [(r[0], r[1], r[2] or 0, *r[3:]) for r in rs]
    assert fix(got) == fix(want)


@pytest.mark.parametrize("keys", [["key"], []])
def test_row_frames(skewed, keys):
    def build(w):
        return {"lag3": F.lag("v", 3).over(w), "avg": F.round(F.avg("v").over(w.rowsBetween(-9, 0)), 6)}

    want, got = (rows(row_frames(skewed, keys, ["t", "id"], 9, build, limit=lim), "id", "lag3", "avg") for lim in (WHOLE, SMALL))
    assert got == want


def test_lookback_longer_than_the_limit(skewed):
    build = lambda w: {"x": F.lag("id", 50).over(w)}
    want, got = (rows(row_frames(skewed, ["key"], ["t", "id"], 50, build, limit=lim), "id", "x") for lim in (WHOLE, 10))
    assert got == want


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, key string, t int, v double")
    assert row_positions(empty, ["key"], ["t"]).count() == 0
    assert running(empty, [], ["t"], {"s": ("sum", "v")}).count() == 0
