from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators.asof import align_target, asof_aggregates, asof_window_join, feature_name

START = datetime(2024, 1, 1)
AGGS = ("count", "mean", "max", "min", "std", "sum")


@pytest.fixture(scope="module")
def requests(spark):
    rnd = random.Random(3)
    data = []
    for i in range(400):
        parent = "hot" if i % 3 else f"p{rnd.randrange(12)}"
        minutes = rnd.randrange(0, 60 * 24 * 12, 5)
        v = None if rnd.random() < 0.1 else rnd.randrange(100)
        data.append((i, parent, START + timedelta(minutes=minutes), v, rnd.randrange(2)))
    return spark.createDataFrame(data, "id long, parent string, at timestamp, v int, y int").cache()


def brute(data, window, delay, strict=False):
    out = []
    for r in data:
        cells = [r["id"]]
        for col, d in (("v", timedelta(0)), ("y", delay)):
            seen = [
                o[col]
                for o in data
                if o["parent"] == r["parent"]
                and r["at"] - window < o["at"] <= r["at"] - d
                and not (strict and o["at"] == r["at"])
                and o[col] is not None
            ]
            n = len(seen)
            mean = sum(seen) / n if n else None
            std = (sum((x - mean) ** 2 for x in seen) / (n - 1)) ** 0.5 if n > 1 else None
            cells += [n, mean, max(seen, default=None), min(seen, default=None), std, sum(seen) if n else None]
        out.append(tuple(round(c, 5) + 0.0 if isinstance(c, float) else c for c in cells))
    return sorted(out, key=repr)


def features(df, **kw):
    made = asof_aggregates(df, ts="at", parents=["parent"], cols=["v"], aggs=AGGS, label="y", **kw)
    cols = [feature_name("parent", a, c) for c in ("v", "y") for a in AGGS]
    got = made.select("id", *cols).collect()
    clean = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted(
        (tuple([r["id"]] + [int(clean(v)) if c.endswith(("SUM__v", "SUM__y")) and v is not None else clean(v) for c, v in zip(cols, r[1:])]) for r in got),
        key=repr,
    )


@pytest.mark.parametrize("sliding_limit", [10**9, 0])
@pytest.mark.parametrize("window,delay", [("3d", "24h"), ("30d", "24h"), ("3d", None)])
def test_both_plans_equal_brute_force(requests, sliding_limit, window, delay):
    want = brute(requests.collect(), timedelta(days=int(window[:-1])), timedelta(hours=24 if delay else 0))
    assert features(requests, window=window, label_delay=delay, sliding_limit=sliding_limit) == want


@pytest.mark.parametrize("sliding_limit", [10**9, 0])
def test_without_the_current_time(requests, sliding_limit):
    want = brute(requests.collect(), timedelta(days=3), timedelta(hours=24), strict=True)
    got = features(requests, window="3d", label_delay="24h", sliding_limit=sliding_limit, include_current=False)
    assert got == want


@pytest.mark.parametrize("sliding_limit", [10**9, 0])
def test_later_rows_change_nothing(requests, sliding_limit):
    cut = START + timedelta(days=8)
    past = requests.filter(F.col("at") <= F.lit(cut))
    ids = {r["id"] for r in past.select("id").collect()}
    alone = features(past, window="3d", sliding_limit=sliding_limit)
    with_future = [r for r in features(requests, window="3d", sliding_limit=sliding_limit) if r[0] in ids]
    assert alone == with_future


@pytest.mark.parametrize("together", [True, False])
def test_a_burst_in_one_bucket(spark, together):
    """All rows of a parent within one second, at one time or at many, with groups of three rows per task."""
    rnd = random.Random(4)
    data = [(i, "burst", START + timedelta(microseconds=0 if together else rnd.randrange(40)), rnd.choice([None, rnd.randrange(9)]), i % 2) for i in range(60)]
    data += [(100 + i, None if i % 2 else "calm", START + timedelta(hours=rnd.randrange(90)), i, i % 2) for i in range(12)]
    df = spark.createDataFrame(data, "id long, parent string, at timestamp, v int, y int")
    spark.conf.set("spark.lodeline.maxGroupRows", "3")
    try:
        want = brute(df.collect(), timedelta(days=3), timedelta(hours=24))
        assert features(df, window="3d", label_delay="24h", sliding_limit=5) == want
        want = brute(df.collect(), timedelta(days=3), timedelta(hours=24), strict=True)
        assert features(df, window="3d", label_delay="24h", sliding_limit=20, include_current=False) == want
    finally:
        spark.conf.unset("spark.lodeline.maxGroupRows")


def test_separate_cutoffs(spark, requests):
    cutoffs = spark.createDataFrame([("hot", START + timedelta(days=5)), ("none", START)], "parent string, cut timestamp")
    got = asof_window_join(cutoffs, requests, key="parent", cutoff_ts="cut", ts="at", cols=["v"], aggs=("count",), window="2d")
    want = sum(
        1
        for r in requests.collect()
        if r["parent"] == "hot" and r["v"] is not None and timedelta(0) <= START + timedelta(days=5) - r["at"] < timedelta(days=2)
    )
    assert rows(got, "parent", "parent__COUNT__v") == [("hot", want), ("none", 0)]


def test_missing_label_fails(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    labels = spark.createDataFrame([(1, 0)], "id long, y int")
    with pytest.raises(Exception, match="no label for key 2"):
        align_target(left, labels, key="id", label="y").collect()


def test_window_tasks_stay_small(spark, monkeypatch):
    """What a task sorts is bounded by rows, not by Spark's number of partitions."""
    from lodeline.plans import layout

    monkeypatch.setattr(layout, "TASK_ROWS", 50)
    df = spark.range(2_000).select("id", (F.col("id") % 40).alias("parent"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").cast("double").alias("v"))
    args = dict(ts="at", parents=["parent"], cols=["v"], aggs=("count", "max"), window="1h")
    many = asof_aggregates(df, **args)
    assert "hashpartitioning(parent#" in (plan := many._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    monkeypatch.setattr(layout, "TASK_ROWS", 10**6)
    assert rows(many) == rows(asof_aggregates(df, **args))
    monkeypatch.setattr(layout, "TASK_ROWS", 50)
    assert rows(asof_aggregates(df, sliding_limit=10, **args)) == rows(many)
