from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import windows
from lodeline.operators.aggregates import describe_numeric, exact_quantiles, histogram, topk_per_group
from lodeline.operators.metrics import roc_auc


@pytest.fixture(scope="module")
def seq(spark):
    return spark.range(103).select(F.col("id"), (F.col("id") % 4).alias("u"), F.sqrt("id").alias("v")).cache()


@pytest.mark.parametrize("size,periods,want", [(1, 2, 0), (2, 2, 1), (9, 10, 0), (10, 10, 1), (11, 10, 2), (11, 2, 10)])
def test_rolling_min_periods(spark, size, periods, want):
    df = spark.range(size).select("id", F.lit(1).alias("k"), F.col("id").cast("double").alias("x"))
    made = windows.rolling_stats(df, keys=["k"], order=["id"], cols=["x"], min_periods=periods)
    assert made.count() == want


def test_folds_are_disjoint_complete_and_even(seq):
    folds = windows.kfold(seq, order=["id"], k=5).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"))
    got = rows(folds, "fold", "n", "a", "z")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5]
    assert [g[1] for g in got] == [21, 21, 21, 20, 20]
    assert all(x[3] + 1 == y[2] for x, y in zip(got, got[1:]))


def test_per_user_split_has_ten_each(seq):
    split = windows.nth_per_user_split(seq, user="u", order=["id"], start=1, stop=10)
    assert {r["count"] for r in split.filter("split = 'test'").groupBy("u").count().collect()} == {10}
    assert split.count() == 103
    capped = windows.nth_per_user_split(seq, user="u", order=["id"], start=1, stop=10, max_test=15)
    assert sorted(r["id"] for r in capped.filter("split = 'test'").collect()) == list(range(15))


def test_last_n_needs_more_than_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(6)], "u string, t int")
    held = windows.last_n_holdout(df, user="u", order=["t"], n=5).filter("held")
    assert rows(held, "u", "t") == [("b", i) for i in range(1, 6)]


def test_chronological_and_walk_forward(seq):
    split = windows.chronological_split(seq, order=["id"])
    assert split.filter("split = 'train'").agg(F.max("id")).first()[0] == 81
    blocks = windows.walk_forward(seq, order=["id"], n_splits=5)
    sizes = rows(blocks.groupBy("block").count(), "block", "count")
    assert sizes == [(0, 18), (1, 17), (2, 17), (3, 17), (4, 17), (5, 17)]


def test_one_class_folds_are_marked(seq):
    df = seq.withColumn("y", (F.col("id") > 90).cast("int"))
    usable = rows(windows.walk_forward_folds(df, order=["id"], label="y"), "fold", "usable")
    assert usable == [(i, False) for i in range(5)]


def test_quantiles_by_position(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 10)] + [("b", 5.0)], "g string, x double")
    assert rows(exact_quantiles(df, "x", (0.0, 0.25, 0.5, 1.0), keys=["g"])) == [("a", 4, 1.0, 1.75, 2.0, 10.0), ("b", 1, 5.0, 5.0, 5.0, 5.0)]
    one = describe_numeric(df, ["x"], approximate=True).first()
    assert one["count"] == 5 and one["p50"] == 2.0


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10)], "x double")
    assert rows(histogram(df, "x", 5)) == [(0, 2), (2, 1), (4, 1)] or rows(histogram(df, "x", 5)) == [(0, 1), (0, 1), (2, 1), (4, 1)]


def test_topk_ties(spark):
    df = spark.createDataFrame([(1, 3, 5), (1, 2, 5), (1, 1, 4)], "g int, id int, s int")
    top = topk_per_group(df, group=["g"], order=[F.desc("s"), F.asc("id")], k=2)
    assert rows(top, "rank", "id") == [(1, 2), (2, 3)]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame(
        [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.35, 1), ("a", 0.8, 1), ("t", 1.0, 0), ("t", 1.0, 1), ("o", 1.0, 1)],
        "k string, s double, y int",
    )
    assert rows(roc_auc(df, score="s", label="y", keys=["k"]), "k", "auc") == [("a", 0.75), ("o", None), ("t", 0.5)]


def test_gaps_stay_null_until_seven(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(12)], "t int, v double").withColumn("k", F.lit(0))
    made = {r["t"]: r["rolling_mean"] for r in windows.rolling_mean(df, keys=["k"], order=["t"], value="v").collect()}
    assert [made[t] for t in (5, 6, 9, 10, 11)] == [None, None, None, 7.0, 8.0]
