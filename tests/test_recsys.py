from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import recsys
from lodeline.session import CLEANUP
from lodeline.session import stored as _stored


@pytest.fixture(scope="module")
def ratings(spark):
    """One item rated by everyone, one user who rated everything."""
    rnd = random.Random(1)
    data = {(u, 0): rnd.randint(1, 5) for u in range(60)}
    data |= {(u, i): rnd.randint(1, 5) for u in range(60) for i in rnd.sample(range(1, 80), 6)}
    data |= {(7, i): rnd.randint(1, 5) for i in range(80)}
    return spark.createDataFrame([(u, i, r) for (u, i), r in data.items()], "user long, item long, rating long").cache()


def brute_neighbors(data, k):
    by = {}
    for r in data:
        by.setdefault(r["user"], {})[r["item"]] = r["rating"]
    norm = {u: sum(x * x for x in v.values()) ** 0.5 for u, v in by.items()}
    out = []
    for u in by:
        sims = []
        for v in by:
            dot = sum(x * by[v].get(i, 0) for i, x in by[u].items())
            if u != v and dot:
                sims.append((-round(dot / norm[u] / norm[v], 9), v))
        out += [(u, v, -s) for s, v in sorted(sims)[:k]]
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "list_rows,task_pairs,long_user", [(10**6, 10**6, 10**6), (3, 10**6, 10**6), (3, 50, 10**6), (20, 200, 10), (20, 10**6, 10**6), (45, 500, 10**6)]
)
@pytest.mark.parametrize("k", [1, 5, 70])
def test_neighbors_with_lists_of_any_length(ratings, k, list_rows, task_pairs, long_user):
    got = recsys.user_neighbors(ratings, k=k, list_rows=list_rows, task_pairs=task_pairs, long_user=long_user)
    assert rows(got, "user", "neighbor", "sim") == brute_neighbors(ratings.collect(), k)


def test_bounds_spare_the_further_lists(spark):
    """Groups of users alike apart from an item of everybody: none of them is searched again."""
    data = [(u, 0, 1) for u in range(200)] + [(u, 1 + u // 10 * 3 + i, 5) for u in range(200) for i in range(3)]
    df = spark.createDataFrame(data, "user long, item long, rating long")
    states = []
    search = recsys._search

    def spy(queries, *args):
        out = search(queries, *args)
        states.append((queries.count(), {r["state"] for r in out.select("state").distinct().collect()}))
        return out

    recsys._search = spy
    try:
        got = recsys.user_neighbors(df, k=9, list_rows=20)
        assert rows(got, "user", "neighbor", "sim") == brute_neighbors(df.collect(), 9)
    finally:
        recsys._search = search
    assert [s[1] for s in states] == [{recsys.PARTIAL}, set()] and states[1][0] == 0


def test_equal_users(spark):
    df = spark.createDataFrame([(u, 0, 3) for u in range(30)] + [(30, 1, 2)], "user long, item long, rating long")
    got = recsys.user_neighbors(df, k=4, list_rows=8)
    assert rows(got, "user", "neighbor", "sim") == brute_neighbors(df.collect(), 4)
    assert recsys.user_neighbors(df.limit(0), k=4).count() == 0


def test_worked_example(spark):
    neighbors = spark.createDataFrame([(1, 2, 0.92), (1, 3, 0.83), (1, 4, 0.78)], "user long, neighbor long, sim double")
    rated = spark.createDataFrame(
        [(2, 12, 5.0), (2, 58, 4.5), (2, 9, 3.0), (3, 12, 4.0), (3, 71, 5.0), (4, 58, 4.0), (4, 33, 4.5)],
        "user long, item long, rating double",
    )
    # 58: 0.92*4.5 + 0.78*4; the rating of 3 for item 9 is below the limit
    assert rows(recsys.candidate_items(neighbors, rated), "item", "score") == [(12, 7.92), (33, 3.51), (58, 7.26), (71, 4.15)]


def test_recommendations_are_unseen_and_ranked(ratings):
    recs = recsys.recommend(ratings, k_neighbors=5, topn=4)
    assert recs.join(ratings, ["user", "item"]).count() == 0
    assert recs.groupBy("user").count().filter("count > 4").count() == 0


def test_repeated_pairs_are_summed(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "user long, item long, rating long")
    assert rows(recsys.user_item(df), "user", "item", "rating") == [(1, 1, 5)]


def test_title_default(spark):
    recs = spark.createDataFrame([(1, 5), (1, 6)], "user long, item long")
    titles = spark.createDataFrame([(5, "Five")], "item long, title string")
    assert rows(recsys.enrich_title(recs, titles), "item", "title") == [(5, "Five"), (6, "Movie 6")]


def test_precision_counts_liked_hits(ratings):
    made = recsys.precision_at_k(ratings.withColumn("t", F.col("item")), order=["t", "item"], holdout=2, k_neighbors=5)
    assert all(0 <= r["hits"] <= r["recs"] <= 5 and r["precision"] == r["hits"] / r["recs"] for r in made.collect())


@pytest.mark.parametrize("shift,scale", [(0, 1), (2**40, 0.1)])
def test_lists_keep_ids_and_ratings_exactly(spark, ratings, shift, scale):
    """Lists are sent in small types only where these hold every value."""
    kind = "long" if scale == 1 else "double"
    df = ratings.select((F.col("user") + shift).alias("user"), "item", (F.col("rating") * scale).cast(kind).alias("rating"))
    assert rows(recsys.user_neighbors(df, k=5), "user", "neighbor", "sim") == brute_neighbors(df.collect(), 5)
    small = recsys._narrowed(df, "user", "rating")
    assert [t for _, t in small.dtypes] == (["tinyint", "bigint", "tinyint"] if scale == 1 else ["bigint", "bigint", "double"])
    assert rows(small, "user", "item", "rating") == rows(df, "user", "item", "rating")


def test_unseen_items_in_the_same_shuffle(ratings, monkeypatch):
    monkeypatch.setattr(recsys, "VOTE_ROWS", 7)
    neighbors = recsys.user_neighbors(ratings, k=5).cache()
    found = recsys.candidate_items(neighbors, ratings)
    votes = ratings.filter("rating >= 4").withColumnRenamed("user", "neighbor").join(neighbors, "neighbor")
    plain = votes.groupBy("user", "item").agg(F.round(F.sum(F.col("sim") * F.col("rating")), 9).alias("score"))
    assert rows(found, "user", "item", "score") == rows(plain, "user", "item", "score")
    fused = recsys.candidate_items(neighbors, ratings, unseen=True)
    assert rows(fused, "user", "item", "score") == rows(recsys.unseen_items(found, ratings), "user", "item", "score")


def test_search_in_rounds_removes_its_shuffles(spark, ratings, monkeypatch):
    """Rounds give the same neighbors, and what they shuffled is gone when they end."""
    kept = []
    monkeypatch.setattr(recsys, "ROUND_PAIRS", 300)
    monkeypatch.setattr(recsys, "stored", lambda df, name: kept.append(name) or _stored(df, name))
    made = recsys.user_neighbors(ratings, k=5, list_rows=20, task_pairs=100)
    assert kept.count("found") > 4
    assert rows(made, "user", "neighbor", "sim") == brute_neighbors(ratings.collect(), 5)


def test_stored_removes_what_it_shuffled(spark):
    def blocks():
        status = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.getName().startswith("shuffle_") for f in (status.apply(i) for i in range(status.size())))

    before, setting = blocks(), spark.conf.get(CLEANUP)
    df = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    again = _stored(df, "sums")
    assert blocks() <= before and spark.conf.get(CLEANUP) == setting
    assert again.count() == 7 and df.count() == 7


def test_narrowing_by_bounds(spark):
    """Types are found without a cast that fails: no row raises, and values on the edge keep their value."""
    edge = spark.createDataFrame([(127, 32767, 2**31 - 1, 0.5, 3.0, 0.1), (-128, -32769, -(2**31), -2.0, -4.0, 1.0)], "a long, b long, c long, d double, e double, f double")
    plan_free = recsys._narrowed(edge, *edge.columns)
    assert [t for _, t in plan_free.dtypes] == ["tinyint", "int", "int", "float", "tinyint", "double"]
    assert rows(plan_free) == rows(edge)
    beyond = spark.createDataFrame([(128, 2**31, float("nan"), None), (0, 0, 1.0, 1.0)], "a long, b long, d double, e double")
    assert [t for _, t in recsys._narrowed(beyond, *beyond.columns).dtypes] == ["smallint", "bigint", "float", "double"]
    assert recsys._narrowed(beyond.limit(0), "a").schema["a"].dataType.simpleString() == "bigint"
