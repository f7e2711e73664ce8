"""What a task holds while words are counted is bounded, whatever the table's size."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import online_text
from lodeline.plans import hot_groups, layout

KEYS = {"order": "id", "text": "text", "label": "y"}


def _messages(spark, n=120):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(rnd.choices(words, k=rnd.randrange(30))), rnd.randrange(2)) for i in range(n)]
    return spark.createDataFrame([*data, (n, None, 1)], "id long, text string, y int").coalesce(1)


def test_tasks_that_count_words_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_CHARS", 500)
    df = _messages(spark)
    chars = df.agg(F.sum(F.length("text"))).first()[0]
    counts = online_text.token_counts(df, **KEYS)
    assert counts.rdd.getNumPartitions() == -(-chars // 500) > 8
    assert counts.agg(F.sum("tf")).first()[0] == df.select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").count()


def test_windows_over_words_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(hot_groups, "WINDOW_ROWS", 50)
    df = _messages(spark)
    sums = {"s": ("sum", "y")}
    made = hot_groups.running(df, ["id"], ["text"], sums, rows=df.count() * 10)
    assert made.rdd.getNumPartitions() == 25
    assert rows(made) == rows(hot_groups.running(df, ["id"], ["text"], sums))


def test_scores_do_not_depend_on_the_tasks(spark, monkeypatch):
    cols = ["id", "pre_pred", "post_pred", "changed", *[F.round(f"{a}_score{c}", 6) for a in ("pre", "post") for c in (0, 1)]]
    want = rows(online_text.prequential_nb(_messages(spark), **KEYS), *cols)
    monkeypatch.setattr(layout, "TASK_CHARS", 500)
    monkeypatch.setattr(hot_groups, "WINDOW_ROWS", 100)
    monkeypatch.setattr(online_text, "WINDOW_ROWS", 100)
    assert rows(online_text.prequential_nb(_messages(spark), **KEYS), *cols) == want and len(want) == 121


def test_batch_training_counts_bounded_texts(spark, monkeypatch):
    monkeypatch.setattr(layout, "TASK_CHARS", 500)
    parts, deal = [], online_text.dealt_texts
    monkeypatch.setattr(online_text, "dealt_texts", lambda *a: parts.append(deal(*a)) or parts[-1], raising=False)
    df = _messages(spark)
    counts, totals = online_text.fit_batch_nb(df, text="text", label="y")
    assert parts and parts[0].rdd.getNumPartitions() > 8
    n = df.filter("text <> ''").select(F.explode(F.split("text", " ")).alias("w")).count()
    assert totals["t0"] + totals["t1"] == n == counts.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]
