"""Streams give what the batch forms give, however the rows are cut into micro-batches."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import context, online_text
from lodeline.operators.windows import rolling_stats
from lodeline.session import work_dir
from lodeline.sources import readers, writers
from lodeline.streaming import jobs


def feed(spark, df, order, parts, path=None):
    """Files in order, one per micro-batch."""
    path = path or work_dir(spark, "feed")
    ids = sorted(r[0] for r in df.select(order).collect())
    cuts = [ids[len(ids) * i // parts] for i in range(parts)] + [None]
    for lo, hi in zip(cuts, cuts[1:]):
        piece = df.filter(F.col(order) >= F.lit(lo))
        piece = piece if hi is None else piece.filter(F.col(order) < F.lit(hi))
        piece.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query):
    query.awaitTermination(180)
    assert not query.isActive


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_naive_bayes_is_exact_for_any_cut(spark, monkeypatch, parts):
    monkeypatch.setattr(jobs, "COMPACT", 3)
    rnd = random.Random(7)
    texts = ["win cash now", "meeting at noon", "cash prize win", "lunch at noon", "", None, "win win lunch"]
    texts += [" ".join(rnd.choice("win cash noon lunch now a b c".split()) for _ in range(5)) for _ in range(15)]
    df = spark.createDataFrame([(i, t, int("win" in (t or ""))) for i, t in enumerate(texts)], "id long, text string, y int")
    out = work_dir(spark, "nb")
    path = work_dir(spark, "feed")
    run(jobs.prequential_nb(feed(spark, df, "id", parts, path), out, f"{out}/c", order="id", text="text", label="y"))
    want = online_text.prequential_nb(df, order="id", text="text", label="y")
    r = lambda c: F.round(c, 6)
    cols = ["id", "y", *[r(f"{k}_score{c}") for k in ("pre", "post") for c in (0, 1)], "pre_pred", "post_pred", "changed"]
    assert rows(spark.read.parquet(f"{out}/scored"), *cols) == rows(want, *cols)
    # A message from before what was learned is put aside, and later ones are scored as if it had not come.
    more = spark.createDataFrame([(3, "late", 1), (100, "win cash", 1)], df.schema)
    run(jobs.prequential_nb(feed(spark, more, "id", 1, path), out, f"{out}/c", order="id", text="text", label="y"))
    assert rows(spark.read.parquet(f"{out}/late"), "id") == [(3,)]
    want = online_text.prequential_nb(df.unionByName(more.filter("id = 100")), order="id", text="text", label="y")
    assert rows(spark.read.parquet(f"{out}/scored"), *cols) == rows(want, *cols)


def test_upserts_across_batches_equal_batch(spark):
    rnd = random.Random(6)
    data = [(i, f"k{rnd.randrange(4)}", round(rnd.random(), 2), i * 10) for i in range(60)]
    df = spark.createDataFrame(data, "id long, key string, confidence double, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumn("type", F.lit("fact")).drop("s")
    made = jobs.memory_upserts(feed(spark, df, "id", 3))
    out = work_dir(spark, "upserts")
    run(jobs.write_files(made, f"{out}/rows", f"{out}/c"))
    batch = context.memory_upsert(df)
    assert rows(spark.read.parquet(f"{out}/rows"), "id", "version", "confidence") == rows(batch, "id", "version", "confidence")


def readings(spark, n=60):
    rnd = random.Random(8)
    data = [(i % 3, "s", i, i * 20, rnd.random()) for i in range(n)]
    df = spark.createDataFrame(data, "device long, session string, off long, s long, x double")
    return df.withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


def test_rolling_state_spans_batches(spark):
    df = readings(spark)
    made = jobs.rolling_features(feed(spark, df, "off", 4), keys=["device", "session"], order=["at", "off"], cols=["x"])
    out = work_dir(spark, "rolling")
    run(jobs.write_files(made, f"{out}/rows", f"{out}/c"))
    want = rolling_stats(df, keys=["device", "session"], order=["at", "off"], cols=["x"])
    cols = ["off", *[F.round(c, 6) for c in ("x_std", "x_mean", "texture_score")]]
    assert rows(spark.read.parquet(f"{out}/rows"), *cols) == rows(want, *cols)


def test_idle_sessions_start_anew(spark):
    two_days = 2 * 86_400
    data = [(0, "s", i, i * 20, float(i)) for i in range(10)]
    data += [(1, "s", 10, two_days, 0.0), (0, "s", 11, two_days + 60, 0.0)]
    df = spark.createDataFrame(data, "device long, session string, off long, s long, x double")
    df = df.withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    full = {}
    for idle in (None, "1 hour"):
        out = work_dir(spark, "idle")
        stream = feed(spark, df, "off", 12)
        made = jobs.rolling_features(stream, keys=["device", "session"], order=["at", "off"], cols=["x"], idle=idle)
        run(jobs.write_files(made, f"{out}/rows", f"{out}/c"))
        full[idle] = sorted(r["off"] for r in spark.read.schema(made.schema).parquet(f"{out}/rows").collect())
    assert full == {None: [9, 11], "1 hour": [9]}


def test_replayed_offsets_are_dropped(spark):
    df = readings(spark).select(F.col("device").alias("kafka_partition"), F.col("off").alias("kafka_offset"), "at", "x")
    path = work_dir(spark, "replay")
    feed(spark, df, "kafka_offset", 2, path)
    stream = feed(spark, df, "kafka_offset", 3, path)
    out = work_dir(spark, "once")
    run(jobs.write_files(jobs.dedup_offsets(stream, ts="at", within="1 day"), f"{out}/rows", f"{out}/c"))
    assert rows(spark.read.parquet(f"{out}/rows"), "kafka_partition", "kafka_offset") == rows(df, "kafka_partition", "kafka_offset")


def test_closed_windows_in_append_mode(spark):
    df = readings(spark, 600).withColumn("status", F.lit("obstacle_near")).withColumn("temp", F.lit(1.0))
    made = jobs.hourly_windows(feed(spark, df, "off", 3), key="device", ts="at", distance="x", temp="temp", status="status")
    out = work_dir(spark, "closed")
    run(jobs.write_files(made, f"{out}/rows", f"{out}/c"))
    got = {(r["device"], r["hour"]): r["reading_count"] for r in spark.read.parquet(f"{out}/rows").collect()}
    want = {(r["device"], r["hour"]): r["count"] for r in df.groupBy("device", F.date_trunc("hour", "at").alias("hour")).count().collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_append_loads_only_new_offsets_and_missing_columns(spark):
    path = work_dir(spark, "bronze")
    old = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c")], "kafka_partition int, kafka_offset long, v string")
    writers.incremental_append_to_path(old, path)
    more = spark.createDataFrame([(0, 2, "x", 1), (0, 3, "d", 2), (1, 1, "y", 3), (2, 1, "e", 4)], "kafka_partition int, kafka_offset long, v string, w int")
    writers.incremental_append_to_path(more, path)
    df = readers.scan_parquet_union(spark, path)
    assert sorted(r["v"] for r in df.collect()) == ["a", "b", "c", "d", "e"]
    assert df.filter("v = 'a'").first()["w"] is None


def test_broken_and_partial_messages(spark):
    ok = '{"device_id":"d","ultrasonic":{"distance_cm":1.5},"grayscale":{"left":1,"center":2,"right":3},"system":{"cpu_temp":40}}'
    data = [(ok, 0, 1), ("{oops", 0, 2), (ok.replace('"system"', '"other"'), 0, 3)]
    df = spark.createDataFrame(data, "value string, kafka_partition int, kafka_offset long")
    flat = {r["kafka_offset"]: r for r in readers.flatten_events(df).collect()}
    assert flat[1]["problem"] is None and flat[1]["distance_cm"] == 1.5 and flat[1]["mode"] is None
    assert flat[3]["problem"] == "missing system" and flat[2]["problem"] is not None
    assert readers.flatten_events(df, on_missing="drop").count() == 1


def test_frames_equal_pandas():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, 2))
    values[[30, 200], 0], values[90, 1] = (np.nan, np.inf), np.nan
    ends = np.arange(9, 400, 3)
    std, mean = jobs._frames(values, ends, 10)
    rolled = pd.DataFrame(values).rolling(10, min_periods=10)
    np.testing.assert_allclose(std, rolled.std().to_numpy()[ends], atol=1e-9)
    np.testing.assert_allclose(mean, rolled.mean().to_numpy()[ends], atol=1e-9)


def test_sessions_share_states(spark):
    """The states, and so the calls of a micro-batch, do not grow with the sessions; missing keys are a session too."""
    data = [(None if i % 40 == 7 else i % 40, None if i % 3 == 0 else "s", i, i * 20, float(i * 7 % 11)) for i in range(1_600)]
    df = spark.createDataFrame(data, "device long, session string, off long, s long, x double")
    df = df.withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    out = work_dir(spark, "shared")
    made = jobs.rolling_features(feed(spark, df, "off", 3), keys=["device", "session"], order=["at", "off"], cols=["x"], buckets=5)
    run(jobs.write_files(made, f"{out}/rows", f"{out}/c"))
    want = rolling_stats(df, keys=["device", "session"], order=["at", "off"], cols=["x"])
    cols = ["device", "session", "off", *[F.round(c, 6) for c in ("x_std", "x_mean", "texture_score")]]
    assert rows(spark.read.parquet(f"{out}/rows"), *cols) == rows(want, *cols)
    assert spark.read.format("statestore").load(f"{out}/c").count() <= 5
