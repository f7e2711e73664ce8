from __future__ import annotations

import pyspark.ml
from pyspark.sql import functions as F

from lodeline.operators import ml


def _seen(monkeypatch):
    parts, fit = [], pyspark.ml.Pipeline.fit

    def spy(self, df, *args):
        parts.append(df.rdd.getNumPartitions())
        return fit(self, df, *args)

    monkeypatch.setattr(pyspark.ml.Pipeline, "fit", spy)
    return parts


def _rows(spark):
    df = spark.range(240).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    return df.withColumn("t", F.col("id")).coalesce(1)


def test_forests_of_the_report_use_all_cores(spark, monkeypatch):
    parts = _seen(monkeypatch)
    df = _rows(spark)
    made = ml.leakage_gap_report(df, df, honest_features=["a"], shortcut_features=["a"], key="id", order=["t"], label="y", n_splits=3, repeats=2, trees=3)
    rows = [(r["setting"], r["fold"]) for r in made.collect()]
    assert rows[:5] == [("honest", 0), ("honest", 1), ("honest", 2), ("shortcut", 0), ("shortcut", 1)] and len(rows) == 8
    assert len(parts) == 5 and min(parts) >= spark.sparkContext.defaultParallelism


def test_classifier_uses_all_cores(spark, monkeypatch):
    parts = _seen(monkeypatch)
    model = ml.rf_classifier(_rows(spark), features=["a"], label="y", trees=3)
    assert ml.batch_score(model, _rows(spark), keep=["id"]).count() == 240
    assert min(parts) >= spark.sparkContext.defaultParallelism


def test_forest_and_scores_take_equal_parts_for_all_cores(spark, monkeypatch):
    parts, cores = _seen(monkeypatch), spark.sparkContext.defaultParallelism
    many = _rows(spark).repartition(2 * cores - 1)
    model = ml.rf_classifier(many, features=["a"], label="y", trees=3)
    assert parts == [cores]
    monkeypatch.setattr(ml, "SCORE_ROWS", 20)
    scored = ml.batch_score(model, _rows(spark), keep=["id"])
    assert scored.rdd.getNumPartitions() == cores * -(-240 // (20 * cores)) and scored.count() == 240
