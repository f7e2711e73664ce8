"""The forest against a plain version that goes row by row, and what it keeps per row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodeline.operators import forest


def _rows(spark, n=700):
    df = spark.range(n).select(
        "id", *[((F.xxhash64("id", F.lit(i)) % 97) / 7.0).alias(f"f{i}") for i in range(4)], (F.col("id") % 3).cast("double").alias("f4")
    )
    return df.withColumn("y", (F.col("f0") + F.col("f1") + F.pmod(F.xxhash64("id"), F.lit(9)) > 4).cast("int"))


FEATURES = [f"f{i}" for i in range(5)]


def _plain(x, y, w, drawn, level, at, depth):
    """(feature, bin) of the inner nodes below and (lowest node, share) of the rows with weights ``w``, by trying every split."""

    def impure(k):
        n, p = w[k].sum(), (w * y)[k].sum()
        return n - (p * p + (n - p) ** 2) / n if n else 0.0

    share = (w * y).sum() / w.sum() if w.sum() else 0.0
    if level == depth:
        return {}, {at: share}
    best = (1e-9, None)
    for f in drawn[level][at]:
        for b in range(31):
            k = x[:, f] <= b
            if w[k].sum() and w[~k].sum():
                gain = impure(w > 0) - impure(k) - impure(~k)
                if gain > best[0] + 1e-9:
                    best = (gain, (int(f), b))
    if best[1] is None:
        low, leaf = _plain(x, y, w, drawn, level + 1, 2 * at, depth) if level + 1 < depth else ({}, {2 * at: share})
        return {(level, at): (0, 255), **low}, leaf
    k = x[:, best[1][0]] <= best[1][1]
    nodes, leaves = {(level, at): best[1]}, {}
    for side, here in ((0, k), (1, ~k)):
        more = _plain(x[here], y[here], w[here], drawn, level + 1, 2 * at + side, depth)
        nodes |= more[0]
        leaves |= more[1]
    return nodes, leaves


def test_trees_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_BLOCK", 60)
    kept, blocks = [], forest._blocks

    def spy(*args):
        kept.append(blocks(*args))
        return kept[0]

    monkeypatch.setattr(forest, "_blocks", spy)
    made, cuts = forest.fit(_rows(spark), features=FEATURES, label="y", trees=6, depth=3, seed=5)
    parts = kept[0].collect()
    assert len(parts) > 4 and sum(len(p["x"]) + len(p["y"]) for p in parts) == 700 * 6  # a byte per value, nothing per tree
    x = np.concatenate([np.frombuffer(p["x"], np.uint8).reshape(-1, 5) for p in parts])
    y = np.concatenate([np.frombuffer(p["y"], np.uint8) for p in parts]).astype(float)
    assert np.array_equal(np.sort(x[:, 4]), np.sort(forest._binned([np.arange(700) % 3.0], cuts[4:])[:, 0]))
    for t in range(6):
        w = np.concatenate([forest._weights(5, p["block"], t, len(p["y"])) for p in parts]).astype(float)
        drawn = [forest.drawn_features(5, t, level, 5, 3) for level in range(3)]
        nodes, leaves = _plain(x, y, w, drawn, 0, 0, 3)
        for (level, at), (f, b) in nodes.items():
            inner = (1 << level) - 1 + at
            assert (made.feature[t, inner], made.bin[t, inner]) == (f, b)
        for at, share in leaves.items():
            assert abs(made.share[t, at] - share) < 1e-12


def test_scores_and_missing_values(spark):
    df = _rows(spark).withColumn("f1", F.when(F.col("id") % 5 > 0, F.col("f1"))).withColumn("y", (F.col("f0") > 2).cast("int"))
    model = forest.BinaryForest(features=FEATURES, label="y", trees=20).fit(df)
    mean = {r["y"]: r["s"] for r in model.transform(df).groupBy("y").agg(F.avg("score").alias("s")).collect()}
    assert 0 <= mean[0] < 0.3 and 0.7 < mean[1] <= 1


def test_one_class_and_one_row(spark):
    one = _rows(spark).withColumn("y", F.lit(1))
    scored = forest.BinaryForest(features=FEATURES, label="y", trees=3).fit(one).transform(one)
    assert scored.agg(F.min("score")).first()[0] == 1.0
    forest.BinaryForest(features=FEATURES, label="y", trees=3).fit(one.limit(1)).transform(one).count()


def test_draws_are_poisson():
    counts = np.bincount(forest.DRAWS, minlength=4) / 65_536
    assert np.allclose(counts[:4], np.exp(-1) / np.array([1, 1, 2, 6]), atol=2e-5)
    assert abs((forest.DRAWS.astype(float)).mean() - 1) < 1e-3
