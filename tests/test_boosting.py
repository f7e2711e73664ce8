"""Boosted trees against a plain version, their patience, and missing values."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodeline.operators import boosting


def plain(x, y, rounds, rate, depth, penalty=1.0):
    """The same trees without bins: every midpoint is tried, recursively."""
    base = y.mean()
    pred = np.full(len(y), base)

    def grow(rows, level, g):
        if level == depth or not len(rows):
            return -rate * g[rows].sum() / (len(rows) + penalty)
        best = (1e-12, None)
        score = lambda r: g[r].sum() ** 2 / (len(r) + penalty)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                gain = score(left) + score(right) - score(rows)
                if gain > best[0]:
                    best = (gain, (f, cut))
        if best[1] is None:
            return -rate * g[rows].sum() / (len(rows) + penalty)
        f, cut = best[1]
        return (f, cut, grow(rows[x[rows, f] <= cut], level + 1, g), grow(rows[x[rows, f] > cut], level + 1, g))

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 0, pred - y)
        pred = pred + np.array([value(tree, r) for r in x])
    return pred


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b = rng.randint(0, 20), rng.randint(0, 9)
        rows.append((i, float(a), float(b), 3.0 * a - (b > 4) * 10 + rng.random(), i % 4 == 0))
    return spark.createDataFrame(rows, "id long, a double, b double, y double, v boolean").repartition(3)


def test_equals_plain_boosting(data, monkeypatch):
    monkeypatch.setattr(boosting, "STAGE", 3)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 90)
    train = data.where("not v")
    model = boosting.fit(train, target="y", features=["a", "b"], valid="v", rounds=8, rate=0.3, depth=3)
    rows = model.transform(train).orderBy("id").collect()
    want = plain(np.array([(r["a"], r["b"]) for r in rows]), np.array([r["y"] for r in rows]), 8, 0.3, 3)
    assert model.n_rounds == 8
    assert np.allclose([r["prediction"] for r in rows], want)


def test_patience(data, spark, tmp_path):
    model = boosting.fit(data, target="y", features=["a", "b"], valid="v", rounds=200, rate=0.5, depth=2, patience=7)
    best = int(np.argmin(model.losses))
    assert model.n_rounds == best + 1 and len(model.losses) == best + 1 + 7 and model.best_loss == min(model.losses)
    held = model.transform(data.where("v")).collect()
    assert np.sqrt(np.mean([(r["prediction"] - r["y"]) ** 2 for r in held])) == pytest.approx(model.best_loss)
    model.save(str(tmp_path / "m"), spark)
    again = boosting.BoostedTrees.load(str(tmp_path / "m"), spark)
    assert [tuple(r) for r in again.transform(data.where("v")).orderBy("id").collect()] == [tuple(r) for r in sorted(held)]


def test_missing_values_and_flat_data(spark):
    df = spark.createDataFrame([(None, 1.0, False), (5.0, 9.0, False), (float("nan"), 1.0, False), (6.0, None, False), (4.0, 9.0, False)], "a double, y double, v boolean")
    model = boosting.fit(df, target="y", features=["a"], valid="v", rounds=60, rate=0.5, depth=1)
    got = {(r["a"] is None or r["a"] != r["a"]): r["prediction"] for r in model.transform(df).collect()}
    assert got[True] == pytest.approx(1, abs=0.1) and got[False] == pytest.approx(9, abs=0.1)
    flat = boosting.fit(df.where("a > 1 and y > 1"), target="y", features=["a"], valid="v", rounds=3, depth=2)
    assert {r["prediction"] for r in flat.transform(df).collect()} == {9.0}
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0), target="y", features=["a"], valid="v")
