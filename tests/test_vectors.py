"""Vectors are scored a slice at a time and texts are dealt to all cores; results stay the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from lodeline.operators import vectors as vec


def _held(monkeypatch):
    seen, matrix = [], vec._matrix
    monkeypatch.setattr(vec, "_matrix", lambda column: seen.append(len(column)) or matrix(column))
    return seen


@pytest.mark.parametrize("scoped", [False, True])
def test_best_rows_of_slices(monkeypatch, scoped):
    monkeypatch.setattr(vec, "ROW_SLICE", 7)
    seen = _held(monkeypatch)
    rnd = np.random.default_rng(4)
    m = rnd.integers(-2, 3, (60, 3)).astype("float32")  # many ties
    ids, q = rnd.permutation(60), m[:9]
    scopes, q_scopes = (ids % 3, np.arange(9) % 3) if scoped else (None, None)
    q_unit = vec._unit(q.astype("float64"))
    got = vec._best(pd.Series(ids), scopes, pd.Series(list(m)), list(range(9)), q_scopes, q_unit, 5)
    assert max(seen) <= 7 and sum(seen) == 60
    sims = np.round(q_unit @ vec._unit(m.astype("float64")).T, vec.SIM_DIGITS)
    for i in range(9):
        of = [(-s, d) for s, d, j in zip(sims[i], ids, range(60)) if not scoped or d % 3 == i % 3]
        mine = got[got["query"] == i]
        assert list(zip(-mine["sim"], mine["id"])) == sorted(of)[:5]


def test_texts_are_embedded_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(vec, "TASK_TEXTS", 10)
    texts = spark.createDataFrame([(i, f"a w{i % 7} w{i % 5}") for i in range(200)] + [(200, ""), (201, None)], "id long, text string").coalesce(1)
    texts = texts.fillna("", ["text"])
    made = vec.embed_documents(texts)
    cores = spark.sparkContext.defaultParallelism
    assert made.rdd.getNumPartitions() == cores * -(-202 // (10 * cores))
    assert rows(made, "id") == sorted([(i,) for i in range(202)], key=repr)


def test_labels_of_slices(spark):
    df = spark.createDataFrame([(i, "t", [float(i), 1.0]) for i in range(1200)], "id long, text string, embedding array<float>").coalesce(1)
    protos = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, embedding array<float>")
    got = {r["id"]: r["labels"] for r in vec.zero_shot_multilabel(df, protos, id="id").collect()}
    assert len(got) == 1200 and got[0][0]["label"] == "y" and got[1199][0]["label"] == "x"
