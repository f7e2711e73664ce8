"""The stored inverted file: exact with all cells, recall with some, appended vectors, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.operators import vector_index
from lodeline.operators.vector_index import VectorIndex

RNG = np.random.default_rng(4)
CENTERS = RNG.normal(size=(12, 8))
VECTORS = (CENTERS[RNG.integers(0, 12, 600)] + 0.4 * RNG.normal(size=(600, 8))).astype("float32")


def frame(spark, ids):
    return spark.createDataFrame([(int(i), VECTORS[i].tolist()) for i in ids], "id long, embedding array<float>").repartition(3)


def brute(ids, asked, k):
    unit = VECTORS.astype(float) / np.linalg.norm(VECTORS.astype(float), axis=1, keepdims=True)
    out = []
    for q in asked:
        sims = np.round(unit[ids] @ unit[q], 9)
        best = sorted(zip(-sims, ids))[:k]
        out += [(int(q), int(i), float(-s), r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_rows", [50_000, 7])
def test_index(spark, tmp_path, monkeypatch, cell_rows):
    monkeypatch.setattr(vector_index, "CELL_ROWS", cell_rows)
    first, later, asked = range(500), range(500, 600), range(0, 600, 7)
    index = VectorIndex.build(frame(spark, first), str(tmp_path / "ix"), cells=20)
    queries = frame(spark, asked).withColumnRenamed("id", "query")
    exact = index.search(queries, k=5, probes=99)
    assert rows(exact, "query", "id", "sim", "rank") == brute(list(first), asked, 5)
    again = VectorIndex(spark, str(tmp_path / "ix"))
    again.add(frame(spark, later))
    want = brute(list(range(600)), asked, 5)
    assert rows(again.search(queries, k=5, probes=99), "query", "id", "sim", "rank") == want
    some = {(q, i) for q, i, *_ in rows(again.search(queries, k=5, probes=4), "query", "id", "sim", "rank")}
    assert len(some & {(q, i) for q, i, *_ in want}) >= 0.9 * len(want)
    probes = again.probes_for(k=5, recall=0.9)
    assert 1 <= probes < 20
    some = {(q, i) for q, i, *_ in rows(again.search(queries, k=5, probes=probes), "query", "id", "sim", "rank")}
    assert len(some & {(q, i) for q, i, *_ in want}) >= 0.85 * len(want)
    new = frame(spark, later).withColumnRenamed("id", "query")
    assert again.search(new, k=1, probes=1).where("query = id").count() == 100


def test_odd_vectors(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "ix"))
    found = index.search(df.withColumnRenamed("id", "query").withColumn("cell", F.lit("c")), k=5)
    assert rows(found, "query", "id", "sim") == [(q, i, 1.0) for q in (1, 6) for i in (1, 6)]
    assert index.search(df.limit(0).withColumnRenamed("id", "query"), k=5).count() == 0
