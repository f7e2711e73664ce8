"""The pipeline against a brute-force version, stage by stage, and on odd tables."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import check_packing, dedup_brute, groups_brute, hits_brute, simhash_brute

import corpus_pipeline as cp
from lodeline.llm import language_id

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_brute(rows, model):
    head, *cents = model
    idf, kept = np.frombuffer(head["idf"]), []
    for r in rows:
        counts = language_id.ngram_counts(r[1])
        if counts is None:
            continue
        v = language_id.unit_vector(counts, idf).astype(np.float32)
        cos = [float(v @ np.frombuffer(c["mean"], np.float32)) for c in cents]
        best = int(np.argmax(cos))
        if cos[best] >= cents[best]["limit"]:
            kept.append(r)
    return kept


def stages_brute(rows, bench, model):
    rows = known_brute(rows, model)
    yield rows
    text = {i: t for i, _, _, t in dedup_brute(rows)}
    rows = [(i, text[i], lang, source, len(text[i])) for i, _, lang, source, _ in rows]
    yield rows
    fps = {r[0]: simhash_brute(r[1]) for r in rows}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = groups_brute(fps, near)
    rows = [r for r in rows if root[r[0]] == r[0]]
    yield rows
    clean = {i for i, _, hit, _ in hits_brute(rows, bench) if not hit}
    yield [r for r in rows if r[0] in clean]


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = list(stages_brute(rows, bench, language_id.fit(docs)))
    sizes = [len(rows)]
    for (_, stage), expected in zip(cp.STAGES, want):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == COLUMNS
        assert sorted(map(tuple, docs.collect())) == sorted(expected)
        sizes.append(len(expected))
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > sizes[4] > 0
    packed = cp.run(spark, SF).collect()
    n, tokens = check_packing(want[-1], packed)
    assert n <= tokens / 2048 * 1.02 + 1


def test_stage_names_and_sql():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    assert cp.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "word word", "en", None, 9)]])
def test_odd_tables(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
    assert all(r.text for r in docs.collect()) or not rows
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] >= 0
