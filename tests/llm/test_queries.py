"""The registered queries without SQL, over whole small tables, against brute force."""

from __future__ import annotations

import itertools
import zlib

import pytest
from test_documents import check_packing, groups_brute, simhash_brute
from test_pages_and_vectors import brute_article

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_every_number_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_op2(spark, docs):
    fps = {i: simhash_brute(t) for i, t, _ in docs}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = groups_brute(fps, near)
    got = sorted(tuple(r) for r in run(spark, "op2_simhash").select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((i, f"{fps[i]:016x}", root[i]) for i in fps)


def test_op3(spark, docs):
    got = run(spark, "op3_lattice_lm")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(docs)
    for i, t, _ in docs:
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) and r["n_tokens"] == len((t or "").encode().split()) + 1
        assert r["score"] < 0 and (r["held_out"] or r["n_known"] == r["n_tokens"])
    assert {r["train_tokens"] for r in rows.values()} == {sum(r["n_tokens"] for r in rows.values() if not r["held_out"])}


def test_op5(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = run(spark, "op5_html_text").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == brute_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_op8(spark, docs):
    n, tokens = check_packing(docs, run(spark, "op8_best_fit_packing").collect())
    assert n <= tokens / 2048 * 1.02 + 1


def test_op10(spark, docs):
    lang = {i: x for i, _, x in docs}
    rows = run(spark, "op10_language_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
