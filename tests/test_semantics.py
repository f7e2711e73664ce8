"""Golden rows written by hand, and both sides of every rule that must not depend on size."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.functions.rubrics import rubric_score
from lodeline.operators import asof, corpus, graph, online_text
from lodeline.operators import context as ctx
from lodeline.operators.records import validate_plans
from lodeline.sources import writers
from lodeline.streaming import jobs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rubric_goldens_with_white_space(spark):
    five = "\n".join(f"\t{i}. item" for i in range(1, 6))
    wordy = "\n".join(f"{i}. an item that goes on for far more than thirty characters" for i in range(1, 6))
    cases = [("I5", "Yes\n", 3), ("I5", " no!\t", 3), ("I5", "maybe", 0), ("I5", "yes, but", 0), ("I1", five, 3), ("I1", wordy, 2),
             ("I1", "1. a\n2. b\n3. c", 1), ("I1", "none", 0), ("??", "x", 1)]
    df = spark.createDataFrame(cases, "prompt string, text string, want int")
    bad = df.withColumn("got", rubric_score(F.col("prompt"), F.col("text"))).where("got <> want").collect()
    assert not bad


def test_strip_and_paths(spark):
    blanks = " \t\n\r\f\v\x1c\x85  　"
    assert spark.range(1).select(tx.strip(F.lit(f"{blanks}a b{blanks}"))).first()[0] == "a b"
    df = spark.createDataFrame([(["\t./a.py\n", "a.py", " ", " b\\c/ "],)], "p array<string>")
    assert df.select(tx.clean_path_list(F.col("p"))).first()[0] == ["a.py", "b/c"]


def test_blank_plan_steps_are_not_described(spark):
    plan = '{"Implementation approach": "%s", "File list": ["a.py\\n"], "Data structures and interfaces": {"a.py": "%s"}, "Program call flow": ["%s"], "Task list": []}'
    good = plan % ("A long enough approach.", "class A", "run")
    data = [(good,), (plan % ("\\t" * 30, "class A", "run"),), (plan % ("A long enough approach.", "\\n\\t", "run"),),
            (plan % ("A long enough approach.", "class A", "\\t"),)]
    got = [r["reason"] for r in validate_plans(spark.createDataFrame(data, "r string"), "r").collect()]
    assert got[0] is None and all(got[1:])


def test_numbers_are_no_names_or_steps(spark):
    plan = '{"Implementation approach": "A long enough approach.", "File list": %s, "Data structures and interfaces": {"a.py": "class A", "5": "x"}, "Program call flow": %s, "Task list": %s}'
    data = [(0, plan % ('["a.py"]', '["run"]', "[]")), (1, plan % ("[5]", '["run"]', "[]")), (2, plan % ('["a.py"]', "[7]", "[]")),
            (3, plan % ('["a.py", 5, null, {"x": 1}]', '["run"]', '[3, "a.py"]')), (4, plan % ('["a.py"]', '["run", 2]', "[]"))]
    made = {r["id"]: r for r in validate_plans(spark.createDataFrame(data, "id int, r string"), "r").collect()}
    assert made[0]["reason"] is None and made[0]["tasks"] == ["a.py"]
    assert made[1]["reason"] == "File list must contain at least one filename"
    assert made[2]["reason"] == made[4]["reason"] == "Program call flow must be a list of non-empty strings"
    assert made[3]["reason"] is None and made[3]["files"] == made[3]["tasks"] == ["a.py"]


def memory_rows(spark):
    data = [(1, "fact", "k", 0.9, 1), (2, "fact", "k", 0.5, 2), (3, "fact", None, 0.9, 1), (4, "fact", None, 0.2, 2), (5, None, "k", 0.3, 3),
            (6, None, None, 0.8, 4)]
    df = spark.createDataFrame(data, "id long, type string, key string, confidence double, s long")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_items_without_a_key_never_conflict(spark):
    made = ctx.memory_upsert(memory_rows(spark))
    assert rows(made, "id", "state", "version", "confidence") == [
        (1, "current", 1, 0.9), (2, "kept", 1, 0.5), (3, "current", 1, 0.9), (4, "current", 1, 0.2), (5, "current", 1, 0.3), (6, "current", 1, 0.8)
    ]


def test_streamed_items_without_a_key_never_conflict(spark):
    from lodeline.session import work_dir

    src, out = work_dir(spark, "null-keys"), work_dir(spark, "null-keys-out")
    df = memory_rows(spark)
    df.coalesce(1).write.parquet(src)
    made = jobs.memory_upserts(spark.readStream.schema(df.schema).parquet(src))
    jobs.write_files(made, f"{out}/rows", f"{out}/c").awaitTermination()
    got = rows(spark.read.schema(made.schema).parquet(f"{out}/rows"), "id", "won", "version")
    assert got == [(1, True, 1), (2, False, 1), (3, True, 1), (4, True, 1), (5, True, 1), (6, True, 1)]


def routed(spark, vecs, schema, requests):
    items = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "id long, text string, embedding array<double>"
    ).withColumns(
        {"type": F.lit("fact"), "roles": F.array().cast("array<string>"), "stages": F.array().cast("array<string>"),
         "ts": F.lit("2024-01-01").cast("timestamp"), "confidence": F.lit(0.0), "tokens": F.lit(1)}
    )
    made = ctx.route_context(
        items, as_of=F.lit("2024-01-01").cast("timestamp"), requests=requests, query_vecs=spark.createDataFrame(vecs, schema)
    )
    return {(r["role"], r["stage"], r["id"]): round(r["importance"], 6) for r in made.collect()}


def test_every_request_gets_its_own_query(spark):
    # More vectors than requests, the wanted one last.
    many = [(f"r{i}", [1.0, 0.0]) for i in range(9)] + [("me", [0.0, 1.0])]
    got = routed(spark, many, "role string, query_vec array<double>", [("me", "x", 10)])
    assert got == {("me", "x", 1): 0.3, ("me", "x", 2): 1.3}
    staged = [("me", "x", [1.0, 0.0]), ("me", None, [0.0, 1.0])]
    got = routed(spark, staged, "role string, stage string, query_vec array<double>", [("me", "x", 10), ("me", "y", 10)])
    assert got == {("me", "x", 1): 1.3, ("me", "x", 2): 0.3, ("me", "y", 1): 0.3, ("me", "y", 2): 1.3}
    with pytest.raises(ValueError, match="more than one"):
        routed(spark, [("me", [1.0, 0.0])] * 2, "role string, query_vec array<double>", [("me", "x", 10)])


def test_exact_selection_of_a_large_group(spark):
    data = [("g", i, 1.0 + (i % 7) / 10, 3 + i % 5, 60) for i in range(45)]
    df = spark.createDataFrame(data, "g string, id long, s double, t long, b long")
    made = ctx.exact_budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b").collect()
    best = [0.0] * 61
    for _, _, s, t, _ in data:
        for b in range(60, t - 1, -1):
            best[b] = max(best[b], best[b - t] + s)
    assert sum(r["s"] for r in made) == pytest.approx(best[60]) and sum(r["t"] for r in made) <= 60
    with pytest.raises(Exception, match="states"):
        ctx.exact_budget_select(df, group=["g"], score="s", id="id", tokens="t", budget="b", max_states=100).collect()


def test_std_of_large_values_is_the_same_in_both_plans(spark):
    start = datetime(2024, 1, 1)
    data = [(i, "a" if i % 2 else "b", start + timedelta(hours=i), 1e9 * (i % 2 + 1) + (i * 7 % 5) / 2) for i in range(300)]
    df = spark.createDataFrame(data, "id long, p string, at timestamp, v double")
    both = [
        {r["id"]: (r["p__STD__v"], r["p__MEAN__v"], r["p__SUM__v"]) for r in asof.asof_aggregates(
            df, ts="at", parents=["p"], cols=["v"], aggs=("std", "mean", "sum"), window="3d", sliding_limit=n).collect()}
        for n in (10**9, 0)
    ]
    for i, (std, mean, total) in both[0].items():
        other = both[1][i]
        assert (std is None) == (other[0] is None)
        assert std is None or other[0] == pytest.approx(std, abs=1e-6)
        assert other[1] == pytest.approx(mean, rel=1e-12) and other[2] == pytest.approx(total, rel=1e-12)


def test_nothing_is_cut_by_default(spark):
    docs = spark.createDataFrame([(1, "hit\n" * 300), (2, "x" * 1_000_001 + " hit")], "doc_id long, text string")
    assert corpus.corpus_grep(docs, query="hit").count() == 301
    assert corpus.corpus_grep(docs, query="hit", max_matches=5, max_chars=10**6).count() == 5
    assert corpus.line_range(docs, start=1, end=10**6).count() == 302
    items = spark.createDataFrame([("g", i, float(-i), 1, 100) for i in range(90)], "g string, id long, s double, t long, b long")
    assert ctx.budget_select(items, group=["g"], score="s", id="id", tokens="t", budget="b").count() == 90


def test_batch_naive_bayes_uses_every_word(spark):
    train = [(i, f"only{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(train, "doc_id long, text string, y int")
    made = online_text.batch_naive_bayes(df, df, order="doc_id", text="text", label="y", keep=["doc_id", "y"])
    assert made.where("batch_pred <> y").count() == 0
    one = spark.createDataFrame([(1, "never seen", 0)], "doc_id long, text string, y int")
    got = online_text.batch_naive_bayes(df, one, order="doc_id", text="text", label="y", keep=["doc_id"]).first()
    assert got["batch_confidence"] == pytest.approx(0.5)


def test_crawl_stays_on_its_host(spark):
    page = lambda i, url, links: (i, url, "".join(f'<a href="{x}">x</a>' for x in links))
    data = [page(1, "http://a.com/1", ["/x"]), page(2, "http://a.com/2", ["/x", "/y"]), page(3, "http://b.com/3", ["/x"]), page(4, "http://a.com/4", ["/y"])]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert rows(graph.bounded_crawl(df, seed=1), "page_id", "depth") == [(1, 0), (2, 1), (4, 2)]
    assert rows(graph.bounded_crawl(df, seed=1, same_host=False), "page_id") == [(1,), (2,), (3,), (4,)]


def test_upsert_keeps_keys_unique(spark):
    target = spark.createDataFrame([(1, 1, "old"), (2, 1, "stays")], "k long, off long, v string")
    batch = spark.createDataFrame([(1, 2, "mid"), (1, 3, "new"), (3, 1, "first"), (3, 0, "stale")], "k long, off long, v string")
    made = writers.incremental_upsert(target, batch, keys=["k"], order=["off"], above=F.col("off") > 0)
    assert rows(made) == [(1, 3, "new"), (2, 1, "stays"), (3, 1, "first")]
    with pytest.raises(Exception, match="more than once"):
        writers.incremental_upsert(target, batch, keys=["k"]).collect()


def test_workers_get_the_package_from_any_folder():
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['memory_upsert_versions'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as cwd:
        out = subprocess.run([sys.executable, "-c", code, ROOT], cwd=cwd, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 200" in out.stdout, out.stderr[-800:]
