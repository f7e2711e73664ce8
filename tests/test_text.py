from __future__ import annotations

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.operators import clean, conversations, corpus, graph, records

DOCS = [(1, "The quick brown fox\njumps over it"), (2, "A foxy approach, an approach"), (3, ""), (4, "xx brown  fox"), (5, None)]
TERMS = ["fox", "quick brown fox", "brown", "approach", "n fox", "x", "a", "brown  fox", "it", "fox\njumps over", "Fox", "oxy app"]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_contained_terms_equal_brute_force(spark, monkeypatch, ignore_case, few):
    monkeypatch.setattr(corpus, "MAX_SENT_TERMS", 10**6 if few else 0)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "term_id long, term string")
    norm = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    want = [
        (d, i, norm(text).index(norm(t)) + 1)
        for d, text in DOCS
        if text
        for i, t in enumerate(TERMS)
        if norm(t) in norm(text)
    ]
    got = corpus.contained_terms(docs, terms, case_insensitive=ignore_case)
    assert rows(got, "doc_id", "term_id", "position") == sorted(want, key=repr)


def test_whole_words(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    terms = spark.createDataFrame([(1, "fox")], "term_id long, term string")
    assert rows(corpus.contained_terms(docs, terms, whole_words=True), "doc_id") == [(1,), (4,)]


def test_needles_keep_absent_ones(spark):
    docs = spark.createDataFrame([(1, "a" * 80 + " needle one here " + "b" * 80)], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "needle one here"), (2, "not in any text")], "n long, s string")
    got = corpus.needle_presence(docs, needles, needle_id="n", needle="s")
    found = {r["n"]: r for r in got.collect()}
    assert found[1]["position"] == 82 and len(found[1]["context"]) == 60 + 15 + 60
    assert found[2]["present"] is False


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_main_text(spark):
    html = (
        "<html><head><title>t</title></head><body><script>var a='<p>';</script><nav>menu</nav><!-- note -->"
        "<h1>Head &amp; more</h1><p>One<br>two &lt;b&gt;</p><style>p{}</style></body></html>"
    )
    assert one(spark, tx.main_text(F.lit(html))) == "Head & more\nOne\ntwo <b>"


def test_strip_tags_prefers_markdown(spark):
    assert one(spark, tx.strip_tags(F.lit(" "), F.lit("<p>a</p><b>b</b>"))) == "a b"
    assert one(spark, tx.strip_tags(F.lit("md"), F.lit("<p>a</p>"))) == "md"


@pytest.mark.parametrize(
    "given,want",
    [("plain", "plain"), ('[{"text":"a"},{"content":"b"},{"k":"v"}]', 'a\nb\n{"k":"v"}'), ("[not json", "[not json")],
)
def test_flatten_parts(spark, given, want):
    assert one(spark, tx.flatten_parts(F.lit(given))) == want


def test_paths(spark):
    col = F.array(*[F.lit(p) for p in (" ./a/b/ ", "a\\b", "", "c/", "c")])
    assert one(spark, tx.clean_path_list(col)) == ["a/b", "c"]


def test_termination_and_tokens(spark):
    assert one(spark, tx.termination_flag(F.lit("ok, TERMINATE now"))) is True
    assert one(spark, tx.termination_flag(F.lit("go on"))) is False
    assert [one(spark, tx.token_estimate(F.lit("a b c"), m)) for m in ("chars", "words_up", "words_down")] == [1, 3, 2]


def test_extract_items(spark):
    data = [
        (1, 'x {"decisions":[{"text":"d","confidence":0.9,"roles":["r"]}],"tool_traces":[{"k":1}]} y'),
        (2, '{"decisions": ['),
        (3, '{"facts":[]}'),
        (4, '{"facts":[{"text":"f","confidence":"high"}]}'),
        (5, " prose "),
    ]
    made = records.extract_items(spark.createDataFrame(data, "id long, reply string"), text="reply", roles=["p"])
    assert rows(made, "id", "type", "text", "confidence") == [
        (1, "decision", "d", 0.9),
        (1, "tool_trace", '{"k":"1"}', 0.7),
        (2, "fact", '{"decisions": [', 0.6),
        (3, "fact", '{"facts":[]}', 0.6),
        (4, "fact", data[3][1], 0.6),
        (5, "fact", "prose", 0.6),
    ]
    assert {r["id"]: r["roles"] for r in made.filter("type = 'decision'").collect()} == {1: ["p", "r"]}


def test_first_failing_reason(spark):
    ok = (
        '{"Implementation approach":"a long enough description","File list":["./a.py"],"Task list":[],'
        '"Data structures and interfaces":{"a.py":"main"},"Program call flow":["x"]}'
    )
    data = [(1, ok), (2, "oops"), (3, ok.replace('"./a.py"', '""')), (4, ok.replace('{"a.py"', '{"b.py"'))]
    made = records.validate_plans(spark.createDataFrame(data, "id long, r string"), "r")
    reasons = {r["id"]: r["reason"] for r in made.collect()}
    assert reasons[1] is None and reasons[2] == "not a JSON object"
    assert "at least one filename" in reasons[3] and "every file" in reasons[4]
    assert made.filter("id = 1").first()["tasks"] == ["a.py"]


def test_prompt_parts_join_to_the_whole(spark):
    data = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(7)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    whole = conversations.render_chat_template(df).first()["prompt"]
    parts = conversations.render_chat_template(df, part_messages=3).orderBy("part").collect()
    assert len(parts) == 3 and "".join(p["prompt"] for p in parts) == whole
    assert whole.endswith("Assistant: ") and whole.startswith("Assistant: m0\nHuman: m1\n")


def test_stages_advance_once_their_role_spoke(spark):
    data = [(1, t, r) for t, r in enumerate(["coder", "planner", "reviewer", "coder", "planner"])]
    df = spark.createDataFrame(data, "c long, t int, role string")
    got = conversations.stage_progression(df, conv="c", order="t", role="role")
    assert [r["stage"] for r in got.orderBy("t").collect()] == ["plan", "plan", "execute", "execute", "review"]


def test_bfs_levels_and_hosts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs(edges, seeds)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    hosts = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "x"), ("d", "h")], "node string, host string")
    assert rows(graph.bfs(edges, seeds, hosts=hosts, same_host=True)) == [("a", 0), ("b", 1)]


def test_graph_tables(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob and Bob\nAnn met Bob"), (2, "nobody")], "doc_id long, text string")
    nodes, edges = graph.build_graph_tables(graph.neighbor_triples(docs))
    assert rows(edges, "source", "target", "weight") == [("Ann", "Bob", 2)]
    assert rows(nodes, "id", "mentions") == [("Ann", 2), ("Bob", 2)]
    sub_nodes, sub_edges = graph.query_subgraph(nodes, edges, docs.filter("doc_id = 1"))
    assert sub_nodes.count() == 2 and sub_edges.count() == 1


def test_change_log_replay(spark):
    log = spark.createDataFrame(
        [(1, 1, "update", "a", None), (1, 2, "update", None, "x"), (2, 1, "update", "b", "y"), (2, 2, "delete", None, None), (3, 1, "delete", None, None), (3, 2, "update", None, "z")],
        "id long, at int, op string, v string, s string",
    )
    assert rows(clean.partial_update(log, key="id", order=["at"], cols=["v", "s"]), "id", "v", "s") == [(1, "a", "x"), (3, None, "z")]
    with pytest.raises(ValueError):
        clean.scoped_delete(log, log, scope=[])


def test_encode_unseen_is_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    assert rows(clean.label_encode(df, "x", classes=df.filter("x <> 'c'"))) == [("a", 0), ("b", 1), ("c", None)]


@pytest.mark.parametrize("whole", [False, True])
def test_mentioned_terms_equal_brute_force(spark, whole):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aAé-.b_") for _ in range(rnd.randint(1, 6)))
    long_word = "x" * 30 + "yz" * 5
    texts = [rnd.choice(" \n\t").join(word() for _ in range(rnd.randint(0, 9))) for _ in range(60)] + [None, "", f"({long_word}) end"]
    made = {word() for _ in range(150)} | {word() + " " + word() for _ in range(40)} | {long_word, long_word[1:], "q" * 40}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = spark.createDataFrame(list(enumerate(sorted(made))), "term_id long, term string")
    edge = r"(^|[^a-zA-Z0-9_]){}([^a-zA-Z0-9_]|$)" if whole else "{}"
    want = [(i,) for i, t in enumerate(sorted(made)) if any(re.search(edge.format(re.escape(t)), x or "") for x in texts)]
    assert rows(corpus.mentioned_terms(docs, terms, whole_words=whole)) == sorted(want, key=repr)


def test_subgraph_reads_words_once(spark):
    """The texts meet the terms by their words: no plan of the search joins texts with candidates."""
    docs = spark.createDataFrame([(i, f"Anna Berta{i % 7} Carl") for i in range(50)], "doc_id long, text string")
    nodes, _ = graph.build_graph_tables(graph.neighbor_triples(docs))
    terms = nodes.select(F.col("id").alias("term_id"), F.col("id").alias("term"))
    plan = corpus.mentioned_terms(docs, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan.lower()
