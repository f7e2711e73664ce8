"""Memory scoring and routing, turn logs, vectors and graphs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import MEM, TURN, memory, ntz, r6, table, turns
from lodeline.functions import vectors as vx
from lodeline.operators import context as ctx
from lodeline.operators import graph, reports
from lodeline.operators import vectors as vec
from lodeline.operators.vector_index import VectorIndex
from lodeline.session import work_dir

AS_OF = "2024-01-15"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def items(spark, sf):
    m = memory(spark, sf)
    return m.withColumns({"roles": F.array("role_tag"), "stages": F.array("stage_tag")})


def item_vectors(spark, sf):
    """Items with the embedding of the same id, where there is one."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return items(spark, sf).join(e, "id", "left")


def role_queries(spark, sf):
    """A query vector per role: the mean vector of one embedding label."""
    c = vec.centroids(table(spark, sf, "embeddings"), group="label", vector="embedding")
    role = F.when(F.col("label") == 0, "planner").when(F.col("label") == 1, "coder").when(F.col("label") == 2, "reviewer")
    return c.select(role.alias("role"), F.col("embedding").alias("query_vec")).filter(F.col("role").isNotNull())


CENTROIDS = """ex AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings),
cm AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY 1, 2),
cen AS (SELECT label, list(m ORDER BY i) AS q FROM cm GROUP BY 1)"""

RECENCY = f"exp(-0.1 * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3600000000.0))"


def _hits(role: str) -> str:
    cases = []
    for name, words in ctx.ROLE_KEYWORDS.items():
        found = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)
        cases.append(f"WHEN {role} = '{name}' THEN {found}")
    return f"CASE {' '.join(cases)} ELSE 0 END"


def _relevance(role: str) -> str:
    return f"CAST(role_tag = {role} AS INTEGER) + least(0.5, ({_hits(role)}) * CAST(0.1 AS DOUBLE))"


def _priority(stage: str) -> str:
    kinds = " OR ".join(
        f"({stage} = '{s}' AND type IN ({', '.join(repr(t) for t in types)}))" for s, types in ctx.STAGE_TYPES.items()
    )
    return f"CAST(CASE WHEN stage_tag = {stage} THEN 1.0 WHEN {kinds} THEN 0.5 ELSE 0.0 END AS DOUBLE)"


def _score(role: str, stage: str, sim: str = "0.0") -> str:
    return f"""round(CAST(0.6 AS DOUBLE) * ({_relevance(role)}) + CAST(0.4 AS DOUBLE) * ({_priority(stage)})
      + CAST(0.3 AS DOUBLE) * ({RECENCY}) + CAST({sim} AS DOUBLE)
      + CAST(CASE type WHEN 'decision' THEN 0.8 WHEN 'plan' THEN 0.4 ELSE 0.0 END AS DOUBLE)
      + CAST(0.1 AS DOUBLE) * confidence, 9)"""


@query("recency_decay", f"WITH {MEM} SELECT id, round({RECENCY}, 9) AS recency FROM mem")
def _(spark, sf):
    return memory(spark, sf).select("id", F.round(ctx.recency_decay(F.col("ts"), as_of()), 9).alias("recency"))


@query(
    "keyword_relevance",
    f"""WITH {MEM} SELECT id, role, round({_relevance("role")}, 6) AS relevance
        FROM mem, (SELECT unnest(['planner', 'coder', 'reviewer', 'searcher']) AS role)""",
)
def _(spark, sf):
    roles = F.explode(F.array(*[F.lit(r) for r in ctx.ROLE_KEYWORDS]))
    m = items(spark, sf).select("id", "text", "roles", roles.alias("role"))
    return m.select("id", "role", r6(ctx.keyword_relevance(F.col("text"), F.col("roles"), F.col("role"))).alias("relevance"))


@query(
    "stage_priority",
    f"""WITH {MEM} SELECT id, stage, {_priority("stage")} AS priority FROM mem,
        (SELECT unnest(['plan', 'execute', 'review']) AS stage)""",
)
def _(spark, sf):
    stages = F.explode(F.array(*[F.lit(s) for s in ctx.STAGE_TYPES]))
    m = items(spark, sf).select("id", "type", "stages", stages.alias("stage"))
    return m.select("id", "stage", ctx.stage_priority(F.col("stages"), F.col("type"), F.col("stage")).alias("priority"))


@query("importance_score", f"WITH {MEM} SELECT id, {_score(repr('planner'), repr('plan'))} AS importance FROM mem")
def _(spark, sf):
    made = ctx.importance(items(spark, sf), as_of=as_of(), role=F.lit("planner"), stage=F.lit("plan"))
    return made.select("id", "importance")


ROUTED = f"""{MEM}, {CENTROIDS}, asked AS (
  SELECT * FROM (VALUES ('planner', 'plan', 2000, 0), ('coder', 'execute', 1500, 1), ('reviewer', 'review', 1200, 2))
    AS a(role, stage, budget, label)),
pair AS (SELECT m.*, a.role, a.stage, a.budget, greatest(0.0, coalesce(
    list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q), 0.0)) AS sim
  FROM mem m CROSS JOIN asked a LEFT JOIN embeddings e ON e.vec_id = m.id LEFT JOIN cen c ON c.label = a.label),
scored AS (SELECT *, {_score("role", "stage", "sim")} AS importance FROM pair),
rk AS (SELECT *, row_number() OVER (PARTITION BY role, stage ORDER BY importance DESC, id) AS rank FROM scored),
top AS (SELECT * FROM rk WHERE rank <= 50),
walk AS (
  SELECT role, stage, rank, tokens <= budget AS take, CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS used
  FROM top WHERE rank = 1
  UNION ALL
  SELECT t.role, t.stage, t.rank, w.used + t.tokens <= t.budget,
         CASE WHEN w.used + t.tokens <= t.budget THEN w.used + t.tokens ELSE w.used END
  FROM walk w JOIN top t ON t.role = w.role AND t.stage = w.stage AND t.rank = w.rank + 1),
routed AS (SELECT t.* FROM top t JOIN walk w USING (role, stage, rank) WHERE w.take)"""


def routed(spark, sf):
    return ctx.route_context(item_vectors(spark, sf), as_of=as_of(), query_vecs=role_queries(spark, sf), k_max=50)


@query("route_context", f"WITH RECURSIVE {ROUTED} SELECT role, stage, CAST(rank AS INTEGER) AS rank, id, tokens, importance FROM routed")
def _(spark, sf):
    return routed(spark, sf).select("role", "stage", "rank", "id", "tokens", "importance")


@query(
    "pack_context",
    f"""WITH RECURSIVE {ROUTED} SELECT role, 'Context (role-scoped, token-budgeted):' || chr(10) || string_agg(
          printf('- [%s v%d conf=%.2f imp=%.2f] (', type, 1, confidence + 1e-9, importance + 1e-9) || role_tag || '|' || stage_tag
          || ') ' || text, chr(10) ORDER BY rank) AS context FROM routed GROUP BY 1""",
)
def _(spark, sf):
    r = routed(spark, sf).withColumn("version", F.lit(1))
    return ctx.pack_context(r, group=["role"])


def _greedy_groups(spark, sf):
    """Sources as groups with a budget of a third of their tokens; the score is the confidence."""
    m = memory(spark, sf).select("id", "key", "type", "tokens", "confidence")
    budget = m.groupBy("key").agg(F.floor(F.sum("tokens") / 12).alias("budget"))
    return m.join(budget, "key")


@query(
    "greedy_budget_select",
    f"""WITH RECURSIVE {MEM}, b AS (SELECT key, floor(sum(tokens) / 12) AS budget FROM mem GROUP BY 1),
        top AS (SELECT * FROM (SELECT m.*, budget, row_number() OVER (PARTITION BY m.key ORDER BY confidence DESC, id) AS rank
                FROM mem m JOIN b USING (key)) WHERE rank <= 50),
        walk AS (SELECT key, rank, tokens <= budget AS take, CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS used
                 FROM top WHERE rank = 1
                 UNION ALL SELECT t.key, t.rank, w.used + t.tokens <= t.budget,
                   CASE WHEN w.used + t.tokens <= t.budget THEN w.used + t.tokens ELSE w.used END
                 FROM walk w JOIN top t ON t.key = w.key AND t.rank = w.rank + 1)
        SELECT key, CAST(rank AS INTEGER) AS rank, id, tokens FROM top JOIN walk USING (key, rank) WHERE take""",
)
def _(spark, sf):
    made = ctx.budget_select(_greedy_groups(spark, sf), group=["key"], score="confidence", id="id", tokens="tokens", budget="budget", k_max=50)
    return made.select("key", "rank", "id", "tokens")


def _exact_groups(spark, sf):
    """Sources cut by 200 ids, about ten items each, with the budget of their source."""
    return _greedy_groups(spark, sf).withColumn("part", F.floor(F.col("id") / 200))


# All subsets of each small group: the best total, then the higher-ranked items, as bits of one number.
EXACT = f"""WITH RECURSIVE {MEM}, b AS (SELECT key, floor(sum(tokens) / 12) AS budget FROM mem GROUP BY 1),
    r AS (SELECT m.key, m.id // 200 AS part, m.id, m.tokens, b.budget, CAST(round(confidence * 1e9) AS BIGINT) AS worth,
            row_number() OVER (PARTITION BY m.key, m.id // 200 ORDER BY confidence DESC, id) AS rank,
            count(*) OVER (PARTITION BY m.key, m.id // 200) AS n FROM mem m JOIN b USING (key)),
    sub AS (
      SELECT DISTINCT key, part, n, budget, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS bits FROM r
      UNION ALL
      SELECT s.key, s.part, s.n, s.budget, s.i + 1, s.used + t.take * r.tokens, s.total + t.take * r.worth, s.bits * 2 + t.take
      FROM sub s JOIN r ON r.key = s.key AND r.part = s.part AND r.rank = s.i + 1, (VALUES (0), (1)) t(take)
      WHERE s.used + t.take * r.tokens <= s.budget),
    best AS (SELECT key, part, max({{'total': total, 'bits': bits}}).bits AS bits FROM sub WHERE i = n GROUP BY 1, 2)
    SELECT r.key, r.part, r.id, r.tokens, CAST(r.rank AS INTEGER) AS rank FROM r JOIN best USING (key, part)
    WHERE ((best.bits >> CAST(r.n - r.rank AS INTEGER)) & 1) = 1"""


@query("exact_budget_select_parts", EXACT)
def _(spark, sf):
    made = ctx.exact_budget_select(
        _exact_groups(spark, sf), group=["key", "part"], score="confidence", id="id", tokens="tokens", budget="budget"
    )
    return made.select("key", "part", "id", "tokens", "rank")


# Whole sources: the best total per tokens used, item by item.
BEST_TOTAL = f"""WITH RECURSIVE {MEM}, b AS (SELECT key, floor(sum(tokens) / 12) AS budget FROM mem GROUP BY 1),
    r AS (SELECT m.key, m.tokens, b.budget, CAST(round(confidence * 1e9) AS BIGINT) AS worth,
            row_number() OVER (PARTITION BY m.key ORDER BY confidence DESC, id) AS rank FROM mem m JOIN b USING (key)),
    dp AS (
      SELECT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS total FROM b
      UNION ALL
      SELECT s.key, s.i + 1, s.used + t.take * r.tokens, max(s.total + t.take * r.worth)
      FROM dp s JOIN r ON r.key = s.key AND r.rank = s.i + 1, (VALUES (0), (1)) t(take)
      WHERE s.used + t.take * r.tokens <= r.budget GROUP BY 1, 2, 3)
    SELECT key, CAST(budget AS BIGINT) AS budget, max(total) AS total, TRUE AS within
    FROM dp JOIN b USING (key) GROUP BY key, budget"""


@query("exact_budget_select", BEST_TOTAL)
def _(spark, sf):
    made = ctx.budget_select(
        _greedy_groups(spark, sf), group=["key"], score="confidence", id="id", tokens="tokens", budget="budget", exact=True
    )
    best = made.groupBy("key", F.col("budget").cast("long").alias("budget")).agg(
        F.sum(F.round(F.col("confidence") * 1e9).cast("long")).alias("total"), F.sum("tokens").alias("used")
    )
    return best.select("key", "budget", "total", (F.col("used") <= F.col("budget")).alias("within"))


@query("exact_budget_select_by_type")
def _(spark, sf):
    made = ctx.budget_select(
        _greedy_groups(spark, sf), group=["key", "type"], score="confidence", id="id", tokens="tokens", budget="budget", exact=True
    )
    return made.select("key", "type", "id", "tokens", "rank")


UPSERT = f"""{MEM}, o AS (SELECT id, type, key, ts, confidence, row_number() OVER (PARTITION BY type, key ORDER BY ts, id) AS i FROM mem),
walk AS (
  SELECT type, key, i, id, confidence, confidence AS c, ts AS t, TRUE AS won, CAST(1 AS BIGINT) AS wins FROM o WHERE i = 1
  UNION ALL
  SELECT type, key, i, id, confidence, CASE WHEN win THEN confidence ELSE c END, CASE WHEN win THEN ts ELSE t END, win,
         CASE WHEN win THEN wins + 1 ELSE wins END
  FROM (SELECT o.*, w.c, w.t, w.wins, CASE WHEN abs(o.confidence - w.c) > CAST(0.1 AS DOUBLE) THEN o.confidence > w.c ELSE o.ts >= w.t END AS win
        FROM walk w JOIN o ON o.type = w.type AND o.key = w.key AND o.i = w.i + 1)),
res AS (SELECT *, CASE WHEN won THEN wins ELSE 1 END AS version, CASE WHEN won THEN confidence ELSE least(confidence, 0.5) END AS kept,
               max(wins) OVER (PARTITION BY type, key) AS top FROM walk)"""


@query(
    "memory_upsert_versions",
    f"""WITH RECURSIVE {UPSERT} SELECT id, type, key, CASE WHEN NOT won THEN 'kept' WHEN wins = top THEN 'current' ELSE 'replaced' END AS state,
          version, kept AS confidence FROM res""",
)
def _(spark, sf):
    made = ctx.memory_upsert(memory(spark, sf).drop("text"))
    return made.select("id", "type", "key", "state", "version", "confidence")


def memory_importance(spark, sf):
    m = ctx.importance(items(spark, sf), as_of=as_of(), role=F.lit("planner"), stage=F.lit("plan"))
    return m.withColumns({"agent": F.col("role_tag"), "round": (F.col("id") / 50).cast("long")})


@query(
    "memory_stats",
    f"""WITH {MEM}, x AS (SELECT *, {_score(repr('planner'), repr('plan'))} AS importance FROM mem),
        p AS (SELECT 'all' AS dimension, 'all' AS value, * FROM x UNION ALL SELECT 'type', type, * FROM x
              UNION ALL SELECT 'agent', role_tag, * FROM x)
        SELECT dimension, value, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens,
               round(avg(confidence), 6) AS avg_confidence, round(avg(importance), 6) AS avg_importance FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    made = reports.memory_stats(memory_importance(spark, sf))
    return made.withColumns({c: r6(F.col(c)) for c in ("avg_confidence", "avg_importance")})


@query(
    "memory_growth_by_round",
    f"""WITH {MEM}, r AS (SELECT CAST(floor(id / 50) AS BIGINT) AS round, count(*) AS n, sum(tokens) AS t, sum(confidence) AS c FROM mem GROUP BY 1)
        SELECT round, CAST(sum(n) OVER w AS BIGINT) AS items, CAST(sum(t) OVER w AS BIGINT) AS tokens,
               round(sum(c) OVER w / sum(n) OVER w, 6) AS avg_confidence FROM r WINDOW w AS (ORDER BY round)""",
)
def _(spark, sf):
    m = memory(spark, sf).withColumn("round", F.floor(F.col("id") / 50))
    made = reports.memory_growth_by_round(m)
    return made.withColumn("avg_confidence", r6(F.col("avg_confidence")))


# ---- turn logs -----------------------------------------------------------------------

PRICED = TURN + """, cost AS (SELECT *, tokens * 2 AS context_tokens, CAST(CASE provider
    WHEN 'gemini' THEN 2 * tokens * 0.000001 + tokens * 0.000002 WHEN 'groq' THEN 2 * tokens * 0.0000001 + tokens * 0.0000002
    ELSE 0 END AS DOUBLE) AS cost FROM trn)"""


def priced(spark, sf):
    t = turns(spark, sf).withColumns({"context_tokens": F.col("tokens") * 2})
    return reports.price_lookup_cost(t, tokens_in="context_tokens", tokens_out="tokens")


@query("price_lookup_cost", f"WITH {PRICED} SELECT session, round, provider, round(cost, 9) AS cost FROM cost")
def _(spark, sf):
    return priced(spark, sf).select("session", "round", "provider", F.round("cost", 9).alias("cost"))


@query(
    "per_agent_breakdown",
    f"""WITH {PRICED}, u AS (SELECT agent, provider, row_number() OVER (PARTITION BY agent ORDER BY count(*) DESC, provider) AS r
          FROM cost GROUP BY 1, 2)
        SELECT c.agent, count(*) AS rounds, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / count(*), 6) AS tokens_per_round,
               round(sum(cost), 9) AS total_cost, round(avg(latency_ms), 6) AS avg_latency,
               round(coalesce(sum(quality) FILTER (WHERE quality > 0), 0) / count(*), 6) AS quality_all,
               round(coalesce(avg(quality) FILTER (WHERE quality > 0), 0), 6) AS quality_scored,
               round(avg(selected / considered), 6) AS context_efficiency,
               (SELECT provider FROM u WHERE u.agent = c.agent AND r = 1) AS main_provider FROM cost c GROUP BY 1""",
)
def _(spark, sf):
    made = reports.per_agent_breakdown(priced(spark, sf))
    six = ("tokens_per_round", "avg_latency", "quality_all", "quality_scored", "context_efficiency")
    return made.withColumns({**{c: r6(F.col(c)) for c in six}, "total_cost": F.round("total_cost", 9)})


def _side(role: str, m: str) -> str:
    f = f"FILTER (WHERE agent = '{role}')"
    scored = f"FILTER (WHERE agent = '{role}' AND quality > 0)"
    return {
        "total_tokens": f"sum(tokens) {f}",
        "context_tokens": f"sum(context_tokens) {f}",
        "total_cost": f"sum(cost) {f}",
        "avg_latency": f"avg(latency_ms) {f}",
        "avg_quality": f"avg(quality) {scored}",
    }[m]


@query(
    "strategy_comparison",
    f"WITH {PRICED}, v AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({_side('assistant', m)} AS DOUBLE) AS b, CAST({_side('user', m)} AS DOUBLE) AS n FROM cost"
        for m in reports.COMPARED
    )
    + """) SELECT metric, round(b, 6) AS base, round(n, 6) AS new,
            round(CASE metric WHEN 'avg_quality' THEN n - b ELSE b - n END / b * 100, 6) AS improvement_pct FROM v""",
)
def _(spark, sf):
    made = reports.strategy_comparison(priced(spark, sf), base=F.col("agent") == "assistant", new=F.col("agent") == "user")
    return made.withColumns({c: r6(F.col(c)) for c in ("base", "new", "improvement_pct")})


@query(
    "budget_assertions",
    f"""WITH {TURN}, it AS (SELECT *, tokens > budget / 10 AS over, tokens / (budget / 10) AS use,
            list_transform(range(0, selected), lambda i: ((latency_ms + i * 7) % 10) / 10.0) AS imp FROM trn),
        p AS (SELECT over, use, len(imp) AS n, list_sum(imp) AS s, len(list_filter(imp, lambda x: x < 0.5)) AS low FROM it),
        a AS (SELECT count(*) AS total_turns, count(*) FILTER (WHERE over) AS budget_violations, avg(use) AS u,
            sum(s) / sum(n) AS m, CAST(sum(low) AS BIGINT) AS low_importance_items, CAST(sum(n) AS BIGINT) AS n FROM p)
        SELECT total_turns, budget_violations, round(u, 6) AS avg_budget_utilization, round(m, 6) AS avg_memory_importance,
               low_importance_items, round(budget_violations / total_turns, 6) AS budget_violation_rate,
               budget_violations = 0 AS all_budgets_respected, u BETWEEN 0.7 AND 0.95 AS efficient_utilization,
               m > 0.5 AS high_memory_relevance, low_importance_items / n < 0.2 AS minimal_noise FROM a""",
)
def _(spark, sf):
    t = turns(spark, sf)
    n = F.sequence(F.lit(0).cast("long"), F.col("selected") - 1)
    each = F.transform(n, lambda i: F.struct((((F.col("latency_ms") + i * 7) % 10) / 10.0).alias("importance")))
    traces = t.select((F.col("budget") / 10).alias("budget"), F.col("tokens").alias("tokens_used"), each.alias("items"))
    made = reports.budget_assertions(traces)
    six = ("avg_budget_utilization", "avg_memory_importance", "budget_violation_rate")
    return made.withColumns({c: r6(F.col(c)) for c in six})


@query(
    "conversation_stats",
    f"""WITH {TURN} SELECT session, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS words,
          CAST(sum(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> ''))) AS BIGINT) AS sentences,
          count(DISTINCT agent) AS speakers, max(round * 10 + tokens) - min(round * 10) AS duration FROM trn GROUP BY 1""",
)
def _(spark, sf):
    t = turns(spark, sf).withColumns({"start": F.col("round") * 10, "end": F.col("round") * 10 + F.col("tokens")})
    return reports.conversation_stats(t, conv="session", text="text", speaker="agent", start="start", end="end")


@query(
    "session_stats",
    f"""WITH {TURN} SELECT session, count(*) AS rounds, CAST(sum(latency_ms) AS BIGINT) AS duration_ms,
          round(coalesce(avg(quality) FILTER (WHERE quality > 0), 0), 6) AS average_quality,
          bool_or(agent = 'assistant') AS success FROM trn GROUP BY 1""",
)
def _(spark, sf):
    made = reports.session_stats(turns(spark, sf))
    return made.withColumn("average_quality", r6(F.col("average_quality")))


# ---- vectors -------------------------------------------------------------------------


@query(
    "vector_math",
    f"""WITH {CENTROIDS} SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS dot,
          round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
          round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS cosine
        FROM embeddings JOIN cen USING (label)""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    c = vec.centroids(e, group="label", vector="embedding").withColumnRenamed("embedding", "q")
    a, q = F.col("embedding"), F.col("q")
    return e.join(c, "label").select(
        "vec_id", r6(vx.dot(a, q)).alias("dot"), r6(vx.norm(a)).alias("norm"), r6(vx.cosine(a, q)).alias("cosine")
    )


def label_queries(spark, sf):
    c = vec.centroids(table(spark, sf, "embeddings"), group="label", vector="embedding")
    return c.withColumn("query", F.col("label"))


def _topk_sql(same_scope: bool) -> str:
    scope = "AND e.label = c.label" if same_scope else ""
    return f"""WITH {CENTROIDS}, s AS (SELECT c.label AS query, e.vec_id AS id,
          round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.q), 9) AS sim FROM cen c JOIN embeddings e ON TRUE {scope}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s)
        SELECT query, id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query("cosine_topk", _topk_sql(False))
def _(spark, sf):
    top = vec.cosine_topk(table(spark, sf, "embeddings"), label_queries(spark, sf), k=5, id="vec_id")
    return top.withColumn("sim", r6(F.col("sim")))


@query("filtered_memory_search", _topk_sql(True))
def _(spark, sf):
    top = vec.filtered_memory_search(
        table(spark, sf, "embeddings"), label_queries(spark, sf), scope=["label"], k=5, id="vec_id"
    )
    return top.withColumn("sim", r6(F.col("sim")))


def grown_index(spark, sf):
    """An index over the even ids, with the others appended afterwards."""
    e = table(spark, sf, "embeddings")
    index = VectorIndex.build(e.filter("vec_id % 2 = 0"), work_dir(spark, "vector-index"), id="vec_id")
    index.add(e.filter("vec_id % 2 <> 0"), id="vec_id")
    return index


@query("ann_topk_rows")
def _(spark, sf):
    e, q = table(spark, sf, "embeddings"), label_queries(spark, sf)
    near = grown_index(spark, sf).search(q, k=5)
    exact = vec.cosine_topk(e, q, k=5, id="vec_id").select("query", "id", F.lit(True).alias("in_exact"))
    return near.join(exact, ["query", "id"], "left").select(
        "query", "id", "sim", "rank", F.coalesce("in_exact", F.lit(False)).alias("in_exact")
    )


@query(
    "ann_topk",
    """SELECT count(*) AS vectors, count(*) FILTER (vec_id % 100 = 0) AS queries,
              10 * count(*) FILTER (vec_id % 100 = 0) AS found, TRUE AS recall_ok, TRUE AS appended_found FROM embeddings""",
)
def _(spark, sf):
    """Recall at ten against the exact search, of every hundredth vector; and whether each appended one finds itself."""
    e = table(spark, sf, "embeddings")
    index = grown_index(spark, sf)
    asked = e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query").select("query", "embedding")
    near = index.search(asked, k=10, probes=index.probes_for(k=10, recall=0.97)).select("query", "id")
    exact = vec.cosine_topk(e, asked, k=10, id="vec_id").select("query", "id", F.lit(1).alias("hit"))
    met = near.join(exact, ["query", "id"], "left").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))
    appended = e.filter("vec_id % 2 <> 0").withColumnRenamed("vec_id", "query")
    own = index.search(appended, k=1, probes=1).where("sim > 0.999999").agg(F.count("*").alias("own"))
    sizes = e.agg(F.count("*").alias("vectors"), F.count_if(F.expr("vec_id % 100 = 0")).alias("queries"), F.count_if(F.expr("vec_id % 2 <> 0")).alias("late"))
    return met.join(own, F.lit(True)).join(sizes, F.lit(True)).select(
        "vectors", "queries", "found",
        (F.col("hits") >= 0.9 * F.col("found")).alias("recall_ok"), (F.col("own") == F.col("late")).alias("appended_found"),
    )


@query("embed_documents_rows")
def embed_documents_rows(spark, sf):
    made = vec.embed_documents(table(spark, sf, "documents").select("doc_id", "text"))
    e = F.col("embedding")
    return made.select("doc_id", F.size(F.filter(e, lambda x: x != 0)).alias("used"), F.round(vx.norm(e), 4).alias("norm"))


@query("retrieve_topk_sources_rows")
def retrieve_topk_sources_rows(spark, sf):
    b = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query")
    made = vec.retrieve_topk_sources(table(spark, sf, "documents"), b, k=3)
    return made.select("query", "rank", "id", F.round("sim", 6).alias("score"), "content", "source", "lang")


@query("zero_shot_multilabel_rows")
def zero_shot_multilabel_rows(spark, sf):
    from lodeline.functions.text import main_text

    d = table(spark, sf, "documents").select("lang", "text")
    model = vec.embedder(d.select("text"))
    prototypes = vec.centroids(vec.embed_documents(d, model=model), group="lang", vector="embedding")
    pages = table(spark, sf, "pages").select("page_id", main_text(F.col("html")).alias("text"))
    scored = vec.zero_shot_multilabel(
        vec.embed_documents(pages, model=model), prototypes.withColumnRenamed("lang", "label"), id="page_id"
    )
    return scored.select("page_id", F.posexplode("labels").alias("at", "l")).select("page_id", "at", "l.label", "l.score")


# ---- graphs --------------------------------------------------------------------------


@query(
    "bounded_bfs_crawl_graph",
    """WITH RECURSIVE h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
       walk AS (SELECT CAST(0 AS BIGINT) AS page_id, 0 AS depth
                UNION SELECT DISTINCT b.page_id, w.depth + 1 FROM walk w JOIN h a ON a.page_id = w.page_id
                  JOIN h b ON b.href = a.href WHERE w.depth < 2)
       SELECT w.page_id, CAST(min(depth) AS INTEGER) AS depth, url FROM walk w JOIN pages p ON p.page_id = w.page_id
       GROUP BY w.page_id, url ORDER BY min(depth), url, w.page_id LIMIT 50""",
)
def _(spark, sf):
    return graph.bounded_crawl(table(spark, sf, "pages"), max_pages=50, same_host=False)


@query(
    "same_domain_crawl",
    """WITH RECURSIVE h AS (SELECT DISTINCT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host,
         unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
       walk AS (SELECT CAST(1 AS BIGINT) AS page_id, 0 AS depth
                UNION SELECT DISTINCT b.page_id, w.depth + 1 FROM walk w JOIN h a ON a.page_id = w.page_id
                  JOIN h b ON b.href = a.href AND b.host = a.host WHERE w.depth < 2)
       SELECT w.page_id, CAST(min(depth) AS INTEGER) AS depth, url FROM walk w JOIN pages p ON p.page_id = w.page_id
       GROUP BY w.page_id, url""",
)
def _(spark, sf):
    return graph.bounded_crawl(table(spark, sf, "pages"), seed=1)



TRIPLES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, regexp_extract_all(line, '[A-Z][a-z]+') AS t FROM ln),
p AS (SELECT t[i] AS source, t[i + 1] AS target FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t)),
tr AS (SELECT * FROM p WHERE source <> target)"""


GRAPH_TABLES = f"""WITH {TRIPLES} SELECT 'edge' AS kind, source AS a, target AS b, count(*) AS n FROM tr GROUP BY 2, 3
        UNION ALL SELECT 'node', id, NULL, count(*) FROM (SELECT source AS id FROM tr UNION ALL SELECT target FROM tr) GROUP BY 2"""


def capital_pairs(text: str):
    """An extractor of a user: each capitalized term of a line with the next one."""
    for line in text.split("\n"):
        terms = re.findall(graph.TERM_PATTERN, line)
        yield from ((a, b, "next_to") for a, b in zip(terms, terms[1:]) if a != b)


def _graph_rows(triples):
    nodes, edges = graph.build_graph_tables(triples)
    e = edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").alias("n"))
    v = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("mentions").alias("n"))
    return e.unionByName(v)


@query("build_graph_tables", GRAPH_TABLES)
def _(spark, sf):
    return _graph_rows(graph.neighbor_triples(table(spark, sf, "documents")))


@query("build_graph_tables_udtf", GRAPH_TABLES)
def _(spark, sf):
    return _graph_rows(graph.extract_triples(table(spark, sf, "documents"), capital_pairs))


@query("query_subgraph_retrieved")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    nodes, edges = graph.build_graph_tables(graph.neighbor_triples(docs))
    b = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query")
    hits = vec.retrieve_topk_sources(docs, b, k=2).select(F.col("id").alias("doc_id")).distinct()
    _, kept = graph.query_subgraph(nodes, edges, docs.join(hits, "doc_id", "left_semi"))
    return kept


@query(
    "subgraph_of_source",
    f"""WITH {TRIPLES}, seen AS (
          SELECT DISTINCT id FROM (SELECT source AS id FROM tr UNION SELECT target FROM tr), documents d
          WHERE d.source = 'src7' AND contains(d.text, id)),
        kept AS (SELECT source, target, count(*) AS n FROM tr
                 WHERE source IN (FROM seen) OR target IN (FROM seen) GROUP BY 1, 2),
        ends AS (SELECT source AS id FROM kept UNION SELECT target FROM kept)
        SELECT 'edge' AS kind, source AS a, target AS b, n FROM kept
        UNION ALL SELECT 'node', id, NULL, count(*) FROM (SELECT source AS id FROM tr UNION ALL SELECT target FROM tr)
                  WHERE id IN (FROM ends) GROUP BY 2""",
)
@query("query_subgraph")
def _(spark, sf):
    """Nodes and edges around the terms of one source's documents."""
    docs = table(spark, sf, "documents")
    nodes, edges = graph.build_graph_tables(graph.neighbor_triples(docs))
    named, kept = graph.query_subgraph(nodes, edges, docs.filter(F.col("source") == "src7"))
    e = kept.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").alias("n"))
    v = named.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("mentions").alias("n"))
    return e.unionByName(v)
