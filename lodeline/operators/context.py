"""Scoring, budgeted selection, packing and versioned upserts of memory items."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions.vectors import cosine
from lodeline.operators.filling import greedy_fill
from lodeline.operators.knapsack import exact_budget_select
from lodeline.plans.hot_groups import join_blocks, running, split_groups
from lodeline.session import stored

# Scoring weights, keywords per role, types per stage, decay per hour.
WEIGHTS = {
    "role_relevance": 0.6,
    "stage_priority": 0.4,
    "recency": 0.3,
    "semantic_similarity": 1.0,
    "decision_boost": 0.8,
    "plan_boost": 0.4,
    "confidence": 0.1,
}
ROLE_KEYWORDS = {
    "planner": ["plan", "strategy", "goal", "objective", "step", "phase"],
    "coder": ["implement", "code", "function", "class", "debug", "execute"],
    "reviewer": ["review", "evaluate", "assess", "feedback", "quality", "check"],
    "searcher": ["search", "find", "retrieve", "query", "lookup", "discover"],
}
STAGE_TYPES = {"plan": ["decision", "plan"], "execute": ["tool_trace", "fact"], "review": ["decision", "entity", "fact"]}
DECAY_PER_HOUR = 0.1
CONFIDENCE_BAND = 0.1
LOSER_CAP = 0.5


def recency_decay(ts: Column, as_of: Column) -> Column:
    age_hours = (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(3.6e9)
    return F.exp(-F.lit(DECAY_PER_HOUR) * age_hours)


def keyword_relevance(text: Column, roles: Column, role: Column, keywords: dict[str, list[str]] = ROLE_KEYWORDS) -> Column:
    """1 for the role's tag, plus 0.1 per keyword of the role found in the text, at most 0.5."""
    lower = F.lower(text)
    hits = F.lit(0)
    for name, words in keywords.items():
        found = sum((lower.contains(w).cast("int") for w in words), F.lit(0))
        hits = F.when(role == name, found).otherwise(hits)
    tag = F.coalesce(F.array_contains(roles, role), F.lit(False))
    return tag.cast("double") + F.least(F.lit(0.5), hits * F.lit(0.1))


def stage_priority(stages: Column, type_: Column, stage: Column, types: dict[str, list[str]] = STAGE_TYPES) -> Column:
    """1 for the stage's tag, 0.5 if the item type suits the stage, else 0."""
    suits = F.lit(False)
    for name, kinds in types.items():
        suits = suits | ((stage == name) & type_.isin(kinds))
    tag = F.coalesce(F.array_contains(stages, stage), F.lit(False))
    return F.when(tag, 1.0).when(suits, 0.5).otherwise(0.0)


def importance(
    df: DataFrame, *, as_of: Column, role: Column, stage: Column, query_vec: Column | None = None,
    weights: dict[str, float] | None = None, keywords: dict[str, list[str]] | None = None, out: str = "importance",
) -> DataFrame:
    """Weighted sum of role, stage, recency, similarity, type boost and confidence.

    Expects text, type, roles, stages, ts, confidence and, for similarity, embedding.
    """
    w = {**WEIGHTS, **(weights or {})}
    sim = F.lit(0.0)
    if query_vec is not None:
        sim = F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("embedding"), query_vec), F.lit(0.0)))
    boost = F.when(F.col("type") == "decision", w["decision_boost"]).when(F.col("type") == "plan", w["plan_boost"])
    score = (
        w["role_relevance"] * keyword_relevance(F.col("text"), F.col("roles"), role, keywords or ROLE_KEYWORDS)
        + w["stage_priority"] * stage_priority(F.col("stages"), F.col("type"), stage)
        + w["recency"] * recency_decay(F.col("ts"), as_of)
        + w["semantic_similarity"] * sim
        + boost.otherwise(0.0)
        + w["confidence"] * F.col("confidence")
    )
    return df.withColumn(out, F.round(score, 9))


def budget_select(
    df: DataFrame, *, group: Sequence[str], score: str, id: str, tokens: str, budget: str, k_max: int | None = None,
    exact: bool = False, max_group_rows: int | None = None,
) -> DataFrame:
    """Rows chosen per group within its token budget, with their ``rank``.

    Items are walked from the highest score; one that no longer fits is skipped. ``k_max``
    looks only at the best of each group, and Spark applies that limit before the shuffle.
    Groups of any size are filled without putting one into one task (see ``greedy_fill``).
    ``exact`` solves every group as a knapsack instead (see ``exact_budget_select``).
    """
    if exact:
        return exact_budget_select(df, group=group, score=score, id=id, tokens=tokens, budget=budget)
    return greedy_fill(
        df, group=group, score=score, id=id, tokens=tokens, budget=budget, k_max=k_max, max_group_rows=max_group_rows
    )


# Token budgets of the routed requests.
REQUESTS = (("planner", "plan", 2000), ("coder", "execute", 1500), ("reviewer", "review", 1200))


def route_context(
    items: DataFrame, *, as_of: Column, requests: Sequence[tuple] = REQUESTS, query_vecs: DataFrame | None = None,
    k_max: int | None = None, exact: bool = False, max_group_rows: int | None = None,
) -> DataFrame:
    """Items chosen for every (role, stage, budget) request in one pass over the items.

    The request list is given by the caller and short. ``query_vecs`` (role, query_vec, and
    stage where a role has a query per stage) adds similarity to the request's own query; a
    row without a stage serves all stages of its role that have none of their own. Two
    queries of one request fail the job.
    """
    asked = F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(s).alias("stage"), F.lit(b).cast("long").alias("budget")) for r, s, b in requests]
    )
    spread = items.withColumn("_a", F.explode(asked)).select("*", "_a.*").drop("_a")
    vec = None
    if query_vecs is not None:
        vec = F.lit(None).cast("array<double>")
        for (role, stage), v in _request_vectors(query_vecs, requests).items():
            mine = (F.col("role") == role) & (F.col("stage") == stage)
            vec = F.when(mine, F.array(*[F.lit(float(x)) for x in v])).otherwise(vec)
    scored = importance(spread, as_of=as_of, role=F.col("role"), stage=F.col("stage"), query_vec=vec)
    # Only ids and scores take part in the choice; the rest of an item comes back for the chosen ones.
    slim = scored.select("id", "role", "stage", "budget", "tokens", "importance")
    chosen = budget_select(
        slim, group=["role", "stage"], score="importance", id="id", tokens="tokens", budget="budget", k_max=k_max, exact=exact,
        max_group_rows=max_group_rows,
    )
    return items.join(chosen.drop("tokens"), "id")


def _request_vectors(query_vecs: DataFrame, requests: Sequence[tuple]) -> dict[tuple[str, str], list[float]]:
    """The query vector of each request that has one; only rows of requested roles and stages are read."""
    if "stage" not in query_vecs.columns:
        query_vecs = query_vecs.withColumn("stage", F.lit(None).cast("string"))
    wanted = F.lit(False)
    for role, stage, _ in requests:
        wanted = wanted | ((F.col("role") == role) & (F.col("stage").isNull() | (F.col("stage") == stage)))
    rows = query_vecs.filter(wanted).select("role", "stage", "query_vec").limit(2 * len(requests) + 1).collect()
    found = {(r["role"], r["stage"]): r["query_vec"] for r in rows}
    if len(found) < len(rows):
        raise ValueError("more than one query vector for one role and stage")
    picked = {(r, s): found.get((r, s), found.get((r, None))) for r, s, _ in requests}
    return {k: v for k, v in picked.items() if v is not None}


def pack_context(routed: DataFrame, *, group: Sequence[str], include_metadata: bool = True) -> DataFrame:
    """The chosen rows of each group as one text: a header and a line per item in rank order."""
    if include_metadata:
        head = F.format_string("[%s v%d conf=%.2f imp=%.2f]", "type", "version", "confidence", "importance")
        tags = F.concat(F.lit("("), F.array_join("roles", ","), F.lit("|"), F.array_join("stages", ","), F.lit(")"))
        line = F.concat(F.lit("- "), head, F.lit(" "), tags, F.lit(" "), F.col("text"))
    else:
        line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    body = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    return routed.groupBy(*group).agg(F.concat(F.lit("Context (role-scoped, token-budgeted):\n"), body).alias("context"))


# ---- versioned upserts ---------------------------------------------------------------


def beats(conf: float, ts, old_conf: float, old_ts, band: float = CONFIDENCE_BAND) -> bool:
    """Clearly higher confidence wins; within the band the later (or equally late) item wins."""
    if abs(conf - old_conf) > band:
        return conf > old_conf
    return ts >= old_ts


def winners(conf: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """(highest, winner): the winner's confidence after each item, and the highest so far, of items in arrival order.

    An item wins unless the winner is above it by more than the band, so what some items do to a winner from
    before is told by two numbers: it stays if it is above their highest by more than the band, and else the
    last winner among them is the same whatever it was. (The highest item beats whoever stands when it comes.)
    Two stretches compose to one of the same kind; so winners after every item are a scan by doubling steps.
    A missing confidence wins always and loses to all.
    """
    high, last = np.where(np.isnan(conf), np.inf, conf), conf.copy()
    step = 1
    while step < len(conf):
        stays = last[:-step] - high[step:] > band
        last = np.concatenate([last[:step], np.where(stays, last[:-step], last[step:])])
        high = np.concatenate([high[:step], np.maximum(high[:-step], high[step:])])
        step *= 2
    return high, last


def arrivals(conf: np.ndarray, before: float | None, band: float) -> np.ndarray:
    """Which items win when they arrive, after a winner from before (None: there is none)."""
    if not len(conf):
        return np.zeros(0, bool)
    if before is not None:
        conf = np.concatenate([[before], conf])
    _, last = winners(conf, band)
    won = np.concatenate([[True], ~(last[:-1] - conf[1:] > band)])
    return won if before is None else won[1:]


def memory_upsert(
    df: DataFrame, *, key: Sequence[str] = ("type", "key"), order: Sequence[str] = ("ts", "id"), band: float = CONFIDENCE_BAND,
    loser_cap: float = LOSER_CAP, limit: int = 100_000,
) -> DataFrame:
    """Items arriving in order, resolved per key.

    ``order`` ends with the item id, which is unique. Only keys, order and confidence are
    folded; the other columns do not pass through Python.

    Adds ``state`` (current: the winner now; replaced: a former winner; kept: a loser, whose
    confidence is capped) and ``version`` (1 plus the wins before it; losers have 1).

    Items with a NULL in the key conflict with nothing: each is current, version 1, and its
    confidence is its own. They take no part in the fold.

    The rule is not transitive, but a stretch of items acts on the winner before it by two numbers
    (see ``winners``). Keys with more than ``limit`` items are cut into blocks: every block gives its two
    numbers, these compose along the key to the winner each block meets, and the blocks are folded with it,
    in the same number of jobs whatever the data.
    """
    order, id = list(order), list(order)[-1]
    keyless = F.lit(False)
    for k in key:
        keyless = keyless | F.col(k).isNull()
    alone = df.filter(keyless).withColumns({"state": F.lit("current"), "version": F.lit(1).cast("long")})
    df = df.filter(~keyless)
    slim = df.select(*key, *order, F.col("confidence").cast("double").alias("confidence"))
    s = split_groups(slim, list(key), order, limit)
    keys, by = s.keys, s.ord
    extra = [T.StructField("_won", T.BooleanType())]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        pdf["_won"] = arrivals(pdf["confidence"].to_numpy(float), None, band)
        return pdf

    marked = s.cold.groupBy(*keys).applyInPandas(whole, T.StructType([*s.cold.schema.fields, *extra]))
    if s.hot is not None:
        marked = marked.unionByName(_fold_hot(s, band, extra).select(marked.columns))
    flat = stored(s.finish(marked, None), "upsert")
    counted = running(flat, list(key), order, {"_wins": ("sum", F.col("_won").cast("long"))})
    # The current winner is the last win of its key.
    last = flat.filter("_won").groupBy(*key).agg(F.max_by(id, F.struct(*order)).alias(id)).withColumn("_last", F.lit(True))
    marks = counted.select(id, "_won", "_wins").join(last.select(id, "_last"), id, "left")
    state = F.when(~F.col("_won"), "kept").when(F.col("_last"), "current").otherwise("replaced")
    folded = df.join(marks, id).withColumns(
        {
            "state": state,
            "version": F.when(F.col("_won"), F.col("_wins")).otherwise(1).cast("long"),
            "confidence": F.when(F.col("_won"), F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(loser_cap))),
        }
    ).drop("_won", "_wins", "_last")
    return folded.unionByName(alone.withColumn("confidence", F.col("confidence").cast(folded.schema["confidence"].dataType)))


def _fold_hot(s, band: float, extra: list) -> DataFrame:
    """Fold the blocks of long keys; their table has at most one row per block."""
    hot, by = stored(s.hot, "upsert-blocks"), s.ord
    id_fields = [hot.schema[k] for k in [*s.keys, "_blk"]]
    pair = [T.StructField("_high", T.DoubleType()), T.StructField("_last", T.DoubleType())]

    def outcome(pdf: pd.DataFrame) -> pd.DataFrame:
        high, last = winners(pdf.sort_values(by)["confidence"].to_numpy(float), band)
        out = pdf.iloc[:1][[f.name for f in id_fields]].copy()
        out["_high"], out["_last"] = high[-1], last[-1]
        return out

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        high, last = pdf["_high"].to_numpy(float), pdf["_last"].to_numpy(float)
        meets = np.full(len(pdf), np.nan)
        for i in range(1, len(pdf)):
            before = meets[i - 1] if i > 1 else np.nan
            meets[i] = before if before - high[i - 1] > band else last[i - 1]
        pdf["_meets"], pdf["_first"] = meets, np.arange(len(pdf)) == 0
        return pdf.drop(columns=["_high", "_last"])

    met = [T.StructField("_meets", T.DoubleType()), T.StructField("_first", T.BooleanType())]
    table = hot.groupBy(*s.keys, "_blk").applyInPandas(outcome, T.StructType([*id_fields, *pair]))
    table = stored(table.groupBy(*s.keys).applyInPandas(along, T.StructType([*id_fields, *met])), "upsert-winners")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        before = None if pdf["_first"].iloc[0] else pdf["_meets"].iloc[0]
        pdf["_won"] = arrivals(pdf["confidence"].to_numpy(float), before, band)
        return pdf.drop(columns=["_meets", "_first"])

    placed = join_blocks(hot, table, s.keys)
    return placed.groupBy(*s.keys, "_blk").applyInPandas(final, T.StructType([*hot.schema.fields, *extra]))
