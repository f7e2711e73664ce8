"""Reports over turn logs, traces, memory tables, benchmarks and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.plans.hot_groups import running

# Price per token of each provider.
PRICES = {
    "gemini": (0.000001, 0.000002),
    "groq": (0.0000001, 0.0000002),
    "ollama": (0.0, 0.0),
    "openai": (0.00001, 0.00003),
    "anthropic": (0.000008, 0.000024),
}
# Factors of the assumed broadcast baseline, for when none was measured.
ASSUMED_BASELINE = {"tokens": 1.5, "cost": 1.5, "latency": 1.3, "quality": 0.95, "context": 3.0}
MAX_SCORE = 3


# ---- benchmark results ---------------------------------------------------------------


def benchmark_rollup(df: DataFrame, *, categories: Sequence[str]) -> DataFrame:
    """Per model: mean score overall and by category, whole percent of 3 (cut off), speed, memory.

    Category means are conditional averages in the same aggregation, so the results are
    shuffled once.
    """
    made = df.groupBy("model").agg(
        F.round(F.avg("score"), 2).alias("quality"),
        F.round(F.avg("speed"), 1).alias("speed"),
        F.max("ram").alias("max_ram"),
        F.round(F.avg("ram"), 2).alias("mean_ram"),
        F.round(F.max("ram") - F.min("ram"), 2).alias("ram_delta"),
        *[F.round(F.avg(F.when(F.col("category") == c, F.col("score"))), 2).alias(c) for c in categories],
    )
    return made.withColumn("quality_pct", F.floor(F.col("quality") / MAX_SCORE * 100))


def benchmark_compare(rollup: DataFrame, *, base: str) -> DataFrame:
    """Quality per GB, best-in-metric marks and differences to the base model (one row per model)."""
    base_row = rollup.filter(F.col("model") == base)

    def first_by(*order: Column) -> Column:
        return rollup.orderBy(*order, "model").limit(1).select("model").scalar()

    return rollup.select(
        "model",
        F.round(F.try_divide("quality", "max_ram"), 6).alias("quality_per_gb"),
        (F.col("quality_pct") - base_row.select("quality_pct").scalar()).alias("quality_diff"),
        F.round(F.col("speed") - base_row.select("speed").scalar(), 6).alias("speed_diff"),
        (F.col("model") == first_by(F.desc("quality"))).alias("best_quality"),
        (F.col("model") == first_by(F.desc("speed"))).alias("best_speed"),
        (F.col("model") == first_by(F.asc("max_ram"))).alias("least_ram"),
    )


# ---- turn logs -----------------------------------------------------------------------


def price_lookup_cost(
    turns: DataFrame, *, prices: dict[str, tuple[float, float]] = PRICES, provider: str = "provider",
    tokens_in: str = "tokens_in", tokens_out: str = "tokens_out",
) -> DataFrame:
    """``cost``: tokens times the provider's prices; an unknown provider costs nothing."""
    schema = T.StructType.fromDDL(f"{provider} string, _pi double, _po double")
    rows = turns.sparkSession.createDataFrame([(k, *v) for k, v in prices.items()], schema)
    joined = turns.join(F.broadcast(rows), provider, "left")
    cost = F.col(tokens_in) * F.coalesce("_pi", F.lit(0.0)) + F.col(tokens_out) * F.coalesce("_po", F.lit(0.0))
    return joined.withColumn("cost", cost).drop("_pi", "_po")


def per_agent_breakdown(turns: DataFrame) -> DataFrame:
    """One row per agent: rounds, tokens, cost, latency, quality, selection ratio, main provider.

    ``quality_all`` divides the positive scores by all rounds, ``quality_scored`` by the
    scored ones. The main provider is the most used; ties go to the first by name.
    """
    positive = F.when(F.col("quality") > 0, F.col("quality"))
    ratio = F.coalesce(F.try_divide("selected", "considered"), F.lit(0.0))
    main = turns.groupBy("agent").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.avg("latency_ms").alias("avg_latency"),
        F.coalesce(F.sum(positive), F.lit(0)).alias("_q"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("quality_scored"),
        F.avg(ratio).alias("context_efficiency"),
    )
    used = turns.groupBy("agent", "provider").agg(F.count(F.lit(1)).alias("n"))
    top = used.groupBy("agent").agg(F.min(F.struct((-F.col("n")).alias("n"), "provider"))["provider"].alias("main_provider"))
    return main.join(top, "agent").withColumns(
        {"tokens_per_round": F.col("total_tokens") / F.col("rounds"), "quality_all": F.col("_q") / F.col("rounds")}
    ).drop("_q")


COMPARED = ("total_tokens", "context_tokens", "total_cost", "avg_latency", "avg_quality")


def strategy_comparison(turns: DataFrame, *, base: Column, new: Column) -> DataFrame:
    """Two measured groups of turns side by side, with the improvement in percent.

    Lower is better except for quality.
    """

    def totals(which: Column) -> list[Column]:
        pick = lambda c: F.when(which, F.col(c))
        scored = F.when(which & (F.col("quality") > 0), F.col("quality"))
        return [F.sum(pick("tokens")), F.sum(pick("context_tokens")), F.sum(pick("cost")), F.avg(pick("latency_ms")), F.avg(scored)]

    one = turns.agg(
        *[c.cast("double").alias(f"b_{m}") for m, c in zip(COMPARED, totals(base))],
        *[c.cast("double").alias(f"n_{m}") for m, c in zip(COMPARED, totals(new))],
    )
    rows = []
    for m in COMPARED:
        b, n = F.col(f"b_{m}"), F.col(f"n_{m}")
        gain = (n - b) if m == "avg_quality" else (b - n)
        rows.append(
            F.struct(
                F.lit(m).alias("metric"), b.alias("base"), n.alias("new"),
                (F.try_divide(gain, b) * 100).alias("improvement_pct"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def assumed_baseline(turns: DataFrame, factors: dict[str, float] = ASSUMED_BASELINE) -> DataFrame:
    """The turns of a hypothetical broadcast strategy: the measured ones times fixed factors."""
    return turns.withColumns(
        {
            "tokens": F.col("tokens") * factors["tokens"],
            "cost": F.col("cost") * factors["cost"],
            "latency_ms": F.col("latency_ms") * factors["latency"],
            "quality": F.col("quality") * factors["quality"],
            "context_tokens": F.col("context_tokens") * factors["context"],
        }
    )


def budget_assertions(traces: DataFrame) -> DataFrame:
    """One row on budgets and item importance over traces with ``items`` arrays."""
    per_trace = traces.select(
        (F.col("tokens_used") > F.col("budget")).alias("over"),
        F.when(F.col("budget") > 0, F.col("tokens_used") / F.col("budget")).otherwise(0.0).alias("use"),
        F.size("items").alias("items"),
        F.aggregate("items", F.lit(0.0), lambda a, x: a + x["importance"]).alias("importance"),
        F.size(F.filter("items", lambda x: x["importance"] < 0.5)).alias("low"),
    )
    one = per_trace.agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if("over").alias("budget_violations"),
        F.avg("use").alias("avg_budget_utilization"),
        F.sum("items").alias("_items"),
        F.coalesce(F.try_divide(F.sum("importance"), F.sum("items")), F.lit(0.0)).alias("avg_memory_importance"),
        F.sum("low").alias("low_importance_items"),
    )
    return one.withColumns(
        {
            "budget_violation_rate": F.col("budget_violations") / F.col("total_turns"),
            "all_budgets_respected": F.col("budget_violations") == 0,
            "efficient_utilization": F.col("avg_budget_utilization").between(0.7, 0.95),
            "high_memory_relevance": F.col("avg_memory_importance") > 0.5,
            "minimal_noise": F.coalesce(F.try_divide("low_importance_items", "_items") < 0.2, F.lit(True)),
        }
    ).drop("_items")


def conversation_stats(turns: DataFrame, *, conv: str, text: str, speaker: str, start: str, end: str) -> DataFrame:
    """Words, sentences, speakers and the span from the first start to the last end."""
    from lodeline.functions.text import word_count

    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))
    per_speaker = turns.groupBy(conv, speaker).agg(
        F.sum(word_count(F.col(text))).alias("w"),
        F.sum(sentences).alias("s"),
        F.min(start).alias("a"),
        F.max(end).alias("z"),
        F.count(F.lit(1)).alias("t"),
    )
    return per_speaker.groupBy(conv).agg(
        F.sum("t").alias("turns"),
        F.sum("w").alias("words"),
        F.sum("s").alias("sentences"),
        F.count(F.lit(1)).alias("speakers"),
        (F.max("z") - F.min("a")).alias("duration"),
    )


def session_stats(turns: DataFrame, *, session: str = "session") -> DataFrame:
    """Rounds, duration, mean of the positive scores and success per session."""
    positive = F.when(F.col("quality") > 0, F.col("quality"))
    return turns.groupBy(session).agg(
        F.count(F.lit(1)).alias("rounds"),
        F.sum("latency_ms").alias("duration_ms"),
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("average_quality"),
        (F.max(F.when(F.col("agent") == "assistant", 1).otherwise(0)) == 1).alias("success"),
    )


# ---- memory tables -------------------------------------------------------------------


def memory_stats(items: DataFrame, *, agent: str = "agent") -> DataFrame:
    """Counts, tokens and means over all items, per type and per agent, as (dimension, value) rows."""
    entry = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    parts = F.array(entry("all", F.lit("all")), entry("type", F.col("type")), entry("agent", F.col(agent)))
    # Every item stands under three values at once, so it is read and scored once.
    rows = items.select(F.inline(parts), "tokens", "confidence", "importance")
    return rows.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("tokens").alias("tokens"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("importance").alias("avg_importance"),
    )


def memory_growth_by_round(items: DataFrame, *, round_col: str = "round") -> DataFrame:
    """The same totals after each round: aggregate per round first, then run over the rounds."""
    per_round = items.groupBy(round_col).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_t"), F.sum("confidence").alias("_c")
    )
    made = running(per_round, [], [round_col], {"items": ("sum", "_n"), "tokens": ("sum", "_t"), "_cc": ("sum", "_c")})
    return made.select(round_col, "items", "tokens", (F.col("_cc") / F.col("items")).alias("avg_confidence"))


def position_accuracy(results: DataFrame, *, position: str = "position", correct: str = "correct") -> DataFrame:
    """Accuracy per position and overall; the overall row has a NULL position."""
    per = results.groupBy(position).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("right"))
    total = per.agg(F.lit(None).cast(per.schema[position].dataType).alias(position), F.sum("n").alias("n"), F.sum("right").alias("right"))
    return per.unionByName(total).withColumn("accuracy_pct", F.col("right") / F.col("n") * 100)
