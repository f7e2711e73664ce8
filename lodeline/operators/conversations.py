"""Ordered message lists, prompts, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import role_prefix
from lodeline.plans.hot_groups import row_positions

# The stages in order and the role that completes each.
STAGES = ("plan", "execute", "review")
STAGE_ROLES = ("planner", "coder", "reviewer")


def conversation_assemble(messages: DataFrame, *, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages without system turns and hidden reasoning, numbered in order per conversation."""
    kept = messages.filter(F.col("role") != "system")
    kept = kept.drop("thinking")
    return row_positions(kept, [conv], [order], name="position")


def render_chat_template(
    messages: DataFrame, *, conv: str = "conv_id", order: str = "turn", style: str = "named", part_messages: int | None = None
) -> DataFrame:
    """One prompt text per conversation (``part`` 0).

    With ``part_messages`` every conversation is written as consecutive parts of so many
    messages, so no task holds more; the parts in order are the whole text.
    """
    placed = row_positions(messages, [conv], [order], name="_pos", total="_size")
    prefix = role_prefix(F.col("role"), style)
    line = F.when(prefix.isNull(), F.lit("")).otherwise(F.concat(prefix, F.lit(": "), F.col("text"), F.lit("\n")))
    part = F.floor((F.col("_pos") - 1) / part_messages) if part_messages else F.lit(0).cast("long")
    placed = placed.withColumn("part", part).withColumn("_line", line)
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_line")))
    text = F.array_join(F.transform(listed, lambda x: x["_line"]), "")
    made = placed.groupBy(conv, "part").agg(text.alias("prompt"), F.max("_pos").alias("_last"), F.max("_size").alias("_size"))
    if style == "named":
        closing = F.when(F.col("_last") == F.col("_size"), F.lit("Assistant: ")).otherwise(F.lit(""))
        made = made.withColumn("prompt", F.concat("prompt", closing))
    return made.drop("_last", "_size")


def stage_progression(turns: DataFrame, *, conv: str, order: str, role: str) -> DataFrame:
    """``stage`` in which each turn was spoken.

    A stage ends with the first turn of its role after the stage began; that turn still
    belongs to the stage. Two aggregations find the ends, no ordered walk is needed.
    """
    first = turns.filter(F.col(role) == STAGE_ROLES[0]).groupBy(conv).agg(F.min(order).alias("_e0"))
    later = turns.filter(F.col(role) == STAGE_ROLES[1]).join(first, conv).filter(F.col(order) > F.col("_e0"))
    second = later.groupBy(conv).agg(F.min(order).alias("_e1"))
    ends = first.join(second, conv, "left")
    joined = turns.join(ends, conv, "left")
    stage = (
        F.when(F.col("_e0").isNull() | (F.col(order) <= F.col("_e0")), STAGES[0])
        .when(F.col("_e1").isNull() | (F.col(order) <= F.col("_e1")), STAGES[1])
        .otherwise(STAGES[2])
    )
    return joined.withColumn("stage", stage).drop("_e0", "_e1")
