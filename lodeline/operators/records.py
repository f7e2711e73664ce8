"""Structured replies and records: items, valid rows, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.text import clean_path_list, json_span, strip

# The arrays of a structured reply and the item type of each.
ITEM_ARRAYS = {"decisions": "decision", "entities": "entity", "facts": "fact", "plans": "plan", "tool_traces": "tool_trace"}
DEFAULT_CONFIDENCE = 0.7
FALLBACK_CONFIDENCE = 0.6


def extract_items(df: DataFrame, *, text: str, roles: Sequence[str] = (), stages: Sequence[str] = ()) -> DataFrame:
    """Replies as item rows.

    The text from the first ``{`` to the last ``}`` is parsed; each object of the five
    arrays is an item with its text (else summary, else JSON), tags and confidence. A reply
    that does not parse, or has no items, becomes one ``fact`` with confidence 0.6.
    """
    keep = [c for c in df.columns if c != text]
    schema = "struct<" + ", ".join(f"{a}: array<map<string,string>>" for a in ITEM_ARRAYS) + ">"
    parsed = F.from_json(json_span(F.col(text)), schema)
    tag = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")

    def item(kind: str, m):
        own = lambda k: F.coalesce(F.from_json(F.try_element_at(m, F.lit(k)), "array<string>"), F.array().cast("array<string>"))
        given = F.try_element_at(m, F.lit("confidence"))
        return F.struct(
            F.lit(kind).alias("type"),
            F.coalesce(
                F.nullif(F.try_element_at(m, F.lit("text")), F.lit("")),
                F.nullif(F.try_element_at(m, F.lit("summary")), F.lit("")),
                F.to_json(m),
            ).alias("text"),
            F.when(given.isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(given.try_cast("double")).alias("confidence"),
            F.concat(tag(roles), own("roles")).alias("roles"),
            F.concat(tag(stages), own("stages")).alias("stages"),
        )

    def items_of(array: str, kind: str):
        objects = F.coalesce(F.col(f"_j.{array}"), F.array().cast("array<map<string,string>>"))
        return F.transform(objects, lambda m: item(kind, m))

    arrays = [items_of(a, kind) for a, kind in ITEM_ARRAYS.items()]
    fallback = F.array(
        F.struct(
            F.lit("fact").alias("type"),
            strip(F.col(text)).alias("text"),
            F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
            tag(roles).alias("roles"),
            tag(stages).alias("stages"),
        )
    )
    made = df.withColumn("_j", parsed).withColumn("_items", F.concat(*arrays))
    usable = (F.size("_items") > 0) & F.forall("_items", lambda i: i["confidence"].isNotNull())
    return made.select(*keep, F.inline(F.when(usable, F.col("_items")).otherwise(fallback)))


# The keys a plan record must have.
PLAN_KEYS = (
    "Implementation approach",
    "File list",
    "Data structures and interfaces",
    "Program call flow",
    "Task list",
)


def validate_plans(df: DataFrame, record: str) -> DataFrame:
    """Each record with cleaned lists and ``reason``: NULL if valid, else the first failed rule.

    Split the result on ``reason`` into the valid and the quarantined table.
    """
    schema = (
        "struct<`Implementation approach`: string, `File list`: array<variant>, "
        "`Data structures and interfaces`: map<string,string>, `Program call flow`: array<variant>, `Task list`: array<variant>>"
    )
    # Only strings are names and steps; a number or an object in a list counts as missing.
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    strings = lambda c: F.transform(F.col(c), text)
    p = df.withColumn("_p", F.from_json(record, schema)).withColumn("_keys", F.json_object_keys(record))
    absent = F.filter(F.array(*[F.lit(k) for k in PLAN_KEYS]), lambda k: ~F.array_contains("_keys", k))
    empty = F.array().cast("array<string>")
    p = p.withColumns(
        {
            "files": F.coalesce(clean_path_list(strings("_p.`File list`")), empty),
            "tasks": F.coalesce(clean_path_list(strings("_p.`Task list`")), empty),
        }
    )
    p = p.withColumn("tasks", F.when(F.size("tasks") == 0, F.col("files")).otherwise(F.col("tasks")))
    described = F.forall(
        "files",
        lambda f: strip(F.coalesce(F.try_element_at(F.col("_p.`Data structures and interfaces`"), f), F.lit(""))) != "",
    )
    flow = strings("_p.`Program call flow`")
    flow_ok = flow.isNotNull() & F.coalesce(F.forall(flow, lambda s: s.isNotNull() & (strip(s) != "")), F.lit(False))
    reason = (
        F.when(F.col("_keys").isNull(), F.lit("not a JSON object"))
        .when(F.size(absent) > 0, F.concat(F.lit("missing keys: "), F.array_join(absent, ", ")))
        .when(F.size("files") == 0, F.lit("File list must contain at least one filename"))
        .when(
            F.length(strip(F.coalesce(F.col("_p.`Implementation approach`"), F.lit("")))) < 20,
            F.lit("Implementation approach must be descriptive"),
        )
        .when(~described, F.lit("Data structures and interfaces must describe every file"))
        .when(~flow_ok, F.lit("Program call flow must be a list of non-empty strings"))
    )
    return p.withColumn("reason", reason).drop("_p", "_keys")
