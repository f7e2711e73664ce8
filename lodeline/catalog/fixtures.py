"""The driver tables, and views of them in the shape each operator expects.

Every view has a Spark form and a SQL form (a common table expression) that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas. Times are read as instants, so filters on them still reach the scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def ntz(col: str | Column) -> Column:
    """An instant as a plain date-time, the form the SQL side returns."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def r6(col: Column) -> Column:
    """Six decimals: sums of doubles differ in the last digits with their order."""
    return F.round(col, 6)


# Telemetry: sensor rows made of events.
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("device_id"),
        F.col("event_type").alias("session_id"),
        (F.col("user_id") % 3).cast("int").alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        F.col("ts").alias("event_timestamp"),
        F.col("value").alias("distance_cm"),
        F.col("value").alias("grayscale_left"),
        k.cast("double").alias("grayscale_center"),
        F.abs(F.col("value") - k).alias("grayscale_right"),
        k.cast("double").alias("cpu_temp_celsius"),
        F.col("event_type").alias("surface_label"),
    )


TEL = """tel AS (
  SELECT user_id AS device_id, event_type AS session_id, CAST(user_id % 3 AS INTEGER) AS kafka_partition,
         event_id AS kafka_offset, ts AS event_timestamp, value AS distance_cm, value AS grayscale_left,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS grayscale_center,
         abs(value - CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS grayscale_right,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cpu_temp_celsius,
         event_type AS surface_label
  FROM events)"""


# Requests: events with parents, numeric columns and a label known a day later.
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("unique_key"),
        F.col("ts").alias("created"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("value") > 50).cast("int").alias("label"),
    )


REQ = """req AS (
  SELECT event_id AS unique_key, ts AS created, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(value > 50 AS INTEGER) AS label
  FROM events)"""


# Ratings: who bought what, rated by quantity. Arrival order is made unique by price and date.
def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.least(F.lit(5), F.ceil(F.col("l_quantity") / 10)).cast("long").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("ship"),
    )


RAW = """raw AS (
  SELECT o_custkey AS "user", l_partkey AS item, CAST(least(5, ceil(l_quantity / 10)) AS BIGINT) AS rating,
         o_orderdate AS ts, o_orderkey AS ord, l_linenumber AS line, l_extendedprice AS price, l_shipdate AS ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ARRIVAL = ["ord", "line", "price", "ship", "item", "rating"]
ARRIVAL_SQL = "ord, line, price, ship, item, rating"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and item; repeated pairs are summed."""
    return raw_ratings(spark, sf_dir).groupBy("user", "item").agg(F.sum("rating").alias("rating"))


RAT = RAW + """, rat AS (
  SELECT "user", item, CAST(sum(rating) AS BIGINT) AS rating FROM raw GROUP BY 1, 2)"""


# Hourly load: event values summed per hour, on a complete hour spine.
def load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("mw"))


LOAD = """pts AS (
  SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS mw FROM events GROUP BY 1, 2),
ext AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM pts GROUP BY 1),
spine AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ext),
ld AS (SELECT s.event_type, s.ts, p.mw FROM spine s LEFT JOIN pts p ON p.event_type = s.event_type AND p.ts = s.ts)"""


# Labeled messages: documents that carry a label.
def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


LAB = """lab AS (
  SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""


# Memory items made of documents.
def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    types = F.array(*[F.lit(t) for t in ("decision", "plan", "entity", "fact", "tool_trace")])
    stages = F.array(*[F.lit(s) for s in ("plan", "execute", "review")])
    role = (
        F.when(F.col("lang") == "en", "planner")
        .when(F.col("lang") == "fr", "coder")
        .when(F.col("lang") == "de", "reviewer")
        .when(F.col("lang") == "es", "searcher")
    )
    return d.select(
        F.col("doc_id").alias("id"),
        F.get(types, (F.col("doc_id") % 5).cast("int")).alias("type"),
        "text",
        role.alias("role_tag"),
        F.get(stages, (F.col("doc_id") % 3).cast("int")).alias("stage_tag"),
        ((F.col("doc_id") % 100) / 100.0).alias("confidence"),
        F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"),
        F.col("source").alias("key"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
        "lang",
    )


MEM = """mem AS (
  SELECT doc_id AS id, ['decision', 'plan', 'entity', 'fact', 'tool_trace'][doc_id % 5 + 1] AS type, text,
         CASE lang WHEN 'en' THEN 'planner' WHEN 'fr' THEN 'coder' WHEN 'de' THEN 'reviewer'
                   WHEN 'es' THEN 'searcher' END AS role_tag,
         ['plan', 'execute', 'review'][doc_id % 3 + 1] AS stage_tag,
         (doc_id % 100) / 100.0 AS confidence, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens, source AS key,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, lang
  FROM documents)"""


def _sql_words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


# Turn log made of conversations.
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    by_role = lambda u, a, s: F.when(F.col("role") == "user", u).when(F.col("role") == "assistant", a).otherwise(s)
    return c.select(
        F.col("conv_id").alias("session"),
        F.col("role").alias("agent"),
        F.col("turn").alias("round"),
        n.alias("tokens"),
        F.length("text").cast("long").alias("latency_ms"),
        by_role("gemini", "groq", "ollama").alias("provider"),
        by_role(2000, 1500, 1200).cast("long").alias("budget"),
        F.lit(10).cast("long").alias("considered"),
        (F.col("turn") + 1).alias("selected"),
        (F.length("text") % 5).cast("long").alias("quality"),
        "text",
    )


TURN = f"""trn AS (
  SELECT conv_id AS session, role AS agent, turn AS round, CAST({_sql_words("text")} AS BIGINT) AS tokens,
         CAST(length(text) AS BIGINT) AS latency_ms,
         CASE role WHEN 'user' THEN 'gemini' WHEN 'assistant' THEN 'groq' ELSE 'ollama' END AS provider,
         CAST(CASE role WHEN 'user' THEN 2000 WHEN 'assistant' THEN 1500 ELSE 1200 END AS BIGINT) AS budget,
         CAST(10 AS BIGINT) AS considered, turn + 1 AS selected,
         CAST(length(text) % 5 AS BIGINT) AS quality, text
  FROM conversations)"""


# Benchmark results made of events.
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.col("event_type").alias("model"),
        (F.col("user_id") % 20).alias("prompt"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("category"),
        (k % 4).alias("score"),
        F.col("value").alias("speed"),
        (k / 10.0).alias("ram"),
    )


SCORE = """sc AS (
  SELECT event_type AS model, user_id % 20 AS prompt, 'c' || CAST(user_id % 4 AS VARCHAR) AS category,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS score, value AS speed,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 10.0 AS ram
  FROM events)"""

sql_words = _sql_words
