"""Streaming jobs driven over the driver tables.

Their results equal the batch forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import ORACLE, learning, query  # noqa: F401
from lodeline.catalog.context import UPSERT
from lodeline.catalog.corpus import KEYWORDS
from lodeline.catalog.fixtures import TEL, labeled, memory, ntz, r6, table, telemetry
from lodeline.catalog.telemetry import HOURLY, ROLL_COLS, _event_messages, _rolling_out, _rolling_sql
from lodeline.functions.scalar import classify_threshold
from lodeline.operators import corpus
from lodeline.session import work_dir
from lodeline.sources import readers
from lodeline.streaming import jobs

PARTS = 4


def _in_time_order(df, ts: str, path: str, parts: int = PARTS, files: int = 1, closing=None):
    """Write the rows slice by slice in time order, each in ``files`` files, and stream them.

    With several files the rows of a slice arrive in any order. ``closing`` rows come last.
    """
    at = F.col(ts).cast("double")
    low, high = df.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - low) / max(high - low, 1e-9) * parts), F.lit(parts - 1))
    for i in range(parts):
        df.filter(part == i).repartition(files).write.mode("append").parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


def _unordered(df, ts: str, path: str, **closing):
    """The rows in many small files, how late a row may be, and a last row far ahead that lets all others pass."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    late = (high - low) / PARTS * 2
    last = {**{c: None for c in df.columns}, ts: high + 2 * late, **closing}
    row = df.sparkSession.createDataFrame([tuple(last[c] for c in df.columns)], df.schema)
    return _in_time_order(df, ts, path, files=12, closing=row), f"{int(late.total_seconds()) + 1} seconds"


def _run(stream_query):
    stream_query.awaitTermination()


@query(
    "stream_json_events",
    f"""WITH {TEL} SELECT kafka_partition, count(*) AS n, count(*) FILTER (WHERE kafka_offset % 7 = 0) AS bad FROM tel GROUP BY 1""",
)
def _(spark, sf):
    src, out = work_dir(spark, "messages"), work_dir(spark, "parsed")
    _event_messages(spark, sf).write.json(src)
    flat = readers.flatten_events(readers.json_line_events(spark, src))
    _run(jobs.write_files(flat, f"{out}/rows", f"{out}/checkpoint"))
    df = spark.read.schema(flat.schema).parquet(f"{out}/rows")
    return df.groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("n"), F.count("problem").alias("bad"))


@query("sink_partitioned_parquet", "SELECT event_id, user_id, value FROM events")
def _(spark, sf):
    src, out = work_dir(spark, "events"), work_dir(spark, "partitioned")
    stream = _in_time_order(table(spark, sf, "events"), "ts", src)
    _run(jobs.sink_partitioned(stream, f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", "value")


@query("incremental_file_discovery", "SELECT CAST(event_id % 2 AS INTEGER) AS run, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """Two runs over one folder: the second sees only the files added in between."""
    src, out = work_dir(spark, "growing"), work_dir(spark, "discovered")
    e = table(spark, sf, "events")
    for run, part in enumerate((F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)):
        e.filter(part).write.mode("append").parquet(src)
        stream = spark.readStream.schema(e.schema).parquet(src)
        _run(jobs.write_files(stream.withColumn("run", F.lit(run)), f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_bronze_ingest",
    f"""WITH {TEL} SELECT kafka_partition, kafka_offset, CASE WHEN kafka_offset % 7 <> 0 THEN distance_cm END AS distance_cm,
          CASE WHEN kafka_offset % 7 = 0 THEN 'missing ultrasonic' END AS problem FROM tel""",
)
def _(spark, sf):
    src, out = work_dir(spark, "messages"), work_dir(spark, "bronze")
    _event_messages(spark, sf).write.json(src)
    _run(jobs.bronze_ingest(readers.json_line_events(spark, src), f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").select("kafka_partition", "kafka_offset", "distance_cm", "problem")


@query("stream_dedup_offset", f"WITH {TEL} SELECT kafka_partition, kafka_offset, device_id, distance_cm FROM tel")
def _(spark, sf):
    src, out = work_dir(spark, "replayed"), work_dir(spark, "deduped")
    t = telemetry(spark, sf).select("kafka_partition", "kafka_offset", "device_id", "event_timestamp", "distance_cm")
    stream = _in_time_order(t.unionByName(t), "event_timestamp", src)
    once = jobs.dedup_offsets(stream, ts="event_timestamp", within="60 days")
    _run(jobs.write_files(once.drop("event_timestamp"), f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows")


@query("stream_hourly_rollup", HOURLY)
def _(spark, sf):
    src, out = work_dir(spark, "readings"), work_dir(spark, "hourly")
    t = telemetry(spark, sf).select(
        F.col("device_id").cast("string").alias("device_id"), "event_timestamp", "distance_cm", "cpu_temp_celsius"
    )
    stream = _in_time_order(t, "event_timestamp", src).withColumn("status", classify_threshold(F.col("distance_cm")))
    made = jobs.hourly_windows(
        stream, key="device_id", ts="event_timestamp", distance="distance_cm", temp="cpu_temp_celsius", status="status"
    )
    _run(jobs.write_updates(made, f"{out}/rows", f"{out}/checkpoint"))
    df = jobs.latest_updates(spark, f"{out}/rows", made.schema, ["device_id", "hour"])
    return df.withColumns(
        {"hour": ntz("hour"), "avg_distance_cm": r6(F.col("avg_distance_cm")), "avg_cpu_temp": r6(F.col("avg_cpu_temp"))}
    )


@query("stream_rolling_features", _rolling_sql(10))
def _(spark, sf):
    src, out = work_dir(spark, "readings"), work_dir(spark, "rolling")
    t = telemetry(spark, sf).select("device_id", "session_id", "event_timestamp", "kafka_offset", *ROLL_COLS)
    stream, late = _unordered(t, "event_timestamp", src, device_id=-1, session_id="end", kafka_offset=-1)
    made = jobs.rolling_features(
        stream, keys=["device_id", "session_id"], order=["event_timestamp", "kafka_offset"], cols=ROLL_COLS, late=late
    )
    _run(jobs.write_files(made, f"{out}/rows", f"{out}/checkpoint"))
    return _rolling_out(spark.read.schema(made.schema).parquet(f"{out}/rows"))


@query("stream_prequential_nb", ORACLE["prequential_naive_bayes"])
def _(spark, sf):
    src, out = work_dir(spark, "stream-messages"), work_dir(spark, "stream-nb")
    stream = _in_time_order(labeled(spark, sf).select("doc_id", "text", "quality"), "doc_id", src)
    _run(jobs.prequential_nb(stream, out, f"{out}/checkpoint", order="doc_id", text="text", label="quality"))
    df = spark.read.parquet(f"{out}/scored").drop("batch")
    return df.withColumns({c: F.round(c, 4) for c in ("pre_score0", "pre_score1", "post_score0", "post_score1")})


@query("stream_memory_upsert", f"WITH RECURSIVE {UPSERT} SELECT id, won, version, kept AS confidence FROM res")
def _(spark, sf):
    src, out = work_dir(spark, "stream-items"), work_dir(spark, "stream-upserts")
    m = memory(spark, sf).select("type", "key", "ts", "id", "confidence")
    stream, late = _unordered(m, "ts", src, id=-1, confidence=0.0)
    made = jobs.memory_upserts(stream, late=late)
    _run(jobs.write_files(made, f"{out}/rows", f"{out}/checkpoint"))
    rows = spark.read.schema(made.schema).parquet(f"{out}/rows").filter(F.col("id") >= 0)
    return rows.select("id", "won", "version", "confidence")


@query(
    "stream_drift_monitor",
    f"""WITH m AS (SELECT date_trunc('hour', TIMESTAMP '2024-01-01' + to_minutes(doc_id)) AS start, quality = toxic AS ok,
             list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w IN ({', '.join(repr(k) for k in KEYWORDS)})) AS f
             FROM documents JOIN labels USING (doc_id)),
        k AS (SELECT unnest([{', '.join(repr(k) for k in KEYWORDS)}]) AS keyword),
        x AS (SELECT start, keyword, ok, len(list_filter(f, lambda w: w = keyword)) AS n, len(f) AS a FROM m, k)
        SELECT start, keyword, CAST(sum(n) AS BIGINT) AS hits,
               round(CASE WHEN sum(a) > 0 THEN sum(n) * 100.0 / sum(a) ELSE 0.0 END, 6) AS pct, count(*) AS messages,
               round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM x GROUP BY 1, 2""",
)
def _(spark, sf):
    src, out = work_dir(spark, "drift-messages"), work_dir(spark, "drift")
    lab = labeled(spark, sf).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"), "text", (F.col("quality") == F.col("toxic")).alias("ok")
    )
    base = corpus.keyword_distribution(lab, KEYWORDS).select("keyword", F.col("pct").alias("base_pct"))
    made = jobs.drift_monitor(_in_time_order(lab, "ts", src), base, ts="ts", text="text", correct="ok")
    _run(jobs.write_updates(made, f"{out}/rows", f"{out}/checkpoint"))
    df = jobs.latest_updates(spark, f"{out}/rows", made.schema, ["start", "keyword"])
    return df.select(
        ntz("start").alias("start"), "keyword", "hits", r6(F.col("pct")).alias("pct"), "messages", r6(F.col("accuracy")).alias("accuracy")
    )
