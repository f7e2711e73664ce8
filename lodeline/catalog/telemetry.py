"""Sources, sinks, silver and gold tables, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import LAB, RAW, REQ, TEL, ntz, r6, raw_ratings, requests, scores, table, telemetry
from lodeline.functions.scalar import classify_threshold, flag_threshold, shape_features
from lodeline.operators.checks import expect
from lodeline.operators.clean import drop_incomplete, staging_cast
from lodeline.operators.windows import buffered_only, rolling_stats
from lodeline.session import work_dir
from lodeline.sources import readers, writers


# ---- sources -------------------------------------------------------------------------


@query(
    "scan_csv_typed",
    f"""WITH {REQ} SELECT unique_key, created, event_type, round(value, 6) AS value, label FROM req""",
)
def _(spark, sf):
    path = work_dir(spark, "requests-csv")
    src = requests(spark, sf).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    src.select("unique_key", "created", "event_type", "value", "label").write.csv(path, header=True)
    schema = "unique_key long, created string, event_type string, value double, label int"
    df = readers.scan_csv_typed(spark, path, schema, times=["created"])
    return df.withColumns({"created": ntz("created"), "value": r6(F.col("value"))})


@query("scan_delimited", f"""WITH {RAW} SELECT "user", item, rating, CAST(epoch(ts) AS BIGINT) AS ts FROM raw""")
def _(spark, sf):
    path = work_dir(spark, "ratings-tsv")
    src = raw_ratings(spark, sf).select("user", "item", "rating", F.unix_seconds("ts").alias("ts"), "price")
    src.write.csv(path, sep="\t", encoding="ISO-8859-1")
    schema = "user long, item long, rating long, ts long, price double"
    return readers.scan_delimited(spark, path, schema, columns=["user", "item", "rating", "ts"])


@query(
    "scan_parquet_union",
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total,
              count(*) FILTER (WHERE event_id % 2 = 1) AS with_props
       FROM events GROUP BY 1""",
)
def _(spark, sf):
    # An old file without props and a new one with it, below one prefix.
    path = work_dir(spark, "events-tree")
    e = table(spark, sf, "events")
    e.filter(F.col("event_id") % 2 == 0).drop("props").write.parquet(f"{path}/old")
    e.filter(F.col("event_id") % 2 == 1).write.parquet(f"{path}/new")
    df = readers.scan_parquet_union(spark, path, e.schema)
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count("props").alias("with_props")
    )


def _event_messages(spark, sf):
    """Events as nested sensor messages; one in seven lacks a required group."""
    t = telemetry(spark, sf)
    event = F.struct(
        F.col("device_id").cast("string").alias("device_id"),
        F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("kafka_offset") % 7 != 0, F.struct("distance_cm")).alias("ultrasonic"),
        F.struct(
            F.col("grayscale_left").alias("left"),
            F.col("grayscale_center").alias("center"),
            F.col("grayscale_right").alias("right"),
        ).alias("grayscale"),
        F.struct(F.col("cpu_temp_celsius").alias("cpu_temp")).alias("system"),
        F.when(F.col("kafka_offset") % 2 == 0, F.struct("surface_label", "session_id")).alias("meta"),
    )
    return t.select(F.to_json(event).alias("value"), "kafka_partition", "kafka_offset")


@query(
    "flatten_event_json",
    f"""WITH {TEL} SELECT CAST(device_id AS VARCHAR) AS device_id, kafka_partition, kafka_offset,
          CASE WHEN kafka_offset % 7 <> 0 THEN distance_cm END AS distance_cm, grayscale_left, grayscale_center,
          round(grayscale_right, 6) AS grayscale_right, cpu_temp_celsius AS cpu_temp,
          CAST(NULL AS DOUBLE) AS throttle, CASE WHEN kafka_offset % 2 = 0 THEN surface_label END AS surface_label,
          CASE WHEN kafka_offset % 2 = 0 THEN session_id END AS session_id, CAST(NULL AS VARCHAR) AS frame_path,
          CASE WHEN kafka_offset % 7 = 0 THEN 'missing ultrasonic' END AS problem FROM tel""",
)
def _(spark, sf):
    flat = readers.flatten_events(_event_messages(spark, sf))
    return flat.select(
        "device_id", "kafka_partition", "kafka_offset", "distance_cm", "grayscale_left", "grayscale_center",
        r6(F.col("grayscale_right")).alias("grayscale_right"), "cpu_temp", "throttle", "surface_label",
        "session_id", "frame_path", "problem",
    )


@query(
    "scan_nested_results",
    """SELECT event_type AS model, user_id % 20 AS prompt,
              CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS score, count(*) AS n
       FROM events GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    # One nested object per model and stretch of 1000 events keeps every array short.
    path = work_dir(spark, "results-json")
    s = scores(spark, sf).withColumn("part", F.floor(F.col("event_id") / 1000))
    nested = s.groupBy("model", "part").agg(
        F.collect_list(F.struct("prompt", "category", "score", "speed", "ram")).alias("results")
    )
    nested.select("model", "results").write.json(path)
    df = readers.scan_nested_results(spark, path, multi_line=False)
    return df.groupBy("model", "prompt", "score").agg(F.count(F.lit(1)).alias("n"))


@query("scan_documents_dir_rows")
def scan_documents_dir_rows(spark, sf):
    path = work_dir(spark, "document-files")
    d = table(spark, sf, "documents").select("source", "text")
    d.write.option("maxRecordsPerFile", 64).partitionBy("source").text(path)
    listed = readers.list_files(spark, path, max_items=None).select(F.col("name").alias("file"))
    names = listed.withColumn("original", F.concat(F.lit("upload-"), "file"))
    files = readers.scan_documents_dir(spark, f"{path}/*", names)
    return files.select("file", "original", F.length("text").alias("chars"))


def _text_files(spark, sf, name: str) -> str:
    """The documents as text files of at most 64 texts, a line end after each."""
    path = work_dir(spark, name)
    table(spark, sf, "documents").select("source", "text").write.option("maxRecordsPerFile", 64).partitionBy("source").text(path)
    return path


@query("list_files_rows")
def list_files_rows(spark, sf):
    return readers.list_files(spark, _text_files(spark, sf, "listed-files"), glob="*.txt")


@query(
    "document_files_totals",
    """SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
       FROM documents""",
)
def _(spark, sf):
    """What the written files hold, read back and listed: all characters and all bytes."""
    path = _text_files(spark, sf, "counted-files")
    read = readers.scan_documents_dir(spark, f"{path}/*").agg(F.sum(F.length("text")).alias("chars"))
    sizes = readers.list_files(spark, path, glob="*.txt").agg(F.sum("size").alias("bytes"))
    return read.select("chars", sizes.select("bytes").scalar().alias("bytes"))


@query(
    "scan_gold_table",
    f"""WITH {TEL} SELECT surface_label, count(*) AS n,
          round(avg((grayscale_left + grayscale_center + grayscale_right) / 3.0), 6) AS gs_mean
        FROM tel GROUP BY 1""",
)
def _(spark, sf):
    path = work_dir(spark, "gold")
    t = telemetry(spark, sf)
    shape = shape_features(F.col("grayscale_left"), F.col("grayscale_center"), F.col("grayscale_right"))
    t.withColumns(shape).write.parquet(path)
    gold = spark.read.parquet(path).select("surface_label", "gs_mean")
    return gold.groupBy("surface_label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gs_mean")).alias("gs_mean"))


# ---- sinks ---------------------------------------------------------------------------


@query(
    "incremental_append",
    f"""WITH {TEL}, old AS (SELECT * FROM tel WHERE event_timestamp < TIMESTAMP '2024-01-16'),
        mark AS (SELECT kafka_partition, max(kafka_offset) AS m FROM old GROUP BY 1),
        fresh AS (SELECT t.* FROM tel t LEFT JOIN mark USING (kafka_partition) WHERE m IS NULL OR kafka_offset > m)
        SELECT kafka_partition, kafka_offset, device_id, loaded FROM (
          SELECT *, 'old' AS loaded FROM old UNION ALL SELECT *, 'new' AS loaded FROM fresh)""",
)
def _(spark, sf):
    t = telemetry(spark, sf)
    old = t.filter(F.col("event_timestamp") < "2024-01-16").withColumn("loaded", F.lit("old"))
    merged = writers.incremental_append(old, t.withColumn("loaded", F.lit("new")))
    return merged.select("kafka_partition", "kafka_offset", "device_id", "loaded")


@query(
    "incremental_upsert_fact",
    f"""WITH {TEL} SELECT kafka_partition, kafka_offset, device_id,
          round(CASE WHEN event_timestamp >= TIMESTAMP '2024-01-12' THEN distance_cm + 1 ELSE distance_cm END, 6)
            AS distance_cm FROM tel""",
)
def _(spark, sf):
    t = telemetry(spark, sf).select("kafka_partition", "kafka_offset", "device_id", "event_timestamp", "distance_cm")
    old = t.filter(F.col("event_timestamp") < "2024-01-18")
    batch = t.filter(F.col("event_timestamp") >= "2024-01-12").withColumn("distance_cm", F.col("distance_cm") + 1)
    merged = writers.incremental_upsert(old, batch, keys=["kafka_partition", "kafka_offset"])
    return merged.select("kafka_partition", "kafka_offset", "device_id", r6(F.col("distance_cm")).alias("distance_cm"))


def _silver(spark, sf):
    t = telemetry(spark, sf).withColumnRenamed("cpu_temp_celsius", "cpu_temp")
    return staging_cast(t)


def _fact(spark, sf):
    return _silver(spark, sf).withColumns(
        {
            "proximity_status": classify_threshold(F.col("distance_cm")),
            "is_overheating": flag_threshold(F.col("cpu_temp_celsius")),
        }
    )


@query(
    "materialize_layers",
    """SELECT event_type AS session_id, count(*) AS n, count(*) FILTER (WHERE value < 20) AS near FROM events GROUP BY 1""",
)
def _(spark, sf):
    fact = _fact(spark, sf)
    writers.materialize_layers(_silver(spark, sf), {"fact": fact}, work_dir(spark, "layers"), prefix="tel_")
    return spark.sql(
        "select session_id, count(*) as n, count_if(proximity_status = 'obstacle_near') as near "
        "from tel_gold_fact group by session_id"
    )


@query("sink_csv_json_reports", "SELECT event_type, count(*) AS n, 'csv' AS kind FROM events GROUP BY 1 "
       "UNION ALL SELECT event_type, count(*) AS n, 'json' AS kind FROM events GROUP BY 1")  # fmt: skip
def _(spark, sf):
    path = work_dir(spark, "reports")
    report = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writers.write_report(report, f"{path}/csv")
    writers.write_report(report, f"{path}/json", "json")
    csv = spark.read.schema("event_type string, n long").csv(f"{path}/csv", header=True)
    js = spark.read.schema("event_type string, n long").json(f"{path}/json")
    return csv.withColumn("kind", F.lit("csv")).unionByName(js.withColumn("kind", F.lit("json")))


# ---- silver and gold -----------------------------------------------------------------


@query(
    "staging_cast",
    f"""WITH {TEL} SELECT CAST(device_id AS VARCHAR) AS device_id, event_timestamp, distance_cm,
          CAST(trunc(grayscale_left) AS INTEGER) AS grayscale_left, CAST(grayscale_center AS INTEGER) AS grayscale_center,
          CAST(trunc(grayscale_right) AS INTEGER) AS grayscale_right, cpu_temp_celsius, kafka_partition, kafka_offset,
          surface_label, session_id, CAST(NULL AS INTEGER) AS waypoint_id, CAST(NULL AS VARCHAR) AS mode FROM tel""",
)
def _(spark, sf):
    cols = [
        "device_id", "distance_cm", "grayscale_left", "grayscale_center", "grayscale_right", "cpu_temp_celsius",
        "kafka_partition", "kafka_offset", "surface_label", "session_id", "waypoint_id", "mode",
    ]
    return _silver(spark, sf).select(*cols, ntz("event_timestamp").alias("event_timestamp"))


@query(
    "classify_threshold",
    """SELECT event_id, value, CASE WHEN value < 20 THEN 'obstacle_near' WHEN value < 50 THEN 'obstacle_moderate'
              ELSE 'clear' END AS proximity_status FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "value", classify_threshold(F.col("value")).alias("proximity_status"))


@query("flag_threshold", f"""WITH {TEL} SELECT kafka_offset, coalesce(cpu_temp_celsius > 70, FALSE) AS is_overheating FROM tel""")
def _(spark, sf):
    return telemetry(spark, sf).select("kafka_offset", flag_threshold(F.col("cpu_temp_celsius")).alias("is_overheating"))


HOURLY = f"""WITH {TEL} SELECT CAST(device_id AS VARCHAR) AS device_id, date_trunc('hour', event_timestamp) AS hour,
    count(*) AS reading_count, round(avg(distance_cm), 6) AS avg_distance_cm, min(distance_cm) AS min_distance_cm,
    round(avg(cpu_temp_celsius), 6) AS avg_cpu_temp, max(cpu_temp_celsius) AS max_cpu_temp,
    count(*) FILTER (WHERE distance_cm < 20) AS near_obstacle_count FROM tel GROUP BY 1, 2"""


@query("hourly_rollup", HOURLY)
def hourly(spark, sf):
    from lodeline.operators.aggregates import hourly_rollup

    made = hourly_rollup(_fact(spark, sf))
    return made.withColumns(
        {"hour": ntz("hour"), "avg_distance_cm": r6(F.col("avg_distance_cm")), "avg_cpu_temp": r6(F.col("avg_cpu_temp"))}
    )


ROLL_COLS = ("grayscale_left", "grayscale_center", "grayscale_right")
ROLL_CTE = TEL + """, roll AS (
  SELECT device_id, session_id, kafka_offset, event_timestamp, surface_label,
    row_number() OVER o AS pos,
    stddev_samp(grayscale_left) OVER w AS sl, stddev_samp(grayscale_center) OVER w AS sc,
    stddev_samp(grayscale_right) OVER w AS sr, avg(grayscale_left) OVER w AS ml,
    avg(grayscale_center) OVER w AS mc, avg(grayscale_right) OVER w AS mr
  FROM tel
  WINDOW w AS (PARTITION BY device_id, session_id ORDER BY event_timestamp, kafka_offset
               ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         o AS (PARTITION BY device_id, session_id ORDER BY event_timestamp, kafka_offset))"""


def rolled(spark, sf, **kw):
    return rolling_stats(
        telemetry(spark, sf),
        keys=["device_id", "session_id"],
        order=["event_timestamp", "kafka_offset"],
        cols=ROLL_COLS,
        **kw,
    )


def _rolling_sql(periods):
    return f"""WITH {ROLL_CTE} SELECT kafka_offset, round(sl, 6) AS grayscale_left_std,
        round(sc, 6) AS grayscale_center_std, round(sr, 6) AS grayscale_right_std,
        round(ml, 6) AS grayscale_left_mean, round(mc, 6) AS grayscale_center_mean,
        round(mr, 6) AS grayscale_right_mean, round((sl + sc + sr) / 3.0, 6) AS texture_score
        FROM roll WHERE pos >= {periods}"""


def _rolling_out(df):
    names = [f"{c}_{k}" for c in ROLL_COLS for k in ("std", "mean")] + ["texture_score"]
    return df.select("kafka_offset", *[r6(F.col(n)).alias(n) for n in names])


@query("rolling_stats_10", _rolling_sql(10))
def _(spark, sf):
    return _rolling_out(rolled(spark, sf))


@query("rolling_stats_10_parity", _rolling_sql(2))
def _(spark, sf):
    return _rolling_out(rolled(spark, sf, min_periods=2))


@query(
    "sensor_shape_features",
    f"""WITH {TEL} SELECT kafka_offset, round((grayscale_left + grayscale_center + grayscale_right) / 3.0, 6) AS gs_mean,
          round(greatest(grayscale_left, grayscale_center, grayscale_right)
                - least(grayscale_left, grayscale_center, grayscale_right), 6) AS gs_spread,
          CASE WHEN grayscale_left + grayscale_right > 0
               THEN round(grayscale_center / ((grayscale_left + grayscale_right) / 2.0), 6) END
            AS gs_center_to_outer_ratio FROM tel""",
)
def _(spark, sf):
    shape = shape_features(F.col("grayscale_left"), F.col("grayscale_center"), F.col("grayscale_right"))
    return telemetry(spark, sf).select("kafka_offset", *[r6(c).alias(n) for n, c in shape.items()])


@query("turn_gating", f"""WITH {ROLL_CTE} SELECT kafka_offset, pos FROM roll WHERE pos >= 10""")
def _(spark, sf):
    gated = buffered_only(
        telemetry(spark, sf), keys=["device_id", "session_id"], order=["event_timestamp", "kafka_offset"], size=10
    )
    return gated.select("kafka_offset", "pos")


@query(
    "drop_incomplete",
    f"""WITH {ROLL_CTE}, x AS (SELECT surface_label, sl, sc, sr FROM roll)
        SELECT surface_label, count(*) AS n FROM x WHERE sl IS NOT NULL AND sc IS NOT NULL AND sr IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    full = rolled(spark, sf, min_periods=1)
    kept = drop_incomplete(full, [f"{c}_std" for c in ROLL_COLS])
    return kept.groupBy("surface_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_labeled",
    "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    joined = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.filter(F.col("quality").isNotNull()).select("doc_id", "lang", "quality")


@query(
    "union_all_batches",
    """SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "props")
    old = e.filter(F.col("event_id") % 2 == 0).drop("props")
    return old.unionByName(e.filter(F.col("event_id") % 2 == 1), allowMissingColumns=True)


# ---- checks --------------------------------------------------------------------------


@query(
    "expect_accepted_values",
    """SELECT 'accepted_values' AS "check", 'event_type' AS "column", count(*) AS rows,
              count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) AS failures,
              count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')) = 0 AS passed FROM events""",
)
def _(spark, sf):
    return expect(table(spark, sf, "events"), [("accepted_values", "event_type", ["view", "click", "purchase"])])


@query(
    "expect_not_null",
    """SELECT 'not_null' AS "check", c AS "column", rows, failures, failures = 0 AS passed FROM (
         SELECT 'quality' AS c, count(*) AS rows, count(*) - count(quality) AS failures
         FROM documents LEFT JOIN labels USING (doc_id)
         UNION ALL SELECT 'text', count(*), count(*) - count(text) FROM documents)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return expect(d, [("not_null", "quality"), ("not_null", "text")])


@query(
    "expect_unique",
    """SELECT 'unique' AS "check", c AS "column", CAST(rows AS BIGINT) AS rows, CAST(failures AS BIGINT) AS failures,
              failures = 0 AS passed FROM (
         SELECT 'l_orderkey+l_linenumber' AS c, sum(n) AS rows, sum(n - 1) AS failures
         FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
         UNION ALL
         SELECT 'l_orderkey+l_linenumber+l_partkey+l_extendedprice+l_shipdate', sum(n), sum(n - 1)
         FROM (SELECT count(*) AS n FROM lineitem
               GROUP BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate))""",
)
def _(spark, sf):
    key = ["l_orderkey", "l_linenumber"]
    return expect(
        table(spark, sf, "lineitem"),
        [("unique", key), ("unique", [*key, "l_partkey", "l_extendedprice", "l_shipdate"])],
    )


@query(
    "expect_range",
    """SELECT 'range' AS "check", c AS "column", rows, failures, failures = 0 AS passed FROM (
         SELECT 'value' AS c, count(*) AS rows, count(*) FILTER (WHERE value < 0 OR value > 200) AS failures FROM events
         UNION ALL SELECT 'event_id', count(*), count(*) FILTER (WHERE event_id < 0) FROM events)""",
)
def _(spark, sf):
    return expect(table(spark, sf, "events"), [("range", "value", (0, 200)), ("range", "event_id", (0, None))])
