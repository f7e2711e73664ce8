"""Profiling, rollups, top rows, calendar functions and keyed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import (
    ARRIVAL,
    RAT,
    RAW,
    REQ,
    SCORE,
    ntz,
    r6,
    ratings,
    raw_ratings,
    requests,
    scores,
    table,
    telemetry,
)
from lodeline.functions import scalar
from lodeline.operators import aggregates as agg
from lodeline.operators import clean
from lodeline.operators.reports import benchmark_compare, benchmark_rollup


@query(
    "dataset_summary",
    f"""WITH {RAT}, s AS (SELECT count(*) AS rows, count(DISTINCT "user") AS users, count(DISTINCT item) AS items,
          avg(rating) AS mean_rating, median(rating) AS median_rating FROM rat)
        SELECT metric, round(value, 6) AS value FROM (
          SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value FROM s UNION ALL SELECT 'users', users FROM s
          UNION ALL SELECT 'items', items FROM s UNION ALL SELECT 'ratings_per_user', rows / users FROM s
          UNION ALL SELECT 'ratings_per_item', rows / items FROM s UNION ALL SELECT 'mean_rating', mean_rating FROM s
          UNION ALL SELECT 'median_rating', median_rating FROM s)""",
)
def _(spark, sf):
    return agg.dataset_summary(ratings(spark, sf)).withColumn("value", r6(F.col("value")))


@query(
    "describe_numeric",
    """SELECT 'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean,
              round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
              round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
              max(value) AS max FROM events""",
)
def _(spark, sf):
    df = agg.describe_numeric(table(spark, sf, "events"), ["value"])
    return df.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "null_profile",
    """WITH x AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT * FROM (
         SELECT 'doc_id' AS "column", count(*) AS rows, count(*) - count(doc_id) AS nulls,
                CAST(min(doc_id) AS VARCHAR) AS min, CAST(max(doc_id) AS VARCHAR) AS max FROM x
         UNION ALL SELECT 'lang', count(*), count(*) - count(lang), min(lang), max(lang) FROM x
         UNION ALL SELECT 'quality', count(*), count(*) - count(quality), CAST(min(quality) AS VARCHAR),
                          CAST(max(quality) AS VARCHAR) FROM x
         UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic), CAST(min(toxic) AS VARCHAR),
                          CAST(max(toxic) AS VARCHAR) FROM x)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return agg.null_profile(d.join(table(spark, sf, "labels"), "doc_id", "left"))


@query(
    "exact_duplicates",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
              count(*) FILTER (WHERE n > 1) AS duplicated_keys FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
)
def _(spark, sf):
    return agg.exact_duplicates(table(spark, sf, "documents"), ["text"], hashed=True)


@query(
    "value_counts",
    """SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share
       FROM events GROUP BY 1""",
)
def _(spark, sf):
    return agg.value_counts(table(spark, sf, "events"), "event_type").withColumn("share", r6(F.col("share")))


@query(
    "count_per_key",
    f"""WITH {RAW} SELECT 'user' AS side, "user" AS id, count(*) AS n FROM raw GROUP BY 2
        UNION ALL SELECT 'item', item, count(*) FROM raw GROUP BY 2""",
)
def _(spark, sf):
    raw = raw_ratings(spark, sf)
    sides = [
        raw.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(c))
        for c in ("user", "item")
    ]
    return sides[0].unionByName(sides[1])


@query(
    "calendar_resample",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1),
            s AS (SELECT unnest(generate_series((SELECT CAST(min(period) AS TIMESTAMP) FROM m),
                                (SELECT CAST(max(period) AS TIMESTAMP) FROM m), INTERVAL 1 MONTH)) AS period)
       SELECT CAST(s.period AS TIMESTAMP) AS period, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (period)""",
)
def _(spark, sf):
    return agg.calendar_resample(table(spark, sf, "orders"), "o_orderdate").withColumn("period", ntz("period"))


@query(
    "pivot_wide",
    f"""WITH {RAW}, x AS (SELECT "user", p_type, rating FROM raw JOIN part ON item = p_partkey)
        SELECT "user", round(avg(rating) FILTER (WHERE p_type = 'ECONOMY'), 6) AS economy,
               round(avg(rating) FILTER (WHERE p_type = 'STANDARD'), 6) AS standard,
               round(avg(rating) FILTER (WHERE p_type = 'PROMO'), 6) AS promo FROM x GROUP BY 1""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), "p_type")
    df = raw_ratings(spark, sf).join(parts, "item")
    wide = agg.pivot_wide(df, rows="user", columns="p_type", value="rating", values=["ECONOMY", "STANDARD", "PROMO"])
    return wide.select("user", *[r6(F.col(c)).alias(c.lower()) for c in ("ECONOMY", "STANDARD", "PROMO")])


@query(
    "matrix_density",
    f"""WITH {RAT} SELECT count(DISTINCT "user") AS users, count(*) AS nnz, count(DISTINCT item) AS items,
          round(count(*) / (count(DISTINCT "user") * count(DISTINCT item)), 9) AS density FROM rat""",
)
def _(spark, sf):
    return agg.matrix_density(raw_ratings(spark, sf)).withColumn("density", F.round("density", 9))


@query(
    "histogram",
    """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
       SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n
       FROM events, m GROUP BY 1""",
)
def _(spark, sf):
    return agg.histogram(table(spark, sf, "events"), "value", 30)


@query(
    "group_box_stats",
    """SELECT p_type, count(*) AS n, min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 6) AS q1,
              round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3,
              max(p_retailprice) AS max FROM part GROUP BY 1""",
)
def _(spark, sf):
    df = agg.group_box_stats(table(spark, sf, "part"), group="p_type", value="p_retailprice")
    return df.withColumns({c: r6(F.col(c)) for c in ("q1", "median", "q3")})


# ---- sort, top rows, sets ------------------------------------------------------------


@query("sort_time", "SELECT event_id, ts, user_id, value FROM events ORDER BY ts, event_id")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return e.orderBy("ts", "event_id").withColumn("ts", ntz("ts"))


@query("topk_global", f"WITH {RAT} SELECT item, count(*) AS n FROM rat GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def _(spark, sf):
    counts = ratings(spark, sf).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return agg.top_rows(counts, 10, [F.desc("n"), F.asc("item")])


@query(
    "best_run",
    """WITH runs AS (SELECT user_id AS run, avg(value) AS accuracy, min(ts) AS started FROM events GROUP BY 1)
       (SELECT 'best' AS pick, run, round(accuracy, 6) AS accuracy, started FROM runs ORDER BY accuracy DESC, run LIMIT 1)
       UNION ALL
       (SELECT 'latest', run, round(accuracy, 6), started FROM runs ORDER BY started DESC, run LIMIT 1)""",
)
def _(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(
        F.avg("value").alias("accuracy"), F.min("ts").alias("started")
    )
    best = agg.best_run(runs, metric="accuracy", ties="run").withColumn("pick", F.lit("best"))
    latest = agg.best_run(runs, metric="started", ties="run").withColumn("pick", F.lit("latest"))
    out = best.unionByName(latest)
    return out.select("pick", "run", r6(F.col("accuracy")).alias("accuracy"), ntz("started").alias("started"))


@query(
    "busiest_key",
    f"""WITH {RAW} SELECT "user", count(*) AS n FROM raw GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC, "user" LIMIT 1""",
)
def _(spark, sf):
    return agg.busiest_key(raw_ratings(spark, sf), "user")


@query(
    "base_test_difference",
    f"""WITH {RAW} SELECT "user", item, rating FROM raw EXCEPT ALL SELECT "user", item, rating FROM raw WHERE line = 1""",
)
def _(spark, sf):
    raw = raw_ratings(spark, sf)
    cols = ["user", "item", "rating"]
    return raw.select(*cols).exceptAll(raw.filter(F.col("line") == 1).select(*cols))


@query(
    "distinct_ids",
    f"""WITH {RAW} SELECT 'user' AS side, "user" AS id FROM raw GROUP BY 2 UNION ALL SELECT 'item', item FROM raw GROUP BY 2""",
)
def _(spark, sf):
    raw = raw_ratings(spark, sf)
    sides = [raw.select(F.lit(c).alias("side"), F.col(c).alias("id")).distinct() for c in ("user", "item")]
    return sides[0].unionByName(sides[1])


# ---- calendar and labels -------------------------------------------------------------


@query(
    "calendar_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
              CAST(quarter(ts) AS INTEGER) AS quarter, CAST(month(ts) AS INTEGER) AS month,
              CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS dayofyear,
              CAST(day(ts) AS INTEGER) AS dayofmonth, CAST(week(ts) AS INTEGER) AS weekofyear FROM events""",
)
def _(spark, sf):
    made = scalar.calendar_features(F.col("ts"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


@query(
    "transform_primitives",
    f"""WITH {REQ} SELECT unique_key, CAST(isodow(created) - 1 AS INTEGER) AS weekday,
          CAST(month(created) AS INTEGER) AS month, CAST(day(created) AS INTEGER) AS day,
          round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created)) / 1000000.0, 6) AS time_since FROM req""",
)
def _(spark, sf):
    made = scalar.transform_primitives(F.col("created"), F.lit("2024-02-01").cast("timestamp"))
    made["time_since"] = r6(made["time_since"])
    return requests(spark, sf).select("unique_key", *[c.alias(n) for n, c in made.items()])


@query(
    "time_parse_trunc",
    """SELECT event_id, ts AS parsed, date_trunc('hour', ts) AS hour, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))
                AT TIME ZONE 'UTC' AS second, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hr FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    parsed = F.to_timestamp("iso")
    return e.select(
        "event_id",
        ntz(parsed).alias("parsed"),
        ntz(F.date_trunc("hour", parsed)).alias("hour"),
        ntz(F.timestamp_seconds(F.unix_seconds("ts"))).alias("second"),
        *[c.alias(n) for n, c in scalar.partition_fields(F.col("ts")).items()],
    )


@query(
    "duration_label",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_shipdate - o_orderdate <= INTERVAL 1440 HOURS AS INTEGER) AS label
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    joined = li.filter(F.col("l_shipdate").isNotNull()).join(o, li.l_orderkey == o.o_orderkey)
    label = scalar.duration_label(F.col("o_orderdate"), F.col("l_shipdate"), hours=1440)
    return joined.select("l_orderkey", "l_linenumber", "l_extendedprice", label.alias("label"))


@query(
    "fill_unknown_keys",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'UNKNOWN') AS quality, coalesce(l.toxic, 0) AS toxic
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", scalar.fill_unknown(F.col("quality")).alias("quality"), "toxic").fillna(0, ["toxic"])


@query(
    "label_encode",
    """SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS code FROM part""",
)
def _(spark, sf):
    return clean.label_encode(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@query(
    "numeric_feature_matrix",
    f"""WITH {REQ} SELECT label, count(*) AS n, round(avg(user_id), 6) AS mean_0, round(avg(value), 6) AS mean_1,
          round(avg(k), 6) AS mean_2 FROM req GROUP BY 1""",
)
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    made = clean.numeric_feature_matrix(requests(spark, sf), target="label", exclude=["unique_key"])
    v = vector_to_array("features")
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(v[i])).alias(f"mean_{i}") for i in range(3)])


# ---- keyed changes -------------------------------------------------------------------


def change_log(spark, sf):
    """Events as changes of users: errors delete, clicks set the value, the rest set both columns."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("moment"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "delete").otherwise("update").alias("op"),
        F.when(kind != "error", F.col("value")).alias("value"),
        F.when(~kind.isin("error", "click"), kind).alias("status"),
    )


LOG = """log AS (
  SELECT user_id AS id, ts AS moment, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type NOT IN ('error', 'click') THEN event_type END AS status FROM events)"""


@query(
    "partial_update",
    f"""WITH {LOG}, gone AS (SELECT id, max((moment, seq)) AS g FROM log WHERE op = 'delete' GROUP BY 1),
        live AS (SELECT log.* FROM log LEFT JOIN gone USING (id) WHERE op <> 'delete' AND (g IS NULL OR (moment, seq) > g))
        SELECT id, arg_max(value, (moment, seq)) FILTER (WHERE value IS NOT NULL) AS value,
               arg_max(status, (moment, seq)) FILTER (WHERE status IS NOT NULL) AS status,
               min(moment) AS created, max(moment) AS changed FROM live GROUP BY 1""",
)
def _(spark, sf):
    df = clean.partial_update(change_log(spark, sf), key="id", order=["moment", "seq"], cols=["value", "status"])
    return df.withColumns({"created": ntz("created"), "changed": ntz("changed")})


@query(
    "change_history",
    f"""WITH {LOG} SELECT id, seq, op, lag(value) OVER (PARTITION BY id ORDER BY moment, seq) AS old_value,
          value AS new_value, moment FROM log""",
)
def _(spark, sf):
    df = clean.change_history(change_log(spark, sf), key="id", order=["moment", "seq"], value="value")
    return df.select("id", "seq", "op", "old_value", "new_value", ntz("moment").alias("moment"))


@query(
    "scoped_delete",
    """WITH t AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 200)
       SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS
         (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.event_type = e.event_type)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    kept = clean.scoped_delete(e, e.filter(F.col("value") > 200), scope=["user_id", "event_type"])
    return kept.select("event_id", "user_id", "event_type")


# ---- benchmark results ---------------------------------------------------------------

ROLLUP = SCORE + """, m AS (
  SELECT model, avg(score) AS quality, avg(speed) AS speed, max(ram) AS max_ram, avg(ram) AS mean_ram,
         max(ram) - min(ram) AS ram_delta FROM sc GROUP BY 1),
cat AS (SELECT model, avg(score) FILTER (WHERE category = 'c0') AS c0, avg(score) FILTER (WHERE category = 'c1') AS c1,
               avg(score) FILTER (WHERE category = 'c2') AS c2, avg(score) FILTER (WHERE category = 'c3') AS c3
        FROM sc GROUP BY 1)"""
CATEGORIES = ["c0", "c1", "c2", "c3"]


@query(
    "benchmark_rollup",
    f"""WITH {ROLLUP} SELECT model, round(quality, 2) AS quality, CAST(floor(round(quality, 2) / 3 * 100) AS BIGINT)
          AS quality_pct, round(speed, 1) AS speed, max_ram, round(mean_ram, 2) AS mean_ram, round(ram_delta, 2) AS ram_delta,
          round(c0, 2) AS c0, round(c1, 2) AS c1, round(c2, 2) AS c2, round(c3, 2) AS c3 FROM m JOIN cat USING (model)""",
)
def _(spark, sf):
    return benchmark_rollup(scores(spark, sf), categories=CATEGORIES)


@query(
    "benchmark_compare",
    f"""WITH {ROLLUP}, r AS (SELECT model, round(quality, 2) AS quality, CAST(floor(round(quality, 2) / 3 * 100) AS BIGINT)
          AS quality_pct, round(speed, 1) AS speed, max_ram FROM m), b AS (SELECT * FROM r WHERE model = 'view')
        SELECT r.model, round(r.quality / r.max_ram, 6) AS quality_per_gb, r.quality_pct - b.quality_pct AS quality_diff,
               round(r.speed - b.speed, 6) AS speed_diff,
               r.model = (SELECT model FROM r ORDER BY quality DESC, model LIMIT 1) AS best_quality,
               r.model = (SELECT model FROM r ORDER BY speed DESC, model LIMIT 1) AS best_speed,
               r.model = (SELECT model FROM r ORDER BY max_ram, model LIMIT 1) AS least_ram FROM r, b""",
)
def _(spark, sf):
    return benchmark_compare(benchmark_rollup(scores(spark, sf), categories=CATEGORIES), base="view")
