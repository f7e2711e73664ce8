"""Point-in-time features, series, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import (
    ARRIVAL,
    ARRIVAL_SQL,
    LAB,
    LOAD,
    RAW,
    REQ,
    labeled,
    load_points,
    ntz,
    r6,
    raw_ratings,
    requests,
    table,
)
from lodeline.operators import asof, metrics, series, windows

AGGS = ("count", "mean", "max", "min", "std")
SQL_AGG = {
    "count": "count({c})",
    "mean": "avg({c})",
    "max": "max({c})",
    "min": "min({c})",
    "std": "stddev_samp({c})",
}
PARENTS = ("user_id", "event_type")


def _feature_sql(days: int, delay_hours: int) -> str:
    """Window form of the as-of aggregates; frames are whole microseconds."""
    length = days * 86_400_000_000 - 1
    delay = delay_hours * 3_600_000_000
    parts = []
    for p in PARENTS:
        for c in ("value", "k", "label"):
            end = f"INTERVAL {delay} MICROSECONDS PRECEDING" if c == "label" and delay else "CURRENT ROW"
            over = (
                f"OVER (PARTITION BY {p} ORDER BY created RANGE BETWEEN INTERVAL {length} MICROSECONDS PRECEDING AND {end})"
            )
            for a in AGGS:
                e = SQL_AGG[a].format(c=c) + " " + over
                e = f"round({e} + 1e-9, 6)" if a in ("mean", "std") else e
                parts.append(f"{e} AS {p}__{a.upper()}__{c}")
    return f"WITH {REQ} SELECT unique_key, {', '.join(parts)} FROM req"


def asof_features(spark, sf, **kw):
    made = asof.asof_aggregates(
        requests(spark, sf), ts="created", parents=PARENTS, cols=["value", "k"], label="label", **kw
    )
    names = [asof.feature_name(p, a, c) for p in PARENTS for c in ("value", "k", "label") for a in AGGS]
    # Means of few two-digit values often end in an exact half; the offset settles those.
    rounded = [r6(F.col(n) + 1e-9).alias(n) if "__MEAN__" in n or "__STD__" in n else F.col(n) for n in names]
    return made.select("unique_key", *rounded)


@query("asof_aggregates", _feature_sql(30, 24))
def _(spark, sf):
    return asof_features(spark, sf)


@query("asof_aggregates_7d", _feature_sql(7, 24))
def _(spark, sf):
    return asof_features(spark, sf, window="7d")


@query("asof_aggregates_parity", _feature_sql(30, 0))
def _(spark, sf):
    return asof_features(spark, sf, label_delay=None)


@query(
    "asof_window_join",
    f"""WITH {REQ}, cut AS (SELECT DISTINCT user_id, date_trunc('day', created) + INTERVAL 12 HOUR AS cutoff FROM req)
        SELECT c.user_id, c.cutoff, count(r.value) AS user_id__COUNT__value, round(avg(r.value), 6) AS user_id__MEAN__value,
               max(r.value) AS user_id__MAX__value
        FROM cut c LEFT JOIN req r ON r.user_id = c.user_id AND r.created <= c.cutoff
             AND r.created > c.cutoff - INTERVAL 7 DAY GROUP BY 1, 2""",
)
def _(spark, sf):
    req = requests(spark, sf)
    cut = F.date_trunc("day", "created") + F.expr("interval 12 hours")
    cutoffs = req.select("user_id", cut.alias("cutoff")).distinct()
    made = asof.asof_window_join(
        cutoffs, req, key="user_id", cutoff_ts="cutoff", ts="created", cols=["value"], aggs=("count", "mean", "max"),
        window="7d",
    )
    return made.withColumns({"cutoff": ntz("cutoff"), "user_id__MEAN__value": r6(F.col("user_id__MEAN__value"))})


@query(
    "parent_aggregates",
    f"""WITH {REQ} SELECT user_id, count(*) AS user_id__ROWS, {", ".join(
        (f"round({SQL_AGG[a].format(c=c)}, 6)" if a in ("mean", "std") else SQL_AGG[a].format(c=c))
        + f" AS user_id__{a.upper()}__{c}" for c in ("value", "k") for a in AGGS)} FROM req GROUP BY 1""",
)
def _(spark, sf):
    made = asof.parent_aggregates(requests(spark, sf), parent="user_id", cols=["value", "k"])
    return made.withColumns({n: r6(F.col(n)) for n in made.columns if "__MEAN__" in n or "__STD__" in n})


@query(
    "align_target",
    f"""WITH {REQ} SELECT unique_key, value, k, label FROM req""",
)
def _(spark, sf):
    req = requests(spark, sf)
    return asof.align_target(req.select("unique_key", "value", "k"), req, key="unique_key", label="label")


@query(
    "feature_broadcast_back",
    f"""WITH {REQ}, a AS (SELECT event_type, count(label) AS n, avg(label) AS m, max(value) AS x FROM req GROUP BY 1)
        SELECT unique_key, n AS event_type__COUNT__label, round(m, 6) AS event_type__MEAN__label
        FROM req JOIN a USING (event_type)""",
)
def _(spark, sf):
    made = asof.feature_broadcast_back(requests(spark, sf), parent="event_type", cols=["label"], aggs=("count", "mean"))
    return made.select("unique_key", "event_type__COUNT__label", r6(F.col("event_type__MEAN__label")).alias("event_type__MEAN__label"))


WALK = REQ + """, o AS (SELECT *, row_number() OVER (ORDER BY created, unique_key) - 1 AS i, count(*) OVER () AS n FROM req),
s AS (SELECT *, n // 6 AS step FROM o), f AS (SELECT unnest(range(0, 5)) AS fold)"""


@query(
    "walk_forward_folds",
    f"""WITH {WALK} SELECT CAST(fold AS INTEGER) AS fold,
          count(*) FILTER (WHERE i < n - (5 - fold) * step) AS train_rows,
          CAST(sum(label) FILTER (WHERE i < n - (5 - fold) * step) AS BIGINT) AS train_positive,
          count(*) FILTER (WHERE i >= n - (5 - fold) * step AND i < n - (4 - fold) * step) AS test_rows,
          CAST(sum(label) FILTER (WHERE i >= n - (5 - fold) * step AND i < n - (4 - fold) * step) AS BIGINT) AS test_positive,
          TRUE AS usable FROM s, f GROUP BY fold""",
)
def _(spark, sf):
    made = windows.walk_forward_folds(requests(spark, sf), order=["created", "unique_key"], label="label")
    return made.withColumns({c: F.col(c).cast("long") for c in ("train_rows", "train_positive")})


@query(
    "roc_auc",
    f"""WITH {REQ}, r AS (SELECT event_type, label, rank() OVER (PARTITION BY event_type ORDER BY k)
            + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS rk FROM req)
        SELECT event_type, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positive,
               round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0)
                     / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r GROUP BY 1""",
)
def _(spark, sf):
    made = metrics.roc_auc(requests(spark, sf), score="k", label="label", keys=["event_type"])
    return made.withColumn("auc", r6(F.col("auc")))


# ---- series --------------------------------------------------------------------------


def load_series(spark, sf):
    return series.gap_fill(load_points(spark, sf), keys=["event_type"])


@query("forward_fill", f"""WITH {LOAD} SELECT event_type, ts, round(last_value(mw IGNORE NULLS) OVER
    (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mw FROM ld""")
def _(spark, sf):
    from lodeline.operators.clean import forward_fill

    df = forward_fill(load_series(spark, sf), keys=["event_type"], order=["ts"], cols=["mw"])
    return df.select("event_type", ntz("ts").alias("ts"), r6(F.col("mw")).alias("mw"))


@query("lag_features", f"""WITH {LOAD} SELECT event_type, ts, round(lag(mw, 1) OVER w, 6) AS lag_1,
    round(lag(mw, 24) OVER w, 6) AS lag_24 FROM ld WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def _(spark, sf):
    df = windows.lag_features(load_series(spark, sf), keys=["event_type"], order=["ts"], value="mw")
    return df.select("event_type", ntz("ts").alias("ts"), *[r6(F.col(c)).alias(c) for c in ("lag_1", "lag_24")])


@query("rolling_mean_full", f"""WITH {LOAD} SELECT event_type, ts, CASE WHEN count(mw) OVER w = 7
    THEN round(avg(mw) OVER w, 6) END AS rolling_mean FROM ld
    WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    df = windows.rolling_mean(load_series(spark, sf), keys=["event_type"], order=["ts"], value="mw")
    return df.select("event_type", ntz("ts").alias("ts"), r6(F.col("rolling_mean")).alias("rolling_mean"))


@query("expanding_mean", f"""WITH {LAB} SELECT doc_id, round(avg(quality) OVER w, 6) AS model_a,
    round(avg(1 - toxic) OVER w, 6) AS model_b FROM lab
    WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    values = {"model_a": F.col("quality"), "model_b": 1 - F.col("toxic")}
    df = windows.expanding_mean(labeled(spark, sf).drop("text"), order=["doc_id"], values=values)
    return df.select("doc_id", *[r6(F.col(c)).alias(c) for c in values])


@query("cumulative_events", f"""WITH {LAB} SELECT doc_id, CAST(sum(CAST(quality <> toxic AS INTEGER)) OVER
    (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS events_so_far FROM lab""")
def _(spark, sf):
    lab = labeled(spark, sf).drop("text")
    df = windows.cumulative_events(lab, order=["doc_id"], event=F.col("quality") != F.col("toxic"))
    return df.select("doc_id", "events_so_far")


@query(
    "hourly_spine",
    """WITH e AS (SELECT event_type, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY 1)
       SELECT event_type, unnest(generate_series(hi + INTERVAL 1 HOUR, hi + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS ts FROM e""",
)
def _(spark, sf):
    ends = load_points(spark, sf).groupBy("event_type").agg(F.max("ts").alias("hi"))
    return series.hourly_spine(ends, keys=["event_type"], start="hi", hours=24).withColumn("ts", ntz("ts"))


@query(
    "chronological_split",
    f"""WITH {LOAD}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event_type) AS i, count(*) OVER () AS n FROM ld)
        SELECT event_type, ts, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o""",
)
def _(spark, sf):
    df = windows.chronological_split(load_series(spark, sf), order=["ts", "event_type"])
    return df.select("event_type", ntz("ts").alias("ts"), "split")


@query(
    "spike_detect",
    f"""WITH {LOAD}, x AS (SELECT event_type, ts, coalesce(mw, 0) AS mw FROM ld),
        s AS (SELECT event_type, stddev_pop(mw) AS sd, avg(mw) AS m FROM x GROUP BY 1)
        SELECT event_type, ts, round(mw + sd, 6) AS upper, mw + sd > m * 1.5 AS is_spike FROM x JOIN s USING (event_type)""",
)
def _(spark, sf):
    df = load_series(spark, sf).fillna(0.0, ["mw"])
    made = series.spike_detect(df, value="mw", keys=["event_type"])
    return made.select("event_type", ntz("ts").alias("ts"), r6(F.col("upper")).alias("upper"), "is_spike")


@query(
    "regression_metrics",
    """WITH x AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT count(*) AS rows, round(avg(abs(p - y)), 4) AS mae, round(avg((p - y) * (p - y)), 1) AS mse,
              round(sqrt(avg((p - y) * (p - y))), 4) AS rmse FROM x""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    df = li.join(p, "p_partkey").withColumn("fit", F.col("l_quantity") * F.col("p_retailprice"))
    made = metrics.regression_metrics(df, actual="l_extendedprice", predicted="fit")
    return made.select("rows", F.round("mae", 4).alias("mae"), F.round("mse", 1).alias("mse"), F.round("rmse", 4).alias("rmse"))


# ---- holdouts ------------------------------------------------------------------------


@query(
    "nth_per_user_split",
    f"""WITH {RAW} SELECT *, CASE WHEN row_number() OVER (PARTITION BY "user" ORDER BY {ARRIVAL_SQL}) BETWEEN 1 AND 10
          THEN 'test' ELSE 'base' END AS split FROM raw""",
)
def _(spark, sf):
    df = windows.nth_per_user_split(raw_ratings(spark, sf), user="user", order=ARRIVAL, start=1, stop=10)
    return df.drop("pos").withColumns({"ts": ntz("ts"), "ship": ntz("ship")})


HELD = f"""held AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, ord DESC, line DESC, price DESC,
    ship DESC, item DESC, rating DESC) AS back, count(*) OVER (PARTITION BY "user") AS size FROM raw)"""
TIME_ORDER = ["ts", *ARRIVAL]


@query(
    "last_n_holdout",
    f"""WITH {RAW}, {HELD} SELECT "user", item, rating, ord, line, size > 5 AND back <= 5 AS held FROM held""",
)
def _(spark, sf):
    df = windows.last_n_holdout(raw_ratings(spark, sf), user="user", order=TIME_ORDER, n=5)
    return df.select("user", "item", "rating", "ord", "line", "held")


@query(
    "contiguous_kfold",
    f"""WITH {RAW} SELECT "user", item, ord, line, price, CAST(ntile(5) OVER (ORDER BY {ARRIVAL_SQL}) AS INTEGER) AS fold FROM raw""",
)
def _(spark, sf):
    return windows.kfold(raw_ratings(spark, sf), order=ARRIVAL).select("user", "item", "ord", "line", "price", "fold")


@query(
    "stratified_split",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS i,
                         count(*) OVER (PARTITION BY quality) AS n FROM labels)
       SELECT doc_id, quality, CASE WHEN i <= ceil(round(0.2 * n, 6)) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def _(spark, sf):
    df = windows.stratified_split(table(spark, sf, "labels"), key="doc_id", label="quality")
    return df.select("doc_id", "quality", "split")
