"""Models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import query
from lodeline.catalog.fixtures import LAB, REQ, TEL, labeled, ntz, r6, requests, table, telemetry
from lodeline.catalog.telemetry import ROLL_COLS, rolled
from lodeline.catalog.timeline import PARENTS, load_series
from lodeline.functions.scalar import calendar_features, shape_features
from lodeline.operators import asof, metrics, ml, online_text, series, windows
from lodeline.operators.aggregates import exact_quantiles
from lodeline.session import stored, work_dir

TREES = 100
FEATURES = [f"{c}_{k}" for c in ROLL_COLS for k in ("std", "mean")] + ["texture_score", "gs_mean", "gs_spread"]


def surface_rows(spark, sf):
    shape = shape_features(*[F.col(c) for c in ROLL_COLS])
    df = rolled(spark, sf).withColumns({n: c for n, c in shape.items() if n in FEATURES})
    df = stored(df.select("kafka_offset", "surface_label", *FEATURES), "rolled")
    return stored(windows.stratified_split(df, key="kafka_offset", label="surface_label"), "surface")


def surface_model(rows):
    train = rows.filter(F.col("split") == "train")
    return ml.rf_classifier(train, features=FEATURES, label="surface_label", trees=TREES)


@query("rf_classifier_rows")
def rf_classifier_rows(spark, sf):
    rows = surface_rows(spark, sf)
    scored = ml.batch_score(surface_model(rows), rows.filter(F.col("split") == "test"), keep=["surface_label"])
    return metrics.classification_report(scored, label="surface_label", prediction="predicted")


@query("feature_importance_rows")
def feature_importance_rows(spark, sf):
    rows = surface_rows(spark, sf)
    return ml.feature_importance(surface_model(rows), FEATURES, spark).filter(F.col("rank") <= 10)


@query("save_load_model_rows")
def save_load_model_rows(spark, sf):
    rows = surface_rows(spark, sf)
    path = work_dir(spark, "model")
    ml.save_model(surface_model(rows), path)
    scored = ml.batch_score(ml.load_model(path), rows, keep=["kafka_offset", "surface_label"])
    return scored.groupBy("surface_label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("batch_score_rows")
def batch_score_rows(spark, sf):
    rows = surface_rows(spark, sf)
    scored = ml.batch_score(surface_model(rows), rows, keep=["kafka_offset", "surface_label"])
    return scored.withColumn("confidence", r6(F.col("confidence")))


@query(
    "classification_report",
    """WITH c AS (SELECT quality AS label, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
       x AS (SELECT label AS class, sum(n) AS support, sum(CASE WHEN label = p THEN n ELSE 0 END) AS tp FROM c GROUP BY 1),
       y AS (SELECT p AS class, sum(n) AS predicted FROM c GROUP BY 1),
       m AS (SELECT x.class, coalesce(tp / predicted, 0.0) AS pr, tp / support AS rc, support,
                    (SELECT sum(CASE WHEN label = p THEN n ELSE 0 END) / sum(n) FROM c) AS acc
             FROM x LEFT JOIN y USING (class))
       SELECT class, round(pr, 6) AS "precision", round(rc, 6) AS recall,
              round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1,
              CAST(support AS BIGINT) AS support, round(acc, 6) AS accuracy FROM m""",
)
def _(spark, sf):
    made = metrics.classification_report(table(spark, sf, "labels"), label="quality", prediction="toxic")
    return made.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    "retrain_gate",
    """WITH runs AS (SELECT event_type, max(ts) AS started, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20') AS n
                     FROM events GROUP BY 1),
       l AS (SELECT CAST(sum(n) AS BIGINT) AS rows_last FROM runs), w AS (SELECT count(*) AS rows_now FROM events)
       SELECT rows_now, rows_last, rows_now - rows_last AS rows_new, rows_now - rows_last >= 1500 AS train FROM w, l""",
)
def _(spark, sf):
    # The last run saw everything before the 20th.
    e = table(spark, sf, "events")
    runs = e.filter(F.col("ts") < "2024-01-20").agg(F.count(F.lit(1)).alias("total_rows"), F.max("ts").alias("started"))
    return metrics.retrain_gate(runs, e)


@query("leakage_gap_report_rows")
def leakage_gap_report_rows(spark, sf):
    req = requests(spark, sf)
    aggs = ("count", "mean", "max", "min", "std")
    honest = asof.asof_aggregates(req, ts="created", parents=PARENTS, cols=["k"], aggs=aggs, label="label")
    shortcut = req
    for p in PARENTS:
        shortcut = asof.feature_broadcast_back(shortcut, parent=p, cols=["k", "label"], aggs=aggs).drop(f"{p}__ROWS")
    return ml.leakage_gap_report(
        honest,
        shortcut,
        honest_features=["k", *(asof.feature_name(p, a, c) for p in PARENTS for c in ("k", "label") for a in aggs)],
        shortcut_features=["k", *(asof.feature_name(p, a, c) for p in PARENTS for c in ("k", "label") for a in aggs)],
        key="unique_key", order=["created"], label="label",
    )


def forecast_rows(spark, sf):
    df = load_series(spark, sf).fillna(0.0, ["mw"])
    keys = dict(keys=["event_type"], order=["ts"], value="mw")
    df = windows.rolling_mean(windows.lag_features(df, **keys), **keys)
    df = df.withColumns(calendar_features(F.col("ts"))).dropna(subset=["lag_1", "lag_24", "rolling_mean"])
    df = windows.chronological_split(df, order=["ts", "event_type"])
    rest = df.filter(F.col("split") == "train").drop("split")
    inner = windows.chronological_split(rest, order=["ts", "event_type"], test_size=0.15)
    valid = inner.filter(F.col("split") == "test").withColumn("split", F.lit("validation"))
    return stored(
        inner.filter(F.col("split") == "train").unionByName(valid).unionByName(df.filter(F.col("split") == "test")), "forecast"
    )


def forecast(spark, sf):
    """The scored test slice and the model, trained as the operator does by default."""
    rows = forecast_rows(spark, sf)
    model = ml.gbt_forecast(rows, target="mw")
    return model.transform(rows.filter(F.col("split") == "test")), model, rows


@query("gbt_forecast_rows")
def gbt_forecast_rows(spark, sf):
    scored, model, _ = forecast(spark, sf)
    spikes = series.spike_detect(scored.withColumnRenamed("prediction", "yhat"), keys=["event_type"])
    return spikes.select(
        "event_type", ntz("ts").alias("ts"), F.round("mw", 4).alias("mw"), F.round("yhat", 4).alias("yhat"), "is_spike",
        F.lit(model.n_rounds).alias("n_rounds"), F.lit(len(model.losses)).alias("n_tried"),
    )


@query(
    "linear_regression",
    """WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b FROM part)
       SELECT p_partkey, round(a * p_size + b, 4) AS prediction FROM part, f""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    model = ml.linear_regression(p, features=["p_size"], target="p_retailprice")
    return model.transform(p).select("p_partkey", F.round("prediction", 4).alias("prediction"))


# ---- online text ---------------------------------------------------------------------


def messages(spark, sf):
    """Labeled documents in order, with the phase by the median id."""
    lab = labeled(spark, sf).select("doc_id", "text", "quality")
    middle = exact_quantiles(lab, "doc_id", (0.5,)).select("q0").scalar()
    return lab.withColumn("phase", F.when(F.col("doc_id") < middle, "initial").otherwise("drift"))


PREQUENTIAL = LAB + """,
tk AS (SELECT doc_id, quality AS y, w, count(*) AS tf FROM (
         SELECT doc_id, quality, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM lab) WHERE w <> '' GROUP BY 1, 2, 3),
tw AS (SELECT *, coalesce(sum(tf) FILTER (WHERE y = 0) OVER w1, 0) AS n0, coalesce(sum(tf) FILTER (WHERE y = 1) OVER w1, 0) AS n1
       FROM tk WINDOW w1 AS (PARTITION BY w ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rw AS (SELECT l.doc_id, l.quality AS y, coalesce(t, 0) AS t, coalesce(fresh, 0) AS fresh FROM lab l LEFT JOIN
       (SELECT doc_id, sum(tf) AS t, count(*) FILTER (WHERE n0 + n1 = 0) AS fresh FROM tw GROUP BY 1) s USING (doc_id)),
tt AS (SELECT *, coalesce(sum(CASE WHEN y = 0 THEN t ELSE 0 END) OVER w2, 0) AS T0x, coalesce(sum(CASE WHEN y = 1 THEN t ELSE 0 END) OVER w2, 0) AS T1x,
         coalesce(sum(1 - y) OVER w2, 0) AS D0, coalesce(sum(y) OVER w2, 0) AS D1, coalesce(sum(fresh) OVER w2, 0) AS V
       FROM rw WINDOW w2 AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lk AS (SELECT w.doc_id,
         sum(tf * ln((n0 + 1.0) / greatest(T0x + V, 1.0))) AS a0, sum(tf * ln((n1 + 1.0) / greatest(T1x + V, 1.0))) AS a1,
         sum(tf * ln((n0 + (1 - t.y) * tf + 1.0) / greatest(T0x + (1 - t.y) * t + V + fresh, 1.0))) AS b0,
         sum(tf * ln((n1 + t.y * tf + 1.0) / greatest(T1x + t.y * t + V + fresh, 1.0))) AS b1
       FROM tw w JOIN tt t USING (doc_id) GROUP BY 1),
sc AS (SELECT doc_id, y, coalesce(a0, 0) + CASE WHEN D0 > 0 THEN ln(D0 / (D0 + D1)) END AS a0,
         coalesce(a1, 0) + CASE WHEN D1 > 0 THEN ln(D1 / (D0 + D1)) END AS a1,
         coalesce(b0, 0) + CASE WHEN D0 + 1 - y > 0 THEN ln((D0 + 1 - y) / (D0 + D1 + 1)) END AS b0,
         coalesce(b1, 0) + CASE WHEN D1 + y > 0 THEN ln((D1 + y) / (D0 + D1 + 1)) END AS b1 FROM tt LEFT JOIN lk USING (doc_id))"""


@query(
    "prequential_naive_bayes",
    f"""WITH {PREQUENTIAL}, o AS (SELECT doc_id, y AS quality, round(a0, 4) AS pre_score0, round(a1, 4) AS pre_score1,
          round(b0, 4) AS post_score0, round(b1, 4) AS post_score1,
          CASE WHEN a1 IS NOT NULL AND (a0 IS NULL OR a1 > a0) THEN 1 ELSE 0 END AS pre_pred,
          CASE WHEN b1 IS NOT NULL AND (b0 IS NULL OR b1 > b0) THEN 1 ELSE 0 END AS post_pred FROM sc)
        SELECT *, pre_pred <> post_pred AS changed FROM o""",
)
def prequential(spark, sf):
    made = online_text.prequential_nb(labeled(spark, sf), order="doc_id", text="text", label="quality")
    return made.withColumns({c: F.round(c, 4) for c in ("pre_score0", "pre_score1", "post_score0", "post_score1")})


# Counts of all words of the first half, then the messages scored with them.
BATCH = LAB + """,
mid AS (SELECT quantile_cont(doc_id, 0.5) AS m FROM lab),
ms AS (SELECT doc_id, quality, CASE WHEN doc_id < m THEN 'initial' ELSE 'drift' END AS phase, text FROM lab, mid),
bt AS (SELECT doc_id, quality, phase, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM ms),
bc AS (SELECT w, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1) AS n1
       FROM bt WHERE phase = 'initial' AND w <> '' GROUP BY 1),
bs AS (SELECT sum(n0) AS c0, sum(n1) AS c1, count(*) AS v,
         (SELECT count(*) FILTER (WHERE quality = 0) FROM ms WHERE phase = 'initial') AS d0,
         (SELECT count(*) FILTER (WHERE quality = 1) FROM ms WHERE phase = 'initial') AS d1 FROM bc),
bl AS (SELECT doc_id, sum(ln((n0 + 1.0) / (c0 + v))) AS s0, sum(ln((n1 + 1.0) / (c1 + v))) AS s1 FROM bt JOIN bc USING (w), bs GROUP BY 1),
bp AS (SELECT ms.doc_id, quality, phase, coalesce(s0, 0) + ln(d0 / (d0 + d1)) AS s0, coalesce(s1, 0) + ln(d1 / (d0 + d1)) AS s1
       FROM ms LEFT JOIN bl USING (doc_id), bs),
bn AS (SELECT doc_id, quality, phase, CAST(s1 > s0 AS INTEGER) AS batch_pred, 1 / (1 + exp(-abs(s1 - s0))) AS batch_confidence FROM bp)"""


@query(
    "batch_naive_bayes",
    f"WITH {BATCH} SELECT doc_id, quality, phase, batch_pred, round(batch_confidence, 6) AS batch_confidence FROM bn",
)
def batch_nb(spark, sf):
    m = messages(spark, sf)
    made = online_text.batch_naive_bayes(
        m.filter(F.col("phase") == "initial"), m, order="doc_id", text="text", label="quality", keep=["doc_id", "quality", "phase"]
    )
    return made.withColumn("batch_confidence", r6(F.col("batch_confidence")))


@query(
    "drift_scoreboard",
    f"""WITH {PREQUENTIAL}, {BATCH.removeprefix(LAB + ",")}, o AS (SELECT doc_id, y,
          CASE WHEN a1 IS NOT NULL AND (a0 IS NULL OR a1 > a0) THEN 1 ELSE 0 END AS pre,
          CASE WHEN b1 IS NOT NULL AND (b0 IS NULL OR b1 > b0) THEN 1 ELSE 0 END AS post FROM sc)
        SELECT phase, count(*) AS messages, round(avg(CAST(batch_pred = y AS INTEGER)), 6) AS batch_accuracy,
               round(avg(CAST(pre = y AS INTEGER)), 6) AS online_accuracy,
               round(avg(CAST(post = y AS INTEGER)), 6) AS online_accuracy_after_learning,
               CAST(count(*) FILTER (WHERE batch_pred <> y) AS BIGINT) AS batch_missed,
               CAST(count(*) FILTER (WHERE post = y) AS BIGINT) AS correct_after_learning,
               CAST(count(*) FILTER (WHERE pre <> post) AS BIGINT) AS updates
        FROM o JOIN bn USING (doc_id) GROUP BY 1""",
)
def _(spark, sf):
    online = online_text.prequential_nb(labeled(spark, sf), order="doc_id", text="text", label="quality")
    made = online_text.drift_scoreboard(online, batch_nb(spark, sf).drop("quality"), order="doc_id", label="quality", phase="phase")
    return made.withColumns({c: r6(F.col(c)) for c in made.columns if "accuracy" in c})
