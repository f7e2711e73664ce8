"""What must hold of results that SQL cannot give: row sets, sizes, sums and bounds, checked over whole tables.

Each query here runs the operator as its ``_rows`` query does and derives from all of its rows what SQL
can tell in advance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeline.catalog import ORACLE, query
from lodeline.catalog import context, learning, telemetry
from lodeline.catalog.fixtures import LOAD, ntz, table
from lodeline.operators import ml
from lodeline.session import stored, work_dir

ROUNDS, PATIENCE = 1000, 50

ORACLE["query_subgraph"] = ORACLE["subgraph_of_source"]

# Readings with ten in their session so far; their label is the session's.
FULL = f"{telemetry.ROLL_CTE}, fr AS (SELECT r.kafka_offset, t.surface_label FROM roll r JOIN tel t USING (kafka_offset) WHERE pos >= 10)"
TELEMETRY = f"WITH {FULL} SELECT kafka_offset, surface_label"


@query("batch_score", f"{TELEMETRY}, TRUE AS known_label, TRUE AS in_bounds FROM fr")
def _(spark, sf):
    """Every row is scored with a label that occurs, surer than a guess."""
    rows = learning.surface_rows(spark, sf)
    names = [r[0] for r in rows.select("surface_label").distinct().limit(1_000).collect()]
    scored = ml.batch_score(learning.surface_model(rows), rows, keep=["kafka_offset", "surface_label"])
    bounds = F.col("confidence").between(1 / len(names) - 1e-9, 1 + 1e-9)
    return scored.select("kafka_offset", "surface_label", F.col("predicted").isin(names).alias("known_label"), bounds.alias("in_bounds"))


@query("save_load_model", f"{TELEMETRY}, TRUE AS same FROM fr")
def _(spark, sf):
    """A model read back scores every row as before."""
    rows = learning.surface_rows(spark, sf)
    model, path = learning.surface_model(rows), work_dir(spark, "model")
    ml.save_model(model, path)
    of = lambda m, n: ml.batch_score(m, rows, keep=["kafka_offset", "surface_label"]).select(
        "kafka_offset", "surface_label", F.struct("predicted", "confidence").alias(n)
    )
    both = of(model, "a").join(of(ml.load_model(path), "b").drop("surface_label"), "kafka_offset")
    return both.select("kafka_offset", "surface_label", (F.col("a") == F.col("b")).alias("same"))


@query("feature_importance", f"SELECT {len(learning.FEATURES)} AS features, CAST(1 AS DOUBLE) AS total, TRUE AS ranked, TRUE AS positive FROM (SELECT count(*) FROM events)")
def _(spark, sf):
    """Importances of all features are shares of one, ranked from the highest."""
    rows = learning.surface_rows(spark, sf)
    made = ml.feature_importance(learning.surface_model(rows), learning.FEATURES, spark)
    above = made.select((F.col("rank") + 1).alias("rank"), F.col("importance").alias("before"))
    return made.join(above, "rank", "left").agg(
        F.count("*").cast("int").alias("features"),
        F.round(F.sum("importance"), 9).alias("total"),
        F.bool_and(F.coalesce(F.col("before") >= F.col("importance"), F.lit(True))).alias("ranked"),
        F.bool_and(F.col("importance") >= 0).alias("positive"),
    )


@query(
    "rf_classifier",
    f"""WITH {FULL}, c AS (SELECT surface_label, count(*) AS n FROM fr GROUP BY 1)
        SELECT surface_label, CAST(ceil(round(0.2 * n, 6)) AS BIGINT) AS tested, TRUE AS known_label, TRUE AS beats_guess FROM c""",
)
def _(spark, sf):
    """The test part of each label, and whether the forest is right more often than an even guess."""
    rows = learning.surface_rows(spark, sf)
    model = learning.surface_model(rows)
    names = [r[0] for r in rows.select("surface_label").distinct().limit(1_000).collect()]
    scored = ml.batch_score(model, rows.filter(F.col("split") == "test"), keep=["surface_label"])
    right = scored.agg(F.avg((F.col("predicted") == F.col("surface_label")).cast("int")).alias("right"))
    per = scored.groupBy("surface_label").agg(F.count("*").alias("tested"), F.bool_and(F.col("predicted").isin(names)).alias("known_label"))
    return per.select("*", (right.scalar() > 0.9 / len(names)).alias("beats_guess"))


SETTINGS = "VALUES ('honest', 0), ('honest', 1), ('honest', 2), ('honest', 3), ('honest', 4), ('shortcut', 0), ('shortcut', 1), ('shortcut', 2)"


@query(
    "leakage_gap_report",
    f"""SELECT setting, CAST(fold AS INTEGER) AS fold, TRUE AS in_bounds, TRUE AS adds_up FROM ({SETTINGS}) t(setting, fold)
        UNION ALL SELECT s, NULL, TRUE, TRUE FROM (VALUES ('honest'), ('shortcut'), ('gap')) m(s) WHERE (SELECT count(*) FROM events) > 0""",
)
def _(spark, sf):
    """Every fold of both settings, areas within bounds, means and their gap as the folds say."""
    made = stored(learning.leakage_gap_report_rows(spark, sf), "report")
    folds = made.where("fold is not null").groupBy("setting").agg(F.avg("auc").alias("mean"))
    gap = folds.agg(F.sum(F.when(F.col("setting") == "shortcut", F.col("mean")).otherwise(-F.col("mean"))).alias("mean"))
    means = folds.unionByName(gap.select(F.lit("gap").alias("setting"), "mean"))
    adds = F.abs(F.col("auc") - F.col("mean")) < 1e-9
    low = F.when(F.col("setting") == "gap", -1).otherwise(0)
    return made.join(means, "setting").select(
        "setting", "fold", F.col("auc").between(low, F.lit(1)).alias("in_bounds"), (F.col("fold").isNotNull() | adds).alias("adds_up")
    )


@query(
    "gbt_forecast",
    f"""WITH {LOAD}, x AS (SELECT event_type, ts, coalesce(mw, 0) AS mw, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM ld),
        o AS (SELECT *, row_number() OVER (ORDER BY ts, event_type) AS j, count(*) OVER () AS n FROM x WHERE i > 24)
        SELECT event_type, ts, round(mw, 4) AS mw, TRUE AS predicted, TRUE AS rounds_ok, TRUE AS improves FROM o WHERE j > floor(n * 0.8)""",
)
def _(spark, sf):
    """All rows of the test slice are predicted; training ended at its limit or its patience after the best round."""
    scored, model, _ = learning.forecast(spark, sf)
    tried = len(model.losses)
    ended = tried == ROUNDS or tried == model.n_rounds + PATIENCE
    return scored.select(
        "event_type", ntz("ts").alias("ts"), F.round("mw", 4).alias("mw"), F.col("prediction").isNotNull().alias("predicted"),
        F.lit(ended and 1 <= model.n_rounds <= ROUNDS).alias("rounds_ok"), F.lit(model.best_loss < model.losses[0]).alias("improves"),
    )


@query(
    "embed_documents",
    r"SELECT doc_id, 1024 AS numbers, CASE WHEN regexp_matches(text, '\S') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM documents",
)
def _(spark, sf):
    """A vector of unit length for every text with a word."""
    from lodeline.functions import vectors as vx
    from lodeline.operators import vectors as vec

    made = vec.embed_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.size("embedding").alias("numbers"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


@query(
    "retrieve_topk_sources",
    """SELECT b.item_id AS query, CAST(r AS INTEGER) AS rank, TRUE AS in_bounds, TRUE AS falling, TRUE AS content_ok
       FROM benchmark b, generate_series(1, least(3, (SELECT count(*) FROM documents))) g(r)""",
)
def _(spark, sf):
    """Three sources per query by falling score, each with the start of its own text."""
    made = stored(context.retrieve_topk_sources_rows(spark, sf), "retrieved")
    above = made.select("query", (F.col("rank") + 1).alias("rank"), F.col("score").alias("before"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    start = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return made.join(above, ["query", "rank"], "left").join(texts, "id").select(
        "query", "rank", F.col("score").between(-1e-6, 1 + 1e-6).alias("in_bounds"),
        F.coalesce(F.col("before") >= F.col("score"), F.lit(True)).alias("falling"), F.col("content").eqNullSafe(start).alias("content_ok"),
    )


@query(
    "list_files",
    """SELECT CAST(sum(ceil(n / 64)) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes
       FROM (SELECT source, count(*) AS n, sum(strlen(text) + 1) AS b FROM documents GROUP BY 1)""",
)
def _(spark, sf):
    """Files of at most 64 texts of one source each, as listed."""
    listed = telemetry.readers.list_files(spark, _by_source(spark, sf), glob="*.txt")
    return listed.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    "scan_documents_dir",
    """SELECT CAST(sum(ceil(n / 64)) AS BIGINT) AS files, CAST(sum(c) AS BIGINT) AS chars, TRUE AS all_named
       FROM (SELECT source, count(*) AS n, sum(length(text) + 1) AS c FROM documents GROUP BY 1)""",
)
def _(spark, sf):
    """The same files read whole, with their original names."""
    path = _by_source(spark, sf)
    names = telemetry.readers.list_files(spark, path).select(F.col("name").alias("file")).distinct()
    names = names.withColumn("original", F.concat(F.lit("upload-"), "file"))
    read = telemetry.readers.scan_documents_dir(spark, f"{path}/*", names)
    return read.agg(
        F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.bool_and(F.col("original").startswith("upload-")).alias("all_named")
    )


def _by_source(spark, sf) -> str:
    """The documents as text files of at most 64 texts, the texts of a source from one task."""
    path = work_dir(spark, "source-files")
    docs = table(spark, sf, "documents").select("source", "text").repartition("source")
    docs.write.option("maxRecordsPerFile", 64).partitionBy("source").text(path)
    return path
