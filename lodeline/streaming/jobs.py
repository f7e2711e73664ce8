"""Streaming forms of the telemetry, memory and text jobs.

Every job takes a streaming DataFrame, writes files with a checkpoint, and returns the
running query. With ``available_now`` it handles what is there and stops; a scheduler may
run it again, and the checkpoint continues where the last run ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeline.functions.scalar import partition_fields
from lodeline.functions.text import words
from lodeline.operators import online_text
from lodeline.operators.context import CONFIDENCE_BAND, LOSER_CAP, beats
from lodeline.operators.online_text import token_counts
from lodeline.session import stored
from lodeline.sources.readers import flatten_events


MAX_KEYWORDS = 1_000


def _start(writer, checkpoint: str, available_now: bool, every: str):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def write_files(
    stream: DataFrame, path: str, checkpoint: str, *, fields: Sequence[str] = (), available_now: bool = True, every: str = "1 minute"
):
    """Append to Parquet folders; the checkpoint makes each micro-batch appear exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if fields:
        writer = writer.partitionBy(*fields)
    return _start(writer, checkpoint, available_now, every)


def sink_partitioned(stream: DataFrame, path: str, checkpoint: str, **kw):
    """Write below ``dt=YYYY-MM-DD/hr=HH`` by processing time (UTC)."""
    return write_files(stream.withColumns(partition_fields(F.current_timestamp())), path, checkpoint, fields=["dt", "hr"], **kw)


def bronze_ingest(messages: DataFrame, path: str, checkpoint: str, **kw):
    """JSON messages to flat bronze rows below dt/hr folders; bad messages stay, marked in ``problem``."""
    return sink_partitioned(flatten_events(messages), path, checkpoint, **kw)


def dedup_offsets(
    stream: DataFrame, *, ts: str, keys: Sequence[str] = ("kafka_partition", "kafka_offset"), within: str = "1 day"
) -> DataFrame:
    """One row per (partition, offset). State is kept for ``within`` after a row's event time,
    which must cover the longest replay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def hourly_windows(
    stream: DataFrame, *, key: str, ts: str, distance: str, temp: str, status: str, near: str = "obstacle_near", late: str = "1 hour"
) -> DataFrame:
    """The hourly rollup as tumbling windows. Rows later than ``late`` are dropped by the watermark."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key)
    made = grouped.agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.avg(distance).alias("avg_distance_cm"),
        F.min(distance).alias("min_distance_cm"),
        F.avg(temp).alias("avg_cpu_temp"),
        F.max(temp).alias("max_cpu_temp"),
        F.count_if(F.col(status) == near).alias("near_obstacle_count"),
    )
    return made.select(key, F.col("window.start").alias("hour"), *[c for c in made.columns if c not in ("window", key)])


def write_updates(stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, every: str = "1 minute"):
    """Write the groups each micro-batch changed to ``batch=<id>`` folders.

    A repeated micro-batch overwrites its own folder. Only changed groups are written, so
    the work does not grow with the table; read with ``latest_updates``.
    """

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream.writeStream.outputMode("update").foreachBatch(save), checkpoint, available_now, every)


def latest_updates(spark, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest version of every group written by ``write_updates``."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select(*keys, "v.*")


# Frames of rolling features that are worked out at a time.
FRAMES = 50_000
# States that the sessions of a stream share.
BUCKETS = 128


def _frames(values: np.ndarray, ends: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample deviation and mean of the ``rows`` values up to each of ``ends``, per column; infinite values count as missing."""
    lo = ends[0] - rows + 1
    some = values[lo : ends[-1] + 1]
    frames = np.lib.stride_tricks.sliding_window_view(np.where(np.isinf(some), np.nan, some), rows, axis=0)[ends - ends[0]]
    mean = frames.mean(axis=2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(((frames - mean[:, :, None]) ** 2).sum(axis=2) / (rows - 1)), mean


def _packed(df: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(df, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def rolling_features(
    stream: DataFrame, *, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], rows: int = 10,
    idle: str | None = None, late: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Stddev and mean of the last ``rows`` readings of a session, from the ``rows``-th on.

    The state of a session is its last ``rows - 1`` readings with their times. With ``idle``
    a session starts anew after a pause of that length, and its state is removed once the
    watermark has passed. With ``late`` readings may arrive out of order by up to that much
    event time, however files and micro-batches cut them: they wait in the state until the
    watermark has passed them. Without it a micro-batch must not hold readings older than
    those already seen of the session.

    Sessions share ``buckets`` states by a hash of their keys: a call handles all sessions of a bucket as arrays,
    since a call per session costs more than its few readings. The number belongs to the checkpoint.
    """
    names = [f"{c}_{k}" for c in cols for k in ("std", "mean")]
    fields = {f.name: f for f in stream.schema.fields}
    # Python holds whole numbers with gaps as doubles, so missing ones are marked beside them.
    marks = {k: f"_no_{k}" for k in keys if isinstance(fields[k].dataType, T.IntegralType)}
    ids = [*keys, *marks.values()]
    out_schema = T.StructType(
        [fields[k] for k in keys] + [T.StructField(m, T.BooleanType()) for m in marks.values()] + [fields[order[-1]]]
        + [T.StructField(n, T.DoubleType()) for n in [*names, "texture_score"]]
    )
    state_schema = T.StructType([T.StructField("readings", T.BinaryType())])
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    order, cols, last = list(order), list(cols), order[-1]
    # Keys, columns and the last of ``order`` may share names.
    values, slots = [f"_v{i}" for i in range(len(cols))], [f"_k{i}" for i in range(len(ids))]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                made = {n: pdf[k] for n, k in zip(slots, ids)}
                made["_ms"] = pdf[order[0]].to_numpy().astype("datetime64[us]").astype(np.int64) / 1000.0
                made |= {"_last": pdf[last], "_seen": False, **{n: pdf[c].to_numpy(np.float64) for n, c in zip(values, cols)}}
                parts.append(pd.DataFrame(made))
        parts = [p for p in parts if len(p)]
        if not parts:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs() if late or idle else 0
        passed = watermark if late else float("inf")
        every = pd.concat(parts, ignore_index=True)
        waiting = every[~every["_seen"]].sort_values(["_ms", "_last"], kind="stable")
        held, new = waiting[waiting["_ms"] >= passed], waiting[waiting["_ms"] < passed]
        ready = pd.concat([every[every["_seen"]], new], ignore_index=True)
        code = ready.groupby(slots, dropna=False, sort=False).ngroup().to_numpy()
        by_session = np.argsort(code, kind="stable")
        ready, code = ready.iloc[by_session].reset_index(drop=True), code[by_session]
        n = np.arange(len(ready))
        is_first = np.diff(code, prepend=-1) != 0
        ends = np.append(np.flatnonzero(is_first)[1:], len(ready))
        end = ends[np.cumsum(is_first) - 1] if len(ready) else n
        fresh, ms = is_first.copy(), ready["_ms"].to_numpy()
        if idle_ms:
            # A pause longer than ``idle`` starts the session anew; no frame may reach across it.
            fresh |= np.diff(ms, prepend=ms[:1]) > idle_ms
        place = n - np.maximum.accumulate(np.where(fresh, n, 0))
        full = np.flatnonzero((place >= rows - 1) & ~ready["_seen"].to_numpy(bool))

        keep = end - n <= rows - 1
        if idle_ms:
            # Sessions whose pause is over, unless readings of theirs wait.
            wait = set(held[slots].astype(object).itertuples(index=False, name=None))
            over = keep & (ms[np.maximum(end - 1, 0)] + idle_ms < watermark)
            for i in np.flatnonzero(over):
                over[i] = tuple(ready.loc[i, slots].astype(object)) not in wait
            keep &= ~over
        kept = ready[keep].assign(_seen=True)
        due = []
        if len(held):
            due.append(int(max(passed, held["_ms"].iloc[0])) + 1)
        if idle_ms and keep.any():
            due.append(max(int(ms[keep & (n == end - 1)].min()) + idle_ms, watermark + 1))
        if len(kept) or len(held):
            state.update((_packed(pd.concat([p for p in (kept, held) if len(p)], ignore_index=True)),))
            if due:
                state.setTimeoutTimestamp(min(due))
        else:
            state.remove()

        readings = ready[values].to_numpy(np.float64)
        # ``FRAMES`` rows at a time have all their frames in memory.
        for lo in range(0, len(full), FRAMES):
            at = full[lo : lo + FRAMES]
            std, mean = _frames(readings, at, rows)
            some = ready.iloc[at]
            made = {k: some[n].to_numpy() for n, k in zip(slots, ids)} | {last: some["_last"].to_numpy()}
            for i, c in enumerate(cols):
                made[f"{c}_std"], made[f"{c}_mean"] = std[:, i], mean[:, i]
            known = ~np.isnan(std)
            with np.errstate(invalid="ignore"):
                made["texture_score"] = np.where(known, std, 0.0).sum(axis=1) / known.sum(axis=1)
            yield pd.DataFrame(made)

    slim = stream.select(*dict.fromkeys([*keys, *order, *cols]))
    slim = slim.withWatermark(order[0], late or idle) if late or idle else slim
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    slim = slim.withColumns({m: F.col(k).isNull() for k, m in marks.items()})
    slim = slim.withColumns({k: F.coalesce(k, F.lit(0).cast(fields[k].dataType)) for k in marks})
    forget = GroupStateTimeout.EventTimeTimeout if late or idle else GroupStateTimeout.NoTimeout
    made = slim.groupBy("_bucket").applyInPandasWithState(step, out_schema, state_schema, "append", forget)
    return made.withColumns({k: F.when(~F.col(m), F.col(k)) for k, m in marks.items()}).drop(*marks.values())


def memory_upserts(
    stream: DataFrame, *, keys: Sequence[str] = ("type", "key"), order: Sequence[str] = ("ts", "id"), band: float = CONFIDENCE_BAND,
    loser_cap: float = LOSER_CAP, late: str | None = None,
) -> DataFrame:
    """Each arriving item with whether it won its key, its version and its kept confidence.

    One state row per key: the winner's confidence and time, and the number of wins. Items with a
    NULL in the key conflict with nothing: each wins with version 1 and leaves no state. With
    ``late`` items may arrive out of order by up to that much event time: they wait in the state
    until the watermark has passed them. Without it a micro-batch must not hold items older
    than those already seen of the key.
    """
    fields = {f.name: f for f in stream.schema.fields}
    id = order[-1]
    out_schema = T.StructType(
        [fields[k] for k in keys]
        + [fields[id], T.StructField("won", T.BooleanType()), T.StructField("version", T.LongType()), T.StructField("confidence", T.DoubleType())]
    )
    state_schema = T.StructType(
        [T.StructField("conf", T.DoubleType()), T.StructField("at", T.LongType()), T.StructField("wins", T.LongType()),
         T.StructField("held_at", T.ArrayType(T.LongType())), T.StructField("held_id", T.ArrayType(fields[id].dataType)),
         T.StructField("held_conf", T.ArrayType(T.DoubleType()))]
    )
    order = list(order)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        conf, at, wins, *held = state.get if state.exists else (0.0, 0, 0, [], [], [])
        items = list(zip(*held))
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches))
            items += [(int(t), i, float(c)) for t, i, c in zip(pdf["_at"], pdf[id], pdf["confidence"])]
        passed = state.getCurrentWatermarkMs() * 1000 if late else float("inf")
        items.sort(key=lambda x: x[:2])
        ready = [x for x in items if x[0] < passed]
        wait = items[len(ready) :]
        rows = []
        for t, item, c in ready:
            won = not wins or beats(c, t, conf, at, band)
            if won:
                conf, at, wins = c, t, wins + 1
            rows.append((*key, item, won, wins if won else 1, c if won else min(c, loser_cap)))
        state.update((conf, at, wins, *([x[i] for x in wait] for i in range(3))))
        if wait:
            state.setTimeoutTimestamp(max(passed, wait[0][0]) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    if late:
        stream = stream.withWatermark(order[0], late)
    # The watermark column stays in the rows of the stateful step: its time-outs need it.
    slim = stream.select(*keys, *order, "confidence", F.unix_micros(order[0]).alias("_at"))
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    alone = slim.filter(keyless).select(
        *keys, id, F.lit(True).alias("won"), F.lit(1).cast("long").alias("version"), F.col("confidence").cast("double")
    )
    folded = slim.filter(~keyless).groupBy(*keys)
    forget = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    folded = folded.applyInPandasWithState(step, out_schema, state_schema, "append", forget)
    return folded.unionByName(alone)


# Batches whose word counts are read one by one before they are added up into one table.
COMPACT = 16


def prequential_nb(
    stream: DataFrame, path: str, checkpoint: str, *, order: str, text: str, label: str, smoothing: float = 1.0,
    available_now: bool = True, every: str = "1 minute",
):
    """Test-then-train over a stream, row by row: each message is scored with the counts of all earlier ones.

    A batch adds its own word counts as a table of their own (``words``) and the totals so far (``totals``);
    every ``COMPACT`` batches the word counts are added up (``base``). So a batch reads one base and a few
    small tables, joined with its own words, and writes no word it did not see. All are written under the
    batch number: a repeated batch reads what stood before it and overwrites its own. Within a batch counts
    run in order as in ``online_text.prequential_nb``, so the result (``scored``) does not depend on how the
    stream is cut. A message not after all earlier batches is neither scored nor learned; it goes to ``late``.
    """
    word_schema, sums = "w string, n0 long, n1 long", "d0 long, d1 long, t0 long, t1 long, v long"

    def learn(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        kind = df.schema[order].dataType.simpleString()
        totals, last = None, None
        if batch_id:
            row = spark.read.schema(f"{sums}, last {kind}").parquet(f"{path}/totals/v={batch_id - 1}").first()
            totals = row.asDict()
            last = totals.pop("last")
        df = df.select(order, text, label)
        if last is not None:
            behind = F.col(order) <= F.lit(last)
            df.filter(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            df = df.filter(~behind)
        df = stored(df, "messages")
        known = _known_words(spark, path, batch_id, word_schema)
        tokens = stored(token_counts(df, order=order, text=text, label=label), "message-words")
        mine = stored(
            tokens.groupBy("w").agg(
                *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("tf"))), F.lit(0)).cast("long").alias(f"n{c}") for c in (0, 1)]
            ),
            "batch-words",
        )
        if known is not None:
            known = stored(known.join(mine.select("w"), "w", "left_semi"), "known-words")
        scored = online_text.prequential_nb(
            df, order=order, text=text, label=label, smoothing=smoothing, known=known, totals=totals, tokens=tokens
        )
        scored.write.mode("overwrite").parquet(f"{path}/scored/batch={batch_id}")
        mine.write.mode("overwrite").parquet(f"{path}/words/v={batch_id}")
        seen = df.agg(*[F.count_if(F.col(label) == c).alias(f"d{c}") for c in (0, 1)], F.max(order).alias("last")).first()
        new = mine.agg(F.count("*"), F.sum("n0"), F.sum("n1")).first()
        start = totals or online_text.NOTHING
        now = {
            "d0": start["d0"] + seen["d0"],
            "d1": start["d1"] + seen["d1"],
            "t0": start["t0"] + (new[1] or 0),
            "t1": start["t1"] + (new[2] or 0),
            "v": start["v"] + new[0] - (known.count() if known is not None else 0),
            "last": last if seen["last"] is None else seen["last"],
        }
        spark.createDataFrame([tuple(now.values())], f"{sums}, last {kind}").write.mode("overwrite").parquet(f"{path}/totals/v={batch_id}")

    return _start(stream.writeStream.foreachBatch(learn), checkpoint, available_now, every)


def _known_words(spark, path: str, batch_id: int, schema: str) -> DataFrame | None:
    """The word counts of all batches before this one; a base is made where one is due."""
    if not batch_id:
        return None
    due = batch_id - batch_id % COMPACT
    added = lambda df: df.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def tables(base: int, end: int) -> DataFrame | None:
        paths = [f"{path}/base/v={base}"] if base else []
        paths += [f"{path}/words/v={v}" for v in range(base, end)]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    if due and due == batch_id:
        added(tables(due - COMPACT, due)).write.mode("overwrite").parquet(f"{path}/base/v={due}")
    return added(tables(due, batch_id))


def drift_monitor(
    stream: DataFrame, baseline: DataFrame, *, ts: str, text: str, correct: str, window: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Per window and keyword: hits, their share of all keyword hits now, the frozen share, messages and their accuracy.

    ``baseline`` (keyword, base_pct) is a short keyword list, read once when the stream starts.
    Every window with messages has a row for every keyword, with zero hits too; the accuracy
    counts each message of the window once.
    """
    listed = baseline.select("keyword", F.col("base_pct").cast("double")).limit(MAX_KEYWORDS + 1).collect()
    if len(listed) > MAX_KEYWORDS:
        raise ValueError(f"the keyword list has more than {MAX_KEYWORDS} entries")
    entry = lambda k, pct: F.struct(F.lit(k).alias("keyword"), F.lit(pct).cast("double").alias("base_pct"))
    names = F.array(*[F.lit(r["keyword"]) for r in listed]).cast("array<string>")
    mine = F.filter(words(F.col(text)), lambda w: F.array_contains(names, w))
    found = stream.withWatermark(ts, late).select(ts, F.col(correct).cast("double").alias("_ok"), mine.alias("_found"))
    each = found.select(ts, "_ok", "_found", F.inline(F.array(*[entry(r["keyword"], r["base_pct"]) for r in listed])))
    own = F.size(F.filter("_found", lambda w: w == F.col("keyword")))
    made = each.groupBy(F.window(ts, window), "keyword", "base_pct").agg(
        F.sum(own).alias("hits"),
        F.sum(F.size("_found")).alias("_all"),
        F.count(F.lit(1)).alias("messages"),
        F.avg("_ok").alias("accuracy"),
    )
    share = F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("_all")), F.lit(0.0))
    return made.select(
        F.col("window.start").alias("start"), "keyword", "base_pct", "hits", share.alias("pct"), "messages", "accuracy"
    )
