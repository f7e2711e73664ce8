"""Point-in-time features: what was known about a parent at each row's own time.

A row at time ``t`` sees its parent's rows in ``(t - window, t]``. A label becomes
known only ``label_delay`` after its row, so label aggregates see
``(t - window, t - label_delay]``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.plans.hot_groups import running
from lodeline.plans.layout import dealt
from lodeline.session import stored

UNIT_MICROS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}

# A sliding frame costs rows x frame, so it is used only while every group is short.
SLIDING_LIMIT = 500
ROWS_PER_BUCKET = 50_000
MIN_BUCKETS, MAX_BUCKETS = 64, 4096
MAX_SENT_PARENTS = 1_000_000


def micros(duration: str) -> int:
    """``"30d"``, ``"24h"``, ``"15m"``, ``"10s"`` in microseconds."""
    m = re.fullmatch(r"(\d+)([smhd])", duration)
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m.group(1)) * UNIT_MICROS[m.group(2)]


AGGREGATES = {
    "count": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "std": lambda c: F.stddev_samp(c),
    "sum": lambda c: F.sum(c),
}


def feature_name(parent: str, agg: str, col: str) -> str:
    return f"{parent}__{agg.upper()}__{col}"


def asof_aggregates(
    df: DataFrame,
    *,
    ts: str,
    parents: Sequence[str],
    cols: Sequence[str],
    aggs: Sequence[str] = ("count", "mean", "max", "min", "std"),
    window: str = "30d",
    label: str | None = None,
    label_delay: str | None = "24h",
    include_current: bool = True,
    sliding_limit: int = SLIDING_LIMIT,
) -> DataFrame:
    """Add ``PARENT__AGG__col`` for every parent, aggregate and column.

    ``label_delay=None`` treats the label as known at once. Rows with the same time as
    the current one belong to its history; ``include_current=False`` stops strictly
    before it.
    """
    length = micros(window)
    now = 0 if include_current else 1
    delays = {c: now for c in cols}
    if label is not None:
        delays[label] = max(micros(label_delay) if label_delay else 0, now)
    out = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    for parent in parents:
        out = _one_parent(out, parent, delays, list(aggs), length, sliding_limit)
    return out.drop("_t")


def _one_parent(df, parent, delays, aggs, length, sliding_limit) -> DataFrame:
    """Short parents take a sliding frame; only the rows of long ones are cut into buckets."""
    extent = df.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    is_long = F.col("n") > sliding_limit
    long_ones = extent.where(is_long)
    n_long, longest, n_short = extent.agg(
        F.count_if(is_long), F.max(F.when(is_long, F.struct("n", F.expr("hi - lo").alias("span")))), F.sum(F.when(~is_long, F.col("n")))
    ).first()
    if not n_long:
        return _sliding(dealt(df, n_short or 0, parent), parent, delays, aggs, length)
    names = long_ones.select(F.col(parent).alias("_long"))
    if n_long <= MAX_SENT_PARENTS:
        names = F.broadcast(names)
    same = df[parent].eqNullSafe(names["_long"])
    short, rest = df.join(names, same, "left_anti"), df.join(names, same, "left_semi")
    means = rest.groupBy(parent).agg(*[F.avg(F.col(c).cast("double")).alias(f"_mean_{c}") for c in delays])
    cut = _bucketed(rest, parent, delays, aggs, length, longest["n"], max(1, longest["span"]), means)
    return _sliding(dealt(short, n_short or 0, parent), parent, delays, aggs, length).unionByName(cut)


def _sliding(df, parent, delays, aggs, length) -> DataFrame:
    w = Window.partitionBy(parent).orderBy("_t")
    return df.withColumns(
        {
            feature_name(parent, a, c): AGGREGATES[a](F.col(c)).over(w.rangeBetween(-length + 1, -delay))
            for c, delay in delays.items()
            for a in aggs
        }
    )


def _bucket_width(length: int, delays: Sequence[int], rows: int, span: int) -> int:
    """A width that divides the window and all whole delays, fine enough for the longest group."""
    step = math.gcd(length, *[d for d in delays if d > 1])
    want = min(MAX_BUCKETS, max(MIN_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET * length / span)))
    parts = max(1, math.ceil(want * step / length))
    while step % parts:
        parts += 1
    return step // parts


def _pieces(c: str, value: Column, over=None) -> dict[str, Column]:
    # Of the distance from the parent's mean: its squares keep their digits however large the values are.
    x = value.cast("double") - F.col(f"_mean_{c}")
    made = {"n": F.count(x), "s": F.sum(x), "q": F.sum(x * x), "lo": F.min(value), "hi": F.max(value)}
    return {k: (v.over(over) if over is not None else v) for k, v in made.items()}


def _bucketed(df, parent, delays, aggs, length, rows, span, means) -> DataFrame:
    """The same frames cut into a bucket tail, whole buckets and a bucket head.

    With the window and the delay whole numbers of buckets, the tail for a row at ``t``
    lies in the rows of one earlier bucket and the head in those of another. Copies of
    both are sent, with shifted times, to the row's own bucket, so heads and tails are
    running aggregates inside small (parent, bucket) groups. Whole buckets come from a
    table with one row per bucket. No group depends on how many rows a parent has, and a burst in one
    bucket is split like any long group.
    """
    columns = df.columns
    means = means.withColumnRenamed(parent, "_pm")
    df = df.join(means, df[parent].eqNullSafe(means["_pm"])).drop("_pm")
    width = _bucket_width(length, list(delays.values()), rows, span)
    delay_steps = {c: (d // width if d > 1 else 0) for c, d in delays.items()}
    shifts = sorted({s for s in delay_steps.values() if s})

    # kind 0: the row itself, kind 1: leaving the window, kind 2+: label heads
    copies = [F.struct(F.lit(0).alias("kind"), F.col("_t").alias("at"))]
    copies.append(F.struct(F.lit(1).alias("kind"), (F.col("_t") + length).alias("at")))
    for i, s in enumerate(shifts):
        copies.append(F.struct(F.lit(2 + i).alias("kind"), (F.col("_t") + s * width).alias("at")))
    spread = df.withColumn("_copy", F.explode(F.array(*copies))).select(
        "*", F.col("_copy.kind").alias("_kind"), F.col("_copy.at").alias("_at")
    ).drop("_copy")
    spread = spread.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))

    # One row per time first: a burst of equal times is a partial sum. Frames within a bucket are running
    # aggregates over its times, which split a bucket with very many of them over tasks.
    pieces, heads, strict, tails = {}, {}, {}, {}
    for c, d in delays.items():
        kind = 2 + shifts.index(delay_steps[c]) if delay_steps[c] else 0
        for p, k, into in (("h", kind, strict if d == 1 else heads), ("e", 1, tails)):
            for name, v in _pieces(c, F.when(F.col("_kind") == k, F.col(c))).items():
                pieces[f"_{p}_{name}_{c}"] = v
                fn = name.replace("lo", "min").replace("hi", "max") if name in ("lo", "hi") else "sum"
                into[f"_{p}_{name}_{c}"] = (fn, F.col(f"_p_{p}_{name}_{c}"))
    mine = F.max((F.col("_kind") == 0).cast("int")).alias("_mine")
    times = spread.groupBy(parent, "_bucket", "_at").agg(mine, *[v.alias(f"_p{n}") for n, v in pieces.items()])
    times = stored(times, "times")
    keys = [parent, "_bucket"]
    times = dealt(times, times.count(), *keys)
    if heads:
        times = running(times, keys, ["_at"], heads)
    if strict:
        times = running(times, keys, ["_at"], strict, strict=True)
    times = running(times, keys, [-F.col("_at")], tails, strict=True)
    times = times.where("_mine = 1").select(F.col(parent).alias("_tp"), F.col("_at").alias("_ta"), "_bucket", *pieces)
    own = df.join(times, df[parent].eqNullSafe(times["_tp"]) & df["_t"].eqNullSafe(times["_ta"])).drop("_tp", "_ta")

    per_bucket = df.withColumn("_bucket", F.floor(F.col("_t") / F.lit(width))).groupBy(parent, "_bucket")
    table = per_bucket.agg(*[v.alias(f"_{k}_{c}") for c in delays for k, v in _pieces(c, F.col(c)).items()])
    # A row's bucket must be present even where only its frame holds data: it is, because
    # every row is in the table under its own bucket.
    by_parent = Window.partitionBy(parent).orderBy("_bucket")
    mids = {}
    for c in delays:
        between = by_parent.rangeBetween(-(length // width) + 1, -delay_steps[c] - 1)
        for k, fn in (("n", F.sum), ("s", F.sum), ("q", F.sum), ("lo", F.min), ("hi", F.max)):
            mids[f"_m_{k}_{c}"] = fn(f"_{k}_{c}").over(between)
    mid = table.withColumns(mids).select(F.col(parent).alias("_mp"), F.col("_bucket").alias("_mb"), *mids)
    joined = own.join(mid, own[parent].eqNullSafe(mid["_mp"]) & (own["_bucket"] == mid["_mb"]), "left")

    out = [F.col(c) for c in columns]
    for c in delays:
        part = {
            k: [F.col(f"_{p}_{k}_{c}") for p in ("h", "m", "e")]
            for k in ("n", "s", "q", "lo", "hi")
        }
        zero = F.lit(0)
        n, s, q = (sum((F.coalesce(x, zero) for x in part[k]), zero) for k in ("n", "s", "q"))
        nn = F.nullif(n, F.lit(0))
        ready = {
            "count": n.cast("long"),
            "sum": F.when(n > 0, s + n * F.col(f"_mean_{c}")),
            "mean": s / nn + F.col(f"_mean_{c}"),
            "max": F.greatest(*part["hi"]),
            "min": F.least(*part["lo"]),
            "std": F.when(n > 1, F.sqrt(F.greatest((q - s * s / nn) / (n - 1), F.lit(0.0)))),
        }
        out += [ready[a].alias(feature_name(parent, a, c)) for a in aggs]
    return joined.select(*out)


def asof_window_join(
    cutoffs: DataFrame,
    history: DataFrame,
    *,
    key: str,
    cutoff_ts: str,
    ts: str,
    cols: Sequence[str],
    aggs: Sequence[str] = ("count", "mean", "max", "min", "std"),
    window: str = "30d",
) -> DataFrame:
    """As-of aggregates at the times of a separate cutoff table.

    Cutoff rows and history rows share one time line; only history rows carry values,
    so no pair of rows is ever formed.
    """
    rows = history.select(key, F.col(ts).alias("_when"), *cols, F.lit(False).alias("_cut"))
    rows = rows.unionByName(
        cutoffs.select("*", F.col(cutoff_ts).alias("_when"), F.lit(True).alias("_cut")), allowMissingColumns=True
    )
    made = asof_aggregates(rows, ts="_when", parents=[key], cols=cols, aggs=aggs, window=window)
    features = [feature_name(key, a, c) for c in cols for a in aggs]
    return made.filter("_cut").select(*cutoffs.columns, *features)


def parent_aggregates(
    df: DataFrame,
    *,
    parent: str,
    cols: Sequence[str],
    aggs: Sequence[str] = ("count", "mean", "max", "min", "std"),
) -> DataFrame:
    """One row per parent over all of its rows; partial aggregation absorbs heavy parents."""
    return df.groupBy(parent).agg(
        F.count(F.lit(1)).alias(f"{parent}__ROWS"),
        *[AGGREGATES[a](F.col(c)).alias(feature_name(parent, a, c)) for c in cols for a in aggs],
    )


def feature_broadcast_back(df: DataFrame, *, parent: str, cols: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    """Each row with its parent's aggregates over the whole table (no cutoff, so it leaks).

    Aggregate and join, not a window: the aggregate shrinks before the shuffle, and the
    join may be broadcast or skew-split at run time.
    """
    made = parent_aggregates(df, parent=parent, cols=cols, aggs=aggs)
    return df.join(made, parent, "left")


def align_target(features: DataFrame, labels: DataFrame, *, key: str, label: str) -> DataFrame:
    """Features with their label; the job fails if a label is missing."""
    joined = features.join(labels.select(key, F.col(label).alias("_label")), key, "left")
    guarded = F.when(
        F.col("_label").isNull(), F.raise_error(F.format_string("no label for key %s", F.col(key).cast("string")))
    ).otherwise(F.col("_label"))
    return joined.withColumn(label, guarded).drop("_label")
