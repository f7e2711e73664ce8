"""Grouped, conditional and profiling aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.plans.hot_groups import running
from lodeline.session import stored

MAX_PIVOT_VALUES = 1000


def hourly_rollup(
    df: DataFrame,
    *,
    key: str = "device_id",
    ts: str = "event_timestamp",
    distance: str = "distance_cm",
    temp: str = "cpu_temp_celsius",
    status: str = "proximity_status",
    near: str = "obstacle_near",
) -> DataFrame:
    return df.groupBy(key, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.avg(distance).alias("avg_distance_cm"),
        F.min(distance).alias("min_distance_cm"),
        F.avg(temp).alias("avg_cpu_temp"),
        F.max(temp).alias("max_cpu_temp"),
        F.count_if(F.col(status) == near).alias("near_obstacle_count"),
    )


def metric_rows(one: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A one-row result as (metric, value) rows."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return one.select(F.inline(F.array(*pairs)))


def _value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, key, value, w): how often each value of several columns occurs, from one scan, stored.

    Numbers stand in ``value`` as doubles, everything in ``key`` as text.
    """
    entry = lambda n, c: F.struct(F.lit(n).alias("column"), c.cast("string").alias("key"), c.try_cast("double").alias("value"))
    rows = df.select(F.inline(F.array(*[entry(n, c) for n, c in columns.items()])))
    return stored(rows.groupBy("column", "key", "value").agg(F.count(F.lit(1)).alias("w")), "value-counts")


def dataset_summary(df: DataFrame, *, user: str = "user", item: str = "item", value: str = "rating") -> DataFrame:
    """Rows, distinct users and items, per-user and per-item averages, value statistics.

    All of it comes from one count per user, item and value, so the input is read once.
    """
    counts = _value_counts(df, {"user": F.col(user), "item": F.col(item), "value": F.col(value)})
    of = lambda n: F.col("column") == n
    number = of("value") & F.col("value").isNotNull()
    one = counts.agg(
        F.sum(F.when(of("user"), F.col("w"))).alias("rows"),
        F.count_if(of("user")).alias("users"),
        F.count_if(of("item")).alias("items"),
        (F.sum(F.when(number, F.col("value") * F.col("w"))) / F.sum(F.when(number, F.col("w")))).alias("mean_rating"),
    )
    median = _quantiles_of_counts(counts.where(number), "value", "w", (0.5,), ["column"])
    one = one.withColumn("median_rating", median.select("q0").scalar())
    one = one.withColumns(
        {"ratings_per_user": F.col("rows") / F.col("users"), "ratings_per_item": F.col("rows") / F.col("items")}
    )
    names = ["rows", "users", "items", "ratings_per_user", "ratings_per_item", "mean_rating", "median_rating"]
    return metric_rows(one, names)


def describe_numeric(df: DataFrame, cols: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column, as doubles, from one scan.

    Quartiles are exact; ``approximate`` uses a sketch with bounded state instead of counts per value.
    """
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if approximate:
        quarts = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
        stats = lambda c: [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), quarts(c), F.max(c).cast("double")]
        one = df.agg(*[v.alias(f"c{i}_{j}") for i, c in enumerate(cols) for j, v in enumerate(stats(F.col(c)))])
        row = lambda i, c: F.struct(
            F.lit(c).alias("column"), *[F.col(f"c{i}_{j}").alias(names[j]) for j in range(4)],
            *[F.col(f"c{i}_4")[q].cast("double").alias(f"p{p}") for q, p in enumerate((25, 50, 75))], F.col(f"c{i}_5").alias("max"),
        )
        return one.select(F.inline(F.array(*[row(i, c) for i, c in enumerate(cols)])))
    counts = _value_counts(df, {c: F.col(c).cast("double") for c in cols}).where("value is not null")
    v, w = F.col("value"), F.col("w")
    sums = counts.groupBy("column").agg(
        F.sum("w").alias("count"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    apart = counts.join(sums.select("column", "mean"), "column").groupBy("column")
    spread = apart.agg(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("_q"))
    quarts = _quantiles_of_counts(counts, "value", "w", (0.25, 0.5, 0.75), ["column"])
    made = sums.join(spread, "column").join(quarts.drop("n"), "column").withColumn(
        "std", F.when(F.col("count") > 1, F.sqrt(F.col("_q") / (F.col("count") - 1)))
    )
    made = made.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    listed = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return listed.join(made, "column", "left").fillna(0, ["count"]).select("column", *names)


def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float], *, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles ``q0, q1, ..`` and the row count ``n`` per group.

    Equal values are counted first, then running counts over the value order tell where
    each wanted position falls. Neither step holds a whole group in one task.
    """
    keys = list(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_w"))
    return _quantiles_of_counts(counts, col, "_w", ps, keys)


def _quantiles_of_counts(counts: DataFrame, col: str, weight: str, ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The quantiles of ``exact_quantiles`` from how often (``weight``) each value occurs."""
    key_cols = list(keys) or ["_one"]
    if not keys:
        counts = counts.withColumn("_one", F.lit(0))
    placed = running(counts, key_cols, [col], {"_cum": ("sum", weight)})
    sizes = counts.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(key_cols)]).agg(F.sum(weight).alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(key_cols)])
    placed = placed.join(sizes, same)
    aggs, out = [], []
    for i, p in enumerate(ps):
        at = F.lit(p) * (F.col("n") - 1)
        aggs += [
            F.min(F.when(F.col("_cum") > F.floor(at), F.col(col))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_cum") > F.ceil(at), F.col(col))).alias(f"_hi{i}"),
        ]
        part = at - F.floor(at)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(f"q{i}"))
    made = placed.groupBy(*key_cols, "n").agg(*aggs)
    return made.select(*keys, "n", *out)


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count, smallest and largest value of every column, in one scan."""
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    aggs = []
    for c in flat:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"z_{c}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n_{c}").alias("nulls"),
            F.col(f"a_{c}").cast("string").alias("min"),
            F.col(f"z_{c}").cast("string").alias("max"),
        )
        for c in flat
    ]
    return one.select("rows", F.inline(F.array(*rows)))


def exact_duplicates(df: DataFrame, cols: Sequence[str], *, hashed: bool = False) -> DataFrame:
    """Rows that repeat an earlier row on ``cols``; ``hashed`` groups long text by its SHA-256."""
    keys = [F.sha2(F.col(c), 256).alias(c) if hashed else F.col(c) for c in cols]
    sizes = df.select(*keys).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def calendar_resample(df: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """Rows per calendar period, 0 where a period is empty."""
    counts = df.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("period"))
    return spine.join(counts, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


def pivot_wide(df: DataFrame, *, rows: str, columns: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Mean of ``value`` per row and column, NULL where there is none."""
    if values is None:
        found = df.select(columns).distinct().orderBy(columns).limit(MAX_PIVOT_VALUES + 1).collect()
        if len(found) > MAX_PIVOT_VALUES:
            raise ValueError(f"more than {MAX_PIVOT_VALUES} pivot columns; pass the values wanted")
        values = [r[0] for r in found]
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.avg(value))


def matrix_density(df: DataFrame, *, user: str = "user", item: str = "item") -> DataFrame:
    users = df.groupBy(user).agg(F.count_distinct(item).alias("n"))
    one = users.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("nnz"))
    one = one.withColumn("items", df.select(item).distinct().agg(F.count(F.lit(1))).scalar())
    return one.withColumn("density", F.col("nnz") / (F.col("users") * F.col("items")))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    from lodeline.functions.scalar import equal_width_bin

    low, high = (df.agg(f(col)).scalar() for f in (F.min, F.max))
    binned = df.where(F.col(col).isNotNull()).select(equal_width_bin(F.col(col), low, high, bins).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def group_box_stats(df: DataFrame, *, group: str, value: str) -> DataFrame:
    """Five-number summary per group."""
    quarts = exact_quantiles(df, value, (0.25, 0.5, 0.75), keys=[group])
    ends = df.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    q = [F.col(f"q{i}").alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return quarts.join(ends, group).select(group, "n", "min", *q, "max")


def top_rows(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def topk_per_group(df: DataFrame, *, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark applies the limit before the shuffle too,
    so a heavy group sends at most ``k`` rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_run(runs: DataFrame, *, metric: str, ties: str) -> DataFrame:
    """The whole row with the highest metric; ties go to the smallest ``ties`` value."""
    return runs.orderBy(F.desc(metric), F.asc(ties)).limit(1)


def busiest_key(df: DataFrame, key: str, *, more_than: int = 10) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
    return counts.orderBy(F.desc("n"), key).limit(1)
