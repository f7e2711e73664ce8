"""Time series: complete spines, gap filling, spikes, forecast inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_spine(ends: DataFrame, *, keys: Sequence[str], start: str, hours: int) -> DataFrame:
    """``hours`` hourly times after ``start`` for each row."""
    first = F.col(start) + F.expr("interval 1 hour")
    last = F.col(start) + F.make_dt_interval(hours=F.lit(hours))
    return ends.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("ts"))


def gap_fill(df: DataFrame, *, keys: Sequence[str], ts: str = "ts", unit: str = "hour") -> DataFrame:
    """One row per key and period between the key's first and last time; missing values are NULL."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    spine = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval 1 {unit}"))).alias(ts))
    return spine.join(df, [*keys, ts], "left")


def spike_detect(df: DataFrame, *, value: str = "yhat", multiplier: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    """``upper`` = value + population stddev of all values; a spike is above mean * multiplier."""
    stats = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_mean"))
    if keys:
        joined = df.join(stats, list(keys))
    else:
        joined = df.withColumns({c: stats.select(c).scalar() for c in ("_sd", "_mean")})
    upper = F.col(value) + F.col("_sd")
    return joined.withColumns({"upper": upper, "is_spike": upper > F.col("_mean") * multiplier}).drop("_sd", "_mean")
