"""Casting, filling, encoding and keyed changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.plans.hot_groups import row_frames, row_positions, running

SILVER_TYPES = {
    "device_id": "string",
    "event_timestamp": "timestamp",
    "distance_cm": "double",
    "grayscale_left": "int",
    "grayscale_center": "int",
    "grayscale_right": "int",
    "cpu_temp": "double",
    "kafka_partition": "int",
    "kafka_offset": "long",
    "steering_angle": "double",
    "throttle": "double",
    "pan_angle": "double",
    "tilt_angle": "double",
    "mode": "string",
    "surface_label": "string",
    "session_id": "string",
    "waypoint_id": "int",
    "frame_path": "string",
}
SILVER_NAMES = {"cpu_temp": "cpu_temp_celsius"}


def staging_cast(df: DataFrame, types: dict[str, str] = SILVER_TYPES, names: dict[str, str] = SILVER_NAMES) -> DataFrame:
    """Every column renamed and cast; columns an older source lacks are NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(names.get(c, c)) for c, t in types.items()]
    )


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def forward_fill(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each NULL takes the last value before it."""
    made = running(df, keys, order, {f"_f_{c}": ("last", c) for c in cols})
    return made.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def numeric_feature_matrix(df: DataFrame, *, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Target and one vector of all numeric columns, NULL as 0."""
    from pyspark.ml.feature import VectorAssembler

    cols = numeric_columns(df, (target, *exclude))
    filled = df.fillna(0, subset=cols)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(filled).select(target, "features")


def label_encode(df: DataFrame, col: str, out: str = "code", classes: DataFrame | None = None) -> DataFrame:
    """Index of each class in sorted order; a value outside ``classes`` gets NULL.

    The ranking runs over the distinct values, not over the rows, and is split into blocks
    when there are very many (user or item ids).
    """
    distinct = (df if classes is None else classes).select(col).where(F.col(col).isNotNull()).distinct()
    codes = row_positions(distinct, [], [col], name=out).withColumn(out, F.col(out) - 1)
    return df.join(codes, col, "left")


def partial_update(
    log: DataFrame, *, key: str, order: Sequence[str], cols: Sequence[str], op: str = "op", delete: str = "delete"
) -> DataFrame:
    """Current rows of a change log: the latest value set per column since the last delete.

    One aggregation; the newest change per column is kept by ``max_by``, so partial
    results combine before the shuffle.
    """
    at = F.struct(*order)
    last_delete = log.filter(F.col(op) == delete).groupBy(key).agg(F.max(at).alias("_gone"))
    live = log.filter(F.col(op) != delete).join(last_delete, key, "left")
    live = live.filter(F.col("_gone").isNull() | (at > F.col("_gone")))
    return live.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols],
        F.min(order[0]).alias("created"),
        F.max(order[0]).alias("changed"),
    )


def change_history(log: DataFrame, *, key: str, order: Sequence[str], value: str, op: str = "op") -> DataFrame:
    """Every change with the value before it."""
    return row_frames(log, [key], order, 1, lambda w: {"old_value": F.lag(value).over(w)}).withColumnRenamed(
        value, "new_value"
    )


def scoped_delete(df: DataFrame, tombstones: DataFrame, *, scope: Sequence[str]) -> DataFrame:
    """Rows outside every tombstone's scope; at least one scope column is required."""
    if not scope:
        raise ValueError("a delete needs at least one scope column")
    return df.join(tombstones.select(*scope).distinct(), list(scope), "left_anti")
