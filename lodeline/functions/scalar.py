"""Dates, thresholds, labels and other plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Proximity bounds in cm and their labels.
PROXIMITY_BOUNDS = ((20, "obstacle_near"), (50, "obstacle_moderate"))
PROXIMITY_OTHERWISE = "clear"
OVERHEAT_LIMIT = 70


def classify_threshold(
    col: Column,
    bounds: Sequence[tuple[float, str]] = PROXIMITY_BOUNDS,
    otherwise: str = PROXIMITY_OTHERWISE,
    null_label: str | None = None,
) -> Column:
    """Label of the first bound the value is below. NULL takes ``otherwise`` unless named."""
    out = F.when(col.isNull(), F.lit(null_label if null_label is not None else otherwise))
    for limit, label in bounds:
        out = out.when(col < limit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def flag_threshold(col: Column, limit: float = OVERHEAT_LIMIT) -> Column:
    """True above the limit; NULL is False."""
    return F.coalesce(col > limit, F.lit(False))


def elapsed_seconds(end: Column, start: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def duration_label(start: Column, end: Column, hours: float = 24) -> Column:
    """1 if the interval lasts at most ``hours``, else 0."""
    return (elapsed_seconds(end, start) <= hours * 3600).cast("int")


def fill_unknown(col: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(col.cast("string"), F.lit(default))


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), quarter, month, year, day of year, day, ISO week."""
    return {
        "hour": F.hour(ts),
        "dayofweek": F.weekday(ts),
        "quarter": F.quarter(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "dayofyear": F.dayofyear(ts),
        "dayofmonth": F.dayofmonth(ts),
        "weekofyear": F.weekofyear(ts),
    }


def transform_primitives(ts: Column, since: Column) -> dict[str, Column]:
    return {
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "time_since": elapsed_seconds(since, ts),
    }


def partition_fields(ts: Column) -> dict[str, Column]:
    """Folder fields: day ``dt=YYYY-MM-DD`` and hour ``hr=HH``."""
    return {"dt": F.date_format(ts, "yyyy-MM-dd"), "hr": F.date_format(ts, "HH")}


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1; the maximum belongs to the last bin."""
    width = (high - low) / F.lit(bins)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((value - low) / width))
    return F.least(raw, F.lit(bins - 1)).cast("long")


def shape_features(left: Column, center: Column, right: Column) -> dict[str, Column]:
    """Mean, spread and center-to-outer ratio of three sensors."""
    return {
        "gs_mean": (left + center + right) / F.lit(3.0),
        "gs_spread": F.greatest(left, center, right) - F.least(left, center, right),
        "gs_center_to_outer_ratio": F.when(left + right > 0, center / ((left + right) / F.lit(2.0))),
    }


def snippet(text: Column, length: int, ellipsis: str = "") -> Column:
    """The first ``length`` characters, with a mark if something was left out."""
    cut = F.substring(text, 1, length)
    return F.when(F.length(text) > length, F.concat(cut, F.lit(ellipsis))).otherwise(text) if ellipsis else cut
