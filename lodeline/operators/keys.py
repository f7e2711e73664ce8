"""Names that cannot clash with a caller's columns, and one key for groups of several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def group_name(group: Sequence[str]) -> Column:
    """The values of several columns as one text; groups with nulls have a name too."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in group]), {"ignoreNullFields": "false"})
