"""Data-quality checks, all in one report: check, column, rows, failures, passed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _failing(check: str, column: str, arg: Any) -> Column:
    c = F.col(column)
    if check == "not_null":
        return c.isNull()
    if check == "accepted_values":
        return c.isNotNull() & ~c.isin(list(arg))
    low, high = arg
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return c.isNotNull() & bad


def expect(df: DataFrame, checks: Sequence[tuple]) -> DataFrame:
    """``checks``: ``(kind, column[, argument])`` with the kinds accepted_values (list),
    not_null, range ((low, high)) and unique (column or list of columns).

    All row checks share one scan. A uniqueness check counts the rows beyond the first of
    each key, in an aggregation of its own.
    """
    row_checks = [c for c in checks if c[0] != "unique"]
    reports = []
    if row_checks:
        one = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                F.count_if(_failing(c[0], c[1], c[2] if len(c) > 2 else None)).alias(f"_f{i}")
                for i, c in enumerate(row_checks)
            ],
        )
        entries = [
            F.struct(F.lit(c[0]).alias("check"), F.lit(c[1]).alias("column"), F.col(f"_f{i}").alias("failures"))
            for i, c in enumerate(row_checks)
        ]
        reports.append(one.select("rows", F.inline(F.array(*entries))))
    for c in checks:
        if c[0] != "unique":
            continue
        cols = [c[1]] if isinstance(c[1], str) else list(c[1])
        sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        reports.append(
            sizes.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.lit("unique").alias("check"),
                F.lit("+".join(cols)).alias("column"),
                F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("failures"),
            )
        )
    out = reduce(DataFrame.unionByName, reports)
    return out.select("check", "column", "rows", "failures", (F.col("failures") == 0).alias("passed"))
