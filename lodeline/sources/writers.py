"""Sinks and incremental loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, fields: Sequence[str], mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*fields).parquet(path)


def new_rows(
    target: DataFrame, batch: DataFrame, *, partition_col: str = "kafka_partition", offset_col: str = "kafka_offset"
) -> DataFrame:
    """Batch rows above the stored offset of their own partition.

    The watermarks, one row per topic partition, come from a partial aggregation.
    """
    marks = target.groupBy(partition_col).agg(F.max(offset_col).alias("_mark"))
    joined = batch.join(marks, partition_col, "left")
    return joined.filter(F.col("_mark").isNull() | (F.col(offset_col) > F.col("_mark"))).drop("_mark")


def incremental_append(
    target: DataFrame, batch: DataFrame, *, partition_col: str = "kafka_partition", offset_col: str = "kafka_offset"
) -> DataFrame:
    """Target plus the new rows; columns missing on either side are NULL."""
    fresh = new_rows(target, batch, partition_col=partition_col, offset_col=offset_col)
    return target.unionByName(fresh, allowMissingColumns=True)


def incremental_append_to_path(
    batch: DataFrame, path: str, *, partition_col: str = "kafka_partition", offset_col: str = "kafka_offset"
) -> None:
    """Append the new rows to a stored table; the first load takes everything."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path).select(partition_col, offset_col)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = None
    fresh = batch if known is None else new_rows(known, batch, partition_col=partition_col, offset_col=offset_col)
    fresh.write.mode("append").parquet(path)


def incremental_upsert(
    target: DataFrame, batch: DataFrame, *, keys: Sequence[str], order: Sequence[str] | None = None, above: Column | None = None
) -> DataFrame:
    """Batch rows replace target rows with the same key; others stay. A key is unique in the result.

    ``order`` names the columns by which the newest of several batch rows of a key is taken;
    without it such a batch fails the job. ``above`` is a predicate on the batch, such as an
    offset above the stored one: rows it does not admit are old and change nothing.
    """
    batch = batch if above is None else batch.where(above)
    rest = [c for c in batch.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    if order is not None:
        best = F.max_by(row, F.struct(*[F.col(c) for c in order], F.xxhash64(*batch.columns)))
    else:
        clash = F.raise_error(F.lit("the batch holds a key more than once; name an order"))
        best = F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.any_value(row))
    newest = batch.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    kept = target.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(newest.select(*batch.columns), allowMissingColumns=True)


def materialize_layers(silver: DataFrame, gold: dict[str, DataFrame], path: str, *, prefix: str = "") -> None:
    """Silver as a view, gold tables written and registered as views on their files."""
    silver.createOrReplaceTempView(f"{prefix}silver")
    for name, df in gold.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        df.sparkSession.read.parquet(f"{path}/{name}").createOrReplaceTempView(f"{prefix}gold_{name}")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)
