"""How rows are laid out before costly per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the input has fewer pieces than there are cores.

    A table in a few files gives a few tasks, however many cores wait. Select the needed
    columns first: only then does the exchange carry little. Tables with many files pass
    unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def waves(df: DataFrame, task_rows: int) -> DataFrame:
    """The rows in equal parts of at most about ``task_rows``, a multiple of the cores.

    For work that takes long per row: all cores end at once, and no more tasks than needed each hold
    what the work keeps. A file may have one large row group, which a single task reads, however many
    pieces the file is cut into; so the rows are always dealt, by chance and without a sort. ``df`` is
    counted, so its count should be cheap.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (cores * task_rows))), F.rand(7))


# Rows that one task of a window sorts, on average.
TASK_ROWS = 100_000


# Characters of text whose words one task counts.
TASK_CHARS = 8_000_000


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows by ``keys`` in as many partitions as ``rows`` need, where Spark's own number is too small.

    A window over the keys then takes these partitions, so what a task sorts does not grow with the table.
    """
    tasks = -(-rows // task_rows)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dealt_texts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """The rows by ``keys`` (else by chance) in partitions of about ``TASK_CHARS`` characters, at least one per core.

    Counting words per key then needs no other exchange, and what a task holds does not grow with the table.
    """
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(-(-chars // TASK_CHARS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *(keys or [F.rand(7)]))
