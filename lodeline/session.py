"""Session defaults and the few settings the library reads."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

MAX_GROUP_ROWS = "spark.lodeline.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def get_session(app: str = "lodeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE with skew-join handling and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application.

    Functions of the package are pickled by name, so workers started from any folder must be
    able to import it. The archive is a few hundred kilobytes.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    sc = spark.sparkContext
    if getattr(sc, "_lodeline_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="lodeline-"), "lodeline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lodeline_shipped = True
    return spark


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one group that a single task may order; longer groups are split."""
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path for tables and checkpoints, on the cluster's shared storage.

    The parent is ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), f"lodeline-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Removes what an execution has shuffled when it ends. Nobody reads that again once the rows are written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _cleaned(spark):
    """The setting is on while any thread writes, and then as it was."""
    key = id(spark)
    with _lock:
        held = _writes.setdefault(key, [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        if held[0] == 1:
            held[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


def stored(df, name: str = "step"):
    """The same rows read back from a table in the shared folder, with the lineage cut.

    What was shuffled on the way is removed at once, not when the driver next collects garbage.
    """
    path = work_dir(df.sparkSession, name)
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
