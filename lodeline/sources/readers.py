"""Scans: delimited files, Parquet trees, JSON events, document folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sensor event as it arrives; the optional groups are absent in old messages.
EVENT_SCHEMA = (
    "device_id string, timestamp string, ultrasonic struct<distance_cm: double>, "
    "grayscale struct<left: double, center: double, right: double>, system struct<cpu_temp: double>, "
    "control struct<steering_angle: double, throttle: double, pan_angle: double, tilt_angle: double>, "
    "meta struct<mode: string, surface_label: string, session_id: string, waypoint_id: int>, "
    "camera struct<frame_path: string>"
)
REQUIRED_GROUPS = ("ultrasonic", "grayscale", "system")

FLAT_FIELDS = {
    "device_id": "e.device_id",
    "event_timestamp": "e.timestamp",
    "distance_cm": "e.ultrasonic.distance_cm",
    "grayscale_left": "e.grayscale.left",
    "grayscale_center": "e.grayscale.center",
    "grayscale_right": "e.grayscale.right",
    "cpu_temp": "e.system.cpu_temp",
    "steering_angle": "e.control.steering_angle",
    "throttle": "e.control.throttle",
    "pan_angle": "e.control.pan_angle",
    "tilt_angle": "e.control.tilt_angle",
    "mode": "e.meta.mode",
    "surface_label": "e.meta.surface_label",
    "session_id": "e.meta.session_id",
    "waypoint_id": "e.meta.waypoint_id",
    "frame_path": "e.camera.frame_path",
}


def scan_csv_typed(
    spark: SparkSession, path: str, schema: str, *, times: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Headered CSV with a declared schema; unreadable times become NULL."""
    df = spark.read.schema(schema).csv(path, header=True)
    df = df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in times})
    return df.limit(limit) if limit else df


def scan_delimited(
    spark: SparkSession, path: str, schema: str, *, sep: str = "\t", columns: Sequence[str] | None = None
) -> DataFrame:
    """Headerless delimited Latin-1 text with columns declared by position."""
    df = spark.read.schema(schema).csv(path, sep=sep, encoding="ISO-8859-1", header=False)
    return df.select(*columns) if columns else df


def scan_parquet_union(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """All Parquet files below a prefix. With a declared schema, older files read as NULL
    where a column is missing; without one the file schemas are merged."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is not None:
        return reader.schema(schema).parquet(path)
    return reader.option("mergeSchema", "true").parquet(path)


def parse_events(df: DataFrame, payload: str | Column = "value", schema: str = EVENT_SCHEMA) -> DataFrame:
    """Raw messages plus the parsed event ``e``; NULL when the JSON is broken."""
    col = F.col(payload) if isinstance(payload, str) else payload
    return df.withColumn("e", F.from_json(col.cast("string"), schema))


def flatten_events(
    df: DataFrame,
    *,
    payload: str = "value",
    required: Sequence[str] = REQUIRED_GROUPS,
    on_missing: str = "quarantine",
    keep: Sequence[str] = ("kafka_partition", "kafka_offset"),
) -> DataFrame:
    """Nested events as flat rows with a ``problem`` column.

    A missing optional group gives NULLs. A missing required group is an error:
    ``on_missing`` keeps such rows marked (quarantine), drops them, or fails the job.
    """
    parsed = parse_events(df, payload)
    problem = F.when(F.col("e").isNull(), F.lit("unreadable"))
    for group in required:
        problem = problem.when(F.col(f"e.{group}").isNull(), F.lit(f"missing {group}"))
    if on_missing == "fail":
        problem = F.when(problem.isNotNull(), F.raise_error(problem))
    flat = parsed.select(
        *[F.col(src).alias(name) for name, src in FLAT_FIELDS.items()], *keep, problem.alias("problem")
    )
    return flat.filter(F.col("problem").isNull()) if on_missing == "drop" else flat


def kafka_events(spark: SparkSession, servers: str, topic: str, *, starting: str = "earliest", per_trigger: int = 100_000):
    """The event topic as a stream, with partition and offset."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )
    return raw.select(
        F.col("value").cast("string").alias("value"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )


def json_line_events(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """The same messages from files: one JSON object per line with value, partition, offset."""
    return (
        spark.readStream.schema("value string, kafka_partition int, kafka_offset long")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def scan_nested_results(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Benchmark result files: one row per model and prompt."""
    schema = "model string, results array<struct<prompt: long, category: string, score: int, speed: double, ram: double>>"
    nested = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return nested.select("model", F.explode("results").alias("r")).select("model", "r.*")


def scan_documents_dir(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """One row per text file; ``names`` maps stored file names to original ones."""
    df = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")
    )
    if names is None:
        return df.withColumn("original", F.col("file"))
    joined = df.join(names.select("file", F.col("original").alias("_o")), "file", "left")
    return joined.withColumn("original", F.coalesce("_o", "file")).drop("_o")


def list_files(spark: SparkSession, path: str, *, glob: str = "*", max_items: int | None = None) -> DataFrame:
    """Name, type and size of the files that match; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = df.select(name.alias("name"), F.lit("file").alias("type"), F.col("length").alias("size"))
    return listed.orderBy("name").limit(max_items) if max_items else listed
