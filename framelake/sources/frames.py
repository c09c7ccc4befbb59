"""Frame tables: stored captures in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.clock import floor_div, ns_from_parts, timestamp_from_ns
from framelake.schemas import FRAMES

DAY_NS = 86_400_000_000_000


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def stream_frames(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FRAMES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def from_capture_clock(rows: DataFrame, seconds: str = "sec", nanos: str = "nsec") -> DataFrame:
    """Replace a capture's (seconds, nanoseconds) pair by ``ts_ns``."""
    stamped = rows.withColumn("ts_ns", ns_from_parts(F.col(seconds), F.col(nanos)))
    return stamped.drop(seconds, nanos)


def write_packets(packets: DataFrame, path: str, mode: str = "append") -> None:
    """Store decoded packets partitioned by day, so that time ranges prune whole folders.

    ``REBALANCE`` groups rows by day for well-filled files; the adaptive optimizer splits a day that is too large for
    one task.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), floor_div(F.col("ts_ns"), DAY_NS).cast("int"))
    packets.withColumn("day", day).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def with_time(frames: DataFrame) -> DataFrame:
    """Frames with a Spark timestamp column ``ts`` for watermarks and windows."""
    return frames.withColumn("ts", timestamp_from_ns(F.col("ts_ns")))
