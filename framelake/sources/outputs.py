"""Sinks: snapshot lines and the benchmark log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.schemas import BENCH_RUNS

# Field names of a snapshot entry, in output order.
SNAPSHOT_FIELDS = ("filter_id", "packets", "bytes", "unique_src_ips", "unique_dst_ips", "src_entropy_bits",
                   "src_window_packets")


def snapshot_lines(snapshots: DataFrame) -> DataFrame:
    """One row per interval with ``filters``, an array of entries ordered by rule.

    A group has one entry per rule that was hit, so it is as large as the rule table, not as the traffic.
    """
    entry = F.struct(*SNAPSHOT_FIELDS)
    return snapshots.groupBy("interval").agg(F.array_sort(F.collect_list(entry)).alias("filters"))


def write_snapshot_json(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines ``{"filters": [...]}`` in interval order."""
    lines = snapshot_lines(snapshots)
    ordered = lines.repartitionByRange("interval").sortWithinPartitions("interval")
    ordered.select("filters").write.mode(mode).json(path)


def read_snapshot_json(spark: SparkSession, path: str, upto_batch: int | None = None) -> DataFrame:
    """Entries of written snapshot lines, one row each; of a folder with a subfolder per batch, those of the batches up
    to ``upto_batch``."""
    entry = ("struct<filter_id: bigint, packets: bigint, bytes: bigint, unique_src_ips: bigint, unique_dst_ips: bigint, "
             "src_entropy_bits: double, src_window_packets: bigint>")
    if upto_batch is None:
        return spark.read.schema(f"filters array<{entry}>").json(path).select(F.inline("filters"))
    lines = spark.read.schema(f"filters array<{entry}>, batch bigint").json(path)
    return lines.filter(F.col("batch") <= upto_batch).select(F.inline("filters"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Add benchmark runs to the log; earlier runs are never rewritten."""
    runs.select(*[F.col(f.name).cast(f.dataType) for f in BENCH_RUNS]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_RUNS).parquet(path)
