"""Continuous interval statistics and snapshots over the interval table they fill."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from framelake.functions.clock import floor_div
from framelake.functions.measures import entropy_bits, entropy_terms
from framelake.functions.packed import be_uint
from framelake.operators.stats import SKETCH_LG_K
from framelake.plans.snapshot import snapshots

INTERVAL_TABLE = ("filter_id bigint, interval bigint, packets bigint, bytes bigint, src_window_packets bigint, "
                  "src_sketch binary, dst_sketch binary, src_entropy_bits double")


def interval_stream(matched: DataFrame, interval_seconds: float, late: str = "0 seconds") -> DataFrame:
    """One row per rule and closed interval, as ``operators.stats.interval_stats`` gives for a table.

    ``matched`` is a stream with ``filter_id``, ``ts``, ``n_bytes``, ``stat_ok`` and addresses.  Two chained windowed
    aggregations: per address, then per rule.  State is keyed by (interval, rule, side, address) and therefore spread
    over all tasks, and is dropped once the watermark (``late`` behind the newest frame) passes the interval.  Frames
    later than that are not counted, and the newest interval stays open; compute such intervals from the stored frames
    and put them in with ``correct_intervals``.  Intervals are whole microseconds wide.
    """
    micros = round(interval_seconds * 1_000_000)
    width = f"{micros} microseconds"
    raw = "src_raw" in matched.columns
    address = {side: F.when(F.col("stat_ok"), F.col(f"{side}_raw" if raw else f"{side}_ip")) for side in ("src", "dst")}
    sides = F.array(*[F.struct(F.lit(s).alias("side"), a.alias("ip")) for s, a in address.items()])
    flat = matched.withWatermark("ts", late).select("ts", "filter_id", "n_bytes", F.inline(sides))
    per_ip = flat.groupBy(F.window("ts", width), "filter_id", "side", "ip").agg(
        F.count("*").alias("c"), F.sum("n_bytes").alias("b"))
    per_ip = per_ip.withColumn("ip", be_uint(F.col("ip"))) if raw else per_ip  # one kind of address in all sketches
    src, known, c = F.col("side") == "src", F.col("ip").isNotNull(), F.col("c")
    per_rule = per_ip.groupBy(F.window(F.window_time("window"), width).alias("window"), "filter_id").agg(
        F.sum(F.when(src, c)).alias("packets"),
        F.sum(F.when(src, F.col("b"))).alias("bytes"),
        F.coalesce(F.sum(F.when(src & known, c)), F.lit(0)).alias("src_window_packets"),
        *entropy_terms(F.when(src & known, c)),
        *[F.hll_sketch_agg(F.when(F.col("side") == s, F.col("ip")), F.lit(SKETCH_LG_K)).alias(f"{s}_sketch")
          for s in ("src", "dst")],
    )
    number = floor_div(F.unix_micros(F.col("window.start")), micros)
    return per_rule.select(
        "filter_id", number.alias("interval"), "packets", "bytes", "src_window_packets", "src_sketch", "dst_sketch",
        entropy_bits(F.col("src_window_packets")).alias("src_entropy_bits"))


def interval_writer(intervals: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Append closed intervals to a Parquet table; the file sink's log makes each batch appear exactly once."""
    return intervals.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option(
        "path", table)


_POINTER = "put string, version bigint, seq bigint"


def correct_intervals(intervals: DataFrame, table: str, version: int) -> None:
    """Put in whole intervals computed from stored frames; they replace what the stream wrote for these intervals.

    Each correction is written to a folder of its own and counts from the moment its pointer, a single small file, is
    there: readers see all of it or nothing.  For each interval the highest ``version`` counts, and of equal versions
    the last one put in; corrections of other intervals stay as they are.
    """
    spark, root = intervals.sparkSession, f"{table.rstrip('/')}-corrections"
    put = uuid.uuid4().hex
    intervals.select(*[c.split()[0] for c in INTERVAL_TABLE.split(", ")]).write.parquet(f"{root}/data/put={put}")
    pointer = spark.createDataFrame([(put, version, time.time_ns())], _POINTER).coalesce(1)
    pointer.write.mode("append").json(f"{root}/log")


def _corrections(spark: SparkSession, table: str) -> DataFrame | None:
    """All corrections with pointers, each row with the order in which it counts."""
    root = f"{table.rstrip('/')}-corrections"
    try:
        log = spark.read.schema(_POINTER).json(f"{root}/log")
        data = spark.read.schema(f"{INTERVAL_TABLE}, put string").parquet(f"{root}/data")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return data.join(log, "put").withColumn("rank", F.struct("version", "seq", "put")).drop("put", "version", "seq")


def read_intervals(spark: SparkSession, table: str) -> DataFrame:
    """The interval table with its corrections."""
    streamed, corrected = spark.read.schema(INTERVAL_TABLE).parquet(table), _corrections(spark, table)
    if corrected is None:
        return streamed
    newest = corrected.groupBy("interval").agg(F.max("rank").alias("rank"))
    latest = corrected.join(newest, ["interval", "rank"], "left_semi").select(*streamed.columns)
    return streamed.join(newest, "interval", "left_anti").select(*latest.columns).unionByName(latest)


def current_snapshots(spark: SparkSession, table: str, last: int | None = None) -> DataFrame:
    """Cumulative snapshots of everything the stream has closed so far.

    Running totals are derived from the small interval table instead of being kept as stream state, so they survive
    query restarts and can be recomputed after corrections.
    """
    return snapshots(read_intervals(spark, table), last=last)
