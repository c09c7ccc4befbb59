"""Reading and writing dump tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.clock import ns_from_timestamp
from framelake.sources import records


_FOUND_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_ENTRY = "struct<file: string, size: bigint, offsets: array<bigint>>"


def register(spark: SparkSession) -> None:
    """Make the "dump" format known to a session."""
    spark.dataSource.register(records.DumpDataSource)


def read_dump(spark: SparkSession, path: str, mode: str = "FAILFAST", time_hint_ns: int | None = None) -> DataFrame:
    """All records below ``path``.  ``PERMISSIVE`` turns the unreadable rest of a file into one row with ``corrupt``."""
    register(spark)
    reader = spark.read.format("dump").option("mode", mode)
    if time_hint_ns is not None:
        reader = reader.option("timeHintNs", str(time_hint_ns))
    return reader.load(path)


def stream_dump(spark: SparkSession, path: str, mode: str = "FAILFAST", time_hint_ns: int | None = None,
                max_files: int | None = None, listed: bool | None = None) -> DataFrame:
    """Records as they appear in a folder.

    A folder that ``write_dump`` fills is followed by its manifests: what a manifest lists is read once, in as many
    parts as the manifest names, and what no manifest lists is not read.  In a folder of files from elsewhere every file
    is read once (``listed`` false; by default so if the folder has dump files and no manifests).  ``max_files`` bounds
    the manifests, or files, of a batch.  Spark's file source finds them and remembers them in the checkpoint.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    listed = not records.is_foreign(path) if listed is None else listed
    name = "*.json" if listed else "*" + records.SUFFIX
    source = spark.readStream.format("text" if listed else "binaryFile").option("pathGlobFilter", name)
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    if listed:
        records.prepare(path)
        entry = F.from_json("value", _ENTRY)
        ends = F.concat(F.slice(entry["offsets"], F.lit(2), F.greatest(F.size(entry["offsets"]) - 1, F.lit(0))),
                        F.array(entry["size"]))
        parts = F.arrays_zip(entry["offsets"].alias("start"), ends.alias("stop"))
        rows = source.load(f"{path.rstrip('/')}/{records.MANIFESTS}").select(
            F.concat(F.lit(path.rstrip("/") + "/"), entry["file"]).alias("path"), F.explode(parts).alias("p"))
        found = rows.select("path", F.lit(0).cast("bigint").alias("mtime_ns"), F.col("p.start").alias("start"),
                            F.col("p.stop").alias("stop")).repartition("path", "start")
    else:
        found = source.schema(_FOUND_FILES).load(path).select(
            "path", ns_from_timestamp(F.col("modificationTime")).alias("mtime_ns"),
            F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))
    permissive = mode == "PERMISSIVE"

    def body(batches):
        return records.read_listed(batches, time_hint_ns, permissive)

    body.__module__ = records.__name__  # shipped by value with the record functions
    return found.mapInArrow(body, records.DUMP_DDL)


def write_dump(matched: DataFrame, path: str, roll_bytes: int = records.ROLL_BYTES, batch_id: int | None = None,
               by_time: bool = False, part_bytes: int = records.PART_BYTES) -> None:
    """Append rows with ``filter_id``, ``ts_ns`` and ``payload`` as dump files; all of them appear together.

    A task writes one file per 3.258-day epoch it meets.  Captures read in time order need nothing more; ``by_time``
    range-partitions other input by time first, so that it does not end up in many small files.
    """
    register(matched.sparkSession)
    rows = matched.select("filter_id", "ts_ns", "payload")
    if by_time:
        rows = rows.repartitionByRange("ts_ns")
    writer = rows.write.format("dump").mode("append").option("rollBytes", str(roll_bytes)).option(
        "partBytes", str(part_bytes))
    if batch_id is not None:
        writer = writer.option("batchId", str(batch_id))
    writer.save(path)
