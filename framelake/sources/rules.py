"""Rule files: JSON requests or flag strings, one per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import rules


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``line_no``: 1, 2, 3, ... over all files by name and then by place in the file.

    Lines are counted per split of a file; only those counts, one row per split, are put in order in one task.
    """
    split = ["_file", "_at"]
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_pos"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    before = raw.groupBy(*split).count().select(*split, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_pos"))
    return raw.withColumn("_place", place).join(before, split).select(
        "value", (F.col("_before") + F.col("_place")).alias("line_no"))


def read_json_rules(spark: SparkSession, path: str) -> DataFrame:
    """Specs from lines ``{"filter": {...}}`` with ``line_no``; bad lines are kept and marked."""
    return rules.from_json(read_lines(spark, path))


def read_flag_rules(spark: SparkSession, path: str) -> DataFrame:
    """Specs from lines ``protocol:src_ip:dst_port`` with ``line_no``; bad lines are kept and marked."""
    return rules.from_flags(read_lines(spark, path))
