"""Delivery reconciliation: which matched frames never arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.clock import low_bits


def _sides(df: DataFrame, expected: int) -> DataFrame:
    stamp = F.col("ts48") if "ts48" in df.columns else low_bits(F.col("ts_ns"))
    return df.select(
        "filter_id", stamp.alias("_ts48"), F.sha2(F.col("payload"), 256).alias("_digest"),
        F.lit(expected).cast("bigint").alias("_matched"), F.lit(1 - expected).cast("bigint").alias("_delivered"),
    )


def dump_drops(matched: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per rule: frames matched, delivered, and lost, as a multiset difference.

    Both sides are stacked and counted in one aggregation with map-side combining, so copies of one frame collapse
    before the shuffle and only digests travel.  Timestamps are compared by the 48 bits a dump record preserves.
    """
    both = _sides(matched, 1).unionByName(_sides(delivered, 0))
    per_frame = both.groupBy("filter_id", "_ts48", "_digest").agg(
        F.sum("_matched").alias("_m"), F.sum("_delivered").alias("_d"))
    return per_frame.groupBy("filter_id").agg(
        F.sum("_m").alias("matched"),
        F.sum("_d").alias("delivered"),
        F.sum(F.greatest(F.col("_m") - F.col("_d"), F.lit(0).cast("bigint"))).alias("dropped"),
    )
