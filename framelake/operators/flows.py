"""Flow summaries by 5-tuple, one-way or with both directions folded together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW_KEY = ("ip_proto", "ip_a", "port_a", "ip_b", "port_b")


def flow_id() -> Column:
    """Stable hash of a summarised flow's key."""
    return F.xxhash64(*FLOW_KEY)


def flow_summary(packets: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Packets, bytes and first/last time per flow.

    With ``bidirectional`` the lesser endpoint (address, then port) is always end A, and ``packets_ab`` /
    ``packets_ba`` tell the directions apart.  One aggregation with map-side combining; a hot flow costs one row per
    task.
    """
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    forward = (src <= dst) if bidirectional else F.lit(True)
    ends = packets.filter("match_ok").select("ip_proto", "ts_ns", "n_bytes", src.alias("_s"), dst.alias("_d"),
                                             forward.alias("_fwd"))
    a = F.when(F.col("_fwd"), F.col("_s")).otherwise(F.col("_d"))
    b = F.when(F.col("_fwd"), F.col("_d")).otherwise(F.col("_s"))
    keyed = ends.select("ip_proto", "ts_ns", "n_bytes", "_fwd", a.alias("_a"), b.alias("_b")).select(
        "ip_proto", "ts_ns", "n_bytes", "_fwd", F.col("_a.ip").alias("ip_a"), F.col("_a.port").alias("port_a"),
        F.col("_b.ip").alias("ip_b"), F.col("_b.port").alias("port_b"))
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return keyed.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packets"),
        F.sum(F.when(F.col("_fwd"), one).otherwise(zero)).alias("packets_ab"),
        F.sum(F.when(F.col("_fwd"), zero).otherwise(one)).alias("packets_ba"),
        F.sum("n_bytes").alias("bytes"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )
