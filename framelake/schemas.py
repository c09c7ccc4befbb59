"""Table layouts shared by sources, operators and tests."""

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("snap_len", T.LongType()),
    T.StructField("wire_len", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])

DUMP = T.StructType([
    T.StructField("filter_id", T.LongType()),
    T.StructField("ts48", T.LongType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("wire_len", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("src_file", T.StringType()),
    T.StructField("src_offset", T.LongType()),
    T.StructField("corrupt", T.StringType()),
])

RULE_SPEC = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
])

RULE_REQUEST = T.StructType([T.StructField("filter", RULE_SPEC)])

COUNTERS = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("rx_packets", T.LongType()),
    T.StructField("rx_drops", T.LongType()),
    T.StructField("tx_packets", T.LongType()),
    T.StructField("freeze_q_count", T.LongType()),
])

BENCH_RUNS = T.StructType([
    T.StructField("branch", T.StringType()),
    T.StructField("commit", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("pps", T.LongType()),
    T.StructField("gbps", T.DoubleType()),
    T.StructField("cpu_percent", T.DoubleType()),
    T.StructField("rx_drops_at_pps", T.LongType()),
    T.StructField("notes", T.StringType()),
])
