"""The physical plans that matter at scale."""

import pytest
from packet_bytes import frame, frames_df, rules_df
from pyspark.sql import functions as F

from framelake.operators import match as m
from framelake.operators import prefilter, stats
from framelake.operators.decode import decode, packets
from framelake.plans.snapshot import intervals_of_packets, running_totals, snapshots
from framelake.session import stage
from framelake.sources.frames import read_frames, write_packets


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark):
    from framelake.session import work_path

    raw, table = work_path(spark, "raw"), work_path(spark, "packets")
    frames_df(spark, [frame(f"10.0.0.{i}") for i in range(20)], ts=[i * 10**13 for i in range(20)]).write.parquet(raw)
    write_packets(packets(read_frames(spark, raw)), table)
    return read_frames(spark, raw), spark.read.parquet(table)


FEW = [{"protocol": "tcp", "dst_port": 443}, {"src_ip": "10.0.0.0/30"}]
MANY = [{"src_ip": f"10.0.{i}.0/24"} for i in range(60)]


def test_few_rules_need_no_join_and_reach_the_reader(spark, stored):
    text = plan(m.match(stored[1], rules_df(spark, FEW)).select("filter_id", "n_bytes"))
    assert "Join" not in text and "Exchange" not in text
    pushed = [line for line in text.splitlines() if "PushedFilters" in line]
    assert pushed and "dst_port" in pushed[0] and "src_ip" in pushed[0]


def test_raw_frames_are_decoded_once_without_conversions(spark, stored):
    text = plan(m.match(decode(stored[0]), rules_df(spark, FEW)).groupBy("filter_id").agg(F.sum("n_bytes")))
    assert "Join" not in text and "conv(hex(substring(payload" not in text
    assert "capture_id" not in [line for line in text.splitlines() if "ReadSchema" in line][0]


def test_many_rules_hash_join_without_nested_loops(spark, stored):
    rules = rules_df(spark, MANY)
    text = plan(m.match(stored[1], rules).select("filter_id", "n_bytes"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    text = plan(m.match(stored[1], rules, broadcast_rules=0).select("filter_id", "n_bytes"))
    # rules are shuffled; only the markers of live prefix lengths, which are bounded, are broadcast: here of one size
    assert "ShuffledHashJoin" in text and "_salt" in text and text.split("\n\n")[0].count("BroadcastHashJoin") == 1


def test_prefilter_keeps_frames_in_place(spark, stored):
    text = plan(prefilter.prefilter(stored[1], rules_df(spark, FEW)).select("n_bytes"))
    assert "Exchange" not in text and "PushedFilters: [" in text
    text = plan(prefilter.prefilter(stored[1], rules_df(spark, MANY)).select("n_bytes"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "SortMerge" not in text


def test_statistics_shuffle_counts_not_frames(spark, stored):
    matched = m.match(stored[1], rules_df(spark, FEW))
    text = plan(stats.top_peers(matched, 10**9, 3))
    assert "WindowGroupLimit" in text
    scan = [line for line in plan(stats.src_entropy(matched, 10**9)).splitlines() if "ReadSchema" in line][0]
    assert "src_ip" in scan and "wire_len" not in scan and "capture_id" not in scan


def test_interval_statistics_skip_unmatched_frames(spark, stored):
    rules = rules_df(spark, FEW)
    text = plan(intervals_of_packets(stored[1], rules, 10**9))
    assert "Join" not in text and "dst_port" in [line for line in text.splitlines() if "PushedFilters" in line][0]
    text = plan(intervals_of_packets(decode(stored[0]), rules, 10**9))
    scan = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "ts_ns" in scan and "wire_len" not in scan


def test_days_prune_folders(spark, stored):
    text = plan(stored[1].filter("day = DATE'1970-01-02'").select("n_bytes"))
    assert "PartitionFilters: [isnotnull(day" in text


def test_plans_do_not_grow_with_shapes(spark, stored):
    def many(lengths):
        return rules_df(spark, [{"protocol": "tcp", "src_ip": f"10.{i % 4}.0.0/24", "dst_ip": f"192.168.{i}.0/{9 + i % lengths}"}
                                for i in range(200)])

    for build in (m.match, prefilter.prefilter, prefilter.rejected):
        few, lots = [plan(build(stored[1], many(n), broadcast_rules=b)) for n in (1, 24) for b in (100_000,)]
        assert few.count("Join") == lots.count("Join") and lots.count("Exchange") <= few.count("Exchange")


def test_no_window_over_addresses_and_no_join_after_the_sketch_window(spark, stored):
    rows = m.few_rules(rules_df(spark, FEW), 40)
    exact = plan(stats.interval_stats(stats.counts_of_packets(stored[1], rows, 10**9), exact=True))
    assert "Window" not in exact
    rough = stats.interval_stats(stats.counts_of_packets(stored[1], rows, 10**9))
    assert "Join" not in plan(running_totals(rough))


def test_snapshots_take_three_scans_and_two_windows(spark, stored):
    rules = rules_df(spark, [{}, {"protocol": "tcp"}])
    for exact in (False, True):
        intervals = stage(intervals_of_packets(stored[1], rules, 10**9, exact), "t")
        text = snapshots(intervals)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == 3 and text.count("Window [") == 2


def test_rules_of_tables_compile_on_many_tasks(spark, work):
    """F7 to F11: the filter on compiled rules was pushed below the only shuffle, into the single task of a small file."""
    from framelake.plans import workload

    d = work("tables")
    spark.range(300).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.range(40).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    cores = spark.sparkContext.defaultParallelism
    for build, rows in ((workload.user_rules, 340), (workload.shape_rules, 300), (workload.wide_rules, 300)):
        rules = build(spark, d)
        assert rules.count() == rows and rules.rdd.getNumPartitions() >= cores


def test_sources_of_rules_run_once(spark, stored):
    """F7 to F11: a lookup reads the rules several times, from a table written once."""
    text = plan(m.match(stored[1], rules_df(spark, MANY)).select("filter_id"))
    assert "rlike" not in text.lower() and "rule-table" in text
    text = plan(prefilter.prefilter(stored[1], rules_df(spark, MANY)).select("n_bytes"))
    assert "rlike" not in text.lower() and "rule-keys" in text
