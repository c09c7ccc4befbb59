import math

import pytest
from packet_bytes import frame, frames_df, rules_df
from pyspark.sql import functions as F

from framelake.operators import stats
from framelake.operators.blocked import carry_forward, fill_intervals, previous, running
from framelake.operators.decode import decode
from framelake.operators.flows import flow_id, flow_summary
from framelake.operators.match import match
from framelake.operators.reconcile import dump_drops
from framelake.plans import snapshot as S
from framelake.session import stage


def hits(spark, rows):
    """Rows that already carry a rule: (filter_id, ts_ns, src, dst, stat_ok, n_bytes)."""
    return spark.createDataFrame(
        rows, "filter_id long, ts_ns long, src_ip long, dst_ip long, stat_ok boolean, n_bytes long")


@pytest.mark.parametrize("n,bound", [(100, 0.05), (1000, 0.02), (10000, 0.02)])
def test_sketch_error_bounds(spark, n, bound):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("filter_id"), F.col("id").alias("ts_ns"),
                                 (F.col("id") + 167772160).alias("src_ip"), F.lit(5).cast("long").alias("dst_ip"),
                                 F.lit(True).alias("stat_ok"), F.lit(60).cast("long").alias("n_bytes"))
    r = stats.unique_ips(rows).first()
    assert abs(r.unique_src_ips - n) <= bound * n and r.unique_dst_ips == 1
    assert stats.unique_ips(rows, exact=True).first().unique_src_ips == n


def test_sketch_starts_anew_each_interval(spark):
    rows = hits(spark, [(1, i % 2 * 10, i, 1, True, 1) for i in range(100)] + [(1, 20, 7, 1, True, 1)])
    got = {r.interval: r.unique_src_ips for r in stats.interval_uniques(rows, 10).collect()}
    assert got == {0: 50, 1: 50, 2: 1}


def test_entropy(spark):
    rows = ([(1, 0, i % 8, 1, True, 1) for i in range(64)] + [(2, 0, 5, 1, True, 1)] * 10
            + [(3, 0, 1, 1, True, 1)] * 3 + [(3, 0, 2, 1, True, 1)])
    got = {r.filter_id: r for r in stats.src_entropy(hits(spark, rows), 10).collect()}
    assert got[1].src_entropy_bits == pytest.approx(3.0) and got[2].src_entropy_bits == 0.0
    want = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert got[3].src_entropy_bits == pytest.approx(want) and got[3].src_window_packets == 4


@pytest.mark.parametrize("exact", [True, False])
def test_frames_without_valid_addresses_count_only_as_packets(spark, exact):
    rows = hits(spark, [(1, 0, 5, 6, False, 100), (1, 0, 7, 8, True, 50), (2, 0, 1, 1, False, 9)])
    got = {r.filter_id: r for r in S.snapshots(stage(S.intervals_of_matched(rows, 10, exact), "t")).collect()}
    one, two = got[1], got[2]
    assert (one.packets, one.bytes, one.unique_src_ips, one.src_window_packets) == (2, 150, 1, 1)
    assert (two.packets, two.unique_src_ips, two.unique_dst_ips, two.src_entropy_bits, two.src_window_packets) == (1, 0, 0, 0.0, 0)


@pytest.mark.parametrize("exact,block", [(True, 1), (True, 4096), (False, 2), (False, 4096)])
def test_totals_run_on_while_entropy_restarts(spark, exact, block):
    rows = [(1, 0, 1, 1, True, 10), (1, 5, 2, 1, True, 10), (1, 40, 1, 2, True, 10), (1, 45, 3, 2, True, 10),
            (2, 10, 9, 9, True, 1), (3, 60, 1, 1, True, 1)]
    table = stage(S.intervals_of_matched(hits(spark, rows), 10, exact), "t")
    got = {(r.filter_id, r.interval): r for r in S.snapshots(table, block=block).collect()}
    assert sorted(got) == ([(1, i) for i in range(7)] + [(2, i) for i in range(1, 7)] + [(3, 6)])
    assert [got[1, i].packets for i in range(7)] == [2, 2, 2, 2, 4, 4, 4]
    assert [got[1, i].unique_src_ips for i in range(7)] == [2, 2, 2, 2, 3, 3, 3]
    assert [got[1, i].unique_dst_ips for i in range(7)] == [1, 1, 1, 1, 2, 2, 2]
    assert [got[1, i].src_entropy_bits for i in range(7)] == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert [got[1, i].src_window_packets for i in range(7)] == [2, 0, 0, 0, 2, 0, 0]


def test_identical_frames_under_a_rule_registered_twice(spark):
    one = frame("192.168.99.2", "192.168.99.1", 12345, 443, 17, 1000)
    df = decode(frames_df(spark, [one]).withColumn("ts_ns", F.explode(F.sequence(F.lit(0), F.lit(9999)))))
    rules = rules_df(spark, [{"protocol": "udp", "dst_port": 443}] * 2)
    got = S.snapshot(df, rules, 10**9).orderBy("filter_id").collect()
    assert [r.filter_id for r in got] == [1, 2]
    for r in got:
        assert (r.packets, r.bytes, r.unique_src_ips, r.unique_dst_ips) == (10000, 10_000_000, 1, 1)
        assert (r.src_entropy_bits, r.src_window_packets) == (0.0, 10000)


def test_both_interval_plans_agree(spark):
    payloads = [frame(f"10.0.{i % 3}.{i % 7}", f"10.9.0.{i % 5}", dport=[443, 53][i % 2], version=[4, 4, 6][i % 3])
                for i in range(60)]
    df = decode(frames_df(spark, payloads))
    rules = rules_df(spark, [{}, {"dst_port": 443}, {"src_ip": "10.0.1.0/24"}, {"dst_ip": "10.9.0.3"}])
    columns = ["filter_id", "interval", "packets", "bytes", "src_window_packets", "new_src", "new_dst",
               F.round("src_entropy_bits", 9)]
    a = S.intervals_of_packets(df, rules, 10, exact=True).select(*columns)
    b = S.intervals_of_matched(match(df, rules), 10, exact=True).select(*columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_top_peers(spark):
    rows = [(1, 0, ip, 1, True, 1) for ip in (5, 5, 5, 3, 3, 4, 4, 9)]
    got = [(r.peer_rank, r.src_ip, r.c) for r in stats.top_peers(hits(spark, rows), 10, 3).orderBy("peer_rank").collect()]
    assert got == [(1, 5, 3), (2, 3, 2), (3, 4, 2)]


def test_flows_fold_directions(spark):
    there, back = frame("10.0.0.2", "10.0.0.1", 99, 443), frame("10.0.0.1", "10.0.0.2", 443, 99)
    df = decode(frames_df(spark, [there, there, back, frame(proto=1)]))
    both = flow_summary(df).filter("ip_proto = 6").withColumn("id", flow_id()).collect()
    assert [(r.packets, r.packets_ab, r.packets_ba, r.port_a, r.first_ns, r.last_ns) for r in both] == [(3, 1, 2, 443, 1, 3)]
    assert flow_summary(df, bidirectional=False).count() == 3


def test_reconciliation_counts_copies(spark):
    ddl = "filter_id long, ts_ns long, payload binary"
    rows = [(1, 5, bytearray(b"a"))] * 3 + [(1, 6, bytearray(b"a")), (2, 5, bytearray(b"b"))]
    got = dump_drops(spark.createDataFrame(rows, ddl), spark.createDataFrame(rows[:2] + rows[4:], ddl)).orderBy("filter_id")
    assert [tuple(r) for r in got.collect()] == [(1, 4, 2, 2), (2, 1, 1, 0)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocked_windows_equal_plain_ones(spark, block):
    rows = [(k, t, t * t) for k in ("a", "b", None) for t in (-7, -1, 0, 2, 3, 9, 30)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = running(previous(df, ["k"], "t", block, {"v": "before"}), ["k"], "t", block, sums={"v": "total"})
    want, last, total = [], {}, {}
    for k, t, v in rows:
        total[k] = total.get(k, 0) + v
        want.append((k, t, v, last.get(k), total[k]))
        last[k] = v
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_gaps_are_filled_to_a_given_end(spark):
    df = spark.createDataFrame([("a", 2), ("a", 4), ("b", 5)], "k string, t long")
    got = sorted(map(tuple, fill_intervals(df, ["k"], "t", 2, last=6).collect()))
    assert got == [("a", i) for i in range(2, 7)] + [("b", 5), ("b", 6)]


def test_gaps_end_before_keys_that_start_later(spark):
    df = spark.createDataFrame([(1, 2), (1, 5), (2, 10)], "k int, t long")
    got = sorted(map(tuple, fill_intervals(df, ["k"], "t", block=4, last=7).collect()))
    assert got == [(1, t) for t in range(2, 8)]


def test_latest_values_are_carried_over_blocks(spark):
    rows = [(k, t, 10 * t if t % 7 == k else None) for k in (1, 2) for t in range(20)]
    df = spark.createDataFrame(rows, "k int, t long, x long")
    got = {(r.k, r.t): r.x for r in carry_forward(df, ["k"], "t", 4, ["x"]).collect()}
    for k in (1, 2):
        latest = None
        for t in range(20):
            latest = 10 * t if t % 7 == k else latest
            assert got[k, t] == latest


def test_many_top_peers_are_ranked_in_parts(spark):
    from framelake.operators.stats import top_peers

    matched = hits(spark, [(1, 0, i % 3000, 1, True, 60) for i in range(7000)])
    got = sorted((r.peer_rank, r.src_ip, r.c) for r in top_peers(matched, 10**9, 2000).collect())
    want = sorted(((3 if i < 1000 else 2, i) for i in range(3000)), key=lambda x: (-x[0], x[1]))[:2000]
    assert got == [(k + 1, ip, c) for k, (c, ip) in enumerate(want)]
