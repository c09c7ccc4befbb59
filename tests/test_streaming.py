import datetime as dt

from packet_bytes import frame, frames_df, rules_df

from framelake.operators.decode import decode
from framelake.operators.match import match
from framelake.plans import snapshot as S
from framelake.session import stage
from framelake.sources.dump import read_dump
from framelake.sources.frames import from_capture_clock, stream_frames
from framelake.streaming import intervals as SI
from framelake.streaming import live
from framelake.streaming import match as SM

SEC = 10**9


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_rule_edits_take_effect_with_the_next_batch(spark, work):
    source, out, checkpoint, rules = work(), work(), work(), work()
    rules_df(spark, [{"protocol": "tcp"}]).write.parquet(rules)

    def run():
        drain(SM.match_writer(stream_frames(spark, source, max_files=1), lambda: spark.read.parquet(rules), out,
                              checkpoint, columns=["capture_id", "ts_ns", "filter_id"]))
        return sorted((r.ts_ns, r.filter_id) for r in spark.read.parquet(out).collect())

    frames_df(spark, [frame()], ts=[1]).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(1, 1)]
    both = rules_df(spark, [{"protocol": "udp"}, {"protocol": "tcp"}]).filter("rule_id = 2")
    both.write.mode("append").parquet(rules)
    frames_df(spark, [frame()], ts=[2]).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(1, 1), (2, 1), (2, 2)]


def test_replayed_batch_replaces_itself(spark, work):
    out = work()
    batch = frames_df(spark, [frame(), frame(proto=17)])
    rules = rules_df(spark, [{"protocol": "tcp"}])

    class Capture:
        """Stands for the stream: hands out the batch function."""

        @property
        def writeStream(self):
            return self

        def foreachBatch(self, function):
            self.function = function
            return self

        def option(self, *_):
            return self

    capture = SM.match_writer(Capture(), lambda: rules, out, "unused")
    for batch_id in (0, 1, 1, 0):
        capture.function(batch, batch_id)
    assert spark.read.parquet(out).count() == 2


def test_frames_to_dump_files_and_back(spark, work):
    source, out, checkpoint = work(), work(), work()
    rules = rules_df(spark, [{"protocol": "tcp"}, {}])

    def run():
        drain(SM.dump_writer(stream_frames(spark, source, max_files=1), lambda: rules, out, checkpoint))
        return sorted((r.filter_id, r.ts_ns, r.wire_len) for r in read_dump(spark, out).collect())

    frames_df(spark, [frame(size=50), frame(proto=17, size=60)], ts=[10**18, 2 * 10**18]).write.parquet(source)
    first = [(1, 10**18, 50), (2, 10**18, 50), (2, 2 * 10**18, 60)]
    assert run() == first
    assert run() == first
    frames_df(spark, [frame(size=70)], ts=[5]).write.mode("append").parquet(source)
    assert run() == sorted([*first, (1, 5, 70), (2, 5, 70)])


def test_closed_intervals_equal_batch_and_late_frames_are_left_to_it(spark, work):
    source, table, checkpoint = work(), work(), work()
    rules = rules_df(spark, [{}, {"protocol": "udp"}])
    times = [0, 1, 1, 9, 12, 13, 25, 31]
    first = [frame(f"10.0.0.{i % 3}", version=[4, 4, 6][i % 3], proto=[6, 17][i % 2]) for i in range(8)]

    def run():
        matched = match(decode(stream_frames(spark, source)), rules)
        drain(SI.interval_writer(SI.interval_stream(matched, 10), table, checkpoint))
        return SI.read_intervals(spark, table)

    frames_df(spark, first, ts=[t * SEC for t in times]).write.mode("append").parquet(source)
    closed = run()
    shared = ["filter_id", "interval", "packets", "bytes", "src_window_packets", "src_entropy_bits"]
    batch = S.intervals_of_packets(decode(spark.read.parquet(source)), rules, 10 * SEC)
    want = sorted(map(tuple, batch.filter("interval < 3").select(*shared).collect()))
    assert sorted(map(tuple, closed.select(*shared).collect())) == want

    # a frame for an interval already closed changes nothing here, but a batch run over the stored frames has it
    frames_df(spark, [frame(), frame()], ts=[5 * SEC, 45 * SEC]).write.mode("append").parquet(source)
    again = run()
    assert sorted(map(tuple, again.filter("interval < 3").select(*shared).collect())) == want
    assert again.filter("interval = 3").count() == 2
    stored = S.intervals_of_packets(decode(spark.read.parquet(source)), rules, 10 * SEC)
    assert stored.filter("interval = 0 AND filter_id = 1").first().packets == 5

    snapshots = {(r.filter_id, r.interval): r for r in SI.current_snapshots(spark, table).collect()}
    exact = {(r.filter_id, r.interval): r
             for r in S.snapshots(stage(batch, "t"), last=3).collect()}
    assert sorted(snapshots) == sorted(exact)
    for key, r in snapshots.items():
        assert (r.packets, r.unique_src_ips) == (exact[key].packets, exact[key].unique_src_ips)


def test_time_column_follows_nanoseconds(spark):
    r = decode(frames_df(spark, [frame()], ts=[1_704_067_200_123_456_789])).first()
    assert r.ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)


def test_capture_clock(spark):
    rows = spark.createDataFrame([(1_704_067_200, 999_999_999)], "sec long, nsec long")
    assert from_capture_clock(rows).first().ts_ns == 1_704_067_200_999_999_999


def test_stream_with_more_rules_than_are_broadcast(spark, work):
    source, table = work(), work()
    frames_df(spark, [frame(f"10.0.{i}.1") for i in range(20)], ts=[i * SEC for i in range(20)]).coalesce(1).write.parquet(source)
    rules = rules_df(spark, [{"src_ip": f"10.0.{i}.0/{24 + i % 3}"} for i in range(60)])
    found = match(decode(stream_frames(spark, source)), rules, plan="keyed", broadcast_rules=0)
    drain(SI.interval_writer(SI.interval_stream(found, 0.5), table, work()))
    got = {r.filter_id: r.interval for r in SI.read_intervals(spark, table).collect()}
    assert got == {i + 1: 2 * i for i in range(19)}  # the newest interval stays open


def test_corrections_replace_whole_intervals(spark, work):
    source, table = work(), work()
    frames_df(spark, [frame(), frame(), frame()], ts=[0, SEC, 2 * SEC]).coalesce(1).write.parquet(source)
    found = match(decode(stream_frames(spark, source)), rules_df(spark, [{"protocol": "tcp"}]))
    drain(SI.interval_writer(SI.interval_stream(found, 1), table, work()))
    first = SI.read_intervals(spark, table).filter("interval = 0")
    for version, packets in ((2, 9), (1, 5), (2, 7)):
        SI.correct_intervals(first.selectExpr(*[c if c != "packets" else f"{packets}L as packets" for c in first.columns]),
                             table, version)
    assert sorted((r.interval, r.packets) for r in SI.read_intervals(spark, table).collect()) == [(0, 7), (1, 1)]
    # another interval under a version already used: both corrections hold
    second = SI.read_intervals(spark, table).filter("interval = 1")
    SI.correct_intervals(second.selectExpr(*[c if c != "packets" else "4L as packets" for c in second.columns]), table, 2)
    assert sorted((r.interval, r.packets) for r in SI.read_intervals(spark, table).collect()) == [(0, 7), (1, 4)]
    # one without a pointer is not seen, as if it had stopped half way
    second.write.parquet(f"{table}-corrections/data/put=unfinished")
    assert SI.read_intervals(spark, table).count() == 2


class Batches:
    """Stands for a stream: hands out the batch function."""

    writeStream = property(lambda self: self)

    def foreachBatch(self, function):
        self.function = function
        return self

    def option(self, *_):
        return self


def test_live_ledger_equals_batch_and_repeats_nothing(spark, work):
    rules = [{"protocol": "tcp"}, {}, {"src_ip": "10.0.0.0/31"}]
    table = rules_df(spark, rules)
    payloads = [frame(f"10.0.0.{i % 5}", proto=[6, 17][i % 2], version=[4, 4, 6][i % 3]) for i in range(40)]
    times = [t * SEC for t in (0, 1, 1, 2, 9, 12, 13, 25, 31, 33, 33, 34, 48, 50, 51, 52, 77, 78, 79, 80)] * 2
    rows = sorted(zip(times, payloads), key=lambda r: r[0])
    out, feed = work(), Batches()
    live.live_statistics(feed, lambda: table, out, "", 10 * SEC)
    cuts = [0, 3, 3, 11, 18, 25, 40]
    batches = [frames_df(spark, [p for _, p in rows[a:b]], ts=[t for t, _ in rows[a:b]]) for a, b in zip(cuts, cuts[1:])]
    for i, batch in enumerate(batches):
        if i == 3:  # the query is started anew, and batch 2 comes once more; an attempt left half of batch 3
            feed = Batches()
            live.live_statistics(feed, lambda: table, out, "", 10 * SEC)
            feed.function(batches[2], 2)
            batches[0].select("ts_ns").write.parquet(f"{out}/counts/batch=3")
        feed.function(batch, i)
        if i == 4:
            half = live.read_live(spark, out, "intervals").agg({"interval": "max"}).first()[0]
            assert half is not None and half < rows[24][0] // (10 * SEC)
    nothing, feed = batches[0].filter("ts_ns < 0"), Batches()
    live.live_statistics(feed, lambda: table, out, "", 10 * SEC, idle_seconds=0)
    for i in (6, 7):  # the idle timer closes what is left, once
        feed.function(nothing, i)
    stored = decode(frames_df(spark, [p for _, p in rows], ts=[t for t, _ in rows]))
    want = S.intervals_of_packets(stored, table, 10 * SEC)
    shared = ["filter_id", "interval", "packets", "bytes", "src_window_packets", "src_entropy_bits"]
    got = live.read_live(spark, out, "intervals")
    assert sorted(map(tuple, got.select(*shared).collect())) == sorted(map(tuple, want.select(*shared).collect()))
    full = sorted(map(tuple, S.snapshots(stage(want, "t"), block=3).select(*S.SNAPSHOT_COLUMNS).collect()))
    assert sorted(map(tuple, live.read_live(spark, out, "snapshots").select(*S.SNAPSHOT_COLUMNS).collect())) == full
    ticks = live.read_ticks(spark, out).collect()
    assert sorted(map(tuple, ticks)) == sorted((r[0], *r[2:]) for r in full)
    assert live.late_counts(spark, out).count() == 0
    feed.function(batches[0], 8)  # frames of long ago
    assert {(r.filter_id, r.interval) for r in live.late_counts(spark, out).collect()} >= {(1, 0), (2, 0)}
    assert live.read_live(spark, out, "intervals").count() == got.count()


def test_live_statistics_of_rules_edited_between_batches(spark, work):
    rules, out, feed = work(), work(), Batches()
    rules_df(spark, [{"protocol": "tcp"}]).write.parquet(rules)
    live.live_statistics(feed, lambda: spark.read.parquet(rules), out, "", SEC)
    feed.function(frames_df(spark, [frame(), frame(proto=17)], ts=[0, 1]), 0)
    rules_df(spark, [{}, {"protocol": "udp"}]).filter("rule_id = 2").write.mode("append").parquet(rules)
    feed.function(frames_df(spark, [frame(), frame(proto=17), frame()], ts=[SEC, SEC + 1, 5 * SEC]), 1)
    got = sorted((r.filter_id, r.interval, r.packets) for r in live.read_live(spark, out, "intervals").collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    ticks = live.read_live(spark, out, "snapshots").filter("filter_id = 2").orderBy("interval").collect()
    assert [(r.interval, r.packets) for r in ticks] == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert live.read_live(spark, work(), "snapshots").count() == 0
