"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.clock import low_bits, recover_ns
from framelake.functions.net import ip_text
from framelake.operators import blocked, flows, match as m, monitor, prefilter, reconcile, rules as R, stats
from framelake.operators.decode import decodable, decode, packets
from framelake.plans import snapshot as S
from framelake.plans import workload as w
from framelake.session import stage, stream_session, work_path
from framelake.sources import dump, frames as frame_source, outputs, rules as rule_source
from framelake.streaming import intervals as SI, live as SL, match as SM

ACTIVE_AT_NS = 1_705_276_800_000_000_000
START_NS = 1_704_067_200_000_000_000


def _decoded(spark: SparkSession, d: str, capture: str = "event_id") -> DataFrame:
    return decode(w.event_frames(spark, d, capture))


def _matched(spark: SparkSession, d: str, capture: str = "event_id") -> DataFrame:
    return m.match(_decoded(spark, d, capture), w.fixed_rules(spark))


def _hits(matched: DataFrame) -> DataFrame:
    return matched.select("capture_id", "filter_id")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- sources and decoding -------------------------------------------------------------------------------------------

def frame_scan(spark, d):
    timed = frame_source.with_time(w.event_frames(spark, d))
    return timed.select("capture_id", "ts_ns", F.unix_micros("ts").alias("ts_us"), "snap_len", "wire_len",
                        F.length("payload").cast("bigint").alias("payload_len"))


def decode_packets(spark, d):
    return packets(w.event_frames(spark, d)).drop("ts", "wire_len")


def decodable_frames(spark, d):
    seen = _decoded(spark, d)
    kept = decodable(seen).select("match_ok", "stat_ok", "n_bytes")
    lost = seen.filter("NOT match_ok").select("match_ok", "stat_ok", "n_bytes")
    return kept.unionByName(lost).groupBy("match_ok", "stat_ok").agg(
        F.count("*").alias("frames"), F.sum("n_bytes").alias("bytes"))


def dump_roundtrip(spark, d):
    path = work_path(spark, "dump")
    dump.write_dump(_matched(spark, d), path)
    back = decode(dump.read_dump(spark, path))
    # a record keeps 48 bits of its time; any later moment within 3.258 days brings the rest back
    again = recover_ns(F.col("ts48"), F.col("ts_ns") + F.lit(200_000_000_000_000))
    return back.select("filter_id", again.alias("ts_ns"), low_bits(F.col("ts_ns")).alias("ts48"), "wire_len",
                       "ip_proto", "src_ip", "dst_ip", "src_port", "dst_port")


def stream_dump_count(spark, d):
    path, table = work_path(spark, "dump"), work_path(spark, "dump-stream")
    dump.write_dump(_matched(spark, d), path, roll_bytes=1 << 20)
    query = (dump.stream_dump(spark, path, max_files=4).select("filter_id", "ts_ns", "wire_len").writeStream
             .format("parquet").option("checkpointLocation", work_path(spark, "checkpoint")).option("path", table)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(table).groupBy("filter_id").agg(
        F.count("*").alias("packets"), F.sum("wire_len").alias("bytes"), F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"))


def dump_replay(spark, d):
    """A dump written batch by batch, with a failed attempt and replays in other partitionings, followed by a stream."""
    path, table, checkpoint = work_path(spark, "dump"), work_path(spark, "dump-stream"), work_path(spark, "checkpoint")
    matched = _matched(spark, d).select("filter_id", "ts_ns", "payload")
    first, second = matched.filter("ts_ns % 2000 = 0"), matched.filter("ts_ns % 2000 <> 0")

    def follow():
        (dump.stream_dump(spark, path).select("filter_id", "wire_len").writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
         .awaitTermination())

    dump.write_dump(first, path, batch_id=0)
    follow()
    try:  # tasks that end well leave files that no manifest lists
        broken = second.unionByName(first.limit(1).withColumn("payload", F.lit(None).cast("binary")))
        dump.write_dump(broken.repartition(4), path, batch_id=1)
    except PySparkException:
        follow()
    dump.write_dump(second.repartition(3), path, batch_id=1)
    dump.write_dump(second.repartition(2), path, batch_id=1)
    dump.write_dump(first.repartition(5), path, batch_id=0)
    follow()
    total = [F.count("*").alias("packets"), F.sum("wire_len").alias("bytes")]
    streamed = spark.read.parquet(table).groupBy("filter_id").agg(*[t.alias(f"streamed_{n}") for t, n in
                                                                    zip(total, ("packets", "bytes"))])
    return dump.read_dump(spark, path).groupBy("filter_id").agg(*total).join(streamed, "filter_id", "full")


# ---- rules ----------------------------------------------------------------------------------------------------------

def _specs(spark, d):
    return w.spec_texts(w.events(spark, d))


def rules_compiled(spark, d):
    return R.compile_rules(_specs(spark, d))


def rules_rejected(spark, d):
    return R.rejected(R.compile_rules(_specs(spark, d))).select("event_id", "reason")


def rules_numbered(spark, d):
    valid = R.accepted(R.compile_rules(_specs(spark, d))).select("event_id")
    return R.assign_ids(valid, "event_id", last_id=1000, partitions=5)


def rules_from_json(spark, d):
    specs = w.spec_texts(w.events(spark, d)).withColumn("kind", F.col("protocol"))
    text = F.to_json(F.struct(F.struct(*R.SPEC_FIELDS).alias("filter")))
    lines = specs.select("event_id", F.when(F.col("kind") == "TCP", '{"filter":{"src_ip":').otherwise(text).alias("value"))
    return R.compile_rules(R.from_json(lines)).select("event_id", "src_lo", "dst_hi", "src_port", "dst_port", "ip_proto",
                                                      "reason")


def rules_from_flags(spark, d):
    text = F.concat_ws(":", "protocol", "src_ip", F.col("dst_port").cast("string"))
    lines = _specs(spark, d).select(
        "event_id", F.when(F.col("protocol") == "TCP", "TCP:::").otherwise(text).alias("value"))
    return R.compile_rules(R.from_flags(lines)).select("event_id", "src_lo", "dst_port", "ip_proto", "reason")


def rules_active_at(spark, d):
    return R.active_at(w.rule_history(w.events(spark, d)), ACTIVE_AT_NS)


def rules_listing(spark, d):
    source = w.events(spark, d)
    numbered = R.assign_ids(source.filter("event_type = 'purchase'").select("event_id"), "event_id")
    specs = w.spec_texts(source).join(numbered, "event_id")
    return R.listing(w.rule_history(source), specs, ACTIVE_AT_NS)


def rules_file_numbered(spark, d):
    """Flag strings written to several files and numbered in the order of their lines."""
    path = work_path(spark, "rule-lines")
    text = F.concat_ws(":", "protocol", "src_ip", F.col("dst_port").cast("string"))
    _specs(spark, d).select("event_id", text.alias("value")).repartitionByRange(3, "event_id").sortWithinPartitions(
        "event_id").select("value").write.text(path)
    valid = R.accepted(R.compile_rules(rule_source.read_flag_rules(spark, path)))
    return R.assign_ids(valid, arrival="line_no").select("rule_id", "line_no", "src_lo", "dst_port", "ip_proto")


def rule_validity(spark, d):
    return R.validity(w.rule_history(w.events(spark, d)))


# ---- matching -------------------------------------------------------------------------------------------------------

def _match_some(*ids: int):
    def run(spark, d):
        return _hits(m.match(_decoded(spark, d), w.fixed_rules(spark, [r for r in w.RULES if r[0] in ids])))
    return run


def match_rules(spark, d):
    return _hits(_matched(spark, d))


def match_rules_shapes(spark, d):
    return _hits(m.match(_decoded(spark, d), w.fixed_rules(spark), plan="keyed"))


def match_many_rules(spark, d):
    return _hits(m.match(_decoded(spark, d), w.user_rules(spark, d)))


def match_many_rules_salted(spark, d):
    """The same with the broadcast bound set below the rule count, so that heavy shapes take the shuffled plan."""
    return _hits(m.match(_decoded(spark, d), w.user_rules(spark, d), broadcast_rules=40, salts=4))


def match_many_shapes(spark, d):
    return _hits(m.match(_decoded(spark, d), w.shape_rules(spark, d)))


def match_many_shapes_salted(spark, d):
    return _hits(m.match(_decoded(spark, d), w.shape_rules(spark, d), broadcast_rules=0))


def match_pruned_shapes(spark, d):
    """Shapes of all prefix lengths: a frame is tried only against those that its addresses leave open."""
    return _hits(m.match(_decoded(spark, d), w.wide_rules(spark, d), plan="keyed"))


def match_pruned_shapes_salted(spark, d):
    return _hits(m.match(_decoded(spark, d), w.wide_rules(spark, d), plan="keyed", broadcast_rules=100, salts=4))


def match_rules_temporal_keyed(spark, d):
    """Every host rule registered again and again: looked up by its key and cells of time."""
    return _hits(m.match(_decoded(spark, d), w.registered_again(spark, d), plan="keyed"))


def prefilter_many_shapes(spark, d):
    return prefilter.prefilter(_decoded(spark, d), w.shape_rules(spark, d)).select("capture_id", "n_bytes")


def rejected_many_rules(spark, d):
    return prefilter.rejected(_decoded(spark, d), w.user_rules(spark, d), broadcast_rules=0).select("capture_id", "n_bytes")


def _some_rules(spark):
    return w.fixed_rules(spark, [r for r in w.RULES if r[0] in (2, 3, 6, 9)])


def prefilter_union(spark, d):
    return prefilter.prefilter(_decoded(spark, d), _some_rules(spark)).select("capture_id", "n_bytes")


def prefilter_rejected(spark, d):
    return prefilter.rejected(_decoded(spark, d), _some_rules(spark)).select("capture_id", "n_bytes")


def prefilter_many_rules(spark, d):
    return prefilter.prefilter(_decoded(spark, d), w.user_rules(spark, d)).select("capture_id", "n_bytes")


def match_rules_temporal(spark, d):
    number = F.col("rule_id")
    start = F.lit(START_NS) + number * F.lit(w.DAY_NS)
    changes = w.rule_specs(spark).select("rule_id", F.lit("add").alias("op"), start.alias("at_ns"), number.alias("seq"))
    ends = changes.filter("rule_id % 3 = 0").select(
        "rule_id", F.lit("remove").alias("op"), (F.col("at_ns") + F.lit(9 * w.DAY_NS)).alias("at_ns"), "seq")
    timed = w.fixed_rules(spark).join(R.validity(changes.unionByName(ends)), "rule_id")
    return _hits(m.match(_decoded(spark, d), timed))


def dump_drops(spark, d):
    """Frames over 150 bytes are lost on the way to the dump."""
    matched = _matched(spark, d)
    path = work_path(spark, "delivered")
    dump.write_dump(matched.filter("n_bytes <= 150"), path)
    return reconcile.dump_drops(matched, dump.read_dump(spark, path))


# ---- statistics -----------------------------------------------------------------------------------------------------

def rule_totals(spark, d):
    return stats.rule_totals(_matched(spark, d))


def unique_ips_exact(spark, d):
    return stats.unique_ips(_matched(spark, d), exact=True)


def unique_ips_hll(spark, d):
    """Sketch estimates judged against exact counts: at most 5 % off up to 100 addresses, 2 % above."""
    counts = stats.address_counts(_matched(spark, d), {"filter_id": F.col("filter_id")}).filter("ip IS NOT NULL")
    exact = stats.unique_columns(exact=True)
    estimates = [c.alias(f"_{s}") for s, c in zip(("src", "dst"), stats.unique_columns(exact=False))]
    return counts.groupBy("filter_id").agg(*exact, *estimates).select(
        "filter_id", "unique_src_ips", "unique_dst_ips",
        *[_in_bound(F.col(f"_{s}"), F.col(f"unique_{s}_ips")).alias(f"{s}_in_bound") for s in ("src", "dst")])


def _in_bound(estimate, exact):
    allowed = F.when(exact <= 100, 0.05).otherwise(0.02)
    return F.abs(estimate - exact) <= allowed * exact


def interval_uniques(spark, d):
    return stats.interval_uniques(_matched(spark, d), w.DAY_NS, exact=True)


def src_entropy(spark, d):
    return _round(stats.src_entropy(_matched(spark, d), w.DAY_NS), "src_entropy_bits")


def src_ip_histogram(spark, d):
    return stats.src_histogram(_matched(spark, d), w.DAY_NS)


def top_peers(spark, d):
    peers = stats.top_peers(_matched(spark, d), w.DAY_NS, 5)
    return peers.select("filter_id", "interval", "peer_rank", ip_text(F.col("src_ip")).alias("peer"), "c")


def capture_totals(spark, d):
    decoded = _decoded(spark, d, "user_id")
    return stats.capture_totals(decoded, m.match(decoded, w.fixed_rules(spark)))


def capture_totals_one_pass(spark, d):
    decoded = _decoded(spark, d, "user_id")
    return stats.capture_totals_of_packets(decoded, m.few_rules(w.fixed_rules(spark), m.inline_bound(decoded)))


def flow_summary(spark, d):
    return flows.flow_summary(_decoded(spark, d))


def flow_summary_oneway(spark, d):
    return flows.flow_summary(_decoded(spark, d), bidirectional=False)


# ---- intervals and snapshots ----------------------------------------------------------------------------------------

def _intervals(spark, d):
    return S.intervals_of_packets(_decoded(spark, d), w.fixed_rules(spark), w.DAY_NS, exact=True)


def interval_stats(spark, d):
    return _round(_intervals(spark, d), "src_entropy_bits")


def running_totals(spark, d):
    totals = S.running_totals(stage(_intervals(spark, d), "intervals"), block=8)
    return _round(totals.select(*S.SNAPSHOT_COLUMNS), "src_entropy_bits")


def gap_fill(spark, d):
    return blocked.fill_intervals(stage(_intervals(spark, d), "intervals"), ["filter_id"], "interval", block=8)


UNTIL = 19_728  #: a day early in the table


def gap_fill_until(spark, d):
    """Rules first hit after the last interval have none."""
    return blocked.fill_intervals(stage(_intervals(spark, d), "intervals"), ["filter_id"], "interval", block=4, last=UNTIL)


def snapshot_until(spark, d):
    return _round(S.snapshots(stage(_intervals(spark, d), "intervals"), last=UNTIL, block=4), "src_entropy_bits")


def snapshot_hll(spark, d):
    """The default mode: sketch counts judged against exact ones in every row."""
    keys, counts = ["filter_id", "interval"], ["unique_src_ips", "unique_dst_ips"]
    rough = S.snapshot(_decoded(spark, d), w.fixed_rules(spark), w.DAY_NS)
    exact = snapshot(spark, d).select(*keys, *[F.col(c).alias(f"_{c}") for c in counts])
    both = _round(rough, "src_entropy_bits").join(exact, keys, "full")
    return both.select(*[c for c in rough.columns if c not in counts], *[F.col(f"_{c}").alias(c) for c in counts],
                       (_in_bound(F.col(counts[0]), F.col(f"_{counts[0]}"))
                        & _in_bound(F.col(counts[1]), F.col(f"_{counts[1]}"))).alias("uniques_in_bound"))


def sketch_union_raw_and_stored(spark, d):
    """Sketches of raw frames and of the same packets stored: their union counts no address twice."""
    raw = _decoded(spark, d)
    stored = stage(packets(w.event_frames(spark, d)), "packets")
    sketches = [S.intervals_of_packets(p, w.fixed_rules(spark), w.DAY_NS).withColumn("_of", F.lit(i))
                for i, p in enumerate((raw, stored))]
    both = sketches[0].unionByName(sketches[1])
    out = both.groupBy("filter_id").agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(F.when(which, F.col(f"{s}_sketch")))).alias(f"{n}_{s}")
          for s in ("src", "dst") for n, which in (("all", F.lit(True)), ("raw", F.col("_of") == 0))])
    return out.select("filter_id", (F.col("all_src") == F.col("raw_src")).alias("same_src"),
                      (F.col("all_dst") == F.col("raw_dst")).alias("same_dst"))


def snapshot(spark, d):
    return _round(S.snapshot(_decoded(spark, d), w.fixed_rules(spark), w.DAY_NS, exact=True), "src_entropy_bits")


def snapshot_of_dump(spark, d):
    """From stored dump records instead of from frames, and with several blocks per rule."""
    path = work_path(spark, "dump")
    dump.write_dump(_matched(spark, d), path)
    intervals = S.intervals_of_matched(decode(dump.read_dump(spark, path)), w.DAY_NS, exact=True)
    return _round(S.snapshots(stage(intervals, "intervals"), block=8), "src_entropy_bits")


def snapshot_volume(spark, d):
    decoded = decode(w.lineitem_frames(spark, d))
    return _round(S.snapshot(decoded, w.fixed_rules(spark), w.HUNDRED_DAYS_NS, exact=True), "src_entropy_bits")


def snapshot_json(spark, d):
    path = work_path(spark, "snapshots")
    outputs.write_snapshot_json(snapshot(spark, d), path)
    return outputs.read_snapshot_json(spark, path)


# ---- streams --------------------------------------------------------------------------------------------------------

def _frame_stream(spark, d, files: int = 3):
    """Event frames stored as a few time-ordered files, read back as a stream of one file per batch."""
    path = work_path(spark, "frames")
    w.event_frames(spark, d).repartitionByRange(files, "ts_ns").write.parquet(path)
    return frame_source.stream_frames(spark, path, max_files=1)


def stream_match(spark, d):
    table = work_path(spark, "matched")
    writer = SM.match_writer(_frame_stream(spark, d), lambda: w.fixed_rules(spark), table,
                             work_path(spark, "checkpoint"), columns=["capture_id", "filter_id"])
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).select("capture_id", "filter_id")


def stream_prefilter(spark, d):
    """Rules of many shapes over a stream: one lookup for all of them in every batch."""
    table, rules = work_path(spark, "kept"), stage(w.shape_rules(spark, d), "shape-rules")
    writer = SM.prefilter_writer(_frame_stream(spark, d), lambda: rules, table, work_path(spark, "checkpoint"),
                                 columns=["capture_id", "n_bytes"])
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).select("capture_id", "n_bytes")


def _interval_table(spark, d) -> str:
    path, table = work_path(spark, "frames"), work_path(spark, "intervals")
    w.event_frames(spark, d).write.parquet(path)
    live = stream_session(spark)
    matched = m.match(decode(frame_source.stream_frames(live, path)), w.fixed_rules(live))
    closed = SI.interval_stream(matched, 86_400)
    SI.interval_writer(closed, table, work_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    # the stream keeps its newest interval open; it is closed from the stored frames
    newest = SI.read_intervals(spark, table).agg(F.max("interval")).first()[0]
    stored = decode(frame_source.read_frames(spark, path))
    rest = stored if newest is None else stored.filter(F.col("ts_ns") >= (newest + 1) * w.DAY_NS)
    SI.correct_intervals(S.intervals_of_packets(rest, w.fixed_rules(spark), w.DAY_NS).select(
        *[c.split()[0] for c in SI.INTERVAL_TABLE.split(", ")]), table, version=1)
    return table


def stream_correction(spark, d):
    """A streamed interval computed wrongly is put right by a later version of it."""
    table = _interval_table(spark, d)
    good = stage(SI.read_intervals(spark, table), "good")
    day = good.agg(F.min("interval")).first()[0]
    one = good.filter(F.col("interval") == day)
    SI.correct_intervals(one.withColumn("packets", F.col("packets") + 1), table, version=2)
    SI.correct_intervals(one, table, version=3)
    # another interval, corrected under the same version: both corrections hold
    other = good.filter(F.col("interval") == day + 1)
    SI.correct_intervals(other.withColumn("packets", F.col("packets") + 5), table, version=3)
    SI.correct_intervals(other, table, version=3)
    return _round(SI.read_intervals(spark, table).drop("src_sketch", "dst_sketch"), "src_entropy_bits")


def _live(spark, d, files: int = 3, restart: bool = False) -> str:
    """The folder of a live query over the event frames, run until all intervals are closed by the idle timer."""
    path, out, checkpoint = work_path(spark, "frames"), work_path(spark, "live"), work_path(spark, "checkpoint")
    every = w.event_frames(spark, d)
    for i in range(files):  # one after the other: a stream takes files in the order of their times
        part = F.floor((F.col("ts_ns") - START_NS) / (10 * w.DAY_NS))
        every.filter(F.least(F.greatest(part, F.lit(0)), F.lit(files - 1)) == i).coalesce(1).write.mode("append").parquet(path)

    def start():
        frames = SL.with_heartbeat(frame_source.stream_frames(spark, path, max_files=1))
        return SL.live_statistics(frames, lambda: w.fixed_rules(spark), out, checkpoint, w.DAY_NS,
                                  idle_seconds=2).trigger(processingTime="500 milliseconds").start()

    query = start()
    if restart:
        SL.wait_for(spark, query, out, lambda state: state.batch >= 0)
        SL.stop(query)
        query = start()
    SL.wait_for(spark, query, out, lambda state: state.base is not None and not state.open)
    SL.stop(query)
    return out


def stream_interval_stats(spark, d):
    return _round(SL.read_live(spark, _live(spark, d), "intervals").drop("src_sketch", "dst_sketch"), "src_entropy_bits")


def stream_snapshot_incremental(spark, d):
    """Snapshots folded forward as intervals close, over a restart; their sketch counts judged against exact ones."""
    return _judged_snapshots(spark, d, SL.read_live(spark, _live(spark, d, restart=True), "snapshots"))


def stream_snapshot_json(spark, d):
    """A JSON line per tick."""
    ticks = SL.read_ticks(spark, _live(spark, d, restart=True))
    return _round(ticks.drop("unique_src_ips", "unique_dst_ips"), "src_entropy_bits")


EDIT_NS = START_NS + 15 * w.DAY_NS


def stream_editable_stats(spark, d):
    """Rules 7 to 12 are added while the query runs, before the frames from ``EDIT_NS`` on come."""
    path, rules, out = work_path(spark, "frames"), work_path(spark, "live-rules"), work_path(spark, "live")
    all_frames, all_rules = w.event_frames(spark, d), w.fixed_rules(spark)
    all_rules.filter("rule_id <= 6").write.parquet(rules)
    all_frames.filter(F.col("ts_ns") < EDIT_NS).write.parquet(path)
    frames = SL.with_heartbeat(frame_source.stream_frames(spark, path))
    query = SL.live_statistics(frames, lambda: spark.read.parquet(rules), out, work_path(spark, "checkpoint"), w.DAY_NS,
                               idle_seconds=2).trigger(processingTime="500 milliseconds").start()
    SL.wait_for(spark, query, out, lambda state: state.batch >= 0)
    all_rules.filter("rule_id > 6").write.mode("append").parquet(rules)
    all_frames.filter(F.col("ts_ns") >= EDIT_NS).write.mode("append").parquet(path)
    SL.wait_for(spark, query, out, lambda state: state.newest_ns >= EDIT_NS and not state.open)
    SL.stop(query)
    return _round(SL.read_live(spark, out, "intervals").drop("src_sketch", "dst_sketch"), "src_entropy_bits")


def _judged_snapshots(spark, d, streamed):
    exact = S.snapshots(stage(_intervals(spark, d), "intervals")).select(
        "filter_id", "interval", F.col("unique_src_ips").alias("exact_src_ips"),
        F.col("unique_dst_ips").alias("exact_dst_ips"))
    both = streamed.join(exact, ["filter_id", "interval"], "full")
    good = (_in_bound(F.col("unique_src_ips"), F.col("exact_src_ips"))
            & _in_bound(F.col("unique_dst_ips"), F.col("exact_dst_ips")))
    return _round(both, "src_entropy_bits").select(
        "filter_id", "interval", "packets", "bytes", "exact_src_ips", "exact_dst_ips", "src_entropy_bits",
        "src_window_packets", good.alias("uniques_in_bound"))


def stream_snapshot(spark, d):
    """Snapshots over the streamed interval table, their sketch counts judged against exact ones."""
    return _judged_snapshots(spark, d, SI.current_snapshots(spark, _interval_table(spark, d)))


# ---- monitoring -----------------------------------------------------------------------------------------------------

def counter_rates(spark, d):
    rates = monitor.counter_rates(w.counter_samples(w.events(spark, d)))
    out = rates.withColumn("ts_ns", F.unix_micros("ts") * F.lit(1000)).drop("ts")
    return _round(out, "elapsed_sec", "rx_packets_per_sec", "rx_drops_per_sec", "tx_packets_per_sec")


def loss_verdict(spark, d):
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    run = F.col("user_id").cast("string").alias("run")
    lost = ((F.col("event_type") == "error") & (F.col("value") > 60)).cast("bigint")
    seen = w.events(spark, d).select(run, one.alias("rx_packets"), lost.alias("rx_drops"), zero.alias("output_lines"))
    third = w.fixed_rules(spark, [r for r in w.RULES if r[0] == 3])
    lines = m.match(_decoded(spark, d, "user_id"), third).select(
        F.col("capture_id").alias("run"), zero.alias("rx_packets"), zero.alias("rx_drops"), one.alias("output_lines"))
    return monitor.loss_verdict(seen.unionByName(lines))


def breaking_point(spark, d):
    return monitor.breaking_point(w.ramp_steps(w.events(spark, d)))


def bench_compare(spark, d):
    path = work_path(spark, "bench-log")
    runs = w.bench_runs(w.events(spark, d))
    outputs.append_runs(runs.filter("branch = 'click'"), path)
    outputs.append_runs(runs.filter("branch <> 'click'"), path)
    return _round(monitor.bench_compare(outputs.read_runs(spark, path)), "latest_gbps", "latest_vs_best")


def queries() -> dict:
    out = {f.__name__: f for f in (
        frame_scan, decode_packets, decodable_frames, dump_roundtrip, dump_replay, stream_dump_count, rules_compiled, rules_rejected,
        rules_numbered, rules_from_json, rules_from_flags, rules_active_at, rule_validity, match_rules,
        rules_listing, rules_file_numbered, match_many_shapes, match_many_shapes_salted, match_pruned_shapes,
        match_pruned_shapes_salted, match_rules_temporal_keyed, prefilter_many_shapes,
        rejected_many_rules, gap_fill_until, snapshot_until, snapshot_hll, sketch_union_raw_and_stored,
        stream_correction, match_rules_shapes, match_many_rules, match_many_rules_salted, prefilter_union, prefilter_rejected,
        prefilter_many_rules, match_rules_temporal, dump_drops, rule_totals, unique_ips_exact, unique_ips_hll,
        interval_uniques, src_entropy, src_ip_histogram, top_peers, capture_totals, flow_summary, flow_summary_oneway,
        interval_stats, running_totals, gap_fill, snapshot, snapshot_of_dump, snapshot_volume, snapshot_json,
        capture_totals_one_pass, stream_match, stream_prefilter, stream_interval_stats, stream_editable_stats, stream_snapshot,
        stream_snapshot_incremental, stream_snapshot_json, counter_rates, loss_verdict, breaking_point,
        bench_compare)}
    for name, ids in (("match_proto", (1, 2, 5, 10)), ("match_src_cidr", (3, 7, 11)), ("match_dst_cidr", (6, 12)),
                      ("match_src_port", (9,)), ("match_dst_port", (1, 2, 7, 10))):
        out[name] = _match_some(*ids)
    return out
