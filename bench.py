"""Headline timings over frames derived from ``lineitem``; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores, BENCH_REPEAT how often each query
runs (the fastest counts).  Frames and packets are written once before timing, as a capture store would hold them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from framelake.operators import flows, match as m, prefilter, stats  # noqa: E402
from framelake.operators.decode import decode, packets  # noqa: E402
from framelake.plans import snapshot as S, workload as w  # noqa: E402
from framelake.session import local_session, stage, work_path  # noqa: E402
from framelake.sources import dump  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))
WIDTH = w.HUNDRED_DAYS_NS


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def some_rules(spark, n: int):
    """``n`` rules over the workload's address space, of nine shapes."""
    kinds = [
        lambda i: ("tcp", f"10.{i % 4}.{i // 4 % 250}.0/24", 0, "", 0),
        lambda i: ("udp", "", 0, f"192.168.{i % 4}.{i // 4 % 250}", 0),
        lambda i: ("", f"10.{i % 4}.{i // 4 % 16}.{i % 250}", 0, "", 443),
        lambda i: ("", "", 1024 + i % 500, "", 0),
        lambda i: ("", "", 0, f"192.168.{i % 4}.{i // 4 * 16 % 250}/28", 53),
    ]
    specs = []
    for i in range(n):
        protocol, src, sport, dst, dport = kinds[i % len(kinds)](i)
        specs.append((i + 1, protocol, src, sport, dst, dport))
    return w.fixed_rules(spark, specs)


def shaped_rules(spark, n: int, shapes: int = 390):
    """``n`` rules of so many shapes: prefix lengths from 8 on, with and without a port; four of them are hit."""
    kinds = [(s, d, port) for s in range(8, 33) for d in range(8, 33) for port in (0, 443)][::3][:shapes]
    specs = [(i + 1, "", f"10.{i}.0.0/24", 0, "", 0) for i in range(4)]
    for i in range(4, n):
        src, dst, port = kinds[i % shapes]
        specs.append((i + 1, "", f"11.{i % 250}.{i // 250 % 250}.7/{src}", 0, f"192.168.{i % 4}.{i % 250}/{dst}", port))
    return w.fixed_rules(spark, specs)


def large_frames(frames):
    """The same frames padded to 1000 bytes, as a full link carries them."""
    padding = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(1000) - F.length("payload"), F.lit(0))))
    return frames.withColumn("payload", F.concat("payload", padding)).withColumn("snap_len", F.lit(1000).cast("bigint"))


def per_rule(matched):
    return matched.groupBy("filter_id").agg(F.count("*").alias("packets"), F.sum("n_bytes").alias("bytes"))


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8, memory="16g")
    frames = w.lineitem_frames(spark, SF_DIR)
    total = frames.count()
    # as many splits as cores, so that small test tables use the whole machine
    frames = stage(frames.repartition(int(CPUS) if CPUS.isdigit() else 8), "bench-frames")
    table = stage(packets(frames), "bench-packets")
    rules = stage(w.fixed_rules(spark), "bench-rules")
    wide = stage(large_frames(frames), "bench-frames-1000")
    rules_shaped = stage(shaped_rules(spark, 400), "bench-rules-shaped")
    rules_n = {n: stage(some_rules(spark, n), f"bench-rules-{n}") for n in (10, 100, 1000)}
    intervals = stage(S.intervals_of_packets(table, rules, WIDTH), "bench-intervals")
    dumped = m.match(decode(frames), rules_n[10]).select("filter_id", "ts_ns", "payload", "n_bytes")
    dump_path = work_path(spark, "bench-dump")
    dump.write_dump(dumped, dump_path, by_time=True)

    runs = {
        "decode_frames": lambda: consume(packets(frames)),
        "match_12_rules_raw": lambda: consume(per_rule(m.match(decode(frames), rules))),
        "match_10_rules": lambda: consume(per_rule(m.match(table, rules_n[10]))),
        "match_100_rules": lambda: consume(per_rule(m.match(table, rules_n[100]))),
        "match_1000_rules": lambda: consume(per_rule(m.match(table, rules_n[1000]))),
        "match_390_shapes": lambda: consume(per_rule(m.match(table, rules_shaped))),
        "decode_1000_bytes": lambda: consume(packets(wide)),
        "match_12_rules_1000_bytes": lambda: consume(per_rule(m.match(decode(wide), rules))),
        "prefilter_raw": lambda: consume(prefilter.prefilter(decode(frames), rules_n[10]).select("capture_id", "n_bytes")),
        "interval_stats_raw": lambda: consume(S.intervals_of_packets(decode(frames), rules, WIDTH)),
        "interval_stats": lambda: consume(S.intervals_of_packets(table, rules, WIDTH)),
        "snapshots_of_intervals": lambda: consume(S.snapshots(intervals)),
        "snapshot": lambda: consume(S.snapshot(table, rules, WIDTH)),
        "snapshot_exact": lambda: consume(S.snapshot(table, rules, WIDTH, exact=True)),
        "top_peers": lambda: consume(stats.top_peers(m.match(table, rules_n[10]), WIDTH, 10)),
        "flow_summary": lambda: consume(flows.flow_summary(table)),
        "dump_write": lambda: dump.write_dump(dumped, work_path(spark, "bench-dump-out"), by_time=True),
        "dump_read": lambda: consume(dump.read_dump(spark, dump_path)),
    }
    seconds = {}
    for name, run in runs.items():
        best = None
        for _ in range(REPEAT):
            began = time.perf_counter()
            run()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "packet_analytics_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else SF_DIR,
        "frames": total,
        "cpus": CPUS,
        "frames_per_sec": {k: round(total / v) for k, v in seconds.items() if v},
        "frames_per_sec_per_core": {k: round(total / v / int(CPUS)) for k, v in seconds.items() if v and CPUS.isdigit()},
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
