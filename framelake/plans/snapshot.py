"""Periodic snapshots: running totals since a rule's first frame next to per-interval entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.clock import floor_div
from framelake.operators import stats
from framelake.operators.blocked import running
from framelake.operators.match import few_rules, inline_bound, match
from framelake.session import stage

BLOCK = 4096

SNAPSHOT_COLUMNS = ("filter_id", "interval", "packets", "bytes", "unique_src_ips", "unique_dst_ips",
                    "src_entropy_bits", "src_window_packets")


def intervals_of_packets(packets: DataFrame, rules: DataFrame, interval_ns: int, exact: bool = False) -> DataFrame:
    """Interval table straight from decoded frames: rule sets as bit masks when few, the match join otherwise."""
    rows = few_rules(rules, inline_bound(packets))
    if rows and "from_ns" not in rules.columns:
        return stats.interval_stats(stats.counts_of_packets(packets, rows, interval_ns), exact)
    return intervals_of_matched(match(packets, rules), interval_ns, exact)


def intervals_of_matched(matched: DataFrame, interval_ns: int, exact: bool = False) -> DataFrame:
    """Interval table from rows that carry ``filter_id``."""
    return stats.interval_stats(stats.counts_of_matched(matched, interval_ns), exact)


def running_totals(intervals: DataFrame, block: int = BLOCK, following: str | None = None) -> DataFrame:
    """Cumulative packets, bytes and unique addresses at every interval row present; ``following`` names a column for
    the rule's next interval."""
    exact = "new_src" in intervals.columns
    sums = {"packets": "packets", "bytes": "bytes"}
    sketches = {}
    if exact:
        sums |= {"new_src": "unique_src_ips", "new_dst": "unique_dst_ips"}
    else:
        sketches = {"src_sketch": "src_sketch", "dst_sketch": "dst_sketch"}
    out = running(intervals, ["filter_id"], "interval", block, sums=sums, sketches=sketches, following=following)
    if exact:
        return out.drop("new_src", "new_dst")
    for side in ("src", "dst"):
        estimate = F.coalesce(F.hll_sketch_estimate(F.col(f"{side}_sketch")), F.lit(0).cast("bigint"))
        out = out.withColumn(f"unique_{side}_ips", estimate)
    return out.drop("src_sketch", "dst_sketch")


def idle_filled(totals: DataFrame, end, block: int = BLOCK) -> DataFrame:
    """Rows of running totals (with ``_next``, the rule's next interval) and the idle intervals behind each of them, up
    to ``end``: totals repeat, what belongs to one interval is zero.  In two steps, so that no row holds a long array."""
    until = F.coalesce(F.col("_next") - 1, end)
    first, last = floor_div(F.col("interval"), block), floor_div(F.col("_until"), block)
    pieces = totals.withColumn("_until", until).withColumn("_piece", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("interval"), F.col("_piece") * F.lit(block))
    high = F.least(F.col("_until"), F.col("_piece") * F.lit(block) + F.lit(block - 1))
    ticks = pieces.withColumn("_tick", F.explode(F.sequence(low, high)))
    hit = F.col("_tick") == F.col("interval")
    own = {"src_entropy_bits": F.when(hit, F.col("src_entropy_bits")).otherwise(0.0),
           "src_window_packets": F.when(hit, F.col("src_window_packets")).otherwise(0), "interval": F.col("_tick")}
    return ticks.select(*[own[c].alias(c) if c in own else F.col(c) for c in SNAPSHOT_COLUMNS])


def snapshots(intervals: DataFrame, last: int | None = None, block: int = BLOCK) -> DataFrame:
    """All snapshot rows of an interval table: every interval from a rule's first frame to the last tick (the newest
    interval of any rule, or ``last``).

    Totals run over the intervals in which a rule was hit, and every such row is unfolded over the idle intervals behind
    it, so sketches never travel through them and nothing is joined back.  ``intervals`` is read three times; pass a
    stored table (``stage`` writes one).
    """
    if last is not None:
        intervals = intervals.filter(F.col("interval") <= last)
    end = F.lit(last).cast("bigint") if last is not None else intervals.select(F.max("interval")).scalar()
    return idle_filled(running_totals(intervals, block, following="_next"), end, block)


def snapshot(packets: DataFrame, rules: DataFrame, interval_ns: int, exact: bool = False,
             block: int = BLOCK) -> DataFrame:
    """Decoded frames and rules to snapshot rows; the interval table is written once in between."""
    intervals = intervals_of_packets(packets, rules, interval_ns, exact)
    return snapshots(stage(intervals, "intervals"), block=block)
