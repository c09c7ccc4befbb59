"""Per-rule statistics: packets, bytes, unique addresses, source entropy, histograms, top peers.

Everything starts from one pass over the matched frames, ``address_counts``: GROUP BY GROUPING SETS on source and
destination.  Frames are combined map-side there, so only distinct (rule, interval, address) rows are shuffled and a hot
address costs one row per task.  Sketches, entropy and totals are then built from those counts; a sketch over distinct
addresses equals the sketch over all frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.clock import interval_of
from framelake.functions.measures import entropy_bits, entropy_terms
from framelake.functions.packed import be_uint
from framelake.operators.match import Fields, mask_column, rules_of_mask, with_mask
from framelake.session import stage

# Fixed value: sketch precision, 2^14 registers.
SKETCH_LG_K = 14
PEER_PARTS = 32


def _addresses(df: DataFrame) -> tuple[Column, Column]:
    """Addresses of frames that count for address statistics, NULL for the others; raw bytes when available."""
    raw = "src_raw" in df.columns
    names = ("src_raw", "dst_raw") if raw else ("src_ip", "dst_ip")
    return tuple(F.when(F.col("stat_ok"), F.col(n)) for n in names)


def address_counts(matched: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Frames and bytes per (keys, side, address); ``side`` is 'src' or 'dst', each covering every frame once.

    Addresses come out as numbers whatever the input keeps, so that sketches of raw and of stored frames can be united.
    """
    src, dst = _addresses(matched)
    flat = matched.select(*[c.alias(k) for k, c in keys.items()], src.alias("_src"), dst.alias("_dst"),
                          F.col("n_bytes").alias("_b"))
    names = list(keys)
    sets = [[*names, "_src"], [*names, "_dst"]]
    counted = flat.groupingSets(
        [[F.col(c) for c in s] for s in sets], *names, "_src", "_dst"
    ).agg(F.count("*").alias("c"), F.sum("_b").alias("b"), F.grouping("_dst").alias("_is_src"))
    is_src = F.col("_is_src") == 1
    ip = F.when(is_src, F.col("_src")).otherwise(F.col("_dst"))
    return counted.select(
        *names,
        F.when(is_src, F.lit("src")).otherwise(F.lit("dst")).alias("side"),
        (be_uint(ip) if "src_raw" in matched.columns else ip).alias("ip"),
        "c", "b",
    )


def rule_totals(matched: DataFrame) -> DataFrame:
    """Packets and bytes per rule over every matched frame, whatever its address validity."""
    return matched.groupBy("filter_id").agg(F.count("*").alias("packets"), F.sum("n_bytes").alias("bytes"))


def unique_ips(matched: DataFrame, exact: bool = False) -> DataFrame:
    """Unique source and destination addresses per rule, from sketches or exactly."""
    counts = address_counts(matched, {"filter_id": F.col("filter_id")}).filter("ip IS NOT NULL")
    # ``counts`` holds each address once per rule and side, so the exact answer is a plain count
    return counts.groupBy("filter_id").agg(*unique_columns(exact))


def unique_columns(exact: bool) -> list[Column]:
    """Aggregates over address counts: how many source and destination addresses."""
    out = []
    for side in ("src", "dst"):
        ip = F.when((F.col("side") == side), F.col("ip"))
        found = F.count(ip) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(ip, F.lit(SKETCH_LG_K)))
        out.append(found.alias(f"unique_{side}_ips"))
    return out


def interval_uniques(matched: DataFrame, interval_ns: int, exact: bool = False) -> DataFrame:
    """Unique addresses per rule and interval, each interval starting from nothing."""
    keys = {"filter_id": F.col("filter_id"), "interval": interval_of(F.col("ts_ns"), interval_ns)}
    counts = address_counts(matched, keys).filter("ip IS NOT NULL")
    return counts.groupBy("filter_id", "interval").agg(*unique_columns(exact))


def src_histogram(matched: DataFrame, interval_ns: int) -> DataFrame:
    """Frames per (rule, interval, source address)."""
    raw = "src_raw" in matched.columns
    flat = matched.filter("stat_ok").select(
        "filter_id", interval_of(F.col("ts_ns"), interval_ns).alias("interval"),
        F.col("src_raw" if raw else "src_ip").alias("src_ip"))
    out = flat.groupBy("filter_id", "interval", "src_ip").agg(F.count("*").alias("c"))
    return out.withColumn("src_ip", be_uint(F.col("src_ip"))) if raw else out


def src_entropy(matched: DataFrame, interval_ns: int) -> DataFrame:
    """Source-address entropy in bits and the frames it is based on, per rule and interval."""
    hist = src_histogram(matched, interval_ns).groupBy("filter_id", "interval").agg(
        F.sum("c").alias("src_window_packets"), *entropy_terms(F.col("c")))
    bits = entropy_bits(F.col("src_window_packets"))
    return hist.select("filter_id", "interval", bits.alias("src_entropy_bits"), "src_window_packets")


def top_peers(matched: DataFrame, interval_ns: int, n: int) -> DataFrame:
    """The ``n`` busiest source addresses per rule and interval, ties broken by address.

    In two steps for any ``n``: the ``n`` best of each of ``PEER_PARTS`` parts of a rule and interval, then the ``n``
    best of those, so that a task ranks at most ``PEER_PARTS * n`` rows of a rule and interval in the second step.
    """
    best = [F.desc("c"), F.asc("src_ip")]
    parts = src_histogram(matched, interval_ns).withColumn("_part", F.pmod(F.hash("src_ip"), F.lit(PEER_PARTS)))
    inside = Window.partitionBy("filter_id", "interval", "_part").orderBy(*best)
    first = parts.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= n).drop("_part", "_rank")
    over = Window.partitionBy("filter_id", "interval").orderBy(*best)
    return first.withColumn("peer_rank", F.row_number().over(over)).filter(F.col("peer_rank") <= n)


def capture_totals(decoded: DataFrame, matched: DataFrame) -> DataFrame:
    """Per capture: frames and bytes received, decodable frames tapped, and rows dumped."""
    zero = F.lit(0).cast("bigint")
    seen = decoded.select("capture_id", F.lit(1).cast("bigint").alias("_rx"), F.col("n_bytes").alias("_b"),
                          F.col("match_ok").cast("bigint").alias("_ok"), zero.alias("_d"))
    dumped = matched.select("capture_id", zero.alias("_rx"), zero.alias("_b"), zero.alias("_ok"),
                            F.lit(1).cast("bigint").alias("_d"))
    return seen.unionByName(dumped).groupBy("capture_id").agg(
        F.sum("_rx").alias("rx_packets"), F.sum("_b").alias("rx_bytes"), F.sum("_ok").alias("decodable"),
        F.sum("_d").alias("dumped"))


def capture_totals_of_packets(packets: DataFrame, rows: list) -> DataFrame:
    """``capture_totals`` of decoded frames under a few rules, in one pass: a frame counts as many dumped rows as its
    rule mask has bits."""
    dumped = F.bit_count(mask_column(rows, Fields.of(packets)))
    return packets.groupBy("capture_id").agg(
        F.count("*").alias("rx_packets"), F.sum("n_bytes").alias("rx_bytes"),
        F.sum(F.col("match_ok").cast("bigint")).alias("decodable"), F.sum(dumped.cast("bigint")).alias("dumped"))


# ---- the interval table ---------------------------------------------------------------------------------------------

INTERVAL_KEYS = ["filter_id", "interval"]


def counts_of_matched(matched: DataFrame, interval_ns: int) -> DataFrame:
    """Address counts of rows that already carry ``filter_id`` (a dump, or the output of ``match``)."""
    return address_counts(matched, {"filter_id": F.col("filter_id"),
                                    "interval": interval_of(F.col("ts_ns"), interval_ns)})


def counts_of_packets(packets: DataFrame, rows: list, interval_ns: int) -> DataFrame:
    """Address counts of decoded frames under a few rules.

    A frame carries the set of rules it matches as one bit mask through the aggregation and is unfolded to one row per
    rule only afterwards, so matching several rules does not multiply what is aggregated and shuffled.
    """
    keys = {"_mask": F.col("_mask"), "interval": interval_of(F.col("ts_ns"), interval_ns)}
    counts = address_counts(with_mask(packets, rows), keys)
    unfolded = counts.select(F.explode(rules_of_mask(rows, F.col("_mask"))).alias("filter_id"), "interval", "side",
                             "ip", "c", "b").filter("filter_id IS NOT NULL")
    # frames with the same address but different rule sets meet again under one rule
    return unfolded.groupBy("filter_id", "interval", "side", "ip").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))


def interval_stats(counts: DataFrame, exact: bool = False) -> DataFrame:
    """One row per rule and interval with mergeable address information.

    With ``exact`` the columns ``new_src`` / ``new_dst`` count addresses a rule sees for the first time, otherwise
    ``src_sketch`` / ``dst_sketch`` hold sketches.  Exact counting reads the counts twice, so they are written once.
    """
    counts = stage(counts, "counts") if exact else counts
    src = F.col("side") == "src"
    known = F.col("ip").isNotNull()
    c = F.col("c")
    measures = [
        F.sum(F.when(src, c)).alias("packets"),
        F.sum(F.when(src, F.col("b"))).alias("bytes"),
        F.coalesce(F.sum(F.when(src & known, c)), F.lit(0)).alias("src_window_packets"),
        *entropy_terms(F.when(src & known, c)),
    ]
    if not exact:
        measures += [F.hll_sketch_agg(F.when(F.col("side") == s, F.col("ip")), F.lit(SKETCH_LG_K)).alias(f"{s}_sketch")
                     for s in ("src", "dst")]
    grouped = counts.groupBy(*INTERVAL_KEYS).agg(*measures)
    if exact:
        # an address counts as new in its first interval; a plain minimum, so that no address has a task of its own
        first = counts.filter(known).groupBy("filter_id", "side", "ip").agg(F.min("interval").alias("interval"))
        new = first.groupBy(*INTERVAL_KEYS).agg(
            *[F.count(F.when(F.col("side") == s, 1)).alias(f"new_{s}") for s in ("src", "dst")])
        grouped = grouped.join(new, INTERVAL_KEYS, "left").fillna(0, ["new_src", "new_dst"])
    entropy = entropy_bits(F.col("src_window_packets"))
    return grouped.withColumn("src_entropy_bits", entropy).drop("_clog", "_top")
