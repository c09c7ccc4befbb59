"""Ethernet/IPv4 decoding as one projection.

Two notions of validity are kept apart.  ``match_ok`` is what rule matching needs (IPv4 ethertype, and four bytes after
the IP header); ``stat_ok`` is what address statistics need (IPv4 ethertype and version nibble 4).  Neither implies the
other.

Addresses and ports come twice: as integers for storage and arithmetic, and as the raw bytes (``*_raw``).  Big-endian
bytes order like the integers they spell, so matching and grouping on the raw form needs no conversion; whichever form a
query does not use is pruned from its plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.clock import timestamp_from_ns
from framelake.functions.packed import be_int64, be_uint, cut

# Ethernet and IPv4 layout.
ETHERTYPE_IPV4 = b"\x08\x00"
ETH_LEN = 14
MIN_IPV4_FRAME = 34
OFF_ETHERTYPE, OFF_VERSION, OFF_PROTO, OFF_SRC, OFF_DST = 12, 14, 23, 26, 30
PORTED = (b"\x06", b"\x11")

RAW_KEYS = ("proto_raw", "src_raw", "dst_raw", "sport_raw", "dport_raw")


def decode(frames: DataFrame) -> DataFrame:
    """Add the decoded columns to a table with ``payload`` and ``ts_ns``; every input column is kept."""
    data = F.col("payload")
    # each step names what later steps use several times, so that it is computed once per frame
    sliced = frames.withColumns({
        "_size": F.length(data),
        "_type": cut(data, OFF_ETHERTYPE, 2),
        "_version": cut(data, OFF_VERSION, 1),
        "_proto": cut(data, OFF_PROTO, 1),
    })
    size, version, proto = F.col("_size"), F.col("_version"), F.col("_proto")
    # nearly every header is 0x45; only others pay for the numeric conversion
    header = F.when(version == F.lit(b"\x45"), F.lit(20)).otherwise(
        (be_uint(version).bitwiseAND(F.lit(15)) * F.lit(4)).cast("int")
    )
    measured = sliced.withColumns({
        "_ipv4": F.coalesce((size >= MIN_IPV4_FRAME) & (F.col("_type") == F.lit(ETHERTYPE_IPV4)), F.lit(False)),
        "_header": header,
    })
    ipv4, header = F.col("_ipv4"), F.col("_header")
    judged = measured.withColumns({
        "match_ok": ipv4 & (size - ETH_LEN >= header + 4),
        "stat_ok": ipv4 & version.between(F.lit(b"\x40"), F.lit(b"\x4f")),
    })

    ported = F.col("match_ok") & proto.isin(*[F.lit(p) for p in PORTED])

    def port(skip: int):
        found = F.when(ported, cut(data, header + F.lit(ETH_LEN + skip), 2))
        return F.when(F.col("match_ok"), F.coalesce(found, F.lit(b"\x00\x00")))

    raw = judged.withColumns({
        "ts": timestamp_from_ns(F.col("ts_ns")),
        "n_bytes": size.cast("bigint"),
        "proto_raw": F.when(ipv4, proto),
        "src_raw": F.when(ipv4, cut(data, OFF_SRC, 4)),
        "dst_raw": F.when(ipv4, cut(data, OFF_DST, 4)),
        "sport_raw": port(0),
        "dport_raw": port(2),
        # one conversion for both addresses and one for both ports; common values need none
        "_addresses": F.when(ipv4, be_int64(cut(data, OFF_SRC, 8))),
        "_ports": F.when(ported, be_uint(cut(data, header + F.lit(ETH_LEN), 4))),
        "ethertype": F.when(size >= ETH_LEN, _known(F.col("_type"), {ETHERTYPE_IPV4: 0x0800})),
        "ip_version": F.when(ipv4, F.shiftright(_known(version, {b"\x45": 0x45}), 4)),
        "ihl": F.when(ipv4, header),
        "ip_proto": F.when(ipv4, _known(proto, {b"\x06": 6, b"\x11": 17, b"\x01": 1})),
    })
    both, ports, none = F.col("_addresses"), F.col("_ports"), F.when(F.col("match_ok"), F.lit(0))
    return raw.withColumns({
        "src_ip": F.shiftrightunsigned(both, 32),
        "dst_ip": both.bitwiseAND(F.lit(0xFFFFFFFF)),
        "src_port": F.coalesce(F.shiftright(ports, 16).cast("int"), none),
        "dst_port": F.coalesce(ports.bitwiseAND(F.lit(0xFFFF)).cast("int"), none),
    }).drop("_size", "_type", "_version", "_proto", "_ipv4", "_header", "_addresses", "_ports")


def _known(data: Column, values: dict[bytes, int]) -> Column:
    """Small unsigned integer; the listed byte strings are translated without a numeric conversion."""
    out = be_uint(data).cast("int")
    for text, number in values.items():
        out = F.when(data == F.lit(text), F.lit(number)).otherwise(out)
    return out


def packets(frames: DataFrame) -> DataFrame:
    """The decoded table to store: integers only, payload left behind.

    Written partitioned by day, this is what repeated analyses should scan: about 60 bytes per frame, with rule
    predicates pushed to the Parquet reader.
    """
    keep = [c for c in ("capture_id", "filter_id", "wire_len") if c in frames.columns]
    return decode(frames).select(
        *keep, "ts_ns", "ts", "n_bytes", "ethertype", "ip_version", "ihl", "ip_proto", "src_ip", "dst_ip", "src_port",
        "dst_port", "match_ok", "stat_ok",
    )


def decodable(decoded: DataFrame) -> DataFrame:
    """Only frames that rules can be applied to."""
    return decoded.filter("match_ok")
