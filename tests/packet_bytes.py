"""Building frames by hand, and a plain matcher to compare with."""

import ipaddress
import struct


def ip(text):
    return int(ipaddress.IPv4Address(text))


def frame(src="10.1.2.3", dst="8.8.8.8", sport=1234, dport=443, proto=6, size=42, version=4, ihl=5, ethertype=0x0800):
    head = bytes.fromhex("02a1b2c3d4e5 02b7c6d5e4f3") + struct.pack("!H", ethertype)
    net = struct.pack("!BBHHHBBHII", version << 4 | ihl, 0, 0, 0, 0, 64, proto, 0, ip(src), ip(dst))
    body = head + net + b"\x01" * (4 * max(ihl - 5, 0)) + struct.pack("!HH", sport, dport)
    return (body + b"\x00" * max(size - len(body), 0))[:size]


def frames_df(spark, payloads, ts=None):
    rows = [(str(i), ts[i] if ts else i + 1, len(p), len(p), bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "capture_id string, ts_ns long, snap_len long, wire_len long, payload binary")


def rules_df(spark, specs):
    """Compiled rules 1..n from dicts of spec fields."""
    from framelake.operators import rules

    rows = [(i + 1, s.get("protocol"), s.get("src_ip"), s.get("dst_ip"), s.get("src_port"), s.get("dst_port"))
            for i, s in enumerate(specs)]
    raw = spark.createDataFrame(
        rows, "rule_id long, protocol string, src_ip string, dst_ip string, src_port long, dst_port long")
    return rules.accepted(rules.compile_rules(raw))


def expect_match(payload, spec):
    """Does one frame match one spec?  Written from the packet layout, without the library."""
    if len(payload) < 34 or payload[12:14] != b"\x08\x00":
        return False
    header = (payload[14] & 15) * 4
    if len(payload) - 14 < header + 4:
        return False
    proto, sport, dport = payload[23], 0, 0
    if proto in (6, 17):
        sport, dport = struct.unpack("!HH", payload[14 + header:18 + header])
    wanted = {"tcp": 6, "udp": 17, "icmp": 1}.get(spec.get("protocol"))
    if wanted and proto != wanted:
        return False
    for key, at in (("src_ip", 26), ("dst_ip", 30)):
        text = spec.get(key)
        if text:
            net = ipaddress.ip_network(text, strict=False)
            if net.version == 6 or ipaddress.IPv4Address(payload[at:at + 4]) not in net:
                return False
    return not (spec.get("src_port") and sport != spec["src_port"]
                or spec.get("dst_port") and dport != spec["dst_port"])
