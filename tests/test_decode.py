from packet_bytes import frame, frames_df, ip

from framelake.operators.decode import decodable, decode, packets


def rows(spark, *payloads):
    return [r for r in decode(frames_df(spark, payloads)).orderBy("ts_ns").collect()]


def test_published_cases(spark):
    short, arp = b"\x01\x02\x03", frame(size=34, ethertype=0x0806)
    tcp, udp = frame(size=50), frame(size=50, proto=17)
    got = rows(spark, short, arp, tcp, udp)
    assert [r.match_ok for r in got] == [False, False, True, True]
    assert [r.ip_proto for r in got] == [None, None, 6, 17]
    assert [r.n_bytes for r in got] == [3, 34, 50, 50]


def test_fields(spark):
    r, = rows(spark, frame("10.1.2.3", "200.255.0.9", 65535, 53, 17))
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port) == (ip("10.1.2.3"), ip("200.255.0.9"), 65535, 53)
    assert (r.ethertype, r.ip_version, r.ihl) == (0x0800, 4, 20)
    assert bytes(r.src_raw) == bytes([10, 1, 2, 3])


def test_header_with_options_shifts_ports(spark):
    r, = rows(spark, frame(ihl=6, size=60, sport=7, dport=8))
    assert (r.src_port, r.dst_port, r.ihl) == (7, 8, 24)


def test_two_kinds_of_validity(spark):
    six = frame(version=6)
    lengths = [frame(size=n) for n in (33, 34, 37, 38)]
    options = frame(ihl=15, size=60)
    got = rows(spark, six, *lengths, options)
    assert [(r.match_ok, r.stat_ok) for r in got] == [
        (True, False), (False, False), (False, True), (False, True), (True, True), (False, True)]


def test_tiny_header_length_reads_ports_inside_header(spark):
    r, = rows(spark, frame(ihl=0))
    assert r.match_ok and (r.src_port, r.dst_port) == (0x4000, 0)


def test_ports_are_zero_without_tcp_or_udp(spark):
    icmp, odd = rows(spark, frame(proto=1, sport=443, dport=443), frame(proto=200))
    assert (icmp.src_port, icmp.dst_port) == (0, 0)
    assert (odd.ip_proto, odd.dst_port) == (200, 0)


def test_empty_and_null_payloads(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, bytearray(b""))], "capture_id string, ts_ns long, payload binary")
    got = decode(df).orderBy("ts_ns").collect()
    assert [(r.match_ok, r.stat_ok) for r in got] == [(False, False)] * 2


def test_high_addresses_stay_positive(spark):
    r, = rows(spark, frame("255.255.255.255", "255.255.255.254"))
    assert (r.src_ip, r.dst_ip) == (2**32 - 1, 2**32 - 2)


def test_packets_leave_payload_behind(spark):
    table = packets(frames_df(spark, [frame()]))
    assert "payload" not in table.columns and "src_raw" not in table.columns
    assert decodable(table).count() == 1
