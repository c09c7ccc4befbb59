from packet_bytes import ip

from framelake.operators import rules as R
from framelake.sources.rules import read_flag_rules, read_json_rules


def ranges(spark, texts):
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)],
                               "n long, src_ip string, dst_ip string, src_port long, dst_port long, protocol string")
    return R.compile_rules(df).orderBy("n").collect()


def test_addresses(spark):
    cases = {
        "10.0.0.0/8": ("10.0.0.0", "10.255.255.255"), "10.1.2.3/8": ("10.0.0.0", "10.255.255.255"),
        "192.168.0.7": ("192.168.0.7", "192.168.0.7"), "0.0.0.0/0": ("0.0.0.0", "255.255.255.255"),
        "255.255.255.255/32": ("255.255.255.255", "255.255.255.255"), "128.0.0.1/1": ("128.0.0.0", "255.255.255.255"),
        "10.3.200.1/14": ("10.0.0.0", "10.3.255.255"), "10.0.0.0/08": ("10.0.0.0", "10.255.255.255"),
    }
    for r, (low, high) in zip(ranges(spark, list(cases)), cases.values()):
        assert (r.src_lo, r.src_hi, r.reason, r.never_matches) == (ip(low), ip(high), None, False)


def test_bad_addresses(spark):
    bad = ["not-a-cidr", "10.0.0", "10.0.0.256", "10.0.0.0/33", "010.0.0.1", "10.0.0.0/", "10.0.0.0/-1", " 10.0.0.1",
           "10.0.0.1 ", "1.2.3.4.5", "::1::", "2001:db8::/129", "12345::", ":::", "fe80::1%eth0", "1:2:3:4:5:6:7",
           "1:2:3:4:5:6:7:8:9", ":", "1:2:3:4:5:6:7:8::"]
    for text, r in zip(bad, ranges(spark, bad)):
        assert r.reason == "invalid src_ip", text


def test_ipv6_is_valid_but_never_matches(spark):
    good = ["2001:db8::/32", "::", "::1", "fe80::1", "1:2:3:4:5:6:7:8", "1::8/64", "1:2:3::7:8", "::/0", "1::"]
    for text, r in zip(good, ranges(spark, good)):
        assert r.reason is None and r.never_matches and r.src_lo > r.src_hi, text


def specs(spark, *rows):
    fields = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    data = [(i, *[row.get(f) for f in fields]) for i, row in enumerate(rows)]
    df = spark.createDataFrame(
        data, "n long, src_ip string, dst_ip string, src_port long, dst_port long, protocol string")
    return R.compile_rules(df).orderBy("n").collect()


def test_protocols(spark):
    cases = [("tcp", 6), ("udp", 17), ("icmp", 1), ("", None), (None, None)]
    got = specs(spark, *[{"protocol": name} for name, _ in cases])
    assert [(r.ip_proto, r.reason) for r in got] == [(number, None) for _, number in cases]


def test_rejections(spark):
    cases = [
        ({"protocol": "sctp"}, "unknown protocol"), ({"protocol": "TCP"}, "unknown protocol"),
        ({"dst_port": 65536}, "port out of range"), ({"src_port": -1}, "port out of range"),
        ({"dst_ip": "x"}, "invalid dst_ip"), ({"src_ip": "x", "dst_ip": "y", "protocol": "z"}, "invalid src_ip"),
    ]
    assert [r.reason for r in specs(spark, *[c for c, _ in cases])] == [reason for _, reason in cases]


def test_zero_and_empty_mean_any(spark):
    r, = specs(spark, {"src_ip": "", "dst_ip": "", "src_port": 0, "dst_port": 0, "protocol": ""})
    assert r.reason is None
    assert [r[c] for c in ("src_lo", "dst_lo", "src_port", "dst_port", "ip_proto")] == [None] * 5


def test_flag_strings(spark, work):
    path = work()
    texts = ["tcp:10.0.0.0/8:443", "udp::53", "tcp::", "::443", "tcp", "tcp:::", "tcp::http", "icmp::", "udp::70000"]
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(path)
    got = {i: r for i, r in enumerate(R.compile_rules(read_flag_rules(spark, path)).collect())}
    assert [got[i].reason for i in range(9)] == [None, None, None, None, "malformed", "malformed", "malformed", None,
                                                 "port out of range"]
    assert (got[0].src_lo, got[0].dst_port, got[0].ip_proto) == (ip("10.0.0.0"), 443, 6)
    assert got[3].ip_proto is None and got[3].dst_port == 443


def test_json_requests(spark, work):
    path = work()
    texts = ['{"filter":{"src_ip":"10.0.0.0/8","dst_port":443,"protocol":"tcp"}}', '{"filter":{}}', "{}", "not json",
             '{"filter":{"dst_port":70000}}', '{"filter":{"dst_port":"443"}}', '{"filter":{"protocol":"tcp"}}' + " " * 4096,
             '{"filter":{"dst_port":443.5}}', '{"filter":{"dst_port":443', '{"filter":null}', '{"filter":{"other":1}}']
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(path)
    got = R.compile_rules(read_json_rules(spark, path)).collect()
    assert [r.reason for r in got] == [None, None, None, "malformed", "port out of range", "malformed", None,
                                        "malformed", "malformed", None, None]
    assert got[0].dst_port == 443 and got[1].ip_proto is None


def test_numbers_skip_rejected_and_never_repeat(spark):
    df = spark.createDataFrame([(5,), (900,), (7,), (100000,), (3,)], "arrival long")
    got = R.assign_ids(df, "arrival", last_id=10, partitions=4).orderBy("arrival").collect()
    assert [r.rule_id for r in got] == [11, 12, 13, 14, 15]


def test_validity(spark):
    rows = [("add", 1, 10, 1), ("remove", 1, 30, 2), ("remove", 1, 40, 3), ("add", 2, 20, 4), ("remove", 3, 5, 5),
            ("remove", 4, 5, 6), ("add", 4, 5, 7)]
    events = spark.createDataFrame(rows, "op string, rule_id long, at_ns long, seq long")
    got = {r.rule_id: (r.from_ns, r.to_ns) for r in R.validity(events).collect()}
    assert got == {1: (10, 30), 2: (20, None), 4: (5, None)}
    assert {r.rule_id for r in R.active_at(events, 25).collect()} == {1, 2, 4}
    assert {r.rule_id for r in R.active_at(events, 30).collect()} == {2, 4}
    specs = spark.createDataFrame([(i, "", "", 0, 443, "tcp") for i in range(1, 5)], "rule_id long, src_ip string, "
                                  "dst_ip string, src_port long, dst_port long, protocol string")
    assert {(r.rule_id, r.protocol) for r in R.listing(events, specs, 30).collect()} == {(2, "tcp"), (4, "tcp")}


def test_rules_of_files_are_numbered_by_line(spark, work):
    path = work()
    lines = [f"tcp::{i}" for i in range(1, 40)] + ["bad"] + [f"udp::{i}" for i in range(1, 9)]
    spark.createDataFrame(list(enumerate(lines)), "n int, value string").repartitionByRange(4, "n").sortWithinPartitions(
        "n").select("value").write.text(path)
    usable = R.assign_ids(R.accepted(R.compile_rules(read_flag_rules(spark, path))), arrival="line_no")
    got = sorted((r.rule_id, r.line_no, r.dst_port) for r in usable.collect())
    want = [(n, int(line.split(":")[2])) for n, line in enumerate(lines, 1) if line != "bad"]
    assert got == [(i, n, port) for i, (n, port) in enumerate(want, 1)]


def test_ipv4_inside_ipv6_text(spark):
    texts = {"::ffff:10.1.2.3": (167838211, 32), "::FFFF:a01:203": (167838211, 32), "0:0:0:0:0:ffff:10.1.2.3/104": (167772160, 8),
             "::ffff:10.1.2.3/95": None, "64:ff9b::1.2.3.4": None, "64:ff9b::1.2.3.4/96": None, "::1.2.3.4": None,
             "::ffff:10.1.2.300": "bad", "1.2.3.4::": "bad", "::ffff:10.1.2.3/129": "bad"}
    specs = spark.createDataFrame([(t, "", 0, 0, "") for t in texts], "src_ip string, dst_ip string, src_port long, dst_port long, protocol string")
    got = R.compile_rules(specs.withColumn("text", specs.src_ip)).collect()
    for r in got:
        want = texts[r.text]
        if want == "bad":
            assert r.reason == "invalid src_ip", r.text
        else:
            assert r.reason is None and r.never_matches == (want is None), r.text
            assert want is None or (r.src_lo, r.src_len) == want, r.text
