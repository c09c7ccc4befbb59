import random

import pytest
from packet_bytes import expect_match, frame, frames_df, rules_df

from framelake.operators import markers, prefilter
from framelake.operators import match as m
from framelake.operators.decode import decode, packets

TCP, UDP = frame(), frame(proto=17)


CASES = [
    (TCP, {}, True), (TCP, {"protocol": "tcp"}, True), (UDP, {"protocol": "tcp"}, False),
    (frame("172.20.4.9"), {"src_ip": "172.16.0.0/12"}, True), (frame("198.51.100.6"), {"src_ip": "172.16.0.0/12"}, False),
    (frame(dport=8443), {"dst_port": 8443}, True), (frame(dport=9090), {"dst_port": 8443}, False),
    (frame(dst="203.0.113.77"), {"dst_ip": "203.0.113.77"}, True), (frame(dst="203.0.113.77"), {"dst_ip": "203.0.113.76"}, False),
    (frame(sport=53), {"src_port": 53}, True), (frame(sport=54), {"src_port": 53}, False),
    (frame(proto=1, dport=443), {"dst_port": 443}, False), (frame(proto=1), {"protocol": "icmp"}, True),
    (TCP, {"src_ip": "0.0.0.0/0"}, True), (TCP, {"src_ip": "2001:db8::/32"}, False),
    (frame(version=6), {}, True), (frame(size=37), {}, False),
]


@pytest.mark.parametrize("plan", ["inline", "keyed"])
def test_single_rules(spark, plan):
    """Each case is a frame and a rule; whether that rule is among the frame's matches is what counts."""
    df, rules = frames_df(spark, [c[0] for c in CASES]), rules_df(spark, [c[1] for c in CASES])
    for table in (decode(df), packets(df)):
        found = {(r.capture_id, r.filter_id) for r in m.match(table, rules, plan=plan).collect()}
        for i, (payload, spec, hit) in enumerate(CASES):
            assert ((str(i), i + 1) in found) == hit == expect_match(payload, spec), spec


def random_case(seed, n_frames=150, n_rules=18):
    rng = random.Random(seed)
    nets = ["10.0.0.0", "10.1.0.0", "10.1.2.0", "192.168.0.0", "200.1.1.0"]

    def address():
        base = rng.choice(nets).split(".")
        return ".".join([base[0], base[1], rng.choice([base[2], "5"]), str(rng.randrange(4))])

    def cidr():
        return rng.choice(["", "", address(), f"{address()}/{rng.choice([0, 1, 8, 15, 16, 24, 31, 32])}", "2001:db8::/32"])

    frames = [frame(address(), address(), rng.choice([53, 443, 1000]), rng.choice([53, 443, 80]), rng.choice([1, 6, 17, 47]),
                    rng.choice([20, 36, 38, 42, 60]), rng.choice([4, 4, 4, 6]), rng.choice([5, 5, 6]),
                    rng.choice([0x0800, 0x0800, 0x0800, 0x0806])) for _ in range(n_frames)]
    specs = [{"src_ip": cidr(), "dst_ip": cidr(), "src_port": rng.choice([0, 0, 0, 53, 443]),
              "dst_port": rng.choice([0, 0, 443, 53]), "protocol": rng.choice(["", "", "tcp", "udp", "icmp"])}
             for _ in range(n_rules)]
    return frames, specs


@pytest.mark.parametrize("seed", [1])
def test_every_plan_agrees_with_a_plain_matcher(spark, seed):
    frames, specs = random_case(seed)
    want = sorted((str(i), j + 1) for i, f in enumerate(frames) for j, s in enumerate(specs) if expect_match(f, s))
    df, rules = frames_df(spark, frames), rules_df(spark, specs)
    plans = [dict(plan="inline"), dict(plan="keyed"), dict(plan="keyed", broadcast_rules=8, salts=3),
             dict(plan="keyed", tried_shapes=0)]
    for table in (decode(df), packets(df)):
        for options in plans:
            got = m.match(table, rules, **options).select("capture_id", "filter_id").collect()
            assert sorted((r.capture_id, r.filter_id) for r in got) == want, options
    kept = sorted({i for i, _ in want})
    # raw frames take the join plan with this many rules, stored packets the literal one
    for table, bound in ((decode(df), m.BROADCAST_RULES), (decode(df), 2), (packets(df), 2)):
        hit = [r.capture_id for r in prefilter.prefilter(table, rules, bound).select("capture_id").collect()]
        assert sorted(hit) == kept
    lost = [r.capture_id for r in prefilter.rejected(packets(df), rules).select("capture_id").collect()]
    assert sorted(hit + lost) == sorted(str(i) for i in range(len(frames)))


def test_duplicate_rules_keep_their_rows(spark):
    got = m.match(decode(frames_df(spark, [TCP])), rules_df(spark, [{"protocol": "tcp"}] * 2)).collect()
    assert sorted(r.filter_id for r in got) == [1, 2]


def test_no_rules(spark):
    df, rules = decode(frames_df(spark, [TCP, b"\x01"])), rules_df(spark, [{"protocol": "nope"}])
    for plan in ("auto", "keyed"):
        assert m.match(df, rules, plan=plan).count() == 0
    assert prefilter.prefilter(df, rules).count() == 2
    assert prefilter.rejected(df, rules).count() == 0


@pytest.mark.parametrize("specs,keep", [
    ([], [True, True, True, True]),
    ([{"protocol": "tcp", "src_ip": "172.16.0.0/12", "dst_port": 8443}], [True, False, False, False]),
    ([{"protocol": "tcp", "dst_port": 8443}, {"protocol": "udp", "dst_port": 514}], [True, True, True, False]),
])
def test_union_prefilter_cases(spark, specs, keep):
    frames = [frame("172.20.4.9", dport=8443), frame("198.51.100.6", dport=8443),
              frame("192.0.2.11", "203.0.113.77", 31001, 514, 17), frame("192.0.2.11", "203.0.113.77", 31001, 9090)]
    rules = rules_df(spark, specs or [{"protocol": "bad"}])
    got = {r.capture_id for r in prefilter.prefilter(decode(frames_df(spark, frames)), rules).collect()}
    assert got == {str(i) for i, k in enumerate(keep) if k}


@pytest.mark.parametrize("plan", ["inline", "keyed"])
def test_rules_apply_only_while_registered(spark, plan):
    df = decode(frames_df(spark, [TCP] * 4, ts=[9, 10, 19, 20]))
    spans = spark.createDataFrame([(1, 10, 20), (2, 15, None)], "rule_id long, from_ns long, to_ns long")
    rules = rules_df(spark, [{}, {"protocol": "tcp"}]).join(spans, "rule_id")
    got = sorted((r.filter_id, r.ts_ns) for r in m.match(df, rules, plan=plan).collect())
    assert got == [(1, 10), (1, 19), (2, 19), (2, 20)]


def test_coarse_markers_lose_nothing(spark, monkeypatch):
    frames, specs = random_case(7, n_frames=80, n_rules=40)
    want = sorted((str(i), j + 1) for i, f in enumerate(frames) for j, s in enumerate(specs) if expect_match(f, s))
    monkeypatch.setattr(markers.side_of, "__defaults__", (3,))  # three markers a side at most, so 16 bits only
    got = m.match(packets(frames_df(spark, frames)), rules_df(spark, specs), plan="keyed", tried_shapes=0).collect()
    assert sorted((r.capture_id, r.filter_id) for r in got) == want


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_only_pairs_of_networks_that_rules_name_are_tried(spark, most, monkeypatch):
    """with all lengths live on both sides, a frame was tried at every pair of them."""
    monkeypatch.setattr(markers.pairs_of, "__defaults__", (most,))  # beyond it, a table of known keys
    specs = [{"src_ip": f"{'10.1.2.3' if a == b else '192.168.2.3'}/{a}", "dst_ip": f"10.4.5.6/{b}"}
             for a in range(9, 25) for b in range(9, 25)]
    rules, df = rules_df(spark, specs), packets(frames_df(spark, [frame(s, "10.4.5.6") for s in ("10.1.2.3", "192.168.2.3")]))
    shapes = list(m.shapes_of(rules))
    tried = m.tried(df, shapes, m.marks_of(m.rule_keys(rules), shapes)).groupBy("capture_id").count().collect()
    for r in tried:  # before: 256 of both
        hits, extra = (16 if r["capture_id"] == "0" else 240), 0 if most > 256 else 16
        assert hits <= r["count"] <= hits + extra
    for bound in (m.BROADCAST_RULES, 0):
        got = m.match(df, rules, plan="keyed", broadcast_rules=bound).groupBy("capture_id").count().collect()
        assert {r["capture_id"]: r["count"] for r in got} == {"0": 16, "1": 240}


def test_markers_are_the_lengths_that_contain_an_address(spark):
    rng = random.Random(4)
    nets = [(rng.randrange(33), rng.getrandbits(32)) for _ in range(300)]
    nets = {(n, a >> (32 - n) << (32 - n) if n else 0) for n, a in nets}
    keyed = spark.createDataFrame([(n << 1, a if n else -1, -1) for n, a in nets], "_shape int, _ks long, _kd long")
    side = markers.side_of(keyed, [n << 1 for n, _ in nets], "src")
    tried = [a | rng.getrandbits(32 - n) if n < 32 else a for n, a in nets for _ in range(3)]
    frames = spark.createDataFrame([(a,) for a in tried], "src_ip long")
    nets.add((0, 0))  # so that no address is without any
    side = markers.Side(side.name, side.table, side.levels, 1)
    for r in markers.with_live(frames, side).distinct().collect():
        want = {n for n, a in nets if n == 0 or r.src_ip >> (32 - n) == a >> (32 - n)}
        assert {n for n in range(33) if r._live_src >> n & 1} == want


def test_rules_registered_again_and_again(spark):
    """One key, many validities: every frame meets the right ones, and the join produces few others."""
    rng = random.Random(9)
    spans = []
    for i in range(3000):
        since = rng.randrange(-10**12, 10**12)
        spans.append((i + 1, since, since + rng.choice([0, 1, 7, 10**3, 10**6, 10**9, 10**11])))
    spans += [(3001, None, 5), (3002, 5, None), (3003, None, None), (3004, 9, 3)]
    times = [rng.randrange(-10**12, 10**12) for _ in range(200)] + [s for _, s, _ in spans[:50]] + [4, 5]
    rules = rules_df(spark, [{"protocol": "tcp"}] * 3004).join(
        spark.createDataFrame(spans, "rule_id long, from_ns long, to_ns long"), "rule_id")
    df = packets(frames_df(spark, [TCP] * len(times), ts=times))
    got = sorted((r.ts_ns, r.filter_id) for r in m.match(df, rules, plan="keyed").distinct().collect())
    want = sorted({(t, i) for t in times for i, a, b in spans if (a is None or t >= a) and (b is None or t < b)})
    assert got == want
    celled = markers.with_cells(spark.createDataFrame(spans, "rule_id long, from_ns long, to_ns long"))
    assert celled.groupBy("rule_id").count().agg({"count": "max"}).first()[0] <= 34
    sizes = [r[0] for r in celled.select("_size").distinct().collect()]
    met = celled.select("_size", "_cell", "from_ns", "to_ns").collect()
    near = sum(1 for t in times for r in met if r._size != markers.ALWAYS and t >> 2 * r._size == r._cell)
    assert len(sizes) < 12 and near < 2 * len([w for w in want if w[1] <= 3000]) + 200


def test_unknown_plan(spark):
    with pytest.raises(ValueError):
        m.match(decode(frames_df(spark, [TCP])), rules_df(spark, [{}]), plan="x")


def test_rules_with_a_validity_stand_once_unless_crowded(spark):
    """rules of a key that has few were filed under up to 34 cells each."""
    spans = [(i + 1, i * 10**9, i * 10**9 + 10**8 * (1 + i % 7)) for i in range(200)]
    spans_df = spark.createDataFrame(spans, "rule_id long, from_ns long, to_ns long")
    specs = [{"protocol": "tcp"}] * 150 + [{"protocol": "udp"}] * 50
    rules = m.usable(rules_df(spark, specs).join(spans_df, "rule_id"))
    table = m._rule_table(rules, True).groupBy("_r.ip_proto").agg({"_size": "max", "*": "count"}).collect()
    found = {r["ip_proto"]: (r["max(_size)"], r["count(1)"]) for r in table}
    assert found[17] == (markers.ALWAYS, 50) and found[6][0] < markers.ALWAYS and found[6][1] > 150
    times = [a + k for _, a, b in spans for k in (-1, 0, 5, b - a)]
    df = packets(frames_df(spark, [TCP, UDP] * len(times), ts=[t for t in times for _ in range(2)]))
    want = sorted((t, i) for t in times for i, a, b in spans if a <= t < b)
    for options in ({}, dict(broadcast_rules=0, salts=3)):
        got = m.match(df, rules, plan="keyed", **options).select("ts_ns", "filter_id").collect()
        assert sorted((r.ts_ns, r.filter_id) for r in got) == want


def test_only_hot_keys_are_salted(spark):
    """every rule of a heavy shape was copied for each salt."""
    rules = rules_df(spark, [{"src_ip": f"10.0.{i}.0/24"} for i in range(250)])
    frames = [frame(f"10.0.{3 if i % 2 else i % 250}.1") for i in range(20_000)]
    df = packets(frames_df(spark, frames))
    out = m.match(df, rules, plan="keyed", broadcast_rules=0, salts=50)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text and " IN (" in text or "INSET" in text
    assert out.filter("filter_id = 4").count() == 10_000 + 20_000 // 250 * ((3 % 2) == 0) and out.count() == 20_000


def test_equal_rules_share_a_row_and_keep_their_numbers(spark):
    """rules that differ in their number only were checked one by one for each frame."""
    rules = rules_df(spark, [{"protocol": "tcp"}] * 40 + [{"protocol": "udp"}] * 3)
    table = m._rule_table(m.usable(rules), False)
    assert table.count() == 2
    got = m.match(decode(frames_df(spark, [TCP, UDP])), rules.union(rules.limit(1)), plan="keyed").collect()
    assert sorted(r.filter_id for r in got if r.capture_id == "0") == [1, *range(1, 41)]
    assert sorted(r.filter_id for r in got if r.capture_id == "1") == [41, 42, 43]


@pytest.mark.parametrize("broadcast", [0, 12])
def test_many_heavy_shapes_shuffle_known_keys_only(spark, broadcast):
    """every frame was shuffled once for each live shape, whether or not a rule had its key."""
    frames, specs = random_case(11, n_frames=120, n_rules=90)
    specs += [{"src_ip": f"10.{i % 2}.0.0/{8 + i % 24}", "dst_ip": f"192.168.0.0/{9 + i % 23}"} for i in range(60)]
    want = sorted((str(i), j + 1) for i, f in enumerate(frames) for j, s in enumerate(specs) if expect_match(f, s))
    df, rules = packets(frames_df(spark, frames)), rules_df(spark, specs)
    out = m.match(df, rules, plan="keyed", broadcast_rules=broadcast, salts=2)
    assert "known-keys" in out._jdf.queryExecution().toString() or "_bits" in out._jdf.queryExecution().toString()
    assert sorted((r.capture_id, r.filter_id) for r in out.collect()) == want
    kept = sorted({i for i, _ in want})
    raw = decode(frames_df(spark, frames))
    assert sorted(r.capture_id for r in prefilter.prefilter(raw, rules, broadcast).collect()) == kept
    lost = sorted(r.capture_id for r in prefilter.rejected(raw, rules, broadcast).collect())
    assert sorted(kept + lost) == sorted(str(i) for i in range(len(frames)))
    groups = prefilter._wide_first({s: 10 for s in (0, 32 << 1, 8 << 1, 24 << 7)}, 20)
    assert groups == [[0, 8 << 1], [24 << 7, 32 << 1]] and prefilter._wide_first({1: 5}, 0) == []


def test_frames_of_many_keys_are_shuffled_once_a_route(spark):
    """F1 to F4: a frame was shuffled once for each key of a heavy shape that it has, here 256 times."""
    rules = rules_df(spark, [{"src_ip": f"10.1.2.3/{a}", "dst_ip": f"10.4.5.6/{b}"} for a in range(9, 25) for b in range(9, 25)])
    df = packets(frames_df(spark, [frame("10.1.2.3", "10.4.5.6")] * 1500 + [frame("10.1.2.3", "11.4.5.6")] * 10))
    out = m.match(df, rules, plan="keyed", broadcast_rules=0, salts=3).select("capture_id", "filter_id")
    text = out._jdf.queryExecution().toString()
    shuffles = [line for line in text.split("== Physical Plan ==")[1].splitlines() if "Exchange hashpartitioning(" in line]
    assert len(shuffles) == 2 and all("hashpartitioning(_route" in line for line in shuffles)
    assert out.count() == 1500 * 256 and out.distinct().count() == 1500 * 256
    shapes = list(m.shapes_of(rules))
    live = m._live(df, m.marks_of(m.rule_keys(rules), shapes))
    for names, most in ((("src",), 3), (("dst",), 3), (("src", "dst"), 9)):
        by = markers.routed(live, shapes, names).groupBy("capture_id").count().agg({"count": "max", "*": "count"}).first()
        assert tuple(by) in ((most, 1500), (1500, most))


@pytest.mark.parametrize("most,timed,table,bound", [
    (400_000, False, packets, 0), (12, True, decode, 12), (12, False, packets, 0)])
def test_routes_lose_nothing(spark, most, timed, table, bound, monkeypatch):
    """F1 to F4: by routes, by keys where routes have too many rules, and by both."""
    frames, specs = random_case(13, n_frames=120, n_rules=90)
    specs += specs[:5] + [{"src_ip": f"10.{i % 2}.0.0/{8 + i % 24}", "dst_ip": f"192.168.0.0/{9 + i % 23}"} for i in range(60)]
    want = sorted((str(i), j + 1) for i, f in enumerate(frames) for j, s in enumerate(specs) if expect_match(f, s))
    rules = rules_df(spark, specs)
    if timed:
        spans = [(j + 1, j % 40, None if j % 9 == 0 else j % 40 + 70) for j in range(len(specs))]
        rules = rules.join(spark.createDataFrame(spans, "rule_id long, from_ns long, to_ns long"), "rule_id")
        want = [(i, j) for i, j in want if spans[j - 1][1] <= int(i) and (spans[j - 1][2] is None or int(i) < spans[j - 1][2])]
    for name, value in (("HOT_ONE_IN", 1), ("HOT_FRAMES", 5), ("ROUTE_GAIN", 0), ("ROUTE_RULES", most)):
        monkeypatch.setattr(m, name, value)
    raw = frames_df(spark, frames, ts=list(range(len(frames))))
    out = m.match(table(raw), rules, plan="keyed", broadcast_rules=bound, salts=3).select("capture_id", "filter_id")
    assert "_route" in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == want
