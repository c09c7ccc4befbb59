"""The same questions in SQL, answered from the tables by arithmetic, without any packet bytes."""

from __future__ import annotations

DAY = 86_400_000_000_000
HUNDRED_DAYS = 100 * DAY

_EVENTS = "SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, value FROM events"
_LINEITEM = """
SELECT l_orderkey * 8 + l_linenumber AS event_id, epoch_us(l_shipdate) * 1000 AS ts_ns, l_suppkey AS user_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup'
       ELSE 'error' END AS event_type,
  l_quantity AS value
FROM lineitem"""


def packets(source: str = _EVENTS) -> str:
    """CTEs ``ev`` (events) and ``pk`` (what decoding must find)."""
    return f"""
WITH ev AS ({source}),
raw AS (
  SELECT *, 64 + CAST(floor(value) AS BIGINT) AS wire0,
    167772160 + (user_id % 4) * 65536 + user_id AS si, 3232235520 + event_id % 1000 AS di,
    CASE WHEN event_type = 'error' THEN 4660 ELSE 1024 + event_id % 500 END AS sp,
    CASE event_type WHEN 'view' THEN 80 WHEN 'purchase' THEN 53 ELSE 443 END AS dp,
    CASE WHEN event_type IN ('click', 'view') THEN 6 WHEN event_type = 'error' THEN 1 ELSE 17 END AS pr,
    event_id % 97 = 0 AS arp, event_id % 89 = 0 AS v6n, event_id % 83 = 0 AS trunc, event_id % 79 = 0 AS opt,
    event_id % 73 = 0 AS nol4
  FROM ev),
pk AS (
  SELECT *, wire0 + CASE WHEN opt THEN 4 ELSE 0 END AS full_len,
    CASE WHEN trunc THEN 20 WHEN nol4 THEN 36 ELSE wire0 + CASE WHEN opt THEN 4 ELSE 0 END END AS n_bytes,
    NOT (arp OR trunc OR nol4) AS match_ok, NOT (arp OR trunc OR v6n) AS stat_ok, NOT (arp OR trunc) AS ipv4,
    CASE WHEN pr IN (6, 17) THEN sp ELSE 0 END AS sport, CASE WHEN pr IN (6, 17) THEN dp ELSE 0 END AS dport
  FROM raw)"""


# rule_id, protocol number, source range, destination range, source port, destination port
RULES = """
rl(rule_id, pr, slo, shi, dlo, dhi, sp, dp) AS (VALUES
  (1, 6, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INT, 443),
  (2, 17, NULL, NULL, NULL, NULL, NULL, 53),
  (3, 6, 167837696, 167903231, NULL, NULL, NULL, NULL),
  (4, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (5, 1, NULL, NULL, NULL, NULL, NULL, NULL),
  (6, NULL, NULL, NULL, 3232235527, 3232235527, NULL, NULL),
  (7, NULL, 167903232, 168034303, NULL, NULL, NULL, 443),
  (8, NULL, 1, 0, NULL, NULL, NULL, NULL),
  (9, NULL, NULL, NULL, NULL, NULL, 1031, NULL),
  (10, 6, NULL, NULL, NULL, NULL, NULL, 443),
  (11, NULL, 167772160, 168034303, NULL, NULL, NULL, NULL),
  (12, NULL, NULL, NULL, 0, 4294967295, NULL, NULL))"""

# rules that follow from customer and supplier
MANY_RULES = """
rl(rule_id, pr, slo, shi, dlo, dhi, sp, dp) AS (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 6 END, 167772160 + (c_custkey % 4) * 65536 + c_custkey,
    167772160 + (c_custkey % 4) * 65536 + c_custkey, NULL::BIGINT, NULL::BIGINT, NULL::INT, NULL::INT
  FROM customer
  UNION ALL
  SELECT 100000000 + s_suppkey, NULL, NULL, NULL, 3232235520 + s_suppkey * 4, 3232235520 + s_suppkey * 4 + 3, NULL,
    CASE WHEN s_suppkey % 3 = 0 THEN 443 END
  FROM supplier)"""

# rules of many shapes that follow from customer
SHAPE_RULES = """
shaped AS (
  SELECT c_custkey AS k, 167772160 + (c_custkey % 4) * 65536 + c_custkey AS a, 3232235520 + c_custkey % 1000 AS b,
    CAST(pow(2, 16 - c_custkey % 17) AS BIGINT) AS x, CAST(pow(2, 12 - c_custkey % 13) AS BIGINT) AS y FROM customer),
rl(rule_id, pr, slo, shi, dlo, dhi, sp, dp) AS (
  SELECT k, CASE WHEN k % 2 = 0 THEN 6 END, a - a % x, a - a % x + x - 1, b - b % y, b - b % y + y - 1, NULL::INT,
    CASE WHEN k % 3 = 0 THEN 443 END FROM shaped)"""

# rules of all prefix lengths that follow from customer
WIDE_RULES = """
wide AS (
  SELECT c_custkey AS k, 167772160 + (c_custkey % 4) * 65536 + c_custkey % 150 AS a, 3232235520 + c_custkey % 1000 AS b,
    CAST(pow(2, 32 - c_custkey % 33) AS BIGINT) AS x, CAST(pow(2, 32 - c_custkey * 7 % 33) AS BIGINT) AS y FROM customer),
rl(rule_id, pr, slo, shi, dlo, dhi, sp, dp) AS (
  SELECT k, CASE WHEN k % 2 = 0 THEN 6 END, a - a % x, a - a % x + x - 1, b - b % y, b - b % y + y - 1,
    CASE WHEN k % 5 = 0 THEN 1024 + k % 500 END, CASE WHEN k % 3 = 0 THEN 443 END FROM wide)"""

# every host rule of customer twelve times, one after the other
TIMED_RULES = """
timed AS (
  SELECT c_custkey AS k, turn, 1704067200000000000 + (c_custkey % 7 + turn * 2) * 86400000000000 AS since,
    167772160 + (c_custkey % 4) * 65536 + c_custkey AS a FROM customer, (SELECT unnest(range(12)) AS turn)),
rl(rule_id, pr, slo, shi, dlo, dhi, sp, dp, since, until) AS (
  SELECT k * 100 + turn, CASE WHEN k % 2 = 0 THEN 6 END, a, a, NULL::BIGINT, NULL::BIGINT, NULL::INT, NULL::INT, since,
    CASE WHEN turn < 11 THEN since + 10800000000000 * CAST(pow(2, (k + turn) % 5) AS BIGINT) END FROM timed)"""

_HITS = """
  (r.pr IS NULL OR r.pr = p.pr) AND (r.slo IS NULL OR p.si BETWEEN r.slo AND r.shi)
  AND (r.dlo IS NULL OR p.di BETWEEN r.dlo AND r.dhi)
  AND (r.sp IS NULL OR r.sp = p.sport) AND (r.dp IS NULL OR r.dp = p.dport)"""


def matched(source: str = _EVENTS, rules: str = RULES) -> str:
    """CTE ``m``: one row per frame and matching rule."""
    return f"""{packets(source)}, {rules},
m AS (SELECT r.rule_id AS filter_id, p.* FROM pk p JOIN rl r ON p.match_ok AND {_HITS})"""


def match_rows(rule_ids: str = "", rules: str = RULES, source: str = _EVENTS) -> str:
    where = f"WHERE filter_id IN ({rule_ids})" if rule_ids else ""
    return f"{matched(source, rules)} SELECT CAST(event_id AS VARCHAR) AS capture_id, CAST(filter_id AS BIGINT) AS filter_id FROM m {where}"


def prefilter(keep: bool, rules: str = RULES, rule_ids: str = "") -> str:
    where = f"AND r.rule_id IN ({rule_ids})" if rule_ids else ""
    return f"""{packets()}, {rules}
SELECT CAST(event_id AS VARCHAR) AS capture_id, n_bytes FROM pk p
WHERE {'' if keep else 'NOT'} EXISTS (SELECT 1 FROM rl r WHERE p.match_ok AND {_HITS} {where})"""


def intervals(source: str = _EVENTS, width: int = DAY, where: str = "TRUE") -> str:
    """CTEs: ``iv`` per (rule, interval), ``hist`` per source address, ``ent`` entropy, ``fresh_*`` first sightings."""
    return f"""{matched(source)},
mi AS (SELECT *, ts_ns // {width} AS interval FROM m WHERE {where}),
iv AS (SELECT filter_id, interval, count(*) AS packets, CAST(sum(n_bytes) AS BIGINT) AS bytes,
         count(*) FILTER (WHERE stat_ok) AS win FROM mi GROUP BY ALL),
hist AS (SELECT filter_id, interval, si, count(*) AS c FROM mi WHERE stat_ok GROUP BY ALL),
ent AS (SELECT filter_id, interval, round(greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0), 6) AS bits
        FROM hist GROUP BY ALL),
fresh_src AS (SELECT filter_id, interval, count(*) AS n FROM
  (SELECT filter_id, si, min(interval) AS interval FROM mi WHERE stat_ok GROUP BY ALL) GROUP BY ALL),
fresh_dst AS (SELECT filter_id, interval, count(*) AS n FROM
  (SELECT filter_id, di, min(interval) AS interval FROM mi WHERE stat_ok GROUP BY ALL) GROUP BY ALL)"""


def snapshot(source: str = _EVENTS, width: int = DAY, filled: bool = True, with_interval: bool = True,
             up_to: str = "(SELECT max(interval) FROM iv)") -> str:
    spine = (f"SELECT filter_id, unnest(generate_series(min(interval), {up_to})) AS interval FROM iv "
             f"WHERE interval <= {up_to} GROUP BY filter_id"
             if filled else "SELECT filter_id, interval FROM iv")
    return f"""{intervals(source, width)},
spine AS ({spine})
SELECT CAST(filter_id AS BIGINT) AS filter_id, {'interval,' if with_interval else ''}
  CAST(sum(coalesce(packets, 0)) OVER w AS BIGINT) AS packets, CAST(sum(coalesce(bytes, 0)) OVER w AS BIGINT) AS bytes,
  CAST(sum(coalesce(s.n, 0)) OVER w AS BIGINT) AS unique_src_ips,
  CAST(sum(coalesce(d.n, 0)) OVER w AS BIGINT) AS unique_dst_ips,
  coalesce(bits, 0.0) AS src_entropy_bits, coalesce(win, 0) AS src_window_packets
FROM spine LEFT JOIN iv USING (filter_id, interval) LEFT JOIN ent USING (filter_id, interval)
  LEFT JOIN fresh_src s USING (filter_id, interval) LEFT JOIN fresh_dst d USING (filter_id, interval)
WINDOW w AS (PARTITION BY filter_id ORDER BY interval)"""


_LEN = "CAST(pow(2, 32 - {n}) AS BIGINT)"


def spec_columns() -> str:
    """CTE ``sp``: what the derived rule texts must compile to."""
    return f"""
WITH ev AS ({_EVENTS}),
base AS (SELECT event_id, user_id, event_type, 167772160 + (user_id % 4) * 65536 + user_id AS si,
           3232235520 + event_id % 1000 AS di,
           CASE event_type WHEN 'click' THEN event_id % 33 WHEN 'view' THEN 32 END AS slen,
           CASE WHEN user_id % 40 <= 32 THEN user_id % 40 END AS dlen
         FROM ev),
sp AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 1 WHEN slen IS NOT NULL THEN si - si % {_LEN.format(n='slen')} END AS src_lo,
    CASE WHEN event_type = 'signup' THEN 0 WHEN slen IS NOT NULL
         THEN si - si % {_LEN.format(n='slen')} + {_LEN.format(n='slen')} - 1 END AS src_hi,
    CASE WHEN dlen IS NOT NULL THEN di - di % {_LEN.format(n='dlen')} END AS dst_lo,
    CASE WHEN dlen IS NOT NULL THEN di - di % {_LEN.format(n='dlen')} + {_LEN.format(n='dlen')} - 1 END AS dst_hi,
    CASE WHEN event_type <> 'purchase' THEN 1024 + event_id % 500 END AS sport,
    CASE WHEN user_id * 997 BETWEEN 1 AND 65535 THEN user_id * 997 END AS dport,
    CASE event_type WHEN 'click' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 1 END AS proto,
    CASE WHEN user_id * 997 > 65535 THEN 'port out of range' WHEN event_type = 'error' THEN 'invalid src_ip'
         WHEN dlen IS NULL THEN 'invalid dst_ip' END AS reason
  FROM base)"""


_COMPILED = """event_id, src_lo, src_hi, dst_lo, dst_hi, CAST(slen AS INT) AS src_len, CAST(dlen AS INT) AS dst_len,
  CAST(sport AS INT) AS src_port, CAST(dport AS INT) AS dst_port, CAST(proto AS INT) AS ip_proto,
  event_type = 'signup' AS never_matches, reason"""


def oracles() -> dict[str, str]:
    out = {}
    out["frame_scan"] = f"""{packets()}
SELECT CAST(event_id AS VARCHAR) AS capture_id, ts_ns, ts_ns // 1000 AS ts_us, n_bytes AS snap_len, full_len AS wire_len,
  n_bytes AS payload_len FROM pk"""
    out["decode_packets"] = f"""{packets()}
SELECT CAST(event_id AS VARCHAR) AS capture_id, ts_ns, n_bytes, CASE WHEN arp THEN 2054 ELSE 2048 END AS ethertype,
  CASE WHEN ipv4 THEN CASE WHEN v6n THEN 6 ELSE 4 END END AS ip_version,
  CASE WHEN ipv4 THEN CASE WHEN opt THEN 24 ELSE 20 END END AS ihl,
  CASE WHEN ipv4 THEN pr END AS ip_proto, CASE WHEN ipv4 THEN si END AS src_ip, CASE WHEN ipv4 THEN di END AS dst_ip,
  CASE WHEN match_ok THEN sport END AS src_port, CASE WHEN match_ok THEN dport END AS dst_port, match_ok, stat_ok FROM pk"""
    out["decodable_frames"] = f"""{packets()}
SELECT match_ok, stat_ok, count(*) AS frames, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM pk GROUP BY ALL"""
    out["rules_compiled"] = f"{spec_columns()} SELECT {_COMPILED} FROM sp"
    out["rules_rejected"] = f"{spec_columns()} SELECT event_id, reason FROM sp WHERE reason IS NOT NULL"
    out["rules_numbered"] = f"""{spec_columns()}
SELECT row_number() OVER (ORDER BY event_id) + 1000 AS rule_id, event_id FROM sp WHERE reason IS NULL"""
    out["rules_from_json"] = f"""{spec_columns()}
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE src_lo END AS src_lo,
  CASE WHEN event_type <> 'error' THEN dst_hi END AS dst_hi,
  CASE WHEN event_type <> 'error' THEN CAST(sport AS INT) END AS src_port,
  CASE WHEN event_type <> 'error' THEN CAST(dport AS INT) END AS dst_port,
  CASE WHEN event_type <> 'error' THEN CAST(proto AS INT) END AS ip_proto,
  CASE WHEN event_type = 'error' THEN 'malformed' ELSE reason END AS reason FROM sp"""
    out["rules_from_flags"] = f"""{spec_columns()}
SELECT event_id,
  CASE WHEN event_type IN ('click', 'view') THEN src_lo END AS src_lo,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(dport AS INT) END AS dst_port,
  CASE event_type WHEN 'click' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 1 END AS ip_proto,
  CASE WHEN event_type IN ('signup', 'error') THEN 'malformed' WHEN user_id * 997 > 65535 THEN 'port out of range'
  END AS reason FROM sp"""
    history = f"""
WITH ev AS ({_EVENTS}),
adds AS (SELECT row_number() OVER (ORDER BY event_id) AS rule_id, ts_ns, event_id FROM ev WHERE event_type = 'purchase'),
rem AS (SELECT user_id AS rule_id, ts_ns, event_id FROM ev WHERE event_type = 'error')"""
    out["rules_active_at"] = f"""{history}
SELECT rule_id, ts_ns AS from_ns FROM adds a WHERE ts_ns <= 1705276800000000000 AND NOT EXISTS (
  SELECT 1 FROM rem r WHERE r.rule_id = a.rule_id AND r.ts_ns <= 1705276800000000000
    AND (r.ts_ns > a.ts_ns OR (r.ts_ns = a.ts_ns AND r.event_id > a.event_id)))"""
    out["rules_listing"] = out["rules_active_at"].replace("SELECT rule_id, ts_ns AS from_ns FROM adds a", """
SELECT rule_id, ts_ns AS from_ns, '' AS src_ip, concat('192.168.', (event_id % 1000) // 256, '.', (event_id % 1000) % 256, '/',
  user_id % 40) AS dst_ip, CAST(0 AS BIGINT) AS src_port, user_id * 997 AS dst_port, 'udp' AS protocol
FROM adds a JOIN ev USING (event_id, ts_ns)""")
    out["rules_file_numbered"] = f"""{spec_columns()},
lines AS (SELECT *, row_number() OVER (ORDER BY event_id) AS line_no FROM sp),
good AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rule_id FROM lines
  WHERE event_type IN ('click', 'view', 'purchase') AND user_id * 997 <= 65535)
SELECT rule_id, line_no, CASE WHEN event_type IN ('click', 'view') THEN src_lo END AS src_lo, CAST(dport AS INT) AS dst_port,
  CAST(proto AS INT) AS ip_proto FROM good"""
    out["rule_validity"] = f"""{history}
SELECT a.rule_id, a.ts_ns AS from_ns, min(r.ts_ns) AS to_ns FROM adds a LEFT JOIN rem r ON r.rule_id = a.rule_id
  AND (r.ts_ns > a.ts_ns OR (r.ts_ns = a.ts_ns AND r.event_id > a.event_id)) GROUP BY a.rule_id, a.ts_ns"""
    for key, ids in (("match_proto", "1, 2, 5, 10"), ("match_src_cidr", "3, 7, 11"), ("match_dst_cidr", "6, 12"),
                     ("match_src_port", "9"), ("match_dst_port", "1, 2, 7, 10")):
        out[key] = match_rows(ids)
    out["match_rules"] = out["match_rules_shapes"] = match_rows()
    out["match_many_rules"] = out["match_many_rules_salted"] = match_rows(rules=MANY_RULES)
    out["match_many_shapes"] = out["match_many_shapes_salted"] = match_rows(rules=SHAPE_RULES)
    out["match_pruned_shapes"] = out["match_pruned_shapes_salted"] = match_rows(rules=WIDE_RULES)
    out["match_rules_temporal_keyed"] = (
        f"{packets()}, {TIMED_RULES} SELECT CAST(event_id AS VARCHAR) AS capture_id, CAST(rule_id AS BIGINT) AS filter_id "
        f"FROM pk p JOIN rl r ON p.match_ok AND {_HITS} AND p.ts_ns >= since AND (until IS NULL OR p.ts_ns < until)")
    out["prefilter_many_shapes"] = prefilter(True, SHAPE_RULES)
    out["stream_prefilter"] = out["prefilter_many_shapes"]
    out["rejected_many_rules"] = prefilter(False, MANY_RULES)
    out["prefilter_union"] = prefilter(True, rule_ids="2, 3, 6, 9")
    out["prefilter_rejected"] = prefilter(False, rule_ids="2, 3, 6, 9")
    out["prefilter_many_rules"] = prefilter(True, MANY_RULES)
    out["match_rules_temporal"] = f"""{packets()}, {RULES}
SELECT CAST(event_id AS VARCHAR) AS capture_id, CAST(r.rule_id AS BIGINT) AS filter_id FROM pk p JOIN rl r ON p.match_ok AND {_HITS}
WHERE p.ts_ns >= 1704067200000000000 + r.rule_id * {DAY}
  AND (r.rule_id % 3 <> 0 OR p.ts_ns < 1704067200000000000 + (r.rule_id + 9) * {DAY})"""
    out["dump_drops"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, count(*) AS matched, count(*) FILTER (WHERE n_bytes <= 150) AS delivered,
  count(*) FILTER (WHERE n_bytes > 150) AS dropped FROM m GROUP BY filter_id"""
    out["dump_roundtrip"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, ts_ns, ts_ns & 281474976710655 AS ts48, n_bytes AS wire_len,
  pr AS ip_proto, si AS src_ip, di AS dst_ip, sport AS src_port, dport AS dst_port FROM m"""
    out["stream_dump_count"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, count(*) AS packets, CAST(sum(n_bytes) AS BIGINT) AS bytes,
  min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM m GROUP BY filter_id"""
    out["dump_replay"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, count(*) AS packets, CAST(sum(n_bytes) AS BIGINT) AS bytes,
  count(*) AS streamed_packets, CAST(sum(n_bytes) AS BIGINT) AS streamed_bytes FROM m GROUP BY filter_id"""
    out["rule_totals"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, count(*) AS packets, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM m GROUP BY filter_id"""
    uniques = """count(DISTINCT si) FILTER (WHERE stat_ok) AS unique_src_ips,
  count(DISTINCT di) FILTER (WHERE stat_ok) AS unique_dst_ips"""
    out["unique_ips_exact"] = f"{matched()} SELECT CAST(filter_id AS BIGINT) AS filter_id, {uniques} FROM m GROUP BY filter_id"
    out["unique_ips_hll"] = f"""{matched()} SELECT CAST(filter_id AS BIGINT) AS filter_id, {uniques}, TRUE AS src_in_bound,
  TRUE AS dst_in_bound FROM m GROUP BY filter_id"""
    out["interval_uniques"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, {uniques} FROM mi WHERE stat_ok GROUP BY ALL"""
    out["src_entropy"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, bits AS src_entropy_bits, win AS src_window_packets
FROM ent JOIN iv USING (filter_id, interval)"""
    out["src_ip_histogram"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, si AS src_ip, c FROM hist"""
    out["top_peers"] = f"""{intervals()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY filter_id, interval ORDER BY c DESC, si) AS peer_rank FROM hist)
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, peer_rank,
  concat_ws('.', (si >> 24) & 255, (si >> 16) & 255, (si >> 8) & 255, si & 255) AS peer, c FROM ranked WHERE peer_rank <= 5"""
    out["capture_totals"] = f"""{matched()}
SELECT CAST(user_id AS VARCHAR) AS capture_id, rx_packets, rx_bytes, decodable, coalesce(dumped, 0) AS dumped FROM
  (SELECT user_id, count(*) AS rx_packets, CAST(sum(n_bytes) AS BIGINT) AS rx_bytes,
     count(*) FILTER (WHERE match_ok) AS decodable FROM pk GROUP BY user_id)
  LEFT JOIN (SELECT user_id, count(*) AS dumped FROM m GROUP BY user_id) USING (user_id)"""
    out["capture_totals_one_pass"] = out["capture_totals"]
    flow = """count(*) AS packets, count(*) FILTER (WHERE fwd) AS packets_ab, count(*) FILTER (WHERE NOT fwd) AS packets_ba,
  CAST(sum(n_bytes) AS BIGINT) AS bytes, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns"""
    out["flow_summary"] = f"""{packets()},
f AS (SELECT *, (si, sport) <= (di, dport) AS fwd FROM pk WHERE match_ok)
SELECT pr AS ip_proto, CASE WHEN fwd THEN si ELSE di END AS ip_a, CASE WHEN fwd THEN sport ELSE dport END AS port_a,
  CASE WHEN fwd THEN di ELSE si END AS ip_b, CASE WHEN fwd THEN dport ELSE sport END AS port_b, {flow}
FROM f GROUP BY 1, 2, 3, 4, 5"""
    out["flow_summary_oneway"] = f"""{packets()}, f AS (SELECT *, TRUE AS fwd FROM pk WHERE match_ok)
SELECT pr AS ip_proto, si AS ip_a, sport AS port_a, di AS ip_b, dport AS port_b, {flow} FROM f GROUP BY 1, 2, 3, 4, 5"""
    out["interval_stats"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, packets, bytes, win AS src_window_packets,
  coalesce(bits, 0.0) AS src_entropy_bits, coalesce(s.n, 0) AS new_src, coalesce(d.n, 0) AS new_dst
FROM iv LEFT JOIN ent USING (filter_id, interval) LEFT JOIN fresh_src s USING (filter_id, interval)
  LEFT JOIN fresh_dst d USING (filter_id, interval)"""
    out["running_totals"] = snapshot(filled=False)
    out["gap_fill"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, unnest(generate_series(min(interval), (SELECT max(interval) FROM iv))) AS interval
FROM iv GROUP BY filter_id"""
    until = "19728"
    out["gap_fill_until"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, unnest(generate_series(min(interval), {until})) AS interval
FROM iv WHERE interval <= {until} GROUP BY filter_id"""
    out["snapshot_until"] = snapshot(up_to=until)
    out["snapshot_hll"] = snapshot().replace("coalesce(win, 0) AS src_window_packets",
                                             "coalesce(win, 0) AS src_window_packets, TRUE AS uniques_in_bound")
    out["sketch_union_raw_and_stored"] = f"""{matched()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, TRUE AS same_src, TRUE AS same_dst FROM m GROUP BY filter_id"""
    out["snapshot"] = out["snapshot_of_dump"] = snapshot()
    out["snapshot_volume"] = snapshot(_LINEITEM, HUNDRED_DAYS)
    out["snapshot_json"] = snapshot(with_interval=False)
    out["stream_match"] = match_rows()
    out["stream_interval_stats"] = f"""{intervals()}
SELECT CAST(filter_id AS BIGINT) AS filter_id, interval, packets, bytes, win AS src_window_packets,
  coalesce(bits, 0.0) AS src_entropy_bits FROM iv LEFT JOIN ent USING (filter_id, interval)"""
    out["stream_correction"] = out["stream_interval_stats"]
    out["stream_editable_stats"] = out["stream_interval_stats"].replace(
        intervals(), intervals(where=f"filter_id <= 6 OR ts_ns >= 1704067200000000000 + 15 * {DAY}"))
    out["stream_snapshot"] = snapshot().replace("unique_src_ips", "exact_src_ips").replace(
        "unique_dst_ips", "exact_dst_ips").replace("coalesce(win, 0) AS src_window_packets",
        "coalesce(win, 0) AS src_window_packets, TRUE AS uniques_in_bound")
    out["stream_snapshot_incremental"] = out["stream_snapshot"]
    out["stream_snapshot_json"] = f"""SELECT filter_id, packets, bytes, src_entropy_bits, src_window_packets
FROM ({snapshot(with_interval=False)})"""
    samples = f"""
WITH ev AS ({_EVENTS}),
st AS (SELECT user_id, ts_ns, sum(64 + CAST(floor(value) AS BIGINT)) AS rx, count(*) FILTER (WHERE event_type = 'error') AS dr,
         sum(63 + CAST(floor(value) AS BIGINT)) AS tx, count(*) FILTER (WHERE event_type = 'signup') AS fz FROM ev GROUP BY ALL),
lg AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns) AS el FROM st)"""
    out["counter_rates"] = f"""{samples}
SELECT CAST(user_id AS VARCHAR) AS host, ts_ns, round(el / 1e9, 6) AS elapsed_sec,
  CASE WHEN el IS NOT NULL THEN CAST(rx AS BIGINT) END AS rx_packets_delta, round(rx * 1e9 / el, 6) AS rx_packets_per_sec,
  CASE WHEN el IS NOT NULL THEN dr END AS rx_drops_delta, round(dr * 1e9 / el, 6) AS rx_drops_per_sec,
  CASE WHEN el IS NOT NULL THEN CAST(tx AS BIGINT) END AS tx_packets_delta, round(tx * 1e9 / el, 6) AS tx_packets_per_sec,
  CASE WHEN el IS NOT NULL THEN fz END AS freeze_q_count_delta FROM lg"""
    out["loss_verdict"] = f"""{matched()},
t AS (SELECT user_id, count(*) AS rx_packets, count(*) FILTER (WHERE event_type = 'error' AND value > 60) AS rx_drops
      FROM ev GROUP BY user_id),
o AS (SELECT user_id, count(*) AS n FROM m WHERE filter_id = 3 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS run, rx_packets, rx_drops, coalesce(n, 0) AS output_lines, rx_drops = 0 AS no_loss,
  rx_packets >= 100 AS enough_traffic, coalesce(n, 0) >= 1 AS has_output,
  rx_drops = 0 AND rx_packets >= 100 AND coalesce(n, 0) >= 1 AS passed FROM t LEFT JOIN o USING (user_id)"""
    out["breaking_point"] = f"""
WITH ev AS ({_EVENTS}),
d AS (SELECT user_id AS run, ts_ns // {DAY} AS step, CAST(sum(64 + CAST(floor(value) AS BIGINT)) AS BIGINT) AS actual_pps,
        count(*) FILTER (WHERE event_type = 'error') AS lost FROM ev GROUP BY ALL),
c AS (SELECT *, CAST(sum(lost) OVER (PARTITION BY run ORDER BY step) AS BIGINT) AS rx_drops,
        CASE WHEN step >= 19752 THEN 0 ELSE (step - 19722) * 100000 END AS offered FROM d),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM c WHERE rx_drops > 0) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM c WHERE rx_drops = 0) WHERE rn = 1)
SELECT t.run, t.steps, b.run IS NULL AS zero_loss, b.step AS break_step,
  CASE WHEN b.offered = 0 THEN 'unbounded' ELSE CAST(b.offered AS VARCHAR) END AS break_offered,
  b.actual_pps AS break_actual_pps, b.rx_drops AS break_drops, k.actual_pps AS last_clean_pps
FROM (SELECT run, count(*) AS steps FROM c GROUP BY run) t LEFT JOIN b USING (run) LEFT JOIN k USING (run)"""
    out["bench_compare"] = f"""
WITH ev AS ({_EVENTS}),
r AS (SELECT event_type AS branch, CAST(event_id AS VARCHAR) AS cm, ts_ns // {DAY} AS day, CAST(floor(value * 1000) AS BIGINT) AS pps,
        CASE WHEN value > 60 THEN 1 ELSE 0 END AS drops FROM ev),
x AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY day DESC, cm DESC) AS a,
        row_number() OVER (PARTITION BY branch ORDER BY pps DESC, day DESC, cm DESC) AS z, count(*) OVER (PARTITION BY branch) AS n FROM r)
SELECT l.branch, l.n AS runs, l.cm AS latest_commit, l.pps AS latest_pps, round(l.pps * 8000 / 1e9, 6) AS latest_gbps,
  l.drops AS latest_drops, b.cm AS best_commit, b.pps AS best_pps, round(l.pps / b.pps, 6) AS latest_vs_best
FROM x l JOIN x b ON l.branch = b.branch AND l.a = 1 AND b.z = 1"""
    return out
