"""Frames x rules: every rule that matches a frame yields one row.

Two plans with equal results:

* ``inline`` - a few rules become literal predicates of one projection.  No join and no shuffle; the comparison runs
  inside the scan stage.
* ``keyed`` - many rules.  Rules that constrain the same fields with the same prefix lengths share a *shape*; masking a
  frame's fields by a shape turns range conditions into equality (tuple space search: Srinivasan, Suri and Varghese,
  SIGCOMM 1999).  A frame is tried against the shapes, of which there are few, however many rules there are; if they are
  not so few, or their rules are too many to broadcast, only against those whose networks its addresses can be in, the
  two together (``operators.markers``).  Rules that differ in their number only are one row with a list of numbers.  They are
  broadcast in a few groups of shapes, each under a bound; what is above it, the heavy shapes, goes through a shuffled
  join.  There the frame side of hot keys is salted, so that one such key spreads over many tasks; if heavy shapes are
  many, only frames whose key is in a broadcast bit table are shuffled.  Where a sample of the frames shows that they
  have several keys each, frames and rules meet by a few coarse networks instead (``markers.routed``) and the keys are
  compared on the other side of the shuffle, so that a frame is shuffled a few times at most, however many rules match
  it.  Only columns selected afterwards are shuffled.
  Where many rules with a validity share a key, they are also filed by cells of time, so that a rule registered again
  and again costs a frame no more than the registrations about its time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import markers as mk
from framelake.operators.decode import RAW_KEYS
from framelake.session import stage

# Literal predicates stay fast while the generated method is small enough to be compiled to machine code; predicates on
# raw bytes are longer than on integers.
INLINE_RULES = {"raw": 16, "int": 40}
BROADCAST_RULES = 400_000
BROADCASTS = 4  #: groups of light shapes that are broadcast at once, each of at most so many rules
SALTS = 32
HOT_KEYS = 1000  #: keys of heavy shapes that are salted at most
HOT_ONE_IN, HOT_FRAMES = 64, 64  #: one frame in so many is looked up beforehand; a key is hot if so many of them have it
ROUTE_RULES = 400_000  #: routes with more rules than this are not used: their rules and frames meet by key
ROUTE_GAIN = 2  #: frames go by routes if by keys so many times the rows would be shuffled
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
CROWDED = 64  #: more rules with a validity than this under one key are filed by cells of time
LIST_RULES = 100_000  #: equal rules stand in lists of about so many numbers
TRIED_SHAPES = 24  #: so many shapes are tried on every frame; of more, only those that its addresses leave open

_COMPILED = ("rule_id", "ip_proto", "src_lo", "src_hi", "src_len", "dst_lo", "dst_hi", "dst_len", "src_port",
             "dst_port", "never_matches")
_VALID = ("from_ns", "to_ns")


@dataclass(frozen=True)
class Fields:
    """Where a table keeps the 5-tuple, and how literals compared with it are spelled."""

    proto: Column
    src: Column
    dst: Column
    sport: Column
    dport: Column
    raw: bool

    @staticmethod
    def of(packets: DataFrame) -> "Fields":
        raw = all(c in packets.columns for c in RAW_KEYS)
        names = RAW_KEYS if raw else ("ip_proto", "src_ip", "dst_ip", "src_port", "dst_port")
        return Fields(*[F.col(n) for n in names], raw=raw)

    def lit(self, value: int, width: int) -> Column:
        return F.lit(value.to_bytes(width, "big")) if self.raw else F.lit(value)


def predicate(rule, fields: Fields) -> Column | None:
    """Conjunction of a rule's conditions, cheapest first; None when the rule constrains nothing."""
    parts = []
    if rule.ip_proto is not None:
        parts.append(fields.proto == fields.lit(rule.ip_proto, 1))
    for column, low, high, length in ((fields.src, rule.src_lo, rule.src_hi, rule.src_len),
                                      (fields.dst, rule.dst_lo, rule.dst_hi, rule.dst_len)):
        if low is None or length == 0:
            continue
        first, last = fields.lit(low, 4), fields.lit(high, 4)
        parts.append(column == first if low == high else (column >= first) & (column <= last))
    if rule.src_port is not None:
        parts.append(fields.sport == fields.lit(rule.src_port, 2))
    if rule.dst_port is not None:
        parts.append(fields.dport == fields.lit(rule.dst_port, 2))
    if getattr(rule, "from_ns", None) is not None:
        parts.append(F.col("ts_ns") >= rule.from_ns)
    if getattr(rule, "to_ns", None) is not None:
        parts.append(F.col("ts_ns") < rule.to_ns)
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def usable(rules: DataFrame) -> DataFrame:
    """Rules that can match something, with only the columns matching reads."""
    keep = [c for c in (*_COMPILED, *_VALID, "_r") if c in rules.columns]
    return rules.filter("NOT never_matches").select(*keep)


def inline_bound(packets: DataFrame) -> int:
    return INLINE_RULES["raw" if Fields.of(packets).raw else "int"]


def few_rules(rules: DataFrame, bound: int) -> list | None:
    """The rules as driver rows when there are at most ``bound``, otherwise None; never reads more than that."""
    rows = usable(rules).limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def match(packets: DataFrame, rules: DataFrame, plan: str = "auto", **options) -> DataFrame:
    """Inner multi-match join: the columns of ``packets`` plus ``filter_id``.

    ``packets`` is a decoded table or stream, ``rules`` a compiled table.  With ``from_ns`` / ``to_ns`` columns in
    ``rules`` a rule applies only to frames in ``[from_ns, to_ns)``.  Duplicate rules keep separate numbers and rows.
    """
    if plan not in ("auto", "inline", "keyed"):
        raise ValueError(f"unknown plan {plan!r}")
    if plan != "keyed":
        rows = few_rules(rules, bound=inline_bound(packets) if plan == "auto" else 1000)
        if rows is not None:
            return match_inline(packets, rows)
        if plan == "inline":
            raise ValueError("too many rules for literal predicates")
    return match_keyed(packets, rules, **options)


def match_inline(packets: DataFrame, rows: list) -> DataFrame:
    """One literal predicate per rule; unmatched frames produce nothing.

    On a stored integer table the union of the predicates is also applied as a filter, which the Parquet reader uses to
    skip data.  On raw frames there is nothing to skip, and a filter would only decode every frame twice.
    """
    fields = Fields.of(packets)
    decodable, hits = F.col("match_ok"), []
    for rule in rows:
        condition = predicate(rule, fields)
        full = decodable if condition is None else decodable & condition
        hits.append(F.when(full, F.lit(rule.rule_id).cast("bigint")))
    if not hits:
        return packets.withColumn("filter_id", F.lit(None).cast("bigint")).filter(F.lit(False))
    wanted = packets if fields.raw else packets.filter(any_predicate(rows, fields))
    found = wanted.select("*", F.explode(F.array(*hits)).alias("filter_id"))
    return found.filter("filter_id IS NOT NULL")


def any_predicate(rows: list, fields: Fields) -> Column:
    """Decodable and matched by at least one of ``rows``."""
    out = None
    for rule in rows:
        condition = predicate(rule, fields)
        if condition is None:
            return F.col("match_ok")
        out = condition if out is None else out | condition
    return F.col("match_ok") & (F.lit(False) if out is None else out)


def mask_column(rows: list, fields: Fields) -> Column:
    """Bit i set where rule i of ``rows`` (at most 62) matches; 0 for frames that are not decodable."""
    bits = []
    for i, rule in enumerate(rows):
        condition = predicate(rule, fields)
        bit = F.lit(1 << i).cast("bigint")
        bits.append(bit if condition is None else F.when(condition, bit).otherwise(F.lit(0).cast("bigint")))
    total = F.lit(0).cast("bigint")
    for bit in bits:
        total = total.bitwiseOR(bit)
    return F.when(F.col("match_ok"), total).otherwise(F.lit(0).cast("bigint"))


def with_mask(packets: DataFrame, rows: list) -> DataFrame:
    """Frames that match at least one of ``rows``, with the set of matching rules as ``_mask``."""
    fields = Fields.of(packets)
    if not fields.raw:
        return packets.filter(any_predicate(rows, fields)).withColumn("_mask", mask_column(rows, fields))
    masked = packets.withColumn("_bits", mask_column(rows, fields))
    hit = F.when(F.col("_bits") != 0, F.col("_bits"))
    # as in match_inline, a plain filter would be pushed below the decoding and repeat it
    return masked.select("*", F.explode(F.array(hit)).alias("_mask")).filter("_mask IS NOT NULL").drop("_bits")


def rules_of_mask(rows: list, mask: Column) -> Column:
    """Array of rule numbers, NULL where a bit is not set; explode and drop the NULLs."""
    return F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(rule.rule_id).cast("bigint"))
        for i, rule in enumerate(rows)
    ])


# ---- keyed plan -----------------------------------------------------------------------------------------------------

_KEY = ("_kp", "_ks", "_kd", "_ksp", "_kdp")
_ABSENT = -1


def shape_code() -> Column:
    """Which fields a rule constrains, as a small integer: at most 2 * 33 * 33 * 2 * 2 different values."""
    return (
        F.col("ip_proto").isNotNull().cast("int")
        + F.coalesce(F.col("src_len"), F.lit(0)) * F.lit(2)
        + F.coalesce(F.col("dst_len"), F.lit(0)) * F.lit(2 << 6)
        + F.col("src_port").isNotNull().cast("int") * F.lit(2 << 12)
        + F.col("dst_port").isNotNull().cast("int") * F.lit(2 << 13)
    )


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules with their shape and the exact field values a frame masked by that shape must have."""
    def or_absent(column: Column) -> Column:
        return F.coalesce(column.cast("bigint"), F.lit(_ABSENT).cast("bigint"))

    constrained = {side: F.coalesce(F.col(f"{side}_len"), F.lit(0)) > 0 for side in ("src", "dst")}
    return usable(rules).select(
        *[F.col(c) for c in ("_r",) if c in rules.columns],
        shape_code().alias("_shape"),
        or_absent(F.col("ip_proto")).alias("_kp"),
        or_absent(F.when(constrained["src"], F.col("src_lo"))).alias("_ks"),
        or_absent(F.when(constrained["dst"], F.col("dst_lo"))).alias("_kd"),
        or_absent(F.col("src_port")).alias("_ksp"),
        or_absent(F.col("dst_port")).alias("_kdp"),
    )


def network(address: Column, length: int) -> Column:
    """An address with the host bits under a prefix length cleared."""
    return address - F.pmod(address, F.lit(1 << (32 - length)).cast("bigint"))


def frame_keys(shape: int) -> dict[str, Column]:
    """A frame's fields masked by one shape; fields the shape leaves open are missing."""
    src_len, dst_len = (shape >> 1) & 63, (shape >> 7) & 63
    out = {}
    if shape & 1:
        out["_kp"] = F.col("ip_proto").cast("bigint")
    if src_len:
        out["_ks"] = network(F.col("src_ip"), src_len)
    if dst_len:
        out["_kd"] = network(F.col("dst_ip"), dst_len)
    if shape >> 13 & 1:
        out["_ksp"] = F.col("src_port").cast("bigint")
    if shape >> 14 & 1:
        out["_kdp"] = F.col("dst_port").cast("bigint")
    return out


def shapes_literal(shapes: list[int]) -> Column:
    """All shapes as one array literal, so that a plan does not grow with their number."""
    return F.expr("array(" + ",".join(map(str, shapes)) + ")")


def masked_fields() -> dict[str, Column]:
    """A frame's fields masked by the shape in its column ``_shape``; one expression for all shapes."""
    shape, absent = F.col("_shape"), F.lit(_ABSENT).cast("bigint")

    def bit(place: int) -> Column:
        return F.shiftright(shape, place).bitwiseAND(F.lit(1)) == 1

    def net(address: str, place: int) -> Column:
        return mk.network(address, F.shiftright(shape, place).bitwiseAND(F.lit(63)))

    return {
        "_kp": F.when(bit(0), F.col("ip_proto").cast("bigint")).otherwise(absent),
        "_ks": net("src_ip", 1),
        "_kd": net("dst_ip", 7),
        "_ksp": F.when(bit(13), F.col("src_port").cast("bigint")).otherwise(absent),
        "_kdp": F.when(bit(14), F.col("dst_port").cast("bigint")).otherwise(absent),
    }


def tried(frames: DataFrame, shapes: list[int], marks: Marks | None = None) -> DataFrame:
    """``frames`` once for each shape, as ``_shape``, or with ``marks`` only for shapes that their addresses leave open;
    frames that are not decodable are gone."""
    if marks is None:
        return frames.select("*", F.explode(F.when(F.col("match_ok"), shapes_literal(shapes))).alias("_shape"))
    return mk.live_shapes(_live(frames, marks), shapes, marks.pairs)


def _live(frames: DataFrame, marks: Marks) -> DataFrame:
    for side in marks.sides:
        frames = mk.with_live(frames, side)
    return frames


@dataclass(frozen=True)
class Marks:
    """What tells the shapes that a frame's addresses leave open."""

    sides: list[mk.Side]
    pairs: mk.Pairs | None


def marks_of(keyed: DataFrame, shapes: list[int]) -> Marks:
    """The markers of both sides, and the pairs, of rules of these shapes (``keyed``: from ``rule_keys``)."""
    sides = [mk.side_of(keyed, shapes, name) for name in mk.SIDES]
    # where all rules leave one side open, and shapes differ in their length only, markers tell as much as pairs
    lone = any(s.table is None for s in sides) and all(s.exact for s in sides) and len(shapes) == len(
        {s & (63 << 1 | 63 << 7) for s in shapes})
    return Marks(sides, None if lone else mk.pairs_of(keyed))


def shapes_of(rules: DataFrame) -> dict[int, int]:
    """Rule count per shape.  One small aggregate; the number of rows is bounded by the number of possible shapes."""
    return {r["_shape"]: r["count"] for r in rule_keys(rules).groupBy("_shape").count().collect()}


def match_keyed(packets: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES,
                salts: int | None = None, tried_shapes: int = TRIED_SHAPES) -> DataFrame:
    """Equality join on a hash of (shape, masked fields, cell of time), checked exactly afterwards; see the module text.

    ``salts`` is over how many tasks a hot key of a heavy shape is spread: by default as many as the session has cores,
    32 at least.  Beyond ``tried_shapes`` shapes, and for all heavy ones, frames are tried by markers.
    """
    salts = salts or max(SALTS, packets.sparkSession.sparkContext.defaultParallelism)
    timed = "from_ns" in rules.columns
    rules = stage(usable(rules), "rules")  # they are read several times; what computed them runs once
    table = stage(_rule_table(rules, timed), "rule-table")
    # bounded by the number of shapes and of cell sizes
    counted = table.groupBy("_rule_shape", *(["_size"] if timed else [])).agg(F.sum(F.size("_ids")).alias("rules")).collect()
    counts: dict[int, int] = {}
    for row in counted:
        counts[row["_rule_shape"]] = counts.get(row["_rule_shape"], 0) + row["rules"]
    sizes = sorted({row["_size"] for row in counted}) if timed else []
    groups = light_groups(counts, broadcast_rules, 1 if packets.isStreaming else BROADCASTS)
    light = [s for group in groups for s in group]
    heavy = [s for s in counts if s not in set(light)]
    names = packets.columns
    # raw frames are not filtered here: the filter would be pushed below and decode every frame twice
    valid = packets if Fields.of(packets).raw else packets.filter("match_ok")
    marks = None
    if heavy or len(light) > tried_shapes:
        marks = marks_of(rule_keys(rules), list(counts))

    def looked_up(frames: DataFrame, shapes: list[int], marked: bool) -> DataFrame:
        return with_key(tried(frames, shapes, marks if marked else None))

    def with_key(found: DataFrame) -> DataFrame:
        key = [F.col("_shape"), *masked_fields().values()]
        if timed:
            found = found.withColumn("_size", F.explode(mk.numbers(sizes)))
            key += [F.col("_size"), mk.cell_of(F.col("_size"))]
        return found.withColumn("_key", F.xxhash64(*key)).drop("_size")

    def of_shapes(shapes: list[int]) -> DataFrame:
        return table.filter(F.array_contains(shapes_literal(shapes), F.col("_rule_shape"))).select(
            "_key", "_rule_shape", "_r", "_ids")

    def exact(joined: DataFrame) -> DataFrame:
        """Hashes may collide: the rule must be of the shape that was tried, and must match."""
        same = (F.col("_shape") == F.col("_rule_shape")) & _satisfied(timed)
        found = joined.filter(same).select(*names, F.explode("_ids").alias("_id"))
        return found.select(*names, F.col("_id.rule_id").alias("filter_id"))

    parts = []
    for group in groups:
        marked = len(light) > tried_shapes
        parts.append(exact(looked_up(valid, group, marked).join(F.broadcast(of_shapes(group)), "_key")))
    if heavy:
        # what tells frames of one flow apart, and is the same when a task runs again; also on streams
        content = [c for c in ("ts_ns", "capture_id", "n_bytes") if c in names]
        spread = valid.withColumn("_mix", F.xxhash64(*content) if content else F.lit(0).cast("bigint"))
        side, few = of_shapes(heavy), None
        if content and not packets.isStreaming:
            few = valid.filter(F.pmod(F.xxhash64(F.lit(1), *content), F.lit(HOT_ONE_IN)) == 0)

        def by_key(found: DataFrame, side: DataFrame, hot: list[int] | None) -> DataFrame:
            if len(heavy) > tried_shapes:
                found = mk.with_known(found, mk.known_keys(side))
            salt, every = F.pmod("_mix", F.lit(salts)).cast("int"), F.array(*[F.lit(i) for i in range(salts)])
            if hot is not None:
                is_hot = F.col("_key").isin(hot)
                salt, every = F.when(is_hot, salt).otherwise(F.lit(0)), F.when(is_hot, every).otherwise(F.array(F.lit(0)))
            side = side.withColumn("_salt", F.explode(every))
            return found.withColumn("_salt", salt).join(side.hint("shuffle_hash"), ["_key", "_salt"])

        keys, hot, routes = 0, None, None
        if few is not None:
            keys, hot = _hot_keys(looked_up(few, heavy, True).join(side.select("_key").distinct(), "_key", "left_semi"))
            if keys and len(heavy) > len(mk.ROUTES):
                routes = _routes(_live(few, marks), heavy, side, keys, salts)
        if routes is None or not _partitioned_by_route(packets.sparkSession):
            parts.append(exact(by_key(looked_up(spread, heavy, True), side, hot)))
        else:
            going = mk.routed(_live(spread, marks), heavy, routes.names)
            side = side.withColumn("_route", mk.route_of_rule(routes.names))
            crowded = F.col("_route").isin(routes.crowded)
            if routes.crowded:
                found = with_key(mk.live_shapes(going.filter(crowded).drop("_route"), heavy, marks.pairs))
                parts.append(exact(by_key(found, side.filter(crowded).drop("_route"), hot)))
                going, side = going.filter(~crowded), side.filter(~crowded)
            salt = F.pmod("_mix", routes.salts(F.col("_route"))).cast("int")
            going = going.withColumn("_salt", salt).drop("_mix").repartition("_route", "_salt")
            every = F.sequence(F.lit(0), routes.salts(F.col("_route")) - 1)
            side = side.withColumn("_salt", F.explode(every)).repartition("_route", "_salt")
            found = with_key(mk.live_shapes(going, heavy, marks.pairs))
            parts.append(exact(found.join(side.hint("shuffle_hash"), ["_route", "_salt", "_key"])))
    if not parts:
        return packets.withColumn("filter_id", F.lit(None).cast("bigint")).filter(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def light_groups(counts: dict[int, int], most: int, groups: int) -> list[list[int]]:
    """Shapes (with their rule counts) in at most ``groups`` groups of at most ``most`` rules, small shapes first; shapes
    that are in no group are heavy."""
    out, room = [], 0
    for shape, count in sorted(counts.items(), key=lambda item: item[1]):
        if count > most:
            break
        if count > room or not out:
            if len(out) == groups:
                break
            out.append([])
            room = most
        out[-1].append(shape)
        room -= count
    return out


def _partitioned_by_route(spark: SparkSession) -> bool:
    """Have joins use tables that are both partitioned by some of the columns they are joined by, as they are.  The setting
    holds for the session, as plans are made when results are asked for; where it was given otherwise it stays."""
    if spark.conf.get(CO_PARTITION, None) is None:
        spark.conf.set(CO_PARTITION, "false")
    return spark.conf.get(CO_PARTITION) == "false"


def _hot_keys(looked_up: DataFrame) -> tuple[int, list[int] | None]:
    """How many rows these are, and the keys that many of them have, at most ``HOT_KEYS``; None if the rows are too few to
    tell.  They decide only how rows are spread, not which."""
    counted = stage(looked_up.groupBy("_key").count(), "key-counts")
    rows = counted.orderBy(F.desc("count")).limit(HOT_KEYS).collect()
    if not rows:
        return 0, None
    total = counted.agg(F.sum("count")).first()[0]
    return total, [r["_key"] for r in rows if r["count"] >= HOT_FRAMES] or [rows[0]["_key"]]


@dataclass(frozen=True)
class Routes:
    """The sides whose networks frames and rules go by, routes of too many rules, and the hot routes by the number of tasks
    that each is spread over."""

    names: tuple[str, ...]
    crowded: list[int]
    hot: dict[int, list[int]]

    def salts(self, route: Column) -> Column:
        out = F.lit(1)
        for number, some in self.hot.items():
            out = F.when(route.isin(some), F.lit(number)).otherwise(out)
        return out


def _routes(few: DataFrame, shapes: list[int], side: DataFrame, keys: int, salts: int) -> Routes | None:
    """How a sample of frames with live lengths, which has ``keys`` rows by key, and rules best go by routes; None if rows
    are not fewer that way."""
    found = []
    for names in (("src",), ("dst",), ("src", "dst")):
        counted = side.groupBy(mk.route_of_rule(names).alias("_route")).agg(F.sum(F.size("_ids")).alias("rules"))
        crowded = counted.filter(F.col("rules") > ROUTE_RULES).collect()  # bounded by the rules over that bound
        found.append((sum(r["rules"] for r in crowded), len(found), names, [r["_route"] for r in crowded]))
        if not crowded:
            break
    _, _, names, crowded = min(found)
    going = mk.routed(few, shapes, names).filter(~F.col("_route").isin(crowded))
    counted = stage(going.groupBy("_route").count(), "route-counts")
    total = counted.agg(F.sum("count")).first()[0]
    if total is None or keys <= ROUTE_GAIN * total:
        return None
    part, hot = max(HOT_FRAMES, total // (4 * salts)), {}
    for row in counted.orderBy(F.desc("count")).limit(HOT_KEYS).collect():
        number = min(salts, 1 << ((row["count"] - 1) // part).bit_length())
        if number > 1:
            hot.setdefault(number, []).append(row["_route"])
    return Routes(names, crowded, hot)


def _rule_table(rules: DataFrame, timed: bool) -> DataFrame:
    """What a lookup returns: rules that differ in their number only as one struct ``_r`` and the list ``_ids`` of their
    numbers, under the hash of their shape, key and cells of time.

    Rules with a validity are one by one, and filed by cells only where more than ``CROWDED`` share a key.
    """
    body = [c for c in (*_COMPILED, *_VALID) if c in rules.columns and c not in ("never_matches", "rule_id")]
    one = F.struct("rule_id")
    if not timed:
        lists = 1 + rules.count() // LIST_RULES
        keys = rule_keys(rules.withColumn("_r", F.struct(F.struct(*body).alias("body"), one.alias("id"))))
        return keys.select(F.xxhash64("_shape", *_KEY).alias("_key"), F.col("_shape").alias("_rule_shape"),
                           F.col("_r.body").alias("_r"), F.col("_r.id").alias("_id"),
                           F.pmod(F.xxhash64("_r.id.rule_id"), F.lit(lists)).alias("_list")).groupBy(
            "_key", "_rule_shape", "_r", "_list").agg(F.collect_list("_id").alias("_ids")).drop("_list")
    keys = rule_keys(rules.withColumn("_r", F.struct("rule_id", *body))).withColumn("_of", F.xxhash64("_shape", *_KEY))
    crowded = stage(keys.groupBy("_of").count().filter(F.col("count") > CROWDED).select(
        "_of", F.lit(True).alias("_crowded")), "crowded-keys")
    few = crowded.limit(mk.MOST_MARKERS + 1).count()
    if few:
        keys = keys.join(F.broadcast(crowded) if few <= mk.MOST_MARKERS else crowded, "_of", "left")
    else:
        keys = keys.withColumn("_crowded", F.lit(None).cast("boolean"))
    celled = mk.with_cells(keys.withColumns({c: F.col(f"_r.{c}") for c in _VALID}), F.col("_crowded"))
    return celled.select(F.xxhash64("_shape", *_KEY, "_size", "_cell").alias("_key"),
                         F.col("_shape").alias("_rule_shape"), "_r", F.array(F.struct("_r.rule_id")).alias("_ids"), "_size")


def _satisfied(timed: bool) -> Column:
    """The rule ``_r`` matches the frame it was found for."""
    out = F.lit(True)
    for frame, low, high in (("ip_proto", "ip_proto", "ip_proto"), ("src_ip", "src_lo", "src_hi"),
                             ("dst_ip", "dst_lo", "dst_hi"), ("src_port", "src_port", "src_port"),
                             ("dst_port", "dst_port", "dst_port")):
        first, last = F.col(f"_r.{low}"), F.col(f"_r.{high}")
        out = out & (first.isNull() | F.col(frame).between(first, last))
    if timed:
        since, until = F.col("_r.from_ns"), F.col("_r.to_ns")
        out = out & (since.isNull() | (F.col("ts_ns") >= since)) & (until.isNull() | (F.col("ts_ns") < until))
    return out
