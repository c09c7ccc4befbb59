"""What can still match a frame: prefix lengths by address, and cells of time.

Markers.  The networks of all rules on one side are filed under their first 4, 8, ... or 32 bits (a network of 18 bits
under each of the four 20-bit prefixes it covers, so under eight at most), each with a bit set of lengths.  Looking an
address up once for every such size that occurs - at most eight lookups, however many shapes or rules there are - gives
the set of lengths at which some rule's network contains it.  Of the pairs of lengths that are live on both sides, only
those are tried whose two networks some rule names together (``Pairs``, which also tell the other fields it names).

Routes.  Where frames and rules meet in a shuffle, a rule goes by the first 0, 8, 16 or 24 bits of its network, and a
frame by each of those four networks of its address that some live length goes by; it is unfolded by shapes on the other
side of the shuffle, so that what is shuffled does not grow with the rules that a frame matches.

Cells.  A rule that applies in ``[from, to)`` is filed under the cells of time it touches, in cells of 4^k nanoseconds,
at most an eighth and over a thirty-second of its duration: at most 34 of them.  A frame is looked up in one cell
of every size that occurs, and so meets rules that apply within a fraction of their own duration, not all that ever had
the same key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.session import stage

STRIDE = 4
#: Markers of one side that are broadcast; beyond it networks are filed under their first 16 bits only, of which there
#: are at most 65,536.
MOST_MARKERS = 1 << 19
COARSE = 16 // STRIDE
#: The cell size of rules without a beginning or without an end: all time.
ALWAYS = 32

SIDES = {"src": 1, "dst": 7}  #: where a shape's number holds a side's prefix length (six bits)


def bit(mask: Column, place: Column | int) -> Column:
    return F.call_function("shiftright", mask, F.lit(place) if isinstance(place, int) else place).bitwiseAND(
        F.lit(1).cast("bigint")) == 1


def power(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def numbers(values: list[int], kind: str = "int") -> Column:
    """An array literal."""
    return F.expr(f"cast(array({','.join(map(str, values))}) as array<{kind}>)")


@dataclass(frozen=True)
class Side:
    """The markers of one side: a table (level, key, lengths), the levels it has, and lengths that are always live."""

    name: str
    table: DataFrame | None
    levels: tuple[int, ...]
    always: int
    exact: bool = True  #: false where longer networks are filed under their first 16 bits


def side_of(keyed: DataFrame, shapes: list[int], name: str, most: int = MOST_MARKERS) -> Side:
    """The markers of one side of keyed rules (``_shape``, ``_ks``, ``_kd``) of these shapes."""
    lengths = {s >> SIDES[name] & 63 for s in shapes}
    always = 1 if 0 in lengths else 0
    if not lengths - {0}:
        return Side(name, None, (), always)
    length = F.shiftright("_shape", SIDES[name]).bitwiseAND(F.lit(63))
    networks = keyed.select(length.alias("length"), F.col("_ks" if name == "src" else "_kd").alias("low")).filter(
        "length > 0").distinct()

    def filed(level: Column, room: Column) -> DataFrame:
        first = F.call_function("shiftright", F.col("low"), F.lit(32) - level * STRIDE)
        return networks.select(level.alias("level"), F.explode(F.sequence(first, first + power(room) - 1)).alias("key"),
                               power(F.col("length")).alias("bits")).groupBy("level", "key").agg(
            F.bit_or("bits").alias("lengths"))

    exact = F.expr(f"(length + {STRIDE - 1}) div {STRIDE}").cast("int")
    table = stage(filed(exact, exact * STRIDE - F.col("length")), f"markers-{name}")
    counts = {r["level"]: r["count"] for r in table.groupBy("level").count().collect()}  # at most eight rows
    coarse = sum(counts.values()) > most
    if coarse:
        level = F.least(exact, F.lit(COARSE))
        table = stage(filed(level, F.greatest(level * STRIDE - F.col("length"), F.lit(0))), f"markers-{name}")
        counts = dict.fromkeys(range(1, COARSE + 1), 0)
    return Side(name, table, tuple(sorted(counts)), always, not coarse)


def with_live(frames: DataFrame, side: Side) -> DataFrame:
    """``frames`` with ``_live_<side>``, the set of prefix lengths at which some rule may contain the address; frames
    without any are gone before the other side is looked up."""
    live = F.lit(side.always).cast("bigint")
    address = f"{side.name}_ip"
    found = []
    for level in side.levels:
        mark = f"_mark_{side.name}{level}"
        known = side.table.filter(F.col("level") == level).select(F.col("key").alias("_at"), F.col("lengths").alias(mark))
        frames = frames.join(F.broadcast(known), F.shiftright(address, 32 - STRIDE * level) == F.col("_at"), "left").drop("_at")
        live = live.bitwiseOR(F.coalesce(F.col(mark), F.lit(0).cast("bigint")))
        found.append(mark)
    return frames.withColumn(f"_live_{side.name}", live).drop(*found).filter(F.col(f"_live_{side.name}") != 0)


@dataclass(frozen=True)
class Pairs:
    """The pairs of networks that rules name, by hash (``_pair``): with the kinds of their shapes (``_met``) while they
    are few enough to be broadcast, else as a table of known keys."""

    table: DataFrame
    exact: bool


def kind_of(shape: Column) -> Column:
    """What a shape asks besides its lengths: bits for the protocol and for both ports."""
    return shape.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftright(shape, 12).bitwiseAND(F.lit(6)))


def pairs_of(keyed: DataFrame, most: int = MOST_MARKERS) -> Pairs:
    """The pairs of networks of keyed rules (``_shape``, ``_ks``, ``_kd``); hashes that collide let more be tried."""
    lengths = [F.shiftright("_shape", place).bitwiseAND(F.lit(63)) for place in SIDES.values()]
    table = stage(keyed.groupBy(F.xxhash64(*lengths, "_ks", "_kd").alias("_pair")).agg(
        F.bit_or(power(kind_of(F.col("_shape")))).alias("_met")), "pairs")
    if table.limit(most + 1).count() <= most:
        return Pairs(table, True)
    return Pairs(known_keys(table, "_pair"), False)


def network(address: str, length: Column) -> Column:
    """An address with the host bits under a prefix length cleared; -1 where the length is 0."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - length)
    return F.when(length > 0, F.col(address) - F.pmod(F.col(address), size)).otherwise(F.lit(-1).cast("bigint"))


def live_shapes(frames: DataFrame, shapes: list[int], pairs: Pairs | None) -> DataFrame:
    """``frames`` once for each of ``shapes`` whose lengths are live on both sides, and (with ``pairs``) whose two networks
    some rule names together, as ``_shape``.

    Lengths are unfolded on one side and then, of those that go with it, on the other, so that the work follows the
    number of lengths and of live shapes instead of the number of shapes.  Frames that are not decodable are gone.
    """
    beside, kinds = [0] * 33, [0] * (33 * 33)
    for shape in shapes:
        s, d = shape >> 1 & 63, shape >> 7 & 63
        beside[s] |= 1 << d
        kinds[33 * s + d] |= 1 << ((shape & 1) | (shape >> 12 & 6))
    lengths = {name: sorted({shape >> place & 63 for shape in shapes}) for name, place in SIDES.items()}
    found = sorted({(shape & 1) | (shape >> 12 & 6) for shape in shapes})
    one = frames.select("*", F.explode(F.when(F.col("match_ok"), numbers(lengths["src"]))).alias("_sl")).filter(
        bit(F.col("_live_src"), F.col("_sl"))).withColumn("_sn", network("src_ip", F.col("_sl")))
    mates = F.col("_live_dst").bitwiseAND(F.get(numbers(beside, "bigint"), F.col("_sl")))
    two = one.select("*", F.explode(numbers(lengths["dst"])).alias("_dl")).filter(bit(mates, F.col("_dl")))
    mine = F.get(numbers(kinds, "bigint"), F.col("_sl") * 33 + F.col("_dl"))
    two = two.withColumn("_pair", F.xxhash64("_sl", "_dl", "_sn", network("dst_ip", F.col("_dl"))))
    if pairs is None:
        pass
    elif pairs.exact:
        two, mine = two.join(F.broadcast(pairs.table), "_pair"), mine.bitwiseAND(F.col("_met"))
    else:
        two = with_known(two, pairs.table, "_pair")
    three = two.select("*", F.explode(numbers(found)).alias("_kind")).filter(bit(mine, F.col("_kind")))
    kind = F.col("_kind")
    shape = (F.col("_sl") * 2 + F.col("_dl") * (1 << 7) + kind.bitwiseAND(F.lit(1))
             + kind.bitwiseAND(F.lit(6)) * (1 << 12))
    return three.withColumn("_shape", shape.cast("int")).drop(
        "_live_src", "_live_dst", "_sl", "_sn", "_dl", "_pair", "_met", "_kind")


# ---- routes ----------------------------------------------------------------------------------------------------------

#: Lengths of the networks that frames and rules go by; longer networks go by the next shorter of these.
ROUTES = (0, 8, 16, 24)


def _route_length(length: Column) -> Column:
    return F.least(F.shiftright(length, 3) * 8, F.lit(ROUTES[-1]))


def route_of_rule(names: tuple[str, ...]) -> Column:
    """What a rule (``_rule_shape``, ``_r``) goes by, told by its networks on these sides."""
    parts = []
    for name in names:
        length = _route_length(F.shiftright("_rule_shape", SIDES[name]).bitwiseAND(F.lit(63)))
        parts += [length, network(f"_r.{name}_lo", length)]
    return F.xxhash64(*parts)


def routed(frames: DataFrame, shapes: list[int], names: tuple[str, ...]) -> DataFrame:
    """``frames`` with live lengths once for each route, as ``_route``, by which rules of these shapes may match them.

    Only the lengths that go by that route stay live, so that each shape is left open by one route of a frame.  Frames
    that are not decodable are gone.
    """
    parts = []
    for name in names:
        other = next(n for n in SIDES if n != name)
        mine, mates = [0] * len(ROUTES), [0] * len(ROUTES)
        for shape in shapes:
            length = shape >> SIDES[name] & 63
            at = min(length // 8, len(ROUTES) - 1)
            mine[at] |= 1 << length
            mates[at] |= 1 << (shape >> SIDES[other] & 63)
        by = F.col(f"_by_{name}")
        lengths = numbers([8 * i for i, bits in enumerate(mine) if bits])
        frames = frames.select("*", F.explode(F.when(F.col("match_ok"), lengths)).alias(f"_by_{name}"))
        for side, bits in ((name, mine), (other, mates)):
            live = F.col(f"_live_{side}").bitwiseAND(F.get(numbers(bits, "bigint"), F.shiftright(by, 3)))
            frames = frames.withColumn(f"_live_{side}", live)
        frames = frames.filter((F.col("_live_src") != 0) & (F.col("_live_dst") != 0))
        parts += [by, network(f"{name}_ip", by)]
    return frames.withColumn("_route", F.xxhash64(*parts)).drop(*[f"_by_{name}" for name in names])


# ---- keys ------------------------------------------------------------------------------------------------------------

#: Words of 64 bits in a table of known keys, as a power of two at most: so many rows are broadcast.
MOST_WORDS = 21


def _known_bits(key: Column) -> Column:
    """Four bits of a word, told by the low end of a hash; its high end tells the word."""
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = out.bitwiseOR(power(F.call_function("shiftright", key, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")))
    return out


def known_keys(rules: DataFrame, key: str = "_key") -> DataFrame:
    """A Bloom table of the hashes ``key``: rows (word, bits), some 16 bits for each while there are few enough."""
    keys = rules.select(key).distinct()
    size = min(MOST_WORDS, max(4, (keys.count() // 4).bit_length()))
    word = F.shiftrightunsigned(key, 64 - size)
    return stage(keys.groupBy(word.alias("_word")).agg(F.bit_or(_known_bits(F.col(key))).alias("_bits"), F.lit(size).alias(
        "_power")), "known-keys")


def with_known(frames: DataFrame, known: DataFrame, key: str = "_key") -> DataFrame:
    """``frames`` whose ``key`` may be known: all that are, and about one in a hundred others."""
    row = known.select("_power").first()
    if row is None:
        return frames.filter(F.lit(False))
    at = F.shiftrightunsigned(key, 64 - row["_power"])
    mine = frames.withColumn("_mine", _known_bits(F.col(key)))
    met = mine.join(F.broadcast(known.select("_word", "_bits")), at == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(F.col("_mine")) == F.col("_mine")).drop("_word", "_bits", "_mine")


# ---- time ------------------------------------------------------------------------------------------------------------

def with_cells(rules: DataFrame, celled: Column | None = None) -> DataFrame:
    """Timed rules once for each cell of time they touch (``_size``, ``_cell``); rules that never apply are gone.  Where
    ``celled`` is not true, a rule stands once, under all time."""
    alone = F.lit(False) if celled is None else ~F.coalesce(celled, F.lit(False))
    span = F.call_function("try_subtract", F.col("to_ns"), F.col("from_ns"))
    size = F.expr("cast((length(bin(greatest(_span div 8, 1))) - 1) div 2 as int)")
    sized = rules.filter("from_ns IS NULL OR to_ns IS NULL OR from_ns < to_ns").withColumn("_span", span).withColumn(
        "_size", F.when(F.col("_span").isNull() | alone, F.lit(ALWAYS)).otherwise(size))
    place = F.col("_size") * 2
    cells = F.when(F.col("_size") == ALWAYS, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(
        F.call_function("shiftright", F.col("from_ns"), place), F.call_function("shiftright", F.col("to_ns") - 1, place)))
    return sized.withColumn("_cell", F.explode(cells)).drop("_span")


def cell_of(size: Column) -> Column:
    """The cell of a size that a frame lies in."""
    return F.when(size == ALWAYS, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", F.col("ts_ns"), size * 2))
