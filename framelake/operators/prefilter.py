"""Union pre-filter: keep a frame once if any rule matches; no rules keep everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import markers as mk
from framelake.operators import match as m
from framelake.session import stage


def _flagged(packets: DataFrame, rules: DataFrame, broadcast_rules: int) -> DataFrame:
    """``packets`` with ``_kept``: one lookup per shape against its distinct keys, so no row is multiplied.

    A left join keeps the frame side splittable by the adaptive skew handling where keys are too many to broadcast.
    """
    counts = m.shapes_of(rules)
    keyed = m.rule_keys(rules)
    out, flags, room = packets, [], broadcast_rules
    for i, shape in enumerate(sorted(counts, key=lambda s: (counts[s], s))):
        mine = m.frame_keys(shape)
        if not mine:  # a rule without conditions
            flags.append(F.col("match_ok"))
            continue
        keys = keyed.filter(F.col("_shape") == shape).select(
            *[F.col(k).alias(f"_q{i}{k}") for k in mine], F.lit(True).alias(f"_hit{i}")).distinct()
        if counts[shape] <= room:  # one bound for all shapes together
            keys = F.broadcast(keys)
            room -= counts[shape]
        on = F.lit(True)
        for name, value in mine.items():
            on = on & (value == F.col(f"_q{i}{name}"))
        out = out.join(keys, on & F.col("match_ok"), "left").drop(*[f"_q{i}{k}" for k in mine])
        flags.append(F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    kept = F.lit(False)
    for flag in flags:
        kept = kept | flag
    return out.select(*packets.columns, kept.alias("_kept"))


_TUPLE = ("ip_proto", "src_ip", "dst_ip", "src_port", "dst_port")


def _wide_first(counts: dict[int, int], most: int) -> list[list[int]]:
    """Shapes (with their key counts) in at most ``m.BROADCASTS`` groups of at most ``most`` keys, those of the shortest
    prefixes first; shapes that are in no group are shuffled."""
    out, room = [], 0
    for shape in sorted((s for s in counts if counts[s] <= most), key=lambda s: ((s >> 1 & 63) + (s >> 7 & 63), s)):
        # few shapes first: what the widest rules want is not tried against all others
        if counts[shape] > room or not out or (len(out) == 1 and len(out[0]) == m.TRIED_SHAPES):
            if len(out) == m.BROADCASTS:
                break
            out.append([])
            room = most
        out[-1].append(shape)
        room -= counts[shape]
    return out


def _by_tuples(packets: DataFrame, rules: DataFrame, keep: bool, broadcast_rules: int) -> DataFrame:
    """One semi or anti join of frames with the distinct 5-tuples that some rule wants, however many shapes there are.

    The tuples are combined before they are shuffled and tried against the distinct masked keys of all rules; payloads
    take part in the last join only.  Keys too many to broadcast at once are tried in a few groups of shapes, wide
    networks first, and only tuples that no group wanted are tried further.  What is over then is shuffled, and if it
    has many shapes, only tuples whose key is in a broadcast bit table are.
    """
    keyed = stage(m.rule_keys(rules).distinct(), "rule-keys")
    counts = {r["_shape"]: r["count"] for r in keyed.groupBy("_shape").count().collect()}  # bounded by possible shapes
    shapes = sorted(counts)
    if not shapes:
        return packets.filter(F.lit(False)) if keep else packets
    few = sum(counts.values()) <= broadcast_rules
    many = len(shapes) > m.TRIED_SHAPES
    marks = m.marks_of(keyed, shapes) if many or not few else None
    tuples = packets.filter("match_ok").select(*_TUPLE).distinct().withColumn("match_ok", F.lit(True))
    if many:  # each tuple is tried many times: on all cores, however few bytes the tuples are
        tuples = tuples.repartition(2 * packets.sparkSession.sparkContext.defaultParallelism, *_TUPLE)

    def wanted_by(some: list[int], left: DataFrame, at_once: bool) -> DataFrame:
        mine = keyed if len(some) == len(shapes) else keyed.filter(
            F.array_contains(m.shapes_literal(some), F.col("_shape")))
        found = m.tried(left, some, marks).withColumns(m.masked_fields())
        if not at_once and len(some) > m.TRIED_SHAPES:
            key = F.xxhash64("_shape", *m.masked_fields())
            found = mk.with_known(found.withColumn("_key", key), mk.known_keys(mine.withColumn("_key", key))).drop("_key")
        return found.join(F.broadcast(mine) if at_once else mine, ["_shape", *m.masked_fields()], "left_semi").select(
            *_TUPLE).distinct()

    if few:
        wanted = wanted_by(shapes, tuples, True)
    else:
        groups = _wide_first(counts, broadcast_rules)
        rest = sorted(set(shapes) - {s for group in groups for s in group})
        left, parts = stage(tuples, "tuples") if groups else tuples, []
        for i, group in enumerate(groups):
            parts.append(stage(wanted_by(group, left, True), "wanted"))
            if rest or i + 1 < len(groups):
                left = stage(left.join(parts[-1], list(_TUPLE), "left_anti"), "tuples")
        if rest:
            parts.append(wanted_by(rest, left, False))
        wanted = parts[0]
        for part in parts[1:]:  # no tuple is in two parts
            wanted = wanted.unionByName(part)
    wanted = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in _TUPLE])
    on = F.col("match_ok")
    for c in _TUPLE:
        on = on & (F.col(c) == F.col(f"_w_{c}"))
    return packets.join(wanted, on, "left_semi" if keep else "left_anti")


def _filter_after_decoding(packets: DataFrame, condition: Column) -> DataFrame:
    """Filter where the columns are computed.

    A plain filter would be pushed below the decoding projection, which then runs twice per frame; a predicate over
    bytes is of no use to the reader anyway.
    """
    marked = packets.select("*", F.explode(F.array(F.when(condition, F.lit(True)))).alias("_kept"))
    return marked.filter("_kept IS NOT NULL").drop("_kept")


def _split(packets: DataFrame, rules: DataFrame, keep: bool, broadcast_rules: int) -> DataFrame:
    if rules.isEmpty():
        return packets if keep else packets.filter(F.lit(False))
    rows = m.few_rules(rules, m.inline_bound(packets))
    if rows is not None:
        fields = m.Fields.of(packets)
        hit = m.any_predicate(rows, fields)
        hit = hit if keep else ~F.coalesce(hit, F.lit(False))
        return _filter_after_decoding(packets, hit) if fields.raw else packets.filter(hit)
    if not packets.isStreaming:
        return _by_tuples(packets, rules, keep, broadcast_rules)
    flagged = _flagged(packets, rules, broadcast_rules)
    return flagged.filter("_kept" if keep else "NOT _kept").drop("_kept")


def prefilter(packets: DataFrame, rules: DataFrame, broadcast_rules: int = m.BROADCAST_RULES) -> DataFrame:
    """Frames at least one rule matches, each once; all frames when there are no rules."""
    return _split(packets, rules, True, broadcast_rules)


def rejected(packets: DataFrame, rules: DataFrame, broadcast_rules: int = m.BROADCAST_RULES) -> DataFrame:
    """The complement: frames no rule wants, undecodable ones included."""
    return _split(packets, rules, False, broadcast_rules)
