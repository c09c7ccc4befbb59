"""Rule tables: parsing, validation, numbering, and validity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.net import (
    PROTOCOL_NUMBERS, ipv4_range, is_any, is_ipv4, is_ipv6, mapped_as_ipv4, protocol_number, range_size,
)
from framelake.schemas import RULE_REQUEST
from framelake.session import stage

SPEC_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
# Fixed value: highest port.
MAX_PORT = 65535


def from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse rule requests ``{"filter": {...}}``.

    Text that is no JSON or has a field of the wrong type gives ``malformed = true``; it must not turn into a rule that
    matches everything.  Extra columns of ``lines`` (arrival order, operator name, ...) are kept.
    """
    schema = T.StructType([*RULE_REQUEST.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("_request", parsed)
    malformed = F.col("_request").isNull() | F.col("_request._bad").isNotNull()
    return out.select(
        *[c for c in lines.columns if c != column],
        *[F.col(f"_request.filter.{name}").alias(name) for name in SPEC_FIELDS],
        malformed.alias("malformed"),
    )


def from_flags(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse ``protocol:src_ip:dst_port`` strings; not three parts or a non-numeric port gives ``malformed = true``."""
    parts = F.split(F.col(column), ":", 3)
    port = F.get(parts, F.lit(2))
    malformed = (F.size(parts) != 3) | ((port != "") & ~port.rlike(r"^\d{1,18}$"))
    value = {
        "src_ip": F.get(parts, F.lit(1)),
        "dst_ip": F.lit(None).cast("string"),
        "src_port": F.lit(None).cast("bigint"),
        "dst_port": F.when(port.rlike(r"^\d{1,18}$"), port).try_cast("bigint"),
        "protocol": F.get(parts, F.lit(0)),
    }
    return lines.select(
        *[c for c in lines.columns if c != column],
        *[value[name].alias(name) for name in SPEC_FIELDS],
        F.coalesce(malformed, F.lit(True)).alias("malformed"),
    )


def _address(text):
    """What an address says: whether it is any, IPv4 or IPv6, and an IPv4 network's first address and prefix length."""
    four = is_ipv4(text)
    low, length = ipv4_range(text)
    return F.struct(is_any(text).alias("any"), four.alias("four"), is_ipv6(text).alias("six"),
                    F.when(four, low).alias("low"), F.when(four, length).alias("length"))


def compile_rules(specs: DataFrame) -> DataFrame:
    """Validate specs and turn them into ranges and numbers; one bad spec never fails the load.

    NULL in a compiled column means "any".  ``reason`` is NULL for a usable rule, otherwise it names what is wrong.
    IPv6 addresses are valid but can match no IPv4 frame (``never_matches``).
    """
    port_ok = {side: F.coalesce(F.col(f"{side}_port").between(0, MAX_PORT), F.lit(True)) for side in ("src", "dst")}
    checks = [(~(port_ok["src"] & port_ok["dst"]), "port out of range")]
    if "malformed" in specs.columns:
        checks.insert(0, (F.col("malformed"), "malformed"))
    # both addresses by one function over an array: as plain columns the many patterns make more code than is compiled
    sides = F.transform(F.transform(F.array("src_ip", "dst_ip"), mapped_as_ipv4), _address)
    parsed = {f"_{side}": F.get("_sides", F.lit(i)) for i, side in enumerate(("src", "dst"))}
    for side in ("src", "dst"):
        address = F.col(f"_{side}")
        checks.append((~(address["any"] | address["four"] | address["six"]), f"invalid {side}_ip"))
    checks.append((~(is_any(F.col("protocol")) | F.col("protocol").isin(*PROTOCOL_NUMBERS)), "unknown protocol"))
    reason = F.lit(None).cast("string")
    for broken, text in reversed(checks):
        reason = F.when(broken, F.lit(text)).otherwise(reason)

    out = {}
    for side in ("src", "dst"):
        six, low, length = (F.col(f"_{side}.{x}") for x in ("six", "low", "length"))
        out[f"{side}_lo"] = F.when(six, F.lit(1).cast("bigint")).otherwise(low)
        out[f"{side}_hi"] = F.when(six, F.lit(0).cast("bigint")).otherwise(low + range_size(length) - 1)
        out[f"{side}_len"] = length
    for side in ("src", "dst"):
        port = F.col(f"{side}_port")
        out[f"{side}_port"] = F.when(port_ok[side] & (port != 0), port).cast("int")
    out["ip_proto"] = protocol_number(F.col("protocol"))
    out["never_matches"] = F.col("_src.six") | F.col("_dst.six")
    out["reason"] = reason
    keep = [c for c in specs.columns if c not in (*SPEC_FIELDS, "malformed")]
    return specs.withColumn("_sides", sides).withColumns(parsed).select(*keep, *[c.alias(n) for n, c in out.items()])


def accepted(compiled: DataFrame) -> DataFrame:
    return compiled.filter("reason IS NULL").drop("reason")


def rejected(compiled: DataFrame) -> DataFrame:
    return compiled.filter("reason IS NOT NULL")


def assign_ids(valid: DataFrame, arrival: str, last_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Number accepted rules 1, 2, 3, ... by their distinct integer ``arrival``.

    Rejected specs must be filtered out before, so they use no number.  ``last_id`` is the highest number ever given
    out, also to rules removed since.  Rules are dealt to partitions by ranges of arrival (however they are spaced) and
    written once, numbered within their partition, and moved up by the sizes of the partitions before: one small row
    per partition.
    """
    spark = valid.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = valid.repartitionByRange(parts, arrival).withColumn("_part", F.spark_partition_id())
    held = stage(dealt, "numbering")
    inside = Window.partitionBy("_part").orderBy(arrival)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    moved = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    numbered = held.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(moved), "_part")
    return numbered.withColumn("rule_id", F.col("_row") + F.col("_before") + F.lit(last_id).cast("bigint")).drop(
        "_part", "_row", "_before")


def validity(events: DataFrame) -> DataFrame:
    """``[from_ns, to_ns)`` per rule from add/remove events; ``to_ns`` is NULL while the rule is registered.

    A removal counts only if it comes after the add, in (``at_ns``, ``seq``) order; numbers are never given out twice.
    """
    at = F.struct("at_ns", "seq")
    adds = events.filter("op = 'add'").groupBy("rule_id").agg(F.min(at).alias("_from"))
    removals = events.filter("op = 'remove'").select("rule_id", at.alias("_at"))
    # inner join, so that a rule with very many removals is split by the adaptive skew handling
    ends = removals.join(adds, "rule_id").filter("_at > _from").groupBy("rule_id").agg(F.min("_at").alias("_to"))
    return adds.join(ends, "rule_id", "left").select(
        "rule_id", F.col("_from.at_ns").alias("from_ns"), F.col("_to.at_ns").alias("to_ns")
    )


def active_at(events: DataFrame, at_ns: int) -> DataFrame:
    """Rules registered at a moment: numbers whose latest effective operation is an add."""
    return validity(events.filter(F.col("at_ns") <= at_ns)).filter("to_ns IS NULL").select("rule_id", "from_ns")


def listing(events: DataFrame, specs: DataFrame, at_ns: int) -> DataFrame:
    """Registered rules with the specs they were added with (``specs``: rule_id and the spec fields)."""
    return active_at(events, at_ns).join(specs.select("rule_id", *SPEC_FIELDS), "rule_id")
