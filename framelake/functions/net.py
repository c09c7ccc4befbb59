"""IPv4 text, CIDR ranges and protocol names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names accepted in rules and their IP protocol numbers.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17}

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/0*([0-9]|[12][0-9]|3[0-2]))?$"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_PREFIX6 = r"(?:/0*(?:[0-9]|[1-9][0-9]|1[01][0-9]|12[0-8]))?"
# Eight groups, or at most seven around one "::".
_IPV6 = (
    rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?=(?:[^:]*:){{2,8}}[^:]*$)(?!.*::.*::)(?!:[^:])(?!.*[^:]:(?:/|$))"
    rf"(?:{_GROUP})?(?::{_GROUP})*::(?:{_GROUP})?(?::{_GROUP})*){_PREFIX6}$"
)


# IPv4 inside IPv6 text: an address that stands for an IPv4 one, in dotted or in hexadecimal form, and dotted tails.
_MAPPED = r"(?i)^(?:::|(?:0{1,4}:){5})ffff:"
_DOTTED_TAIL = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_SUFFIX = r"(/0*(?:9[6-9]|1[01][0-9]|12[0-8]))?$"


def ip_text(ip: Column) -> Column:
    """Dotted text of an IPv4 address held as an integer."""
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def is_any(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(_IPV4), F.lit(False))


def is_ipv6(text: Column) -> Column:
    plain = F.regexp_replace(text, rf":{_DOTTED_TAIL}(?=/|$)", ":0:0")
    return F.coalesce(text.contains(":") & plain.rlike(_IPV6), F.lit(False))


def mapped_as_ipv4(text: Column) -> Column:
    """IPv4-mapped IPv6 text (``::ffff:10.1.2.3``, ``::ffff:a01:203``, ``/104`` and the like) as IPv4 text; other text as it is."""
    tail = F.regexp_replace(text, _MAPPED, "")
    dotted, hexed = rf"^({_DOTTED_TAIL}){_SUFFIX}", rf"^({_GROUP}):({_GROUP}){_SUFFIX}"
    number = (F.conv(F.regexp_extract(tail, hexed, 1), 16, 10).try_cast("bigint") * F.lit(65536)
              + F.conv(F.regexp_extract(tail, hexed, 2), 16, 10).try_cast("bigint"))
    bits = F.regexp_extract(tail, r"/0*([0-9]+)$", 1).try_cast("int")
    length = F.when(bits.isNotNull(), F.concat(F.lit("/"), (bits - 96).cast("string"))).otherwise("")
    mapped = text.rlike(_MAPPED)
    return (F.when(mapped & tail.rlike(dotted), F.concat(F.regexp_extract(tail, dotted, 1), length))
            .when(mapped & tail.rlike(hexed), F.concat(ip_text(number), length)).otherwise(text))


def range_size(length: Column) -> Column:
    """Number of addresses under a prefix length."""
    return F.pow(F.lit(2), F.lit(32) - length).cast("bigint")


def ipv4_range(text: Column) -> tuple[Column, Column]:
    """(first address, prefix length) of valid IPv4 text; host bits are cleared, a bare address is a /32."""
    octets = [F.regexp_extract(text, _IPV4, i).try_cast("bigint") for i in range(1, 5)]
    length = F.coalesce(F.regexp_extract(text, _IPV4, 5).try_cast("int"), F.lit(32))
    address = octets[0] * F.lit(1 << 24) + octets[1] * F.lit(1 << 16) + octets[2] * F.lit(1 << 8) + octets[3]
    return address - F.pmod(address, range_size(length)), length


def protocol_number(name: Column) -> Column:
    """Number of a protocol name; NULL for the empty name (any) and for unknown names."""
    out = F.lit(None).cast("int")
    for text, number in PROTOCOL_NUMBERS.items():
        out = F.when(name == text, F.lit(number)).otherwise(out)
    return out
