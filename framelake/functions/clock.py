"""Nanosecond clocks: conversions and recovery of truncated timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: only the low 48 bits of a nanosecond timestamp survive in a dump record.
TS_BITS = 48
TS_SPAN = 1 << TS_BITS


def ns_from_parts(seconds: Column, nanos: Column) -> Column:
    return seconds.cast("bigint") * F.lit(1_000_000_000) + nanos.cast("bigint")


def ns_from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def timestamp_from_ns(ts_ns: Column) -> Column:
    """Spark timestamp (microseconds); sub-microsecond digits stay only in ``ts_ns``."""
    return F.timestamp_micros(floor_div(ts_ns, 1000))


def floor_div(value: Column, by: int) -> Column:
    """Integer division rounding down; ``/`` would pass through double and lose digits."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def interval_of(ts_ns: Column, interval_ns: int) -> Column:
    """Number of the tumbling interval a nanosecond timestamp falls in."""
    return floor_div(ts_ns, interval_ns)


def low_bits(ts_ns: Column) -> Column:
    return ts_ns.bitwiseAND(F.lit(TS_SPAN - 1))


def recover_ns(ts48: Column, hint_ns: Column) -> Column:
    """The one timestamp with these low bits that is at most 2^48 ns (3.258 days) before ``hint_ns``."""
    return hint_ns - F.pmod(hint_ns - ts48, F.lit(TS_SPAN))
