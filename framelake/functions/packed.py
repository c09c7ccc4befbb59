"""Fixed-width integers inside binary columns, both byte orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(data: Column, offset: int | Column, width: int) -> Column:
    """``width`` bytes from a zero-based ``offset``; shorter or empty beyond the end."""
    if isinstance(offset, int):
        return F.substring(data, offset + 1, width)
    return F.substr(data, offset + F.lit(1), F.lit(width))


def be_uint(data: Column) -> Column:
    """Network-order unsigned integer of up to seven bytes; NULL for no bytes."""
    return F.conv(F.hex(data), 16, 10).try_cast("bigint")


def be_int64(data: Column) -> Column:
    """Eight network-order bytes as a bigint; the top bit becomes the sign."""
    return F.conv(F.hex(data), 16, -10).try_cast("bigint")


def be_hex(value: Column, width: int) -> Column:
    """Hex digits of ``value`` in network order, zero-padded to ``width`` bytes."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
