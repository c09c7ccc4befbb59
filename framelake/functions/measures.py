"""Entropy and rate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_terms(count: Column) -> list[Column]:
    """Aggregates over a histogram's counts that ``entropy_bits`` needs; all of them can be combined map-side."""
    return [F.sum(count * F.log2(count)).alias("_clog"), F.max(count).alias("_top")]


def entropy_bits(total: Column) -> Column:
    """Shannon entropy in bits of a histogram with ``total`` observations and the columns of ``entropy_terms``.

    ``log2(n) - sum(c * log2(c)) / n`` needs no second pass over the histogram; an empty one and one with a single
    value give exactly 0.
    """
    bits = F.log2(total.cast("double")) - F.col("_clog") / total
    return F.when(F.col("_top") < total, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0))


def mbps(pps: Column, frame_bytes: Column) -> Column:
    return pps * frame_bytes * F.lit(8) / F.lit(1e6)


def gbps(pps: Column, frame_bytes: Column) -> Column:
    return pps * frame_bytes * F.lit(8) / F.lit(1e9)


def per_second(amount: Column, elapsed_ns: Column) -> Column:
    """Rate of ``amount`` over a span of nanoseconds; NULL when no time passed."""
    return F.when(elapsed_ns > 0, amount * F.lit(1e9) / elapsed_ns)
