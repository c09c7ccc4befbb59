"""Packet-capture analytics as Spark plans.

Frames (raw Ethernet bytes) are decoded to IPv4 5-tuples with native column expressions, matched against rule tables,
and summarised per rule and interval.  Every step takes and returns a DataFrame, so steps combine with
``DataFrame.transform`` and work on batch tables and (where stated) on streams.
"""

__version__ = "0.1.0"
