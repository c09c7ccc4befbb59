"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_CLASS = 1500  #: at most so many labelled rows of each class are fitted on, whatever the data


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None,
           per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``per_class`` rows of either class, chosen by a hash of the id.

    Null ids and labels are left out; an id with several labels counts with the smallest, one with several texts with
    the first in order.  The ids chosen are at most twice ``per_class`` and are broadcast to the documents.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(
        "id IS NOT NULL AND label IN (0, 1)")
    known = known.filter(allowed) if allowed is not None else known
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(
        known.filter("label = 1").orderBy(*order).limit(per_class))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def folded(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
