"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import stage


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b: bigint): the vertices of a component share its number.

    Each round sends every vertex to the smallest vertex beside it and merges what met there; as vertex numbers are
    hashes, a round removes a fair share of the vertices, and the number of rounds follows the logarithm of the largest
    component.  Rounds are written to the shared folder; only counts come to the driver.
    """
    edges = stage(links.filter("a <> b").select("a", "b").distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "v"), "near")
        steps.append(near)
        left = edges.join(near.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
        right = left.join(near.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = stage(right.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                      .distinct(), "links")
    if not steps:
        return links.sparkSession.createDataFrame([], "v bigint, component bigint")
    out = steps[0].select("v", F.col("to").alias("component"))
    for near in steps[1:]:
        out = out.join(near.select(F.col("v").alias("component"), "to"), "component", "left").select(
            "v", F.coalesce("to", "component").alias("component"))
    return out
