"""Ordered computations that never put a whole key into one task.

A plain window over ``PARTITION BY key ORDER BY t`` sends every row of a key to one task, however long its history.
Here the order column is cut into blocks of fixed width: rows are processed per (key, block), and only one summary row
per block travels through the per-key window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.clock import floor_div


def _keyed(keys: list[str]) -> list:
    return [F.col(k) for k in keys]


def _rejoin(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Join block summaries back; NULL keys are equal to each other here."""
    right = summary.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_rblk"),
                           *[c for c in summary.columns if c not in (*keys, "_blk")])
    on = df["_blk"] == right["_rblk"]
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(right[f"_r{i}"])
    return df.join(right, on, "left").drop("_rblk", *[f"_r{i}" for i in range(len(keys))])


def sketch_union(column: str, window=None):
    """Union of sketches, NULL for none; the built-in would give an empty sketch of default precision."""
    present, union = F.count(column), F.hll_union_agg(column)
    if window is not None:
        present, union = present.over(window), union.over(window)
    return F.when(present > 0, union)


def running(df: DataFrame, keys: list[str], order: str, block: int, sums: dict[str, str] | None = None,
            sketches: dict[str, str] | None = None, following: str | None = None) -> DataFrame:
    """Running totals (``sums``: input -> output) and running sketch unions per key, in ``order``.

    ``order`` must be an integer that is unique within a key.  ``following`` names a column for the key's next value of
    ``order`` (NULL for its last row).
    """
    sums, sketches = sums or {}, sketches or {}
    blocked = df.withColumn("_blk", floor_div(F.col(order), block))
    totals = blocked.groupBy(*keys, "_blk").agg(
        *[F.sum(c).alias(f"_t_{o}") for c, o in sums.items()],
        *[sketch_union(c).alias(f"_t_{o}") for c, o in sketches.items()],
        *([F.min(order).alias("_first")] if following else []),
    )
    chain = Window.partitionBy(*_keyed(keys)).orderBy("_blk")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    # what comes before and after a block enters it as a row ahead of its own, so nothing is joined after the window
    carried = totals.select(
        *keys, "_blk", F.lit(0).alias("_own"),
        *[F.sum(f"_t_{o}").over(before).alias(f"_i_{o}") for o in sums.values()],
        *[sketch_union(f"_t_{o}", before).alias(f"_i_{o}") for o in sketches.values()],
        *([F.lead("_first").over(chain).alias("_behind")] if following else []),
    )
    inputs = sums | sketches
    own = blocked.withColumns({"_own": F.lit(1), **{f"_i_{o}": F.col(c) for c, o in inputs.items()}})
    rows = own.unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*_keyed(keys), "_blk").orderBy("_own", order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {o: F.coalesce(F.sum(f"_i_{o}").over(upto), F.lit(0)) for o in sums.values()}
    out |= {o: sketch_union(f"_i_{o}", upto) for o in sketches.values()}
    if following:
        out[following] = F.coalesce(F.lead(order).over(inside), F.first("_behind").over(upto))
    # a column may be replaced by its own running value
    kept = [F.col(c) for c in df.columns if c not in out]
    return rows.select(*kept, "_own", *[c.alias(o) for o, c in out.items()]).filter("_own = 1").drop("_own")


def carry_forward(df: DataFrame, keys: list[str], order: str, block: int, columns: list[str]) -> DataFrame:
    """Each of ``columns`` where NULL replaced by the key's latest earlier value; same conditions as ``running``."""
    blocked = df.withColumn("_blk", floor_div(F.col(order), block))
    ends = blocked.groupBy(*keys, "_blk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    before = Window.partitionBy(*_keyed(keys)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_blk", F.lit(0).alias("_own"),
                          *[F.last(c, ignorenulls=True).over(before).alias(c) for c in columns])
    rows = blocked.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy(*_keyed(keys), "_blk").orderBy("_own", order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [F.col(c) for c in df.columns if c not in columns]
    latest = [F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns]
    return rows.select(*kept, "_own", *latest).filter("_own = 1").select(*df.columns)


def previous(df: DataFrame, keys: list[str], order: str, block: int, columns: dict[str, str]) -> DataFrame:
    """The value each key had one row earlier (``columns``: input -> output), NULL for a key's first row.

    ``order`` must be an integer that is unique within a key.
    """
    blocked = df.withColumn("_blk", floor_div(F.col(order), block))
    packed = F.struct(*columns)
    last = blocked.groupBy(*keys, "_blk").agg(F.max_by(packed, order).alias("_last"))
    chain = Window.partitionBy(*_keyed(keys)).orderBy("_blk")
    carried = last.select(*keys, "_blk", F.lag("_last").over(chain).alias("_carry"))
    inside = Window.partitionBy(*_keyed(keys), "_blk").orderBy(order)
    local = blocked.withColumn("_prev", F.lag(packed).over(inside))
    joined = _rejoin(local, carried, keys).withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(o) for c, o in columns.items()])


def fill_intervals(df: DataFrame, keys: list[str], order: str, block: int, last: int | None = None) -> DataFrame:
    """Keys x every interval from the key's first to the last one seen by any key (or ``last``).

    Keys that start after ``last`` have no intervals.  The range is expanded in two steps, blocks and then intervals, so that no row ever holds a long array.
    """
    bounds = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    end = F.lit(last).cast("bigint") if last is not None else df.select(F.max(order)).scalar()
    first_blk = floor_div(F.col("_first"), block)
    blocks = bounds.withColumn("_end", end).filter("_first <= _end").withColumn(
        "_blk", F.explode(F.sequence(first_blk, floor_div(F.col("_end"), block))))
    start = F.greatest(F.col("_first"), F.col("_blk") * F.lit(block))
    stop = F.least(F.col("_end"), F.col("_blk") * F.lit(block) + F.lit(block - 1))
    spread = blocks.repartition(*keys, "_blk") if keys else blocks.repartition("_blk")
    return spread.select(*keys, F.explode(F.sequence(start, stop)).alias(order))
