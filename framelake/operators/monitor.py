"""Capture-health reports over counter samples and benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.measures import gbps, per_second
from framelake.operators.blocked import previous

COUNTER_COLUMNS = ("rx_packets", "rx_drops", "tx_packets", "freeze_q_count")
# Fixed value: a run with fewer received packets than this proves nothing about loss.
MIN_RX = 100


def counter_rates(samples: DataFrame, drops_mode: str = "cumulative", block_us: int = 86_400_000_000) -> DataFrame:
    """Increase and rate of each counter since the host's previous sample.

    ``samples``: host, ts (unique per host) and the counters.  ``drops_mode='per_poll'`` takes ``rx_drops`` and
    ``freeze_q_count`` as counts since the previous poll instead of running totals.  A counter that went down was reset
    by a restart and counts from zero.  History is processed in blocks of ``block_us`` microseconds per host.
    """
    if drops_mode not in ("cumulative", "per_poll"):
        raise ValueError(f"unknown drops_mode {drops_mode!r}")
    timed = samples.withColumn("_us", F.unix_micros("ts"))
    seen = previous(timed, ["host"], "_us", block_us, {"_us": "_us0", **{c: f"_{c}0" for c in COUNTER_COLUMNS}})
    elapsed = (F.col("_us") - F.col("_us0")) * F.lit(1000)
    out = [F.col("host"), F.col("ts"), (elapsed / F.lit(1e9)).alias("elapsed_sec")]
    for c in COUNTER_COLUMNS:
        now, before = F.col(c), F.col(f"_{c}0")
        if drops_mode == "per_poll" and c in ("rx_drops", "freeze_q_count"):
            delta = F.when(F.col("_us0").isNotNull(), now)
        else:
            delta = F.when(now >= before, now - before).when(now < before, now)
        out.append(delta.alias(f"{c}_delta"))
        if c in ("rx_packets", "rx_drops", "tx_packets"):
            out.append(per_second(delta, elapsed).alias(f"{c}_per_sec"))
    return seen.select(*out)


def loss_verdict(runs: DataFrame) -> DataFrame:
    """Zero-loss verdict per run from rows of (run, rx_packets, rx_drops, output_lines) increments."""
    totals = runs.groupBy("run").agg(
        F.sum("rx_packets").alias("rx_packets"), F.sum("rx_drops").alias("rx_drops"),
        F.sum("output_lines").alias("output_lines"))
    no_loss, enough, output = F.col("rx_drops") == 0, F.col("rx_packets") >= MIN_RX, F.col("output_lines") >= 1
    return totals.withColumns({"no_loss": no_loss, "enough_traffic": enough, "has_output": output,
                               "passed": no_loss & enough & output})


def breaking_point(steps: DataFrame) -> DataFrame:
    """First offered rate at which drops exceed the run's baseline.

    ``steps``: run, step (order of the ramp), offered_pps (0 = unbounded), actual_pps, rx_drops (running total), and
    baseline_drops.  Runs that never lose frames have NULL break columns.
    """
    lost = F.col("rx_drops") > F.col("baseline_drops")
    at = F.min_by(F.when(lost, F.struct("step", "offered_pps", "actual_pps", "rx_drops")),
                  F.when(lost, F.col("step")))
    found = steps.groupBy("run").agg(
        at.alias("_at"), F.count("*").alias("steps"),
        F.max_by(F.col("actual_pps"), F.when(~lost, F.col("step"))).alias("last_clean_pps"))
    return found.select(
        "run", "steps", F.col("_at").isNull().alias("zero_loss"), F.col("_at.step").alias("break_step"),
        F.when(F.col("_at.offered_pps") == 0, F.lit("unbounded"))
        .otherwise(F.col("_at.offered_pps").cast("string")).alias("break_offered"),
        F.col("_at.actual_pps").alias("break_actual_pps"), F.col("_at.rx_drops").alias("break_drops"),
        "last_clean_pps")


def with_throughput(runs: DataFrame, frame_bytes: int) -> DataFrame:
    """Fill ``gbps`` from packets per second and the frame size."""
    return runs.withColumn("gbps", gbps(F.col("pps"), F.lit(frame_bytes)))


def bench_compare(runs: DataFrame) -> DataFrame:
    """Latest and best run per branch, and how far the latest is from the best.

    Reduced with ``max_by`` under map-side combining; a branch's history is never gathered in one task.
    """
    body = F.struct("commit", "date", "pps", "gbps", "rx_drops_at_pps")
    grouped = runs.groupBy("branch").agg(
        F.max_by(body, F.struct("date", "commit")).alias("_latest"),
        F.max_by(body, F.struct(F.col("pps"), F.col("date"), F.col("commit"))).alias("_best"),
        F.count("*").alias("runs"))
    return grouped.select(
        "branch", "runs",
        F.col("_latest.commit").alias("latest_commit"), F.col("_latest.pps").alias("latest_pps"),
        F.col("_latest.gbps").alias("latest_gbps"), F.col("_latest.rx_drops_at_pps").alias("latest_drops"),
        F.col("_best.commit").alias("best_commit"), F.col("_best.pps").alias("best_pps"),
        (F.col("_latest.pps") / F.col("_best.pps")).alias("latest_vs_best"))
