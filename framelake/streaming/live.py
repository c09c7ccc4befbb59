"""Statistics of one running query whose rules may be edited meanwhile: closed intervals, snapshots, a line per tick.

Each micro-batch is matched with the rules as they are then and combined to address counts per interval.  When the
newest frame has passed an interval (or nothing has come for a while), the interval is closed: its counts become
interval rows, and the stored base, one row of totals and sketches per rule, is folded forward to give the snapshots of
all ticks closed.  What a batch does depends on its own frames, on the counts of intervals still open, on the base and
on the log entry of the batch before, and so not on how long the query has been running.

Everything a batch writes stands in folders named after it, and its log entry is written last.  A batch that has an
entry is not done again; one that was stopped before is done afresh, over what it left.  Readers take the batches that
have entries.  So every interval and every tick appears exactly once, whatever is restarted.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from framelake.operators import stats
from framelake.operators.blocked import sketch_union
from framelake.operators.decode import decode
from framelake.operators.match import few_rules, inline_bound, match
from framelake.plans import snapshot as S
from framelake.sources.outputs import read_snapshot_json, write_snapshot_json

COUNTS = "filter_id bigint, interval bigint, side string, ip bigint, c bigint, b bigint"
INTERVALS = ("filter_id bigint, interval bigint, packets bigint, bytes bigint, src_window_packets bigint, "
             "src_sketch binary, dst_sketch binary, src_entropy_bits double")
SNAPSHOTS = ("filter_id bigint, interval bigint, packets bigint, bytes bigint, unique_src_ips bigint, "
             "unique_dst_ips bigint, src_entropy_bits double, src_window_packets bigint")
_ENTRY = ("batch bigint, newest_ns bigint, open_from bigint, late_below bigint, base bigint, seen_at double, "
          "open array<struct<batch: bigint, low: bigint, high: bigint>>")
_KINDS = {"intervals": INTERVALS, "snapshots": SNAPSHOTS}


@dataclass
class State:
    """What one batch leaves to the next: the newest frame, the first interval not closed yet (and that before the batch),
    the batch that holds the base, when frames were last seen, and the batches with counts of open intervals (with the
    intervals they span)."""

    batch: int = -1
    newest_ns: int | None = None
    open_from: int | None = None
    late_below: int | None = None
    base: int | None = None
    seen_at: float = 0.0
    open: list = field(default_factory=list)


def _logged(spark: SparkSession, out: str) -> State:
    """The last entry of the log."""
    try:
        row = spark.read.schema(_ENTRY).json(f"{out}/log/*").orderBy(F.desc("batch")).limit(1).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        row = []
    return State(**row[0].asDict(recursive=True)) if row else State()


def with_heartbeat(frames: DataFrame, rate: int = 1) -> DataFrame:
    """A stream of frames that goes on having batches when no frames come: rows of NULLs, ``rate`` a second."""
    beats = frames.sparkSession.readStream.format("rate").option("rowsPerSecond", rate).load()
    return frames.unionByName(beats.select(*[F.lit(None).cast(t).alias(c) for c, t in frames.dtypes]))


class Ledger:
    """The folder of a live query, and what its batches do there."""

    def __init__(self, out: str, load_rules: Callable[[], DataFrame], interval_ns: int, late_ns: int = 0,
                 idle_seconds: float | None = None, block: int = S.BLOCK):
        self.out, self.load_rules, self.interval_ns, self.late_ns = out.rstrip("/"), load_rules, interval_ns, late_ns
        self.idle_seconds, self.block = idle_seconds, block
        self.state: State | None = None

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.out}/{kind}/batch={batch}"

    def one_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.state is None:  # the query has just started
            last = _logged(spark, self.out)
            if last.batch >= batch_id:  # done before the query was stopped
                return
            self.state = last
        state, frames = self.state, batch.filter("ts_ns IS NOT NULL")
        newest = frames.agg(F.max("ts_ns")).first()[0]
        if newest is None:
            idle = state.open and self.idle_seconds is not None and time.time() - state.seen_at >= self.idle_seconds
            if not idle:
                return
            seen = state.newest_ns
            upto, seen_at, counted = seen // self.interval_ns + 1, state.seen_at, state.open
        else:
            seen = newest if state.newest_ns is None else max(newest, state.newest_ns)
            upto = (seen - self.late_ns) // self.interval_ns
            counted = [*state.open, *self._count(decode(frames), batch_id, state.open_from)]
            seen_at = time.time()
        open_from, base = state.open_from, state.base
        if open_from is None or upto > open_from:
            if self._close(spark, batch_id, counted, open_from, upto, base):
                open_from, base = upto, batch_id
            elif open_from is not None:  # nothing was ever hit before, so there is no tick either
                open_from = upto
        after = State(batch_id, seen, open_from, state.open_from, base, seen_at,
                      [o for o in counted if open_from is None or o["high"] >= open_from])
        self._log(spark, after)
        self.state = after

    def _count(self, decoded: DataFrame, batch_id: int, open_from: int | None) -> list[dict]:
        """Write the batch's address counts; gives its entry if it has any for open intervals."""
        rules = self.load_rules()
        rows = few_rules(rules, inline_bound(decoded))
        if rows and "from_ns" not in rules.columns:
            counts = stats.counts_of_packets(decoded, rows, self.interval_ns)
        else:
            counts = stats.counts_of_matched(match(decoded, rules), self.interval_ns)
        path = self._path("counts", batch_id)
        counts.select(*_columns(COUNTS)).write.mode("overwrite").parquet(path)
        written = decoded.sparkSession.read.schema(COUNTS).parquet(path)
        on_time = written if open_from is None else written.filter(F.col("interval") >= open_from)
        low, high = on_time.agg(F.min("interval"), F.max("interval")).first()
        return [] if low is None else [{"batch": batch_id, "low": low, "high": high}]

    def _close(self, spark: SparkSession, batch_id: int, counted: list[dict], since: int | None, upto: int,
               base: int | None) -> bool:
        """Close the intervals up to ``upto``; false if no rule was ever hit in them or before."""
        parts = [self._path("counts", o["batch"]) for o in counted if o["low"] < upto]
        if not parts and base is None:
            return False
        if parts:
            counts = spark.read.schema(COUNTS).parquet(*parts).filter(F.col("interval") < upto)
            counts = counts if since is None else counts.filter(F.col("interval") >= since)
            merged = counts.groupBy("filter_id", "interval", "side", "ip").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
            rows = stats.interval_stats(merged).select(*_columns(INTERVALS))
        else:
            rows = spark.createDataFrame([], INTERVALS)
        path = self._path("intervals", batch_id)
        rows.write.mode("overwrite").parquet(path)
        closed = spark.read.schema(INTERVALS).parquet(path)
        if base is not None:  # totals so far stand as one more interval, the last that was closed
            closed = closed.unionByName(spark.read.schema(INTERVALS).parquet(self._path("base", base)))
        forward = closed.groupBy("filter_id").agg(
            F.lit(upto - 1).cast("bigint").alias("interval"), F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"), F.lit(0).cast("bigint").alias("src_window_packets"),
            sketch_union("src_sketch").alias("src_sketch"), sketch_union("dst_sketch").alias("dst_sketch"),
            F.lit(0.0).alias("src_entropy_bits"))
        forward.write.mode("overwrite").parquet(self._path("base", batch_id))
        ticks = S.snapshots(closed, last=upto - 1, block=self.block)
        ticks = ticks if since is None else ticks.filter(F.col("interval") >= since)
        shots = self._path("snapshots", batch_id)
        ticks.select(*_columns(SNAPSHOTS)).write.mode("overwrite").parquet(shots)
        write_snapshot_json(spark.read.schema(SNAPSHOTS).parquet(shots), self._path("ticks", batch_id), mode="overwrite")
        return True

    def _log(self, spark: SparkSession, state: State) -> None:
        spark.createDataFrame([asdict(state)], _ENTRY).coalesce(1).write.mode("overwrite").json(
            self._path("log", state.batch))


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def live_statistics(frames: DataFrame, load_rules: Callable[[], DataFrame], out: str, checkpoint: str, interval_ns: int,
                    late_ns: int = 0, idle_seconds: float | None = None, block: int = S.BLOCK) -> DataStreamWriter:
    """Keep intervals, snapshots and one JSON line per tick of a stream of raw frames in the folder ``out``.

    ``load_rules`` is called for every batch, so a rule added or removed meanwhile counts from the next batch on (rules
    with ``from_ns`` / ``to_ns`` apply by frame time).  An interval is closed once a frame ``late_ns`` past its end has
    come; frames for closed intervals are counted aside (``late_counts``).  With ``idle_seconds`` and a stream with
    heartbeats (``with_heartbeat``) all open intervals are closed after so long without frames.
    """
    ledger = Ledger(out, load_rules, interval_ns, late_ns, idle_seconds, block)
    return frames.writeStream.foreachBatch(ledger.one_batch).option("checkpointLocation", checkpoint)


def wait_for(spark: SparkSession, query: StreamingQuery, out: str, reached: Callable[[State], bool], seconds: float = 300) -> None:
    """Wait until the log of a running live query has come to a state; a failed or ended query raises."""
    until = time.time() + seconds
    while not reached(_logged(spark, out.rstrip("/"))):
        if query.exception() is not None:
            raise query.exception()
        if time.time() > until or not query.isActive:
            query.stop()
            raise TimeoutError(f"live query did not come that far in {seconds} seconds")
        time.sleep(0.5)


def stop(query: StreamingQuery, seconds: float = 60) -> None:
    """Stop a query between two batches, if that can be had within ``seconds``."""
    until = time.time() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.time() < until:
        time.sleep(0.05)
    query.stop()


def read_live(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """What a live query has closed so far: ``intervals`` or ``snapshots``."""
    last = _logged(spark, out.rstrip("/"))
    try:
        found = spark.read.schema(f"{_KINDS[kind]}, batch bigint").parquet(f"{out.rstrip('/')}/{kind}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], f"{_KINDS[kind]}, batch bigint")
    return found.filter(F.col("batch") <= last.batch).drop("batch")


def read_ticks(spark: SparkSession, out: str) -> DataFrame:
    """The entries of the JSON lines written so far; one line per tick, in order within a batch."""
    last = _logged(spark, out.rstrip("/"))
    return read_snapshot_json(spark, f"{out.rstrip('/')}/ticks", upto_batch=last.batch)


def late_counts(spark: SparkSession, out: str) -> DataFrame:
    """Frames that came after their interval was closed, per rule and interval; correct those intervals from the stored
    frames (``streaming.intervals.correct_intervals``)."""
    out = out.rstrip("/")
    counted = spark.read.schema(f"{COUNTS}, batch bigint").parquet(f"{out}/counts").filter("side = 'src'")
    log = spark.read.schema(_ENTRY).json(f"{out}/log/*").select("batch", "late_below")
    return counted.join(log, "batch").filter("interval < late_below").groupBy("filter_id", "interval").agg(
        F.sum("c").alias("packets"))
