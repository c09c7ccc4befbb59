"""Continuous matching against rules that may be edited while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from framelake.operators.decode import decode
from framelake.operators.match import match
from framelake.operators.prefilter import prefilter, rejected
from framelake.sources.dump import write_dump


def match_writer(frames: DataFrame, load_rules: Callable[[], DataFrame], out: str, checkpoint: str,
                 columns: list[str] | None = None) -> DataStreamWriter:
    """Match each micro-batch with the rules as they are then, appending to the Parquet table ``out``.

    A plain stream-static join would keep the rule files listed when the query started.  Here ``load_rules`` is called
    per batch, so an edit takes effect with the next batch.  A batch owns the folder named after it and replaces it when
    replayed, so a restart neither loses nor repeats rows.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        matched = match(decode(batch), load_rules())
        if columns:
            matched = matched.select(*columns)
        matched.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return frames.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def prefilter_writer(frames: DataFrame, load_rules: Callable[[], DataFrame], out: str, checkpoint: str,
                     keep: bool = True, columns: list[str] | None = None) -> DataStreamWriter:
    """The frames of a stream that some rule wants (or, with ``keep`` false, that none does), into the Parquet table
    ``out``.

    Each micro-batch takes the batch plan: its distinct 5-tuples are tried in one lookup for all shapes, where a join
    within the stream needs one for each shape.  Rules are read per batch and replays replace, as in ``match_writer``.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        chosen = (prefilter if keep else rejected)(decode(batch), load_rules())
        if columns:
            chosen = chosen.select(*columns)
        chosen.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return frames.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def dump_writer(frames: DataFrame, load_rules: Callable[[], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Like ``match_writer``, but into dump files; a replayed batch is recognised and not written again."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        write_dump(match(decode(batch), load_rules()), out, batch_id=batch_id)

    return frames.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
