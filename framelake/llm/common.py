"""Helpers shared by the text operators: table access and Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20  #: texts handled at a time inside a task; one longer text makes a chunk of its own


_RELEASED: list[Callable[[], None]] = []


def released_after_tasks(release: Callable[[], None]) -> None:
    """Have ``release`` called in a worker whenever a task ends: what a module holds between batches goes then."""
    _RELEASED.append(release)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns, made longer until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving back to the system what it has freed when a task ends: workers live on, and next tasks may need
    other amounts of memory for other things."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for release in _RELEASED:
                release()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts take at most ``limit`` bytes (or are a single row)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts as strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str,
              make: Callable[[], Callable[[list[str]], list]], limit: int = CHUNK_BYTES) -> DataFrame:
    """One output row per input row: the id, then what a worker computes from a list of whole texts.

    ``make`` runs once per task and returns the function that turns texts into output columns (lists or arrays, in the
    order of ``schema`` after the id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in chunks(batch, 1, limit):
                columns = compute(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                                       for c, f in zip(columns, target[1:], strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = StructType([StructField(id_col, df.schema[id_col].dataType), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(kind)
    target = list(arrow)
    return df.select(id_col, text_col).mapInArrow(trimmed(run), kind)


def keep_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]],
              limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, for which the worker's function gives true."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for batch in batches:
            for part in chunks(batch, place, limit):
                yield part.filter(pa.array(np.asarray(decide(texts_of(part, place)), dtype=bool)))

    return df.mapInArrow(trimmed(run), df.schema)


def concat_utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each (one more than there are texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along the first axis) between consecutive offsets; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
