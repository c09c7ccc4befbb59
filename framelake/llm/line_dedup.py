"""Line deduplication behind two Bloom filters.

Workers send the hash of each line's key, once or twice per chunk of texts; for every slice of the hash space one task
keeps a filter of hashes seen once and a filter of hashes seen twice, and returns the latter.  With the twice-seen
filter (bounded in size, broadcast) the texts are read again, and only keys that it may hold are shuffled, as text, to
be counted exactly and to have the document chosen that keeps the line.  A filter that holds too much sends more keys
to that count; it never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrays import Texts, mix, owner
from framelake.llm.common import chunks, free_names, texts_of, trimmed
from framelake.llm.twice_filter import PACKED, TWICE_BITS, pack, slices_for, suspected, twice_seen
from framelake.session import stage

MIN_CHARS = 40
MIN_DOCS = 5
BROADCAST_DECISIONS = 2_000_000  #: up to so many keys (48 MB) decisions are broadcast, beyond they are joined
_CHUNK = 2 << 20


def keys(texts: list[str], min_chars: int = MIN_CHARS) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines with a long enough key: (laid texts, text of each, line number, start and end of the key).

    A key is the line without ASCII white space at its ends, A-Z lower-cased.
    """
    laid = Texts(texts, lower=True)
    first, last, n_lines = laid.lines()
    starts, ends, _ = laid.words()
    low, high = np.searchsorted(starts, first), np.searchsorted(starts, last)
    own = owner(n_lines)
    number = np.arange(len(own)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    some = np.flatnonzero(high > low)
    s, e = starts[low[some]], ends[high[some] - 1]
    points = np.concatenate(([0], np.cumsum((laid.bytes & 0xC0) != 0x80)))
    long = points[e] - points[s] >= min_chars
    return laid, own[some][long], number[some][long], s[long], e[long]


def _distinct(own: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """One place for each pair of text and hash."""
    return np.unique(mix(hashed ^ mix(own.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def line_hashes(docs: DataFrame, text_col: str, min_chars: int, slices: int) -> DataFrame:
    """Hashes of all keys by slice, each at most twice for a chunk of texts, whatever number of texts has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, _CHUNK):
                laid, own, _, s, e = keys(texts_of(part, 0), min_chars)
                hashed = laid.hashes(s, e)
                yield pack(hashed[_distinct(own, hashed)], slices)

    return docs.select(text_col).mapInArrow(trimmed(run), PACKED)


def suspects(docs: DataFrame, bitmaps: np.ndarray, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, id): the keys that may repeat, as text, once per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                laid, own, _, s, e = keys(texts_of(part), min_chars)
                hashed = laid.hashes(s, e)
                at = _distinct(own, hashed)
                at = at[suspected(shared.value, hashed[at])]
                raw = laid.bytes.tobytes()
                found = [raw[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), part.column(0).take(pa.array(own[at]))], names=["key", "id"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"key binary, id {kind}")


def decide(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper): keys in at least ``min_docs`` documents, and the largest id among them."""
    return (found.groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key")
            .agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
            .select("key", "keeper"))


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, twice_bits: int = TWICE_BITS,
               broadcast_decisions: int = BROADCAST_DECISIONS) -> DataFrame:
    """``docs`` without lines that at least ``min_docs`` documents have, but for the largest id among them.

    All columns stay; ``text_col`` holds the other lines, joined by the line end, and two columns are added (replacing
    any of their names): ``n_lines`` before and ``n_dropped``.  Null texts count as one empty line and become empty.
    Rows with one id are one document: each of its rows keeps or loses the line.  Null ids count as one document, which
    never keeps.
    """
    made = {"n_lines", "n_dropped"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    most = base.agg(F.sum(F.expr(f"octet_length(`{text_col}`) div {min_chars + 1} + 1"))).first()[0] or 0
    slices = slices_for(int(most))  # no text has more keys than its length allows
    bitmaps = twice_seen(line_hashes(base, text_col, min_chars, slices), slices, twice_bits)
    decided = stage(decide(suspects(base, bitmaps, id_col, text_col, min_chars), min_docs), "line-decisions")
    if decided.count() <= broadcast_decisions:
        return _drop_by_broadcast(base, decided, id_col, text_col, min_chars)
    return _drop_by_join(base, bitmaps, decided, id_col, text_col, min_chars)


def _outputs(texts: list[str], own: np.ndarray, number: np.ndarray) -> tuple[list[str], list[int], list[int]]:
    """Texts without the given lines, their number of lines before, and how many went."""
    gone: dict[int, set[int]] = {}
    for t, k in zip(own.tolist(), number.tolist(), strict=True):
        gone.setdefault(t, set()).add(k)
    out = [t if i not in gone else "\n".join([x for k, x in enumerate(t.split("\n")) if k not in gone[i]])
           for i, t in enumerate(texts)]
    return out, [t.count("\n") + 1 for t in texts], [len(gone.get(i, ())) for i in range(len(texts))]


def _rebuilt(part: pa.RecordBatch, place: int, texts, lines, dropped, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(part.columns[:len(names)])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                      names=[*names, "n_lines", "n_dropped"])


def _schema(base: DataFrame):
    from pyspark.sql.types import LongType, StructType

    return StructType(list(base.schema.fields)).add("n_lines", LongType()).add("n_dropped", LongType())


def _drop_by_broadcast(base: DataFrame, decided: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = decided.mapInArrow(_digests, f"a bigint, b bigint, keeper {dict(decided.dtypes)['keeper']}").toArrow()
    a = rows.column("a").to_numpy().view(np.uint64)
    order = np.argsort(a)
    keepers = rows.column("keeper").to_pylist()
    table = (a[order], rows.column("b").to_numpy()[order], np.array(keepers, dtype=object if isinstance(
        next(iter(keepers), 0), str) else None)[order])
    shared = base.sparkSession.sparkContext.broadcast(table)
    names, place, at_id = base.columns, base.columns.index(text_col), base.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, keeper = shared.value
        for batch in batches:
            for part in chunks(batch, place, _CHUNK):
                texts = texts_of(part, place)
                laid, own, number, s, e = keys(texts, min_chars)
                hashed = laid.hashes(s, e)
                at = np.searchsorted(first, hashed)
                at[at == len(first)] = 0
                hit = np.flatnonzero(first[at] == hashed) if len(first) else at[:0]
                ids, raw, drop = part.column(at_id).to_pylist(), laid.bytes.tobytes(), []
                for i in hit.tolist():
                    k = int(at[i])
                    want = int.from_bytes(_digest(raw[s[i]:e[i]])[:8], "little", signed=True)
                    while k < len(first) and first[k] == hashed[i]:
                        if second[k] == want:
                            if ids[own[i]] != keeper[k]:
                                drop.append(i)
                            break
                        k += 1
                yield _rebuilt(part, place, *_outputs(texts, own[drop], number[drop]), names)

    return base.mapInArrow(trimmed(run), _schema(base))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key its range hash and half of a strong digest."""
    for batch in batches:
        found = batch.column(0).to_pylist()
        laid = Texts([k.decode("utf-8") for k in found])
        strong = [int.from_bytes(_digest(k)[:8], "little", signed=True) for k in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(laid.hashes(laid.starts, laid.ends).view(np.int64)), pa.array(strong, pa.int64()), batch.column(1)],
            names=["a", "b", "keeper"])


def _drop_by_join(base: DataFrame, bitmaps: np.ndarray, decided: DataFrame, id_col: str, text_col: str,
                  min_chars: int) -> DataFrame:
    """Decisions too many to broadcast: they meet the suspected keys in a join, and the texts by id."""
    found = suspects(base, bitmaps, id_col, text_col, min_chars).distinct()
    lost, doc = free_names(base, "lost", "doc")
    gone_of = found.join(decided, "key").filter(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(
        F.collect_list("key").alias(lost)).withColumnRenamed("id", doc)
    joined = base.join(gone_of, F.col(f"`{id_col}`").eqNullSafe(F.col(doc)), "left").drop(doc)
    names, place = base.columns, base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, place, _CHUNK):
                texts = texts_of(part, place)
                laid, own, number, s, e = keys(texts, min_chars)
                gone = [set(x or ()) for x in part.column(len(names)).to_pylist()]
                raw = laid.bytes.tobytes()
                drop = [i for i in range(len(own)) if raw[s[i]:e[i]] in gone[own[i]]]
                yield _rebuilt(part, place, *_outputs(texts, own[drop], number[drop]), names)

    return joined.mapInArrow(trimmed(run), _schema(base))
