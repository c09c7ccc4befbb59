"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word (run of letters and digits, or run of signs; ASCII case kept) is hashed to a slot and has a sparse random
index vector.  A slot's word vector is the sum of the index vectors of its neighbours over all occurrences in all
documents: workers add up their own part, Spark adds the parts by slot.  A document's input is the mean and the spread
of its words' vectors.  The network is fitted with numpy on a bounded sample of labelled rows, its probabilities are
tempered on rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrays import Texts, mix, owner, sums
from framelake.llm.common import chunks, keep_rows, texts_of, trimmed
from framelake.llm.labelled import SAMPLE_PER_CLASS, sample

SLOT_BITS = 13  #: word vectors are kept for 2^13 slots, at any size of the vocabulary
DIMS = 32
REACH = 2  #: neighbours on each side
HIDDEN = 24
_SLOTS = 1 << SLOT_BITS
_CHUNK = 1 << 20

#: What a byte belongs to: 0 white space, 1 letters, digits and all bytes of other alphabets, 2 signs.
_KIND = np.full(256, 2, dtype=np.int8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def words(laid: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word, and how many words each text has."""
    kind = _KIND[laid.bytes]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kind))) != 0)  # the last byte is a line end
    starts = edge[kind[edge] > 0]
    ends = edge[np.searchsorted(edge, starts, side="right")] if len(starts) else starts
    return (laid.hashes(starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), laid.per_text(starts)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each slot's two places of its index vector, which hold +1 and -1."""
    seed = mix(np.arange(_SLOTS, dtype=np.uint64) * np.uint64(7919) + np.uint64(17))
    plus = (seed % np.uint64(DIMS)).astype(np.int64)
    minus = (plus + 1 + ((seed >> np.uint64(32)) % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS
    return plus, minus


def neighbour_sums(slot: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of the neighbours within each text to ``total`` (slots x DIMS, flat)."""
    plus, minus = index_vectors()
    own = owner(counts)
    for away in range(1, REACH + 1):
        same = own[:-away] == own[away:]
        left, right = slot[:-away][same], slot[away:][same]
        for at, other in ((left, right), (right, left)):
            total += np.bincount(at * DIMS + plus[other], minlength=len(total))
            total -= np.bincount(at * DIMS + minus[other], minlength=len(total))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all slots from all rows of ``docs``, of length one (or zero), after removing their mean.

    Each task sends a row per slot that it met; the result is 2^13 rows of 32 numbers at any size of the input.
    """
    columns = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS * DIMS, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, 0, _CHUNK):
                slot, counts = words(Texts(texts_of(part, 0)))
                neighbour_sums(slot, counts, total)
        table = total.reshape(_SLOTS, DIMS)
        met = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), *[pa.array(table[met, i], pa.int64()) for i in range(DIMS)]],
            names=["slot", *columns])

    parts = docs.select(text_col).mapInArrow(trimmed(run), "slot int, " + ", ".join(f"{c} bigint" for c in columns))
    rows = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    table = np.zeros((_SLOTS, DIMS))
    if rows.num_rows:
        table[rows.column("slot").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, size, out=np.zeros_like(table), where=size > 0)
    table -= table[size[:, 0] > 0].mean(axis=0) if (size > 0).any() else 0
    return table.astype(np.float32)


def pooled(laid: Texts, vectors: np.ndarray) -> np.ndarray:
    """Each text's pool: mean and standard deviation of its word vectors, how alike neighbouring vectors are on the
    mean, the share of neighbours in the same slot, and the logarithm of the number of words; zeros without words."""
    slot, counts = words(laid)
    n = np.maximum(counts, 1)[:, None]
    rows = vectors[slot]
    mean = sums(rows, counts) / n
    spread = np.sqrt(np.maximum(sums(rows * rows, counts) / n - mean ** 2, 0))
    alike, same = np.zeros(len(slot), np.float32), np.zeros(len(slot), np.float32)
    if len(slot) > 1:
        alike[1:] = np.einsum("ij,ij->i", rows[1:], rows[:-1])
        same[1:] = slot[1:] == slot[:-1]
        first = (np.cumsum(counts) - counts)[counts > 0]
        alike[first] = same[first] = 0
    near = np.stack([sums(alike, counts), sums(same, counts)], axis=1) / n
    return np.concatenate([mean, spread, near, np.log1p(counts)[:, None]], axis=1).astype(np.float64)


@dataclass
class Model:
    """Word vectors, scaling of the pooled input, two layers, temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, texts: list[str]) -> np.ndarray:
        z = self.logits(pooled(Texts(texts), self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 400, seed: int = 11) -> Model:
    """Two layers by Adam on all rows at once, classes counting alike; the temperature on every fourth row, left out."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    draw = np.random.default_rng(seed)
    w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    out = np.arange(len(y)) % 4 == 3
    if len(set(y[out])) < 2 or len(set(y[~out])) < 2:
        out = np.zeros(len(y), dtype=bool)
    z, t = ((x - centre) / scale)[~out], y[~out]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) / len(t)
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, steps + 1):
        h = np.maximum(z @ w[0] + w[1], 0)
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40)))
        g = (p - t) * weight
        back = np.outer(g, w[2]) * (h > 0)
        grads = [z.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad ** 2
            w[i] = w[i] - 0.01 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    model = Model(np.zeros((0, DIMS), np.float32), centre, scale, w[0], w[1], w[2], float(w[3][0]), 1.0)
    held = out if out.any() else np.ones(len(y), dtype=bool)
    raw, truth = model.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -raw / k) * truth + np.logaddexp(0, raw / k) * (1 - truth)) for k in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Word vectors from all of ``docs``, the network from at most ``per_class`` labelled rows of each quality.

    ``allowed`` restricts the ids (column ``id``) whose labels may be learnt.  With labels of one quality only, or
    none, every text gets the same score: that quality's, or one half.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, _CHUNK):
                x = pooled(Texts(texts_of(part, 0)), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["label", "id", "x"])

    picked = sample(docs, labels, "quality", allowed, per_class)
    rows = picked.select("text", "label", F.xxhash64("id").alias("id")).mapInArrow(
        trimmed(run), "label int, id bigint, x binary").toArrow().sort_by("id")
    y = np.array(rows.column("label").to_pylist(), dtype=np.float64)
    width = 2 * DIMS + 3
    if len(y) < 8 or y.min() == y.max():
        flat = 4.0 * (2 * y.mean() - 1) if len(y) else 0.0
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN),
                     np.zeros(HIDDEN), flat, 1.0)
    model = fit_network(np.stack([np.frombuffer(b) for b in rows.column("x").to_pylist()]), y)
    model.vectors = vectors
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``score``, the probability of good quality, 0 to 1.

    Null and empty texts have no words and get the network's answer to an empty pool; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(shared.value.probability(texts_of(part)))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, keep_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is ``keep_at`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda: lambda texts: shared.value.probability(texts) >= keep_at, _CHUNK)
