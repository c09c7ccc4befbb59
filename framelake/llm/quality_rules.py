"""Quality rules: repetition and length rules, and a logistic regression over hashed n-grams with fixed thresholds.

The regression sees, per text, the mean weight of its hashed word n-grams (one and two words) and of its hashed
character n-grams (three and four bytes); it is fitted with numpy on a bounded sample of labelled rows, its
probabilities are calibrated on rows left out of the fit, and all texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrays import Texts, mix, owner, sums
from framelake.llm.common import chunks, texts_of, trimmed
from framelake.llm.labelled import SAMPLE_PER_CLASS, sample

BITS = 11  #: each of the two feature groups has 2^BITS hashed weights
MIN_WORDS = 20
MAX_REPEATED = 30  #: per cent of the words
KEEP_AT = 0.3  #: texts with a lower calibrated probability of good quality are not kept
WINDOW = 8
_CHUNK = 2 << 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SLOTS = 1 << BITS


def base_counts(texts: list[str], laid: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    Repeats are looked for by hash over the whole chunk; texts in which any hash repeats are counted exactly.
    """
    starts, ends, n_words = laid.words()
    inside = np.ones(len(laid.bytes), dtype=bool)
    inside[laid.ends] = False
    letters = (laid.bytes & 0xC0) != 0x80
    blank = (laid.bytes == 32) | ((laid.bytes >= 9) & (laid.bytes <= 13))
    bounds = laid.ends + 1 - laid.starts
    word_chars = sums(letters & ~blank, bounds).astype(np.int64)
    n_symbols = sums(_SYMBOL[laid.bytes] & inside, bounds).astype(np.int64)
    hashed = laid.hashes(starts, ends)
    own = owner(n_words)
    repeated = np.zeros(laid.n, dtype=np.int64)
    if len(hashed) >= WINDOW:
        window = np.zeros(len(hashed) - WINDOW + 1, dtype=np.uint64)
        for i in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashed[i:i + len(window)]
        whole = own[:len(window)] == own[WINDOW - 1:]
        for t in _repeating(window[whole], own[:len(window)][whole]):
            repeated[t] = repeat_words(texts[t])
    line_starts, line_ends, n_lines = laid.lines()
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_own = owner(n_lines)
    dup_lines = np.zeros(laid.n, dtype=np.int64)
    for t in _repeating(laid.hashes(line_starts[with_word], line_ends[with_word]), line_own[with_word]):
        lines = [x for x in texts[t].split("\n") if x.strip(" \t\n\r\v\f")]
        dup_lines[t] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": repeated}


def _repeating(hashed: np.ndarray, own: np.ndarray) -> list[int]:
    """The texts in which some hash occurs twice."""
    keys = np.sort(mix(hashed ^ mix(own.astype(np.uint64) + np.uint64(1))))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    if not len(twice):
        return []
    again = np.isin(mix(hashed ^ mix(own.astype(np.uint64) + np.uint64(1))), twice)
    return np.unique(own[again]).tolist()


def repeat_words(text: str) -> int:
    """Words in windows of eight that the text has twice or more, the first included."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[tuple, int] = {}
    windows = [tuple(words[i:i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, reach)
            reach = i + WINDOW
    return covered


def slots(laid: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(feature group, slot of each n-gram, number of n-grams of each text), for each kind of n-gram."""
    shift = np.uint64(64 - BITS)
    starts, ends, n_words = laid.words()
    hashed = laid.hashes(starts, ends)
    yield 0, (hashed >> shift).astype(np.int32), n_words
    if len(hashed) > 1:
        same = owner(n_words)
        same = same[:-1] == same[1:]
        pair = mix(hashed[:-1] * np.uint64(3) + hashed[1:])[same]
        yield 0, (pair >> shift).astype(np.int32), np.maximum(n_words - 1, 0)
    wide = laid.bytes.astype(np.uint32)
    sizes = laid.ends - laid.starts
    for n in (3, 4):
        if len(wide) < n:
            continue
        code = np.zeros(len(wide) - n + 1, dtype=np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + wide[i:len(wide) - n + 1 + i]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        inside = np.ones(len(wide), dtype=bool)
        for i in range(n):
            at = laid.ends - i
            inside[at[at >= 0]] = False
        counts = np.maximum(sizes - n + 1, 0)
        # texts shorter than n lose places of the text before them too; those are put back by the exact count
        places = np.flatnonzero(inside[:len(code)])
        if len(places) != counts.sum():
            places = np.concatenate([np.arange(s, s + c) for s, c in zip(laid.starts, counts)]) if counts.sum() else places[:0]
        yield 1, code[places].astype(np.int32), counts


@dataclass
class Model:
    """Weights of both groups, intercept, and the calibration of the score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw(self, laid: Texts) -> np.ndarray:
        total = np.full(laid.n, self.bias)
        top, low = np.zeros((2, laid.n)), np.zeros((2, laid.n))
        for group, slot, counts in slots(laid):
            top[group] += sums(self.weights[group][slot], counts)
            low[group] += counts
        return total + (top / np.maximum(low, 1)).sum(axis=0)

    def probability(self, laid: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(laid) + self.shift, -40, 40)))


def features(texts: list[str]) -> np.ndarray:
    """The share of each slot among the n-grams of its group, one row per text."""
    laid = Texts(texts)
    table = np.zeros((laid.n, 2, _SLOTS))
    for group, slot, counts in slots(laid):
        np.add.at(table, (owner(counts), group, slot), 1)
    total = table.sum(axis=2, keepdims=True)
    return (table / np.maximum(total, 1)).reshape(laid.n, -1).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps; classes count alike."""
    scale = np.sqrt(np.maximum((x ** 2).mean(axis=0), 1e-12))
    z = (x / scale / np.sqrt(x.shape[1])).astype(np.float32)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ (w + 0.9 * vw) + b + 0.9 * vb, -40, 40)))
        g = ((p - y) * balance).astype(np.float32)
        vw = 0.9 * vw - 4.0 * (z.T @ g + penalty * w)
        vb = 0.9 * vb - 4.0 * g.sum()
        w, b = w + vw, b + vb
    return (w / scale / np.sqrt(x.shape[1])).astype(np.float64), float(b)


def fit_platt(raw: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Slope and shift that turn raw scores into probabilities, with smoothed targets; a slope below zero is refused."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * raw).sum(), g.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most ``per_class`` labelled rows of each quality; with only one class, one that keeps all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, 1 << 20):
                rows = features(texts_of(part, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "x"])

    rows = sample(docs, labels, "quality", per_class=per_class).select("text", "label", "id").orderBy("id").select(
        "text", "label").mapInArrow(trimmed(run), "label int, x binary").toArrow()
    y = np.array(rows.column("label").to_pylist(), dtype=np.float64)
    if len(y) < 8 or y.min() == y.max():
        return Model(np.zeros((2, _SLOTS), np.float32), 4.0, 1.0, 0.0)
    x = np.stack([np.frombuffer(b, np.float32) for b in rows.column("x").to_pylist()])
    left_out = np.arange(len(y)) % 4 == 3
    if len(set(y[left_out])) < 2 or len(set(y[~left_out])) < 2:
        left_out[:] = True
    w, b = fit_logistic(x[~left_out] if not left_out.all() else x, y[~left_out] if not left_out.all() else y)
    slope, shift = fit_platt(x[left_out] @ w + b, y[left_out])
    return Model(w.reshape(2, _SLOTS).astype(np.float32), b, slope, shift)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep_at: float = KEEP_AT) -> DataFrame:
    """One row per input row: id, the five counts, ``base_failed``, ``probability`` of good quality and ``kept``.

    Null texts count as empty: no words, base rules failed, not kept.  Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few ten KB, whatever the data
    kind = dict(docs.dtypes)[id_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                texts = texts_of(part)
                laid = Texts(texts)
                counts = base_counts(texts, laid)
                failed = (counts["n_words"] < MIN_WORDS) | (
                    100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])
                p = shared.value.probability(laid)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(counts[n], pa.int64()) for n in names], pa.array(failed), pa.array(p),
                     pa.array(~failed & (p >= keep_at))], names=["id", *names, "base_failed", "probability", "kept"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(run), f"id {kind}, " + ", ".join(f"{n} bigint" for n in names)
        + ", base_failed boolean, probability double, kept boolean").withColumnRenamed("id", id_col)
