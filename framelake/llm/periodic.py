"""Runs of words that repeat with a period, found by block convolution.

At scale B (8, 16, 32, ...) a text is cut into blocks of B words.  A run of period q in [B, 2B) that is at least three
periods long contains a whole block together with its copy q words later, so it is enough to know where each block
occurs again, without a mismatch, in the window that follows.  That is where the sum of squared differences of word
numbers is zero; the sums of all blocks and distances come from number-theoretic transforms of integers, modulo as many
primes as the largest possible sum needs, so they are exact.  Every distance found seeds an extension to both sides,
word by word; neighbouring blocks with one distance are one seed, so an extension never passes a block on either side.
A block with a word that does not stand in the window again has no zero sum there and is not transformed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import chunks, released_after_tasks, texts_of, trimmed

LEAST_WORDS = 24  #: a run has at least so many words
LEAST_PERIODS = 3  #: and at least so many periods
_FIRST = 8  #: the smallest block; runs of smaller periods contain one with its copy too, being 24 words long
_SLAB = 1 << 15  #: numbers transformed at a time
_CHUNK = 1 << 20  #: bytes of text handled at a time; a longer text stands alone

#: Primes k * 2^m + 1 below 2^30 with a generator of their multiplicative groups, largest powers of two first.
_PRIMES = ((469762049, 3), (167772161, 3), (754974721, 11))
_roots: dict[tuple[int, int, bool], np.ndarray] = {}


released_after_tasks(_roots.clear)


def _powers_of(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of order ``size``, the first half of them."""
    key = (prime, size, inverse)
    if key not in _roots:
        root = pow(generator, (prime - 1) // size, prime)
        root = pow(root, -1, prime) if inverse else root
        out = np.ones(max(1, size // 2), dtype=np.uint64)
        done = 1
        while done < len(out):  # doubling: the known powers times the next one
            out[done:2 * done] = out[:done] * np.uint64(pow(root, done, prime)) % np.uint64(prime)
            done *= 2
        _roots[key] = out
    return _roots[key]


def _reversed_bits(size: int) -> np.ndarray:
    out = np.zeros(1, dtype=np.int64)
    while len(out) < size:
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


def transform(values: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each column of ``values`` (a power of two of rows), modulo ``prime``.

    Sums are left unreduced between the stages (they stay below 64 primes, under 2^36), products are reduced at once.
    """
    size = len(values)
    roots = _powers_of(prime, generator, size, inverse)
    p = np.uint64(prime)
    a = values[_reversed_bits(size)]
    half = 1
    while half < size:
        pairs = a.reshape(size // (2 * half), 2, half, -1)
        t = pairs[:, 1] * roots[::size // (2 * half), None]
        t -= t // p * p
        np.subtract(pairs[:, 0] + p, t, out=pairs[:, 1])
        pairs[:, 0] += t
        half *= 2
    a -= a // p * p
    if inverse:
        a *= np.uint64(pow(size, -1, prime))
        a -= a // p * p
    return a


def _zero_sums(table: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """For some blocks (rows of ``table``, ascending): a (distance, block) table that says where the block's sum of
    squared differences to the words that far behind it is zero, and its first distance.

    ``table`` ends with two rows more than there are blocks to ask for.  Each block needed is transformed once.
    """
    size = table.shape[1]
    needed = np.unique(np.concatenate((asked, asked + 1, asked + 2)))
    place = [np.searchsorted(needed, asked + i) for i in range(3)]
    columns = table[needed].T
    primes = []
    bound, largest = 1, size * int(columns.max()) ** 2
    for prime in _PRIMES:
        primes.append(prime)
        bound *= prime[0]
        if bound > largest:
            break
    squares = np.zeros((size + 1, len(needed)), dtype=np.int64)
    np.cumsum(columns * columns, axis=0, out=squares[1:])
    own = squares[size][place[0]]
    windows = ((1, size, 0),) if size > _FIRST else ((0, 0, 1), (1, size, 0))  # first block, distance there, lags skipped
    totals = {w: own + squares[size][place[w[0]]] - squares[:size, place[w[0]]] + squares[:size, place[w[0] + 1]]
              for w in windows}
    backwards = -np.arange(2 * size) % (2 * size)
    zero = {w: np.ones((size, len(asked)), dtype=bool) for w in windows}
    for prime, generator in primes:
        p = np.uint64(prime)
        padded = np.zeros((2 * size, len(needed)), dtype=np.uint64)
        padded[:size] = columns
        seen = transform(padded, prime, generator)
        mirrored = seen[backwards][:, place[0]]
        behind = seen.copy()  # of a block that stands half the transform later
        behind[1::2] = p - seen[1::2]
        for w in windows:
            product = (seen[:, place[w[0]]] + behind[:, place[w[0] + 1]]) * mirrored
            product -= product // p * p
            crossed = transform(product, prime, generator, inverse=True)[:size].astype(np.int64)
            rest = totals[w] - 2 * crossed  # below the prime it is the sum itself
            zero[w] &= (rest if totals[w].max(initial=0) < 2 * prime else rest % prime) == 0
    for w in windows:
        yield zero[w][w[2]:], w[1] + w[2]


def _next_same(words: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """How far behind each word the same word of the same text stands next; a great number if nowhere."""
    key = owners * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    out = np.full(len(words), np.iinfo(np.int64).max, dtype=np.int64)
    again = key[order[1:]] == key[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _seeds(words: np.ndarray, soon: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks in ``words`` that occur again at a distance, and the distances; both inside one text.

    ``soon``: how far off each word stands next.  A block occurs again within its window only if all its words do, so
    the others need no transform.
    """
    n = len(words) // size
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    per_slab = max(1, _SLAB // (2 * size))
    table = np.zeros((n + 2, size), dtype=np.int64)
    table[:n] = words.reshape(n, size)
    hopeful = np.flatnonzero(soon.reshape(n, size).max(axis=1) < 2 * size)
    for low in range(0, len(hopeful), per_slab):
        asked = hopeful[low:low + per_slab]
        for zero, first in _zero_sums(table, asked):
            lag, block = np.nonzero(zero)
            start, distance = asked[block] * size, first + lag
            last = start + distance + size - 1
            fits = last < len(words)
            start, distance, last = start[fits], distance[fits], last[fits]
            fits = (words[start + size - 1] > 0) & (words[last] > 0) & (owners[start] == owners[last])
            starts.append(start[fits])
            distances.append(distance[fits])
    return np.concatenate(starts), np.concatenate(distances)


def _reach(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal those ``distance`` later; at most ``most``."""
    out = np.zeros(len(at), dtype=np.int64)
    open_ = np.arange(len(at))
    done, width = 0, 8
    while len(open_) and done < most:
        width = min(width, most - done)
        go = []
        rows = max(1, (1 << 20) // width)
        for low in range(0, len(open_), rows):
            part = open_[low:low + rows]
            places = at[part][:, None] + step * (done + np.arange(width))[None, :]
            later = places + distance[part][:, None]
            inside = (places >= 0) & (later < len(words))
            same = inside & (words[np.where(inside, places, 0)] == words[np.where(inside, later, 0)])
            same &= words[np.where(inside, places, 0)] > 0
            length = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            out[part] += length
            go.append(part[length == width])
        open_ = np.concatenate(go)
        done += width
        width *= 2
    return out


class _Found:
    """Runs found so far, to tell which seeds lie inside one whose period divides their distance: they would give it
    again.  Starts and ends are those of the words in their texts laid end to end without gaps."""

    def __init__(self):
        self.rows = np.zeros((0, 3), dtype=np.int64)  # start, length, period

    def add(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate((self.rows, rows))

    def covered(self, start: np.ndarray, stop: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Seeds from start to stop (end of the copy) inside the longest-reaching run that starts at or before them."""
        if not len(self.rows):
            return np.zeros(len(start), dtype=bool)
        rows = self.rows[np.argsort(self.rows[:, 0], kind="stable")]
        ends = rows[:, 0] + rows[:, 1]
        best = np.maximum.accumulate(ends)
        holder = np.maximum.accumulate(np.where(ends == best, np.arange(len(rows)), -1))
        at = np.searchsorted(rows[:, 0], start, side="right") - 1
        run = holder[np.maximum(at, 0)]
        return (at >= 0) & (best[np.maximum(at, 0)] >= stop) & (distance % rows[run, 2] == 0)


def runs_of(texts: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """The runs of each text, given as numbers from 1 on for its words: rows of start, length, period, by start, then
    period.

    A run is a maximal stretch with smallest period q of at least ``max(least, periods * q)`` words.  The method needs
    three periods and 24 words or more.
    """
    if least < 3 * _FIRST or periods < 3:
        raise ValueError("runs need 24 words and three periods at least")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bases = np.cumsum(sizes) - sizes
    found = _Found()
    size = _FIRST
    flat = np.concatenate([np.zeros(0, np.int64), *texts])
    soon = np.split(_next_same(flat, np.repeat(np.arange(len(texts)), sizes)), bases[1:]) if len(texts) else []
    while True:
        chosen = np.flatnonzero(sizes >= max(least, periods * (1 if size == _FIRST else size)))
        if not len(chosen):
            break
        room = -(-sizes[chosen] // size) * size + size  # a gap ends every text, so no run goes on into the next
        offsets = np.cumsum(room) - room
        words = np.zeros(int(room.sum()), dtype=np.int64)
        off = np.full(len(words), np.iinfo(np.int64).max, dtype=np.int64)
        for o, k in zip(offsets, chosen, strict=True):
            words[o:o + sizes[k]] = texts[k]
            off[o:o + sizes[k]] = soon[k]
        owners = np.repeat(np.arange(len(chosen)), room)
        start, distance = _seeds(words, off, owners, size)
        shift = bases[chosen] - offsets
        if len(start):
            moved = start + shift[owners[start]]
            fresh = ~found.covered(moved, moved + size + distance, distance)
            start, distance = start[fresh], distance[fresh]
        if len(start):
            order = np.lexsort((start, distance))
            start, distance = start[order], distance[order]
            heads = np.concatenate(([True], (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + size)))
            first = np.flatnonzero(heads)
            last = np.concatenate((first[1:], [len(start)])) - 1
            left = _reach(words, start[first] - 1, distance[first], -1, size)
            right = _reach(words, start[last] + size, distance[first], 1, size)
            begin = start[first] - left
            length = start[last] + size + right - begin + distance[first]
            period = distance[first]
            long = length >= np.maximum(least, periods * period)
            rows = np.stack((begin + shift[owners[begin]], length, period), axis=1)[long]
            if len(rows):  # of equal stretches the smallest distance is the period
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
                if len(found.rows):
                    old = {(s, n) for s, n, _ in found.rows.tolist()}
                    rows = rows[np.array([(s, n) not in old for s, n, _ in rows.tolist()], dtype=bool)]
                found.add(rows)
        size *= 2
    rows = found.rows[np.lexsort((found.rows[:, 2], found.rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], bases[1:]) if len(bases) else []
    out = np.split(rows, cuts) if len(bases) else []
    return [r - np.array([b, 0, 0]) for r, b in zip(out, bases, strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are left when every run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number from 1 on for each word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    return np.array([put(w, len(numbers) + 1) for w in words], dtype=np.int64)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
         periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``runs`` (array of start, length, period, by start, then period) and
    ``collapsed``, the words outside repetitions (every run keeps its first period) joined by one space.

    Words are maximal runs of other characters than ASCII white space.  Null and empty texts and texts without words
    have no runs and collapse to the empty text; repeated rows stay; other columns are ignored; texts are read whole.
    """

    def one(words: list[bytes], runs: np.ndarray) -> str:
        if len(runs):
            keep = kept_words(len(words), runs)
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        return b" ".join(words).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                words = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(part)]
                found = runs_of([_numbered(w) for w in words], least, periods)
                ends = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                flat = np.concatenate(found)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)],
                                                  names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), runs),
                     pa.array([one(w, r) for w, r in zip(words, found, strict=True)], pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(run), f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                      "collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: F.Column) -> F.Column:
    """Of an array of runs that with the greatest exact ratio of length and period (ties: smallest start, then period);
    null if there is none.  Ratios are compared by cross-multiplication."""
    ahead: Callable = lambda best, r: (best["length"] * r["period"] < r["length"] * best["period"]) | (
        (best["length"] * r["period"] == r["length"] * best["period"])
        & (F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"])))
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1),
                                                lambda best, r: F.when(ahead(best, r), r).otherwise(best)))
