"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A document is contaminated by an item where some window of as many words as the item has a weighted similarity of 0.8
or more to it: shared weight over joint weight of their five-word shingles, a shingle weighing as often as it occurs.
At least 0.8 of such a window's shingles are the item's, so only windows of which so many are some item's are laid.
Each window's 64-bit SimHash looks into the items of its length: fingerprints are cut into eight blocks, and whatever
lies within a radius of 20 bits agrees in some block up to two bits, so that the items filed under a window's eight block
values, each under the 37 values nearest to its own, hold every fingerprint within the radius.  What is found within the radius is verified on the words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelake.llm.arrays import Texts, mix
from framelake.llm.common import chunks, keep_rows, texts_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20  #: at a similarity of 0.8 fingerprints differ in 9.7 bits on the mean, with a deviation of 2.9
BLOCKS = 8
ITEMS_AT_ONCE = 10_000  #: items are broadcast in blocks of about so many; each block is one pass over the documents
_CHUNK = 2 << 20
_FILTER_BITS = 22
#: a block's value with none, one or two of its eight bits turned
_NEAR = [sum(1 << b for b in turned) for k in range(RADIUS // BLOCKS + 1) for turned in combinations(range(8), k)]


def _rolled(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i:i + len(out)]
    return mix(out)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """For each shingle, +1 or -1 for each of 64 bits."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


class Fingerprints:
    """SimHashes of any runs of consecutive shingles; each occurrence weighs one."""

    def __init__(self, shingles: np.ndarray):
        self.total = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
        np.cumsum(_signs(shingles), axis=0, out=self.total[1:])

    def of(self, starts: np.ndarray, width: int) -> np.ndarray:
        bits = (self.total[starts + width] - self.total[starts]) > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel()


class Index:
    """Items by number of words: their fingerprints in Hamming blocks, and all their shingles."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.words = ids, [_words(t) for t in texts]
        laid = Texts(texts, lower=True)
        starts, ends, n_words = laid.words()
        hashed = laid.hashes(starts, ends)
        first = np.cumsum(n_words) - n_words
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        shingles: dict[int, list[np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(n_words.tolist()):
            if n:
                by_length.setdefault(n, []).append(i)
        for n, items in by_length.items():
            size = min(SHINGLE, n)
            own = [_rolled(hashed[first[i]:first[i] + n], size) for i in items]
            shingles.setdefault(size, []).extend(own)
            prints = np.concatenate([Fingerprints(s).of(np.zeros(1, np.int64), len(s)) for s in own])
            self.lengths[n] = (np.array(items), prints, self._buckets(prints))
        self.shingles = {size: np.unique(np.concatenate(all_)) for size, all_ in shingles.items()}
        self.filters = {}
        for size, known in self.shingles.items():
            table = np.zeros(1 << _FILTER_BITS, dtype=bool)
            table[known >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[size] = table

    @staticmethod
    def _buckets(prints: np.ndarray) -> np.ndarray:
        """[block, value, fingerprint]: whether the fingerprint's block differs from the value in two bits at most."""
        out = np.zeros((BLOCKS, 256, len(prints)), dtype=bool)
        for i, blocks in enumerate(prints.view(np.uint8).reshape(-1, BLOCKS)):
            for turned in _NEAR:
                out[np.arange(BLOCKS), blocks ^ turned, i] = True
        return out

    def near(self, n: int, prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
        """(window, item) for all items of ``n`` words whose fingerprint is within ``radius`` of the window's."""
        items, own, buckets = self.lengths[n]
        values = prints.view(np.uint8).reshape(-1, BLOCKS)
        candidates = np.zeros((len(prints), len(own)), dtype=bool)
        for block in range(BLOCKS):
            candidates |= buckets[block][values[:, block]]
        w, c = np.nonzero(candidates)
        close = np.bitwise_count(prints[w] ^ own[c]) <= radius
        return list(zip(w[close].tolist(), items[c[close]].tolist(), strict=True))

    def scan(self, texts: list[str]) -> list[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best window for each contaminated text and item."""
        laid = Texts(texts, lower=True)
        starts, ends, n_words = laid.words()
        hashed = laid.hashes(starts, ends)
        edge = np.concatenate(([0], np.cumsum(n_words)))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        words: dict[int, list[bytes]] = {}
        for size, known in self.shingles.items():
            runs = _rolled(hashed, size)
            at = np.flatnonzero(self.filters[size][runs >> np.uint64(64 - _FILTER_BITS)])
            at = at[np.isin(runs[at], known)]
            own = np.searchsorted(edge, at, side="right") - 1
            whole = at + size <= edge[own + 1]
            at, own = at[whole], own[whole]
            longest = max(n for n in self.lengths if min(SHINGLE, n) == size)
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(at) > longest)) + 1
            for places in np.split(at, cuts) if len(at) else []:  # no window covers two of these groups
                t = int(np.searchsorted(edge, places[0], side="right") - 1)
                for item, start in self._windows(hashed, int(edge[t]), int(edge[t + 1]), size, longest, places):
                    if t not in words:
                        words[t] = _words(texts[t])
                    first = start - int(edge[t])
                    got = similarity(words[t][first:first + len(self.words[item])], self.words[item])
                    held = best.get((t, item), (0.0, 0))
                    if got >= SIMILARITY and (got, -first) > (held[0], -held[1]):
                        best[t, item] = (got, first)
        return [(t, item, got, first) for (t, item), (got, first) in sorted(best.items())]

    def _windows(self, hashed: np.ndarray, low: int, high: int, size: int, longest: int,
                 places: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first word) of all windows near these places of one text (words ``low`` to ``high``) whose
        fingerprint is within the radius of an item of their length."""
        low, high = max(low, int(places[0]) - longest), min(high, int(places[-1]) + size + longest)
        runs = _rolled(hashed[low:high], size)
        seen = np.zeros(len(runs) + 1, dtype=np.int64)
        seen[places - low + 1] = 1
        seen, prints = np.cumsum(seen), Fingerprints(runs)
        for n in self.lengths:
            width = n - size + 1
            if min(SHINGLE, n) == size and high - low >= n:
                starts = np.flatnonzero(seen[width:] - seen[:-width] >= SIMILARITY * width)
                for w, item in self.near(n, prints.of(starts, width)) if len(starts) else []:
                    yield item, int(starts[w]) + low


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_weights(words: list[bytes]) -> Counter:
    """How often each five-word shingle occurs; fewer words are one shingle."""
    return Counter(tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))) if words else Counter()


def similarity(a: list[bytes], b: list[bytes]) -> float:
    """Shared weight over joint weight of the two shingle multisets."""
    x, y = shingle_weights(a), shingle_weights(b)
    joint = sum((x | y).values())
    return sum((x & y).values()) / joint if joint else 0.0


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, at_once: int) -> Iterator:
    """Broadcast indexes over all items, in blocks of about ``at_once``."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-items.count() // at_once))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = part.toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(
            Index(rows.column("item").to_pylist(), rows.column("text").to_pylist()))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(id, item, similarity, first_word, n_words): each contaminated row of ``docs`` with each item found in it, once,
    at its most similar window (the first of equals).

    Null texts and texts or items without words match nothing.  Items with equal texts and repeated rows are all
    reported; null ids stay null.
    """
    id_type, item_type = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"{id_col} {id_type}, {item_col} {item_type}, similarity double, first_word bigint, n_words bigint"
    out = None
    for shared in _indexes(benchmark, item_col, item_text_col, at_once):
        found = docs.select(id_col, text_col).mapInArrow(_finder(shared, to_arrow_type(benchmark.schema[item_col].dataType)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                index = shared.value
                hits = index.scan(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                     pa.array([index.ids[h[1]] for h in hits], item_type),
                     pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int64()),
                     pa.array([len(index.words[h[1]]) for h in hits], pa.int64())],
                    names=["id", "item", "similarity", "first_word", "n_words"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of ``docs``, all their columns, in which no item is found."""
    for shared in _indexes(benchmark, item_col, item_text_col, at_once):
        def make(shared=shared):
            def clean(texts: list[str]) -> np.ndarray:
                keep = np.ones(len(texts), dtype=bool)
                keep[[h[0] for h in shared.value.scan(texts)]] = False
                return keep
            return clean
        docs = keep_rows(docs, text_col, make, _CHUNK)
    return docs
