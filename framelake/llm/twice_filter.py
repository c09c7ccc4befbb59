"""Two Bloom filters over slices of a hash space: what was seen once, and what was seen twice or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.arrays import mix
from framelake.llm.common import trimmed

BITS_PER_KEY = 32
PROBES = 4
ONCE_BITS = 1 << 22  #: one slice's filter of hashes seen once; there are as many slices as the keys need
TWICE_BITS = 1 << 28  #: all slices' filters of hashes seen twice, which are broadcast, together (32 MB)

PACKED = "slice int, hashes binary"  #: hashes of one slice laid end to end, eight bytes each


def slices_for(keys: int) -> int:
    """A power of two, so that a slice's filter has about 32 bits for each key."""
    return 1 << max(0, (max(keys, 1) * BITS_PER_KEY // ONCE_BITS).bit_length())


def slice_of(hashed: np.ndarray, slices: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)


def pack(hashed: np.ndarray, slices: int) -> pa.RecordBatch:
    """The hashes of a chunk, each at most twice however often it occurs, as one row per slice."""
    once, times = np.unique(hashed, return_counts=True)
    sent = np.concatenate((once, once[times > 1]))
    part = slice_of(sent, slices)
    order = np.argsort(part, kind="stable")
    met, first = np.unique(part[order], return_index=True)
    pieces = np.split(sent[order], first[1:]) if len(met) else []
    return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                                      names=["slice", "hashes"])


def _probes(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits`` bits (a power of two)."""
    second = mix(hashed) | np.uint64(1)
    return np.stack([(hashed + np.uint64(i) * second) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> np.uint64(3),
                     np.uint8(1) << (places.ravel() & np.uint64(7)).astype(np.uint8))


def twice_seen(packed: DataFrame, slices: int, twice_bits: int = TWICE_BITS) -> np.ndarray:
    """The filter of hashes that occur at least twice in ``packed``: one row of bytes per slice.

    Every slice belongs to one task.  The filters of hashes seen once grow in number with the keys; those of hashes
    seen twice have ``twice_bits`` bits in all, and hold more than they should beyond some 2^24 repeated hashes.
    """
    size = min(ONCE_BITS, max(64, twice_bits // slices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, []).append(np.frombuffer(raw, np.uint64))
            for k, parts in held.items():
                if k not in once:
                    once[k], twice[k] = np.zeros(ONCE_BITS // 8, np.uint8), np.zeros(size // 8, np.uint8)
                found, times = np.unique(np.concatenate(parts), return_counts=True)
                places = _probes(found, ONCE_BITS)
                again = (times > 1) | _has(once[k], places)
                _put(twice[k], _probes(found[again], size))
                _put(once[k], places)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(twice), pa.int32()), pa.array([b.tobytes() for b in twice.values()], pa.binary())],
            names=["slice", "bits"])

    rows = packed.repartition(slices, "slice").mapInArrow(trimmed(run), "slice int, bits binary").toArrow()
    out = np.zeros((slices, size // 8), dtype=np.uint8)
    for k, b in zip(rows.column("slice").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[k] |= np.frombuffer(b, np.uint8)
    return out


def suspected(bitmaps: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; all that occurred twice are among them."""
    slices, size = bitmaps.shape
    places = _probes(hashed, size * 8) + (slice_of(hashed, slices).astype(np.uint64) * np.uint64(size * 8))[:, None]
    return _has(bitmaps.reshape(-1), places)
