"""A list of texts as one byte array, with hashes of any of its ranges in a few passes.

The hash of a range of bytes is a polynomial in an odd base over mixed byte values, modulo 2^64, taken from prefix sums;
equal ranges have equal hashes.  Callers that need exact equality check the texts again where hashes agree.
"""

from __future__ import annotations

import numpy as np

from framelake.llm.common import released_after_tasks

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: ASCII white space, the bytes [\x20\x09-\x0D]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _forget_powers() -> None:
    _powers[:] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


released_after_tasks(_forget_powers)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """Texts laid end to end, each closed by a line end that belongs to no text."""

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(raw)
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1 if self.n else np.zeros(0, dtype=np.int64)
        self.starts = self.ends - sizes
        self._prefix = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each byte range."""
        power, inverse = _power(len(self.bytes) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
            np.cumsum(_VALUES[self.bytes] * power[:-1], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * inverse[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words (runs without ASCII white space), and how many each text has."""
        blank = _SPACE[self.bytes]
        edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return starts, ends, self.per_text(starts)

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of these ascending byte places lie in each text."""
        return np.diff(np.searchsorted(places, np.concatenate((self.starts, [len(self.bytes)]))))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, and how many each text has (an empty text has one)."""
        ends = np.flatnonzero(self.bytes == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, self.per_text(ends)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` of the given lengths (0 for an empty run)."""
    kind = np.int64 if values.dtype.kind in "biu" else values.dtype
    out = np.zeros((len(counts), *values.shape[1:]), dtype=kind)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0, dtype=kind)
    return out


def owner(counts: np.ndarray) -> np.ndarray:
    """The text that each element belongs to."""
    return np.repeat(np.arange(len(counts)), counts)
