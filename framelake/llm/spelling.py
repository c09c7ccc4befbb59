"""Spelling variants: words one letter apart, each led back to its most frequent form.

Words that may be one insertion, deletion or replacement apart meet in groups: a word is cut into three pieces, an error
lies in one of them, and so both words share what is before and behind that piece.  Groups are laid into blocks of a
bit-sliced position index, one bitset over the block's words for each position and letter.  All words of a group are
run over its blocks at once: after i letters one bitset holds the block's words that agree so far, two others those with
their one error behind them, a replaced letter at an unshifted position or an inserted letter at a position shifted by
one.  An error counts only where the letters differ first, which lies in one piece: each pair is found exactly once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import chunks, texts_of, trimmed
from framelake.session import stage

LEAST_LETTERS = 5
LEAST_COUNT = 3
PIECES = 3
LARGE_GROUP = 16_384  #: words of a larger group meet by the position of the error instead: at most alphabet^2 share one
BLOCK = 1024  #: words of a bitset
_HELD = 200_000  #: counted words that a task holds before it sends them on
_CELLS = 1 << 21  #: letters of words compared at a time; more only if a single group has more

_RUN = re.compile("[a-z\u00C0-\u00FF]+")  #: after lower-casing ASCII letters only

Change = Callable[[object], Callable[[str], str]]  #: for a document's id, what its words are replaced by


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None,
                least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of at least so many code points that occur at least so often in all texts.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, ASCII letters lower-cased; ``change`` may replace
    them.  Null and empty texts have none; repeated rows count repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                              pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in chunks(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    found = _RUN.findall(text.encode("utf-8").lower().decode("utf-8"))
                    total.update(found if change is None else map(change(key), found))
                if len(total) > _HELD:
                    yield sent()
        yield sent()

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(run), "word string, n bigint")
    return (counted.filter(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


def _bits(rows: np.ndarray, bit: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bitsets of ``width`` bits as 64-bit numbers: row ``rows[k]`` has the bit ``bit[k]``."""
    flat = np.zeros((n_rows, width // 8), dtype=np.uint8)
    np.bitwise_or.at(flat, (rows, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    return flat.view(np.uint64)


def _ones(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit of every bit set."""
    row, word = np.nonzero(sets)
    inner, bit = np.nonzero(np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[inner], word[inner] * 64 + bit


class Group:
    """Rows of whole groups: letters (0 behind the end), lengths, and where a group's error may lie."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, group: np.ndarray, base: np.ndarray, low: np.ndarray,
                 high: np.ndarray):
        self.letters, self.sizes, self.group, self.base, self.low, self.high = letters, sizes, group, base, low, high
        edges = np.flatnonzero(np.diff(group)) + 1
        self.starts = np.concatenate(([0], edges))
        self.ends = np.concatenate((edges, [len(group)]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, near row), both ways for every pair, as arrays."""
        n = len(self.group)
        width = BLOCK if self.letters.shape[1] <= 256 else 64
        for begin in range(0, n, width):
            end = min(n, begin + width)
            first, last = self.starts[self.group[begin]], self.ends[self.group[end - 1]]
            asked = first + np.flatnonzero(self.sizes[first:last] == self.base[first:last])
            if not len(asked):
                continue
            asked = asked[np.argsort(-self.sizes[asked], kind="stable")]
            replaced, longer = self._near(begin, end, asked, width)
            row, bit = _ones(replaced)
            yield asked[row], begin + bit
            row, bit = _ones(longer)
            yield asked[row], begin + bit
            yield begin + bit, asked[row]

    def _near(self, begin: int, end: int, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitsets over the block's rows for each asked row, longest first: those with one letter replaced, and those
        with one letter more."""
        block, sizes = self.letters[begin:end], self.sizes[begin:end]
        alphabet = np.unique(block)
        alphabet = alphabet[alphabet > 0]
        kinds = len(alphabet) + 1  # the last stands for letters that the block does not have
        at, place = np.nonzero(block)
        code = np.searchsorted(alphabet, block[at, place])
        length = self.letters.shape[1] + 2
        index = _bits(place * kinds + code, at, length * kinds, width)
        members = end - begin
        ids = self.group[begin:end] - self.group[begin]
        same = _bits(ids, np.arange(members), int(ids[-1]) + 1, width)
        exact = _bits(np.zeros(members, np.int64), np.arange(members), 1, width)
        base = _bits(np.zeros(members, np.int64)[sizes == self.base[begin:end]],
                     np.flatnonzero(sizes == self.base[begin:end]), 1, width)
        own = same[self.group[asked] - self.group[begin]]
        wanted = self.letters[asked]
        coded = np.searchsorted(alphabet, wanted)
        known = (coded < len(alphabet)) & (alphabet[np.minimum(coded, len(alphabet) - 1)] == wanted)
        coded = np.where(known, coded, kinds - 1)
        size, low, high = self.sizes[asked], self.low[asked], self.high[asked]
        agree = own.copy()
        replaced = np.zeros_like(own)
        longer = np.zeros_like(own)
        for i in range(int(size[0])):
            k = int(np.searchsorted(-size, -i, side="left"))  # rows with more than i letters
            here = index[i * kinds + coded[:k, i]]
            shifted = index[(i + 1) * kinds + coded[:k, i]]
            differ = agree[:k] & ~here
            differ[(low[:k] > i) | (high[:k] <= i)] = 0
            replaced[:k] = (replaced[:k] & here) | differ
            longer[:k] = (longer[:k] | differ) & shifted
            agree[:k] &= here
        at_end = high > size
        longer[at_end] |= agree[at_end]
        return replaced & base, longer & exact & ~base


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by key: (word, n_near, best_n, best) of each row that has near words in its group."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        words = table.column("word").combine_chunks()
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        text = "".join(words.to_pylist())
        flat = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        letters = np.zeros((len(sizes), int(sizes.max())), dtype=np.uint32)
        letters[np.arange(letters.shape[1])[None, :] < sizes[:, None]] = flat
        number = lambda c: table.column(c).to_numpy().astype(np.int64)
        same = [number(c) for c in ("key", "base", "low")]  # keys are hashes; lengths and places are held exactly
        group = np.concatenate(([0], np.cumsum(sum((c[1:] != c[:-1]) for c in same) > 0)))
        n = table.column("n").to_numpy()
        rank = pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        got = list(Group(letters, sizes, group, same[1], same[2], number("high")).pairs())
        row = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
        near = np.concatenate([g[1] for g in got]) if got else row
        order = np.lexsort((rank[near], -n[near], row))
        row, near = row[order], near[order]
        met, first, count = np.unique(row, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [words.take(pa.array(met)), pa.array(count.astype(np.int64)), pa.array(n[near[first]]),
             words.take(pa.array(near[first]))], names=["word", "n_near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    cells = longest = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        sizes = pc.utf8_length(batch.column(1)).to_numpy()
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and cells > _CELLS and held[-1].column(0)[-1].as_py() != key[begin]:
                yield solved(pa.Table.from_batches(held))
                held, longest, rows = [], 0, 0
            held.append(batch.slice(begin, end - begin))
            rows += end - begin
            longest = max(longest, int(sizes[begin:end].max()))
            cells = rows * longest
    if held:
        yield solved(pa.Table.from_batches(held))


def _keys(words: DataFrame, least: int) -> DataFrame:
    """key, word, n, base, low, high: a word in the groups where it meets words of its own length (``base``) and of one
    letter more (base: its own length), and of one letter less (base: one less), for an error in [low, high)."""
    base = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda b: b >= least)).alias("base")
    piece = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")
    cut = words.select("word", "n", base).select("*", piece).select(
        "word", "n", "base", "piece", F.expr(f"piece * base div {PIECES}").cast("int").alias("low"),
        F.expr(f"(piece + 1) * base div {PIECES}").cast("int").alias("stop")).filter(
        f"low < stop OR piece = {PIECES - 1}")  # very short words have empty pieces
    return cut.select(
        F.xxhash64("base", "piece", F.expr("left(word, low)"), F.expr("right(word, base - stop)")).alias("key"),
        "word", "n", "base", "low", F.expr(f"if(piece = {PIECES - 1}, base + 1, stop)").alias("high"))


def _by_position(rows: DataFrame) -> DataFrame:
    """The same rows in groups for an error at a single position."""
    placed = rows.select("word", "n", "base", F.explode(F.sequence("low", F.col("high") - 1)).alias("low"))
    return placed.select(
        F.xxhash64(F.lit(-1), "base", "low", F.expr("left(word, low)"),
                   F.expr("right(word, greatest(base - low - 1, 0))")).alias("key"),
        "word", "n", "base", "low", (F.col("low") + 1).alias("high"))


def near_words(words: DataFrame, least: int = 1, large: int = LARGE_GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of every word with others one letter apart: how many, and the most frequent one
    (ties: the first in code-point order).  ``words`` has distinct (word, n); words of fewer than ``least`` code points
    are left out."""
    keyed = _keys(words.select("word", F.col("n").cast("bigint").alias("n")).filter(F.length("word") >= least),
                  max(least, 1))
    hot = stage(keyed.groupBy("key").count().filter(F.col("count") > large).select("key"), "large-groups")
    if not hot.isEmpty():
        keyed = keyed.join(hot, "key", "left_anti").unionByName(_by_position(keyed.join(hot, "key", "left_semi")))
    met = keyed.repartition("key").sortWithinPartitions("key", "base", "low").mapInArrow(
        trimmed(_compare), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def variants(words: DataFrame, least: int = 1, ratio: int = 2, large: int = LARGE_GROUP) -> DataFrame:
    """One row per word of ``words`` (word, n; words distinct): word, form, root, n, n_near, form_n.

    ``form`` is the most frequent word one letter apart if that occurs at least ``ratio`` times (two or more) as often,
    else null; ``root`` is where the forms lead to.  As counts grow along forms, they never come back, and their chains
    are short; they are followed in doubling steps.  Null words are dropped; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("forms may lead in circles unless they are at least twice as frequent")
    words = stage(words.filter("word IS NOT NULL").select("word", F.col("n").cast("bigint").alias("n")), "words")
    taken = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    found = stage(words.join(near_words(words, least, large), "word", "left").select(
        "word", F.when(taken, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("best_n")).alias("form_n")), "forms")
    step = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = stage(step, "roots")
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if step.join(ahead, "root", "left_semi").isEmpty():
            break
        step = step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Change | None = None) -> DataFrame:
    """The spelling variants among the words of all texts: ``variants`` of ``count_words``."""
    return variants(count_words(docs, id_col, text_col, change), LEAST_LETTERS)
