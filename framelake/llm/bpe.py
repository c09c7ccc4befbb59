"""BPE encoding and decoding over a pair occurrence index.

Words that a task has not met yet are encoded together: all their symbols stand in one array, an index maps each pair
that has a rank to all its positions, and the active ranks are taken in ascending order; applying one rewrites the
positions of that pair and updates the lists of the pairs beside them.  Every merge makes a symbol that only later
ranks use (checked when the vocabulary is loaded), so one ascending pass gives what merging word by word gives.  What
a word encodes to is kept for the task, up to a bound, since texts repeat their words; of two generations the older one
goes when the younger is full, and words still in use move over to the younger.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import chunks, texts_of, trimmed

CACHED = 100_000  #: pieces, and words, that a task keeps at least while they are in use (twice as many at most, some 70 MB)
CACHED_ALONE = 400_000  #: the same for a job that has its executors to itself: texts have many rare words (some 280 MB)
_CHUNK = 1 << 20

_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = regex.compile(r"\p{White_Space}+")

#: Fixed values of the vocabulary format: bytes that stand for themselves; the others follow from code point 256 on.
_PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    out, extra = [], 256
    for b in range(256):
        if b in _PLAIN:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """A word-end BPE vocabulary in the tokenizers library's JSON format.

    Supported: NFC, white space to one space, lower case; a split pattern whose matches are the words; byte level; BPE
    with a word-end suffix; special tokens found in the raw text; no decoder (tokens joined by one space).
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.texts = {i: t for t, i in (self.ids | self.special).items()}
        self.names = {i: str(i) for i in self.texts}
        self.symbols = byte_symbols()
        size = max(self.texts) + 1
        self.size = size
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = self.ids[a], self.ids[b], self.ids[a + b]
            if max(made.get(left, -1), made.get(right, -1)) >= rank or new in made:
                raise ValueError("a merge uses a symbol that a later one makes, or makes one twice")
            made[new] = rank
            self.merges[left * size + right] = (rank, new)
        self.pairs = {rank: (key // size, key % size, new) for key, (rank, new) in self.merges.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.raw_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                         + ")") if self.special else None
        self.first = np.array([self.ids[c] for c in self.symbols], dtype=np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in self.symbols], dtype=np.int64)
        edge = int(max(self.first.max(), self.last.max())) + 2  # index -1 meets a row and column without pairs
        self.table = np.full((edge, edge), -1, dtype=np.int32)
        for rank, (left, right, _) in self.pairs.items():
            if left < edge - 1 and right < edge - 1:
                self.table[left, right] = rank

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character (no rule for the final sigma)."""
        from unicodedata import normalize

        return normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space (no word has any) and around special tokens, which stand as they are."""
        if self.raw_special is not None and any(t in text for t in self.special):
            parts = self.raw_special.split(text)
            return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):  # str.split takes these for white space, the format does not
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def split(self, piece: str) -> list[str]:
        """The words of a piece."""
        if piece.isascii():
            low = piece.lower()
            return [low] if low.isalpha() else [piece] if piece in self.special else self.words.findall(low)
        return [piece] if piece in self.special else self.words.findall(self.normal(piece))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words in one pass over the ascending ranks."""
        merges, size, pairs, get = self.merges, self.size, self.pairs, self.merges.get
        if not words:
            return []
        raw = np.frombuffer(b"\xff".join([w.encode("utf-8") for w in words]) + b"\xff", dtype=np.uint8)
        ends = np.flatnonzero(raw == 255)  # a byte that UTF-8 never has
        start = self.first[raw]
        start[ends - 1] = self.last[raw[ends - 1]]
        start[ends] = -1  # between words; in no pair
        ranks = self.table[start[:-1], start[1:]]  # -1 takes the last row and column, which hold no pair
        ranked = np.flatnonzero(ranks >= 0)
        ranked = ranked[np.argsort(ranks[ranked], kind="stable")]
        found, cuts = np.unique(ranks[ranked], return_index=True)
        at = {int(r): p.tolist() for r, p in zip(found, np.split(ranked, cuts[1:]), strict=True)} if len(ranked) else {}
        sym = start.tolist()
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        active = list(at)
        heapq.heapify(active)
        gone = -2
        while active:
            rank = heapq.heappop(active)
            a, b, new = pairs[rank]
            places = at.pop(rank)
            places.sort()
            base = new * size
            for i in places:
                j = nxt[i]
                if sym[i] != a or sym[j] != b:
                    continue  # an overlapping place was merged before
                sym[i] = new
                sym[j] = gone
                k = nxt[j]
                nxt[i] = k
                prv[k] = i
                right = sym[k]
                if right >= 0:
                    m = get(base + right)
                    if m is not None:
                        m = m[0]
                        if m in at:
                            at[m].append(i)
                        else:
                            at[m] = [i]
                            heapq.heappush(active, m)
                h = prv[i]
                if h >= 0:
                    left = sym[h]
                    if left >= 0:
                        m = get(left * size + new)
                        if m is not None:
                            m = m[0]
                            if m in at:
                                at[m].append(h)
                            else:
                                at[m] = [h]
                                heapq.heappush(active, m)
        final = np.array(sym)
        kept = final[final != gone]
        stops = np.flatnonzero(kept == -1).tolist()
        flat = kept.tolist()
        out, begin = [], 0
        for stop in stops:
            out.append(flat[begin:stop])
            begin = stop + 1
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as a vocabulary without a decoder gives them."""
        return " ".join([self.texts[i] for i in ids])


Entry = tuple[int, str, str]  #: number of ids, ids joined by spaces, their texts joined by spaces


class Kept:
    """What was met lately: two generations of at most ``bound`` entries."""

    def __init__(self, bound: int):
        self.bound = bound
        self.young: dict[str, Entry] = {}
        self.old: dict[str, Entry] = {}

    def again(self, key: str) -> Entry | None:
        """An entry of the older generation, which it leaves."""
        found = self.old.get(key)
        if found is not None:
            self.young[key] = found
        return found

    def age(self) -> None:
        """Let the older generation go if the younger is full."""
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young


class Coder:
    """Encodes texts within a task, keeping pieces and words met lately."""

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHED):
        self.vocabulary = vocabulary
        self.words, self.pieces = Kept(cached), Kept(cached)

    def learn(self, wanted: list[str]) -> dict[str, Entry]:
        """The entries of these pieces, encoding words that are not kept."""
        v, special = self.vocabulary, self.vocabulary.special
        split = [v.split(p) for p in wanted]
        words: dict[str, Entry] = {}
        new = []
        young, again = self.words.young, self.words.again
        for w in set().union(*split):
            found = young.get(w) or again(w)
            if found is not None:
                words[w] = found
            elif w in special:
                words[w] = (1, str(special[w]), w)
            else:
                new.append(w)
        names, texts = v.names, v.texts
        for w, ids in zip(new, v.encode_words(new), strict=True):
            words[w] = young[w] = (len(ids), " ".join([names[i] for i in ids]), " ".join([texts[i] for i in ids]))
        self.words.age()
        pieces, out = self.pieces.young, {}
        for p, own in zip(wanted, split, strict=True):
            if len(own) == 1:
                out[p] = pieces[p] = words[own[0]]
            else:
                got = [words[w] for w in own]
                out[p] = pieces[p] = (sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))
        return out

    def texts(self, texts: list[str]) -> Iterator[Entry]:
        """(number of ids, ids joined by a space, decoded text) of each text."""
        cut = [self.vocabulary.pieces(t) for t in texts]
        get, again = self.pieces.young.get, self.pieces.again
        met = [[get(p) for p in pieces] for pieces in cut]
        short = [i for i, got in enumerate(met) if None in got]
        missing = {p for i in short for p, g in zip(cut[i], met[i], strict=True) if g is None}
        if missing:
            found = {p: again(p) for p in missing}
            found |= self.learn([p for p, g in found.items() if g is None])
            for i in short:
                met[i] = [found[p] if g is None else g for p, g in zip(cut[i], met[i], strict=True)]
            self.pieces.age()
        for got in met:
            yield sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])


def _vocabulary_file(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(counts: list[int], joined: list[str]) -> pa.Array:
    """Lists of ids from ids joined by spaces."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    values = np.fromstring(" ".join([j for j in joined if j]), dtype=np.int32, sep=" ")  # numbers, no string objects
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
           digests: bool = False, cached: int = CACHED) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, and ``ids`` (array) with ``decoded``, or with ``digests`` only
    their SHA-256, as ``ids_sha256`` (ids joined by one space) and ``decoded_sha256`` (decoded text in UTF-8).  A task
    keeps ``cached`` pieces and words that are in use.

    The vocabulary is a file of the driver, a few MB whatever the data, and is broadcast.  Null and empty texts have no
    ids and decode to the empty text; repeated rows stay; a text of any length is encoded whole.
    """
    shared = _vocabulary_file(docs.sparkSession, vocabulary_path)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(shared.value), cached)  # goes with the task: workers live on, and may do other things next
        digest = lambda t: hashlib.sha256(t.encode("utf-8")).hexdigest()
        for batch in batches:
            for part in chunks(batch, 1, _CHUNK):
                counts, first, second = [], [], []
                for n, ids, text in coder.texts(texts_of(part)):
                    counts.append(n)
                    first.append(digest(ids) if digests else ids)
                    second.append(digest(text) if digests else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()),
                     pa.array(first, pa.string()) if digests else _lists(counts, first), pa.array(second, pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"])

    from pyspark.sql import functions as F

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(run), f"id {kind}, n_tokens bigint, ids {'string' if digests else 'array<int>'}, decoded string")
    if digests:
        return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
    return out.toDF(id_col, "n_tokens", "ids", "decoded")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids (null: empty text); unknown ids raise."""
    shared = _vocabulary_file(encoded.sparkSession, vocabulary_path)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            texts = [vocabulary.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    from pyspark.sql import functions as F

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        trimmed(run), f"id {kind}, decoded string").withColumnRenamed("id", id_col)
