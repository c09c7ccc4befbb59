"""Size-aware heavy-light Jaccard join of word n-gram sets, and the groups it links.

Sets are cut to prefixes under one global order of shingles, rare before frequent.  Small sets enumerate the 2-subsets of
prefixes of which linked sets share two shingles; large sets enter inverted lists with the single shingles of longer
prefixes, of which linked sets share a fifth of their size, and sets that share fewer with all others are out; the size
boundary is where enumerating would cost more than scanning lists of the mean length.  A pair of Bloom filters
drops signatures that occur once before anything is shuffled.  The sets of a list meet around the list's most shared
set, in blocks of bounded size and of like set sizes; each block counts all its overlaps with matrix products, holds
them to the exact threshold, and returns a spanning set of links and link counts, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelake.llm.arrays import Texts, mix, owner
from framelake.llm.common import chunks, texts_of, trimmed
from framelake.llm.components import components
from framelake.llm.twice_filter import PACKED, TWICE_BITS, pack, slices_for, suspected, twice_seen
from framelake.session import stage

WORDS = 4
PERCENT = 85
COUNTER_BITS = 18  #: shingle frequencies are kept in 2^18 counters (1 MB) at any size of the input
BLOCK_SETS = 512  #: sets and shingles of a block, which is what one task compares with another block at a time
BLOCK_SHINGLES = 1 << 20
_COUNTER_ROW = 1 << 10
_CHUNK = 2 << 20


def shingle_sets(texts: list[str], words: int, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, and how many each text has.

    Shingles are runs of ``words`` lower-cased (A-Z) words; fewer words make one shingle, none make none.  Within a
    text they ascend, by the frequency level of their counter first where levels are given.
    """
    laid = Texts(texts, lower=True)
    starts, ends, n_words = laid.words()
    hashed = laid.hashes(starts, ends)
    if not len(hashed):
        return hashed, n_words
    own = owner(n_words)
    n = len(hashed)
    rolled = np.zeros(n, dtype=np.uint64)
    last_of = np.cumsum(n_words)[own]  # one past the last word of the text
    place = np.arange(n)
    for i in range(words):
        inside = place + i < last_of
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15)
        rolled[inside] += hashed[np.minimum(place + i, n - 1)][inside]
    whole = (place + words <= last_of) | (place == last_of - n_words[own])
    e, own = mix(rolled[whole]), own[whole]
    key = e if level is None else (level[_counter(e)].astype(np.uint64) << np.uint64(56)) | (e >> np.uint64(8))
    order = np.lexsort((key, own))
    e, own = e[order], own[order]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e[1:] != e[:-1]) | (own[1:] != own[:-1])
    return e[new], np.bincount(own[new], minlength=len(texts))


def _counter(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def set_hashes(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, the same for equal sets."""
    total = np.zeros(len(n) + 1, dtype=np.uint64)
    run = np.concatenate(([np.uint64(0)], np.cumsum(mix(e ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)))
    ends = np.cumsum(n)
    total = run[ends] - run[ends - n]
    return mix(total + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n shares at least with any set it links to."""
    return (percent * n + 99) // 100


def boundary(mean_list: float, percent: int) -> int:
    """The largest set size for which its 2-subsets are no more than the list entries its prefix would scan."""
    best = 1
    for n in range(2, 2000):
        p1 = n - int(least_overlap(np.array(n), percent)) + 1
        if (p1 + 1) * p1 // 2 <= p1 * (1 + mean_list):
            best = n
    return best


def listed_overlap(n):
    """How many prefix shingles a listed set of n counts on sharing: one, and a fifth of its size."""
    return n // 5 + 1


def signatures(e: np.ndarray, n: np.ndarray, bound: int,
               percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, leading) of all texts: 2-subsets of the prefix for sets up to ``bound``, single shingles of it
    for sets that a larger one may link to.

    Two sets that share ``least_overlap`` shingles share k of the first n - least_overlap + k of each, for any k; linked
    sets share a leading signature, as those are all 2-subsets and the shingles of the prefix for k = 1.
    """
    first = np.cumsum(n) - n
    rest = n - least_overlap(n, percent)
    listed = np.flatnonzero((n > 0) & ((n == 1) | (100 * n >= percent * (bound + 1))))
    counts = (rest + listed_overlap(n))[listed]
    own = [np.repeat(listed, counts)]
    at = np.repeat(first[listed] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    sig = [mix(e[at] ^ np.uint64(0x8EBC6AF09C88C6E3))]
    lead = [at - first[own[0]] <= rest[own[0]]]
    small = np.flatnonzero((n > 1) & (n <= bound))
    for p in np.unique(rest[small] + 2).tolist():
        these = small[rest[small] + 2 == p]
        left, right = np.triu_indices(p, 1)
        rows = e[first[these][:, None] + np.arange(p)]
        a, b = np.minimum(rows[:, left], rows[:, right]), np.maximum(rows[:, left], rows[:, right])
        sig.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + b).ravel())
        own.append(np.repeat(these, len(left)))
        lead.append(np.ones(len(own[-1]), dtype=bool))
    return np.concatenate(own), np.concatenate(sig), np.concatenate(lead)


def needed(n: np.ndarray, bound: int, percent: int) -> np.ndarray:
    """How many signatures of other sets a set must have to link to any of them at all.

    A linked set has ``least_overlap`` shingles at least, and the lower count of the two holds.
    """
    return np.where(n > bound, listed_overlap(least_overlap(n, percent)), 1)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """Rows (id, v, n) of all texts, and rows (block, counts) with each task's counters."""
    kind = docs.dtypes[0][1]
    empty_type = to_arrow_type(docs.schema[0].dataType)  # of a task without rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        id_type = empty_type
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in chunks(batch, 1, _CHUNK):
                e, n = shingle_sets(texts_of(part), words)
                counted += np.bincount(_counter(e), minlength=len(counted))
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(set_hashes(e, n), mask=n == 0), pa.array(n, pa.int64()),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["id", "v", "n", "block", "counts"])
        blocks = counted.astype(np.uint32).reshape(-1, _COUNTER_ROW)
        met = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(met), id_type), pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.int64()),
             pa.array(met, pa.int32()), pa.array([blocks[i].tobytes() for i in met], pa.binary())],
            names=["id", "v", "n", "block", "counts"])

    return docs.mapInArrow(trimmed(run), f"id {kind}, v bigint, n bigint, block int, counts binary")


def _frequencies(sizes: DataFrame) -> np.ndarray:
    """All tasks' counters added up: 2^18 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in held:
                    held[k] = np.zeros(_COUNTER_ROW, dtype=np.int64)
                held[k] += np.frombuffer(raw, np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())],
            names=["block", "counts"])

    rows = sizes.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(
        trimmed(run), "block int, counts binary").toArrow()
    out = np.zeros((1 << COUNTER_BITS) // _COUNTER_ROW * _COUNTER_ROW, dtype=np.int64).reshape(-1, _COUNTER_ROW)
    for k, raw in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, np.int64)
    return out.ravel()


def levels(counted: np.ndarray) -> np.ndarray:
    """A frequency level for each counter: 0 up to its usual spread about the mean, then one more for each doubling."""
    mean = counted.mean() if len(counted) else 0.0
    over = np.maximum((counted - mean) / (4 * np.sqrt(mean) + 1), 0)
    return np.minimum(np.floor(np.log2(1 + over)), 63).astype(np.uint8)


def mean_list(counted: np.ndarray) -> float:
    """How many other sets a shingle of a prefix is in, on the mean: what the counters of rare shingles spread more than
    shingles of one set each would."""
    rare = counted[levels(counted) == 0].astype(np.float64)
    total = rare.sum()
    return max(0.0, float(((rare - rare.mean()) ** 2 - rare.mean()).sum() / total)) if total else 0.0


def _wanted(sizes: DataFrame, bound: int, percent: int) -> int:
    """How many signatures all texts have together."""
    rest = F.expr(f"n - ({percent} * n + 99) div 100")
    singles = F.when((F.col("n") == 1) | (100 * F.col("n") >= percent * (bound + 1)),
                     rest + F.floor(F.col("n") / 5) + 1).otherwise(0)
    subsets = F.when((F.col("n") > 1) & (F.col("n") <= bound), (rest + 2) * (rest + 1) / 2).otherwise(0)
    row = sizes.filter("n > 0").agg(F.sum(singles + subsets).alias("k")).first()
    return int(row["k"] or 0)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
         twice_bits: int = TWICE_BITS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``n_links``.

    Two rows link when 100 * intersection >= percent * union of their shingle sets.  ``component_id`` is the smallest
    id reachable by links, itself included; ``n_links`` the number of rows linked to it.  Null and empty texts, and
    texts of white space only, have no shingles and link with nothing.  Equal sets count as one vertex and are never
    paired up.  Null ids take part, but never name a component; it is null if no other id is reachable.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = stage(_sizes(base, words), "sizes")
    counted = _frequencies(sizes)
    level = spark.sparkContext.broadcast(levels(counted))
    bound = boundary(mean_list(counted), percent)
    rows = sizes.filter("block IS NULL").select("id", "v", "n")
    slices = slices_for(_wanted(rows, bound, percent))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, _CHUNK):
                e, n = shingle_sets(texts_of(part, 0), words, level.value)
                first = _first_rows(set_hashes(e, n))
                own, sig, _ = signatures(e, n, bound, percent)
                yield pack(sig[first[own]], slices)

    twice = spark.sparkContext.broadcast(twice_seen(base.select("text").mapInArrow(trimmed(send), PACKED), slices, twice_bits))

    def involve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, _CHUNK):
                e, n = shingle_sets(texts_of(part, 0), words, level.value)
                v = set_hashes(e, n)
                first = _first_rows(v)
                own, sig, lead = signatures(e, n, bound, percent)
                total = np.bincount(own, minlength=len(n))
                hit = first[own]
                hit[hit] = suspected(twice.value, sig[hit])
                met = np.bincount(own[hit], minlength=len(n))
                hit &= lead & (met >= needed(n, bound, percent))[own]
                own, sig = own[hit], sig[hit]
                order = np.argsort(own, kind="stable")
                own, sig = own[order], sig[order]
                texts, at = np.unique(own, return_index=True)
                begin = np.cumsum(n) - n
                lone = (1000 * (total[texts] - met[texts]) // np.maximum(total[texts], 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[texts]), pa.array(n[texts], pa.int64()), pa.array(lone),
                     pa.array([x.view(np.int64) for x in np.split(sig, at[1:])] if len(texts) else [],
                              pa.list_(pa.int64())),
                     pa.array([_packed(e[begin[t]:begin[t] + n[t]]) for t in texts.tolist()], pa.binary())],
                    names=["v", "n", "lone", "sigs", "members"])

    involved = stage(base.select("text").mapInArrow(
        trimmed(involve), "v bigint, n bigint, lone int, sigs array<bigint>, members binary"), "involved")
    vertices = stage(rows.filter("v IS NOT NULL").groupBy("v").agg(
        F.min("id").alias("least"), F.count("*").alias("copies")), "vertices")
    found = stage(_compare(involved, vertices, percent, block_sets), "found")
    parts = components(found.filter("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("v").agg(F.sum("links").alias("links"))
    placed = (vertices.join(parts, "v", "left").join(linked, "v", "left")
              .withColumn("component", F.coalesce("component", "v")))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stage(placed.join(named, "component").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    out = rows.filter("v IS NOT NULL").join(classes, "v").select("id", "n", "component_id", "n_links")
    alone = rows.filter("v IS NULL").select("id", "n", F.col("id").alias("component_id"),
                                            F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone).toDF(id_col, "n_shingles", "component_id", "n_links")


def _first_rows(v: np.ndarray) -> np.ndarray:
    """True for the first of equal sets within a chunk."""
    out = np.zeros(len(v), dtype=bool)
    out[np.unique(v, return_index=True)[1]] = True
    return out


def _packed(e: np.ndarray) -> bytes:
    """Six bytes of each hash."""
    return np.ascontiguousarray(e.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _compare(involved: DataFrame, vertices: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """(v, root, links): for every set and block that it was compared in, the smallest set it is connected to there,
    and how many rows it links to that no earlier list's block counts."""
    # a set that several tasks met is here once for each of them
    entries = stage(involved.select("v", "n", "lone", F.explode("sigs").alias("sig")).groupBy("v", "sig").agg(
        F.first("n").alias("n"), F.first("lone").alias("lone")), "entries")
    hubs = stage(entries.groupBy("sig").agg(F.min(F.struct("lone", "v")).alias("hub"), F.count("*").alias("k"))
                 .filter("k > 1").select("sig", F.col("hub.v").alias("h")), "hubs")
    around = stage(entries.join(hubs, "sig").select("h", "v", "n").distinct(), "around")
    # sets that can link differ in size by the threshold's ratio at most, so by one band at most
    ratio = float(np.log(100 / (percent - 1)))
    banded = around.withColumn("band", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    spread = banded.select("h", "v", "n", "band", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn(
        "band", F.col("band") - F.col("up"))
    groups = stage(spread.groupBy("h", "band").agg(
        F.count("*").alias("k"), F.sum(1 - F.col("up")).alias("base"), F.sum("n").alias("size"))
        .filter("k > 1 AND base > 0").select("h", "band", F.greatest(
            F.ceil(F.col("k") / block_sets), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "groups")
    dealt = spread.join(groups, ["h", "band"]).withColumn(
        "block", F.expr("cast(pmod(xxhash64(v), blocks) as int)"))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "h", "band", "v", "up", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    lists = around.groupBy("v").agg(F.sort_array(F.collect_set("h")).alias("lists"))
    compared = dealt.select("v").distinct()
    sets = involved.select("v", "n", "members").join(compared, "v", "left_semi").dropDuplicates(["v"]).join(
        vertices.select("v", "copies"), "v").join(lists, "v")
    full = pairs.join(sets, "v")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        v, root, links = compare_block(
            key[0].as_py(), group.column("v").to_numpy(), group.column("n").to_numpy(),
            [_unpacked(m) for m in group.column("members").to_pylist()],
            group.column("lists").to_pylist(), group.column("copies").to_numpy(),
            group.column("up").to_numpy() == 1, group.column("block").to_numpy(),
            key[2].as_py() != key[3].as_py(), percent)
        return pa.table({"v": v, "root": root, "links": links})

    return full.groupBy("h", "band", "i", "j").applyInArrow(run, "v bigint, root bigint, links bigint")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of the sets share, for all of a block's sets."""
    m = len(sets)
    own = np.repeat(np.arange(m), [len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, own = elements[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], elements[1:] != elements[:-1])))
    counts = np.diff(np.concatenate((first, [len(elements)])))
    shared = np.zeros((m, m), dtype=np.float32)
    dense_from = max(8, m // 32)
    dense = np.flatnonzero(counts >= dense_from)
    for at in range(0, len(dense), 4096):
        some = dense[at:at + 4096]
        x = np.zeros((m, len(some)), dtype=np.float32)
        for c, (f, k) in enumerate(zip(first[some].tolist(), counts[some].tolist(), strict=True)):
            x[own[f:f + k], c] = 1
        shared += x @ x.T
    for k in range(2, dense_from):
        rows = first[counts == k]
        if len(rows):
            docs = own[rows[:, None] + np.arange(k)]
            for a in range(k):
                for b in range(a + 1, k):
                    flat = np.bincount(docs[:, a] * m + docs[:, b], minlength=m * m).reshape(m, m)
                    shared += (flat + flat.T).astype(np.float32)
    return shared


def compare_block(h: int, v: np.ndarray, n: np.ndarray, sets: list[np.ndarray], lists: list[list[int]],
                  copies: np.ndarray, up: np.ndarray, block: np.ndarray, crossing: bool, percent: int):
    """Links among one block's sets, or between two blocks' sets where ``crossing``."""
    shared = overlaps(sets)
    union = n[:, None] + n[None, :] - shared
    linked = (100 * shared >= percent * union) & ~(up[:, None] & up[None, :])
    if crossing:
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    root = np.arange(len(v))
    order = np.argsort(v)
    rank = np.empty(len(v), dtype=np.int64)
    rank[order] = np.arange(len(v))
    label = rank.copy()
    while True:  # each set takes the smallest label beside it until nothing changes
        beside = np.where(linked, label[None, :], len(v)).min(axis=1, initial=len(v))
        new = np.minimum(label, beside)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    root = v[order[label]]
    earlier: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for x in own:
            if x >= h:
                break
            earlier.setdefault(x, []).append(i)
    for rows in earlier.values():  # pairs of a list before this one are counted there
        if len(rows) > 1:
            linked[np.ix_(rows, rows)] = False
    return v, root, (linked @ copies.astype(np.int64)).astype(np.int64)
