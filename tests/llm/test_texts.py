"""Coding, counting, models, deduplication and decontamination against brute force, a library or held-out rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from framelake.llm import (bpe, components, decontaminate, jaccard_join, language_id, line_dedup, quality_net,
                           quality_rules)
from framelake.llm.arrays import Texts
from framelake.llm.queries import tokenizer_path

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# ---- BPE -----------------------------------------------------------------------------------------------------------

def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    draw = random.Random(8)
    marks = [chr(c) for c in (*range(0, 592), *range(880, 1024), 0x2003, 0x3000, 0x1F600, 0x130, 0x3A3, 0x301, 0xAC00, 0x1161)]
    texts = ["".join(draw.choice(marks) if draw.random() < 0.4 else draw.choice("abc 'st're<|endoftext|>\n")
                     for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["", "<|endoftext|>", "a<|startoftext|>b", "don't WE'LL", "ΑΣ ΣΑΣ", "aaaaaaaaaa" * 9]
    with open(tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()), cached=500)
    for text, (n, ids, decoded) in zip(texts, coder.texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False), repr(text)


def test_bpe_encodes_words_in_use_once(monkeypatch):
    """op3_bpe: words that came back after 100,000 others were encoded again."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()), bpe.CACHED_ALONE)
    met, encode = [], coder.vocabulary.encode_words
    monkeypatch.setattr(coder.vocabulary, "encode_words", lambda words: met.extend(words) or encode(words))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(330_000)]
    parts = [" ".join(words[i:i + 30_000]) for i in range(0, len(words), 30_000)]
    first = [list(coder.texts([p]))[0] for p in parts]
    assert [list(coder.texts([p]))[0] for p in parts] == first and len(met) == len(words)


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(1, "The thing is <|endoftext|> 42 things!"), (2, None)], "doc_id bigint, text string")
    coded = bpe.encode(docs, tokenizer_path())
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, tokenizer_path()).collect()}
    assert again == {r["doc_id"]: r["decoded"] for r in coded.collect()} and again[2] == ""
    digests = {r["doc_id"]: r for r in bpe.encode(docs, tokenizer_path(), digests=True).collect()}
    for r in coded.collect():
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()


# ---- quality -------------------------------------------------------------------------------------------------------

def test_base_counts():
    draw = random.Random(1)
    texts = []
    for _ in range(300):
        vocabulary = ["a", "bb", "é#", "|", "x<y>"][: draw.randint(1, 5)]
        texts.append("".join(draw.choice(vocabulary) + draw.choice(" \n\t ") for _ in range(draw.randint(0, 60))))
    got = quality_rules.base_counts(texts, Texts(texts))
    for i, t in enumerate(texts):
        words = words_of(t)
        windows = [tuple(words[j:j + 8]) for j in range(len(words) - 7)]
        seen, inside, lines = Counter(windows), set(), []
        for j, w in enumerate(windows):
            inside |= set(range(j, j + 8)) if seen[w] > 1 else set()
        for line in t.split("\n"):
            lines += [line] if words_of(line) else []
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def junk_and_prose(n, seed):
    draw = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ing", "ou", "ti"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    rows = []
    for i in range(n):
        good = draw.random() < 0.7
        words = [word() for _ in range(draw.randint(30, 120))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + draw.choice(["***", "###", "!!"]) for w in words), int(good)))
    return rows


@pytest.mark.parametrize("kind", ["net", "rules"])
def test_held_out_quality(spark, kind):
    rows = junk_and_prose(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0], "doc_id bigint, quality int")
    if kind == "net":
        scored = quality_net.score(docs, quality_net.fit(docs, labels, per_class=100))
    else:
        scored = quality_rules.judge(docs, quality_rules.fit(docs, labels, per_class=100)).withColumnRenamed("probability", "score")
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all(0 <= p <= 1 for p in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in rows if i % 2]) > 0.97


# ---- language ------------------------------------------------------------------------------------------------------

def test_trigrams_of_letters():
    draw = random.Random(3)
    reader = language_id.Reader()
    for _ in range(100):
        texts = ["".join(draw.choice("ab é,.\n3𝒜😀ß") for _ in range(draw.randint(0, 8))) for _ in range(draw.randint(1, 6))]
        code, n = language_id.trigrams(*reader.read(texts))
        want, sizes = [], []
        for t in texts:
            s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).strip(" ")
            s = f" {s} " if s else ""
            grams = [(ord(s[i]) << 42) | (ord(s[i + 1]) << 21) | ord(s[i + 2]) for i in range(len(s) - 2)]
            want += grams
            sizes.append(len(grams))
        assert code.tolist() == want and n.tolist() == sizes


def test_probabilities_add_up():
    import pyarrow as pa

    text = " abra kadabra bar "
    grams = Counter((ord(text[i]) << 42) | (ord(text[i + 1]) << 21) | ord(text[i + 2]) for i in range(len(text) - 2))
    model = language_id.build(pa.table({"lang": ["x"] * len(grams), "code": list(grams), "n": list(grams.values())}))
    scorer = language_id.Scorer(model)
    letters = sorted({ord(c) for c in text})
    code = np.array([(ord("a") << 42) | (ord("b") << 21) | c for c in letters], dtype=np.uint64)
    at = scorer.place["tri"][language_id._slot(code)]
    bi = code & np.uint64((1 << 42) - 1)
    backed = scorer._rows("after2", code >> np.uint64(21), 0.0) + np.where(
        np.isnan(known := scorer._rows("bi", bi, np.nan)),
        scorer._rows("after1", bi >> np.uint64(21), 0.0) + scorer._rows("uni", code & np.uint64((1 << 21) - 1), model.floor), known)
    total = sum(2.0 ** float(model.tri[1][a, 0] if a >= 0 else b) for a, b in zip(at, backed[:, 0], strict=True))
    rest = 2.0 ** float(scorer._rows("after2", code[:1] >> np.uint64(21), 0.0)[0, 0]
                        + scorer._rows("after1", bi[:1] >> np.uint64(21), 0.0)[0, 0] + model.floor[0])
    assert abs(total + rest - 1) < 1e-5  # all letters met, and one never met


def test_held_out_languages(spark):
    draw = random.Random(6)
    kinds = {"aa": "la le mo ni to".split(), "bb": "sch ung er ich pf".split(), "cc": "qx zy wv".split()}
    rows = [(i, " ".join("".join(draw.choice(kinds[k]) for _ in range(draw.randint(1, 4))) for _ in range(8)), k)
            for i in range(300) for k in [draw.choice(list(kinds))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, allowed=docs["doc_id"] % 2 == 0)).collect()
    truth = {i: k for i, _, k in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and r["score"] > 0.5 for r in got if r["doc_id"] % 2)


def test_no_trigram_is_lost_or_taken_for_another():
    import pyarrow as pa

    draw = np.random.default_rng(4)
    code = np.unique(draw.integers(0, 1 << 63, 200_000).astype(np.uint64))
    counts = {"lang": ["x"] * len(code), "code": code.astype(np.int64), "n": np.ones(len(code), np.int64)}
    scorer = language_id.Scorer(language_id.build(pa.table(counts)))
    assert len(scorer.model.tri[0]) == len(code)
    assert sorted(scorer.place["tri"][language_id._slot(code)].tolist()) == list(range(len(code)))
    never = np.setdiff1d(draw.integers(0, 1 << 63, 50_000).astype(np.uint64), code)
    assert (scorer.place["tri"][language_id._slot(never)] == -1).all()


def test_model_in_tables_is_the_model_in_memory(spark):
    draw = random.Random(7)
    word = lambda low: "".join(chr(low + draw.randrange(300)) for _ in range(draw.randint(1, 5)))
    rows = [(i % 90, " ".join(word(low) for _ in range(draw.randint(0, 30))), lang)
            for i in range(100) for lang, low in [draw.choice([("aa", 0x4E00), ("bb", 0x4E80), (None, 0xAC00)])]]
    docs = spark.createDataFrame([*rows, (None, None, "aa"), (200, "...", "bb")], "doc_id bigint, text string, lang string")
    held, joined = (language_id.fit(docs, allowed=docs["doc_id"] % 3 != 0, **how) for how in ({}, {"cells": 500}))
    assert held.rest is None and joined.rest is not None and len(joined.tri[0]) == 250
    assert held.sharpness == joined.sharpness and np.allclose(held.limits, joined.limits, rtol=1e-4)
    plain = lambda m: sorted(([*r] for r in language_id.identify(docs, m).collect()), key=str)
    for a, b in zip(plain(held), plain(joined), strict=True):
        assert [a[0], a[1], a[4]] == [b[0], b[1], b[4]] and np.allclose(a[2:4], b[2:4], rtol=1e-3), (a, b)


# ---- deduplication -------------------------------------------------------------------------------------------------

def plain_lines(rows, least=40, docs=5):
    key = lambda line: line.strip(" \t\n\r\v\f").translate(LOWER)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("how", [{}, {"broadcast_decisions": -1}, {"twice_bits": 64}])
def test_lines(spark, how):
    draw = random.Random(2)
    pool = [("  " if draw.random() < 0.3 else "") + "Line é %d " % i + "x" * draw.randint(25, 40) for i in range(30)]
    pool += [p.upper() + "\t" for p in pool[:10]]
    rows = [(i, "\n".join(draw.choice(pool) if draw.random() < 0.7 else "own %d" % draw.random()
                          for _ in range(draw.randint(0, 6)))) for i in range(60)] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(docs, **how).collect()}
    assert got == plain_lines(rows)


def plain_links(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    group, degree = {i: i for i in sets}, Counter()

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                degree[a] += 1
                degree[b] += 1
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), degree[i]) for i in ids}


def near_copies():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    doc = lambda n: [draw.choice(vocabulary) for _ in range(n)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return words

    hot, shared = doc(150), doc(50)
    texts = [edited(hot, draw.randint(0, 9)) for _ in range(120)]
    for _ in range(40):
        base = doc(draw.choice([1, 3, 5, 12, 30, 45, 200, 600]))
        texts += [edited(base, draw.randint(0, 2)) for _ in range(draw.randint(1, 6))]
    texts += [doc(draw.randint(20, 200)) + shared + doc(30) for _ in range(40)]
    texts = [" ".join(t) for t in texts] + ["", None, "a b c", "A  B\tC", "a b c d"]
    return list(enumerate(texts + texts[:20]))


@pytest.mark.parametrize(("k", "percent", "how"), [(4, 85, {}), (5, 80, {"block_sets": 16, "twice_bits": 1 << 12})])
def test_jaccard_links(spark, k, percent, how):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.link(docs, words=k, percent=percent, **how).collect()}
    assert got == plain_links(rows, k, percent)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["v"]: r["component"] for r in components.components(links).collect()}
    assert len(got) == 43 and len({got[i] for i in range(41)}) == 1 and got[100] == got[101] != got[0]


def test_boundary_follows_the_lists():
    assert jaccard_join.boundary(0.0, 85) < jaccard_join.boundary(3.0, 85) < jaccard_join.boundary(50.0, 85)


# ---- decontamination -----------------------------------------------------------------------------------------------

def test_contaminated_windows():
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [" ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 4, 5, 9, 20, 44]))) for _ in range(40)]
    items += ["", items[5]]
    texts = []
    for _ in range(250):
        words = draw.choice(items).split()
        for _ in range(draw.randint(0, 3)):
            if words:
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        pad = lambda: [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        texts.append(" ".join(pad() + words + pad()).upper())
    got = {(t, i): (round(s, 9), w) for t, i, s, w in decontaminate.Index(list(range(42)), items).scan(texts)}
    want = {}
    for t, text in enumerate(texts):
        words = words_of(text.translate(LOWER))
        for i, item in enumerate(items):
            own = item.split()
            for s in range(len(words) - len(own) + 1) if own else ():
                x = decontaminate.similarity([w.encode() for w in words[s:s + len(own)]], [w.encode() for w in own])
                if x >= 0.8 and x > want.get((t, i), (0, 0))[0]:
                    want[t, i] = (x, s)
    assert got == {k: (round(s, 9), w) for k, (s, w) in want.items()}


def test_everything_within_the_radius_is_a_candidate():
    draw = np.random.default_rng(1)
    texts = [" ".join(f"q{i}" for i in draw.integers(0, 50, 12)) for _ in range(60)]
    index = decontaminate.Index(list(range(60)), texts)
    items, own, _ = index.lengths[12]
    windows = own[draw.integers(0, 60, 200)] ^ (draw.integers(0, 1 << 63, 200).astype(np.uint64)
                                                & draw.integers(0, 1 << 63, 200).astype(np.uint64))
    near = set(index.near(12, windows))
    assert near == {(w, int(items[c])) for w in range(200) for c in range(60) if bin(int(windows[w]) ^ int(own[c])).count("1") <= 20}


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(i, f"alpha beta gamma delta item{i} word{i} end{i}") for i in range(9)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"x y alpha beta gamma delta item{i} word{i} end{i} z") for i in range(9)] + [(50, "clean")],
                                 "doc_id bigint, text string")
    got = decontaminate.find(docs, items, at_once=4).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got) == [(i, i, 2) for i in range(9)]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items, at_once=4).collect()] == [50]
