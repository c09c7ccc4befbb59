"""Periodic runs, spelling variants and main texts against brute force, on odd rows, and as registered queries."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelake.llm import main_text, periodic, spelling
from framelake.llm import queries as Q
from framelake.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
present = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def plain_runs(w, least=24, periods=3):
    out = set()
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                n = j - i + q
                if n >= max(least, periods * q) and not any(
                        all(w[k] == w[k + e] for k in range(i, i + n - e)) for e in range(1, q)):
                    out.add((i, n, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(rng):
    n, kinds = rng.choice([0, 5, 23, 24, 30, 100, 300, 700]), rng.choice([1, 2, 3, 5, 50])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 10:
            a, e = sorted(rng.sample(range(n + 1), 2))
            p = rng.randint(1, max(1, (n - a) // rng.randint(2, 10)))
            for i in range(a, e):
                words[i] = words[a + (i - a) % p]
    return words


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for prime, generator in periodic._PRIMES:
        for size in (1, 2, 8, 256):
            a, b = rng.integers(0, prime, (2, size, 3)).astype(np.uint64)
            got = periodic.transform(periodic.transform(a, prime, generator) * periodic.transform(b, prime, generator)
                                     % np.uint64(prime), prime, generator, inverse=True)
            for c in range(3):
                want = [sum(int(a[i, c]) * int(b[(k - i) % size, c]) for i in range(size)) % prime for k in range(size)]
                assert got[:, c].tolist() == want


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(25):
        texts = [made_words(rng) for _ in range(rng.randint(1, 9))]
        found = periodic.runs_of([periodic._numbered([w.encode() for w in t]) for t in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]
    assert periodic.runs_of([]) == []
    big = np.tile(np.arange(1, 60_001), 4)  # numbers whose squares need more than one prime
    assert periodic.runs_of([big])[0].tolist() == [[0, 240_000, 60_000]]
    with pytest.raises(ValueError):
        periodic.runs_of([big], least=10)


def test_runs_of_odd_rows(spark, odd):
    got = {r["doc_id"]: r for r in periodic.find(odd).collect()}
    assert periodic.find(odd).columns == ["doc_id", "n_words", "runs", "collapsed"] and len(got) == 10
    assert all((got[i]["n_words"], got[i]["runs"], got[i]["collapsed"]) == (0, [], "") for i in (0, 1, 2))
    assert got[5]["n_words"] == 60_000 and [tuple(r) for r in got[5]["runs"]] == []
    assert periodic.find(odd.limit(0)).count() == 0
    long = spark.createDataFrame([("a", "x y z " * 50_000), (None, "q\x1cq " * 24)], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in periodic.find(long).collect()}
    assert [tuple(r) for r in rows["a"]["runs"]] == [(0, 100_000, 2)] and rows["a"]["collapsed"] == "x y z"
    assert [tuple(r) for r in rows[None]["runs"]] == [(0, 24, 1)]


@present
def test_registered_runs(spark):
    docs = table(spark, SMALL, "documents").collect()
    got = {r["doc_id"]: r.asDict() for r in Q.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = WORD.findall(d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert got[d["doc_id"]] == {
            "doc_id": d["doc_id"], "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            "collapsed_sha256": sha(collapsed(words, runs))}


def test_strongest_run_is_exact(spark):
    from pyspark.sql import functions as F

    kind = "k int, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    rows = [(0, []), (1, [(0, 30, 9), (5, 40, 12), (9, 90, 27)]), (2, [(7, 24, 8), (3, 27, 9), (3, 30, 10)]),
            (3, [(0, 10**9, 3 * 10**8), (1, 10**9 + 1, 3 * 10**8)])]
    got = dict(spark.createDataFrame(rows, kind).select("k", periodic.strongest(F.col("runs"))).collect())
    assert got[0] is None and tuple(got[1]) == (0, 30, 9) and tuple(got[2]) == (3, 27, 9) and got[3][0] == 1


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=2):
    form, many = {}, {}
    one_off = {}
    for w in counts:  # words that share one with a letter left out are all that can be near
        for i in range(len(w)):
            one_off.setdefault(w[:i] + w[i + 1:], set()).add(w)
        one_off.setdefault(w, set()).add(w)
    for w in counts:
        around = set().union(*[one_off.get(w[:i] + w[i + 1:], set()) for i in range(len(w))], one_off.get(w, set()))
        close = [v for v in around if near(w, v)]
        many[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, many[w], counts[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("letters, large", [("ab", 16_384), ("abé", 10), ("abcdefgh", 100), ("ab漢", 3)])
def test_variants_equal_brute_force(spark, letters, large):
    rng = random.Random(len(letters) + large)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([3, 4, 6, 12, 25, 100])
              for _ in range(600)}
    words = spark.createDataFrame(list(counts.items()), "word string, n int").repartition(5)
    got = spelling.variants(words, large=large)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(counts)


def test_words_of_odd_rows(spark, odd):
    got = dict(spelling.count_words(odd, least_count=1).collect())
    assert got["twice"] == 3 and got["Ünïcode"] == 5 and got["thing"] > 5 and "élan" not in got
    assert spelling.group(odd.limit(0)).count() == 0
    none = spark.createDataFrame([(None, 7)], "word string, n bigint")
    assert spelling.variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(none, ratio=1)
    long = "q" * 5_000
    words = spark.createDataFrame([(long, 9), (long + "r", 4), (long[1:] + "s", 1)], "word string, n bigint")
    assert {(len(r["word"]), r["form"] == long, r["n_near"]) for r in spelling.variants(words).collect()} == {
        (5_000, False, 2), (5_001, True, 1), (5_000, True, 1)}


@present
def test_registered_variants(spark):
    counts = Counter()
    for d in table(spark, SMALL, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{d['doc_id']}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = Q.op12_spelling_variants(spark, SMALL)
    assert {tuple(r) for r in got.collect()} == plain_variants(counts)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def plain_article(page):
    """The text of the article of a test page, whose markup is known: h1, p, b, br."""
    if not page:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


@present
def test_registered_main_text(spark):
    pages = {r["page_id"]: r for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = Q.op13_main_text(spark, "/root/testdata/sf0.01")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = plain_article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


ARTICLE = "A long paragraph of the article goes on and on, as they do. " * 4


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p>short</p>", "short"), ("plain &amp; simple", "plain & simple"),
    (f"<header><h1>Site</h1></header><div class=menu><a href=x>a</a></div><h1>Title</h1><p>{ARTICLE}</p><p>End.</p>"
     f"<div id='footer'><p>{ARTICLE}</p></div>", f"Title\n{ARTICLE.strip()}\nEnd."),
    (f"<div class='has-sidebar'><article><p>One<br>two<p class=notice>Cookies!<p>a &lt; b&nbsp;c</article></div>"
     f"<p>{ARTICLE}", "One two\na < b c"),
    (f"<main><article><h2>T</h2><form><p>{ARTICLE}</form><ul><li>x<li>y</ul></article>"
     f"<section id=comments><article class='comment'><p>{ARTICLE}</article></section></main>", "T\nx\ny"),
    ("<article><p>a<span class=share>s <span>t</span> u</span> b<script>'</p>'+\"<p>\"</script> c</article>", "a b c"),
    ("<article>x <!-- <p>no</p> --><a title='>' href=\"q\">link</a> y</article>", "x link y"),
    (f"<div class=sidebar-page><article>in</article></div><aside>{ARTICLE}</aside>", "in"),
    (f"<ul>{'<li><a href=x>Some words that link away</a>' * 9}</ul><div><p>{ARTICLE}</div>"
     f"<ul>{'<li><a href=x>Some words that link away</a>' * 9}</ul>", ARTICLE.strip()),
])
def test_main_text(page, text):
    assert main_text.main_text(page) == text


def test_main_text_of_broken_and_long_pages(spark, odd):
    for page in ("<", "<a", '<a href="', "</", "<!--", "<" * 99_999, "<a " * 99_999, "</div>" * 99_999, "<div>" * 99_999,
                 '<a ="' * 99_999 + ">", "='\"" * 99_999, '<div class="ad">' * 9_999):
        main_text.main_text(page)
    got = {r["doc_id"]: r["main_text"] for r in main_text.extract(odd, "doc_id", "text").collect()}
    assert got[0] == got[1] == got[2] == "" and got[7] == "x" and len(got[5].split()) == 60_000
    assert main_text.extract(odd.limit(0), "doc_id", "text").count() == 0
    assert main_text.between(np.zeros(0, np.int64)).tolist() == []
    lengths = np.array([0, 3, 0, 0, 0, 40, 2, 50, 0, 0, 0, 9, 9, 0, 0, 0])
    assert np.flatnonzero(main_text.between(lengths)).tolist() == [5, 6, 7]
