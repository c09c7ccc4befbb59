"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

from framelake.llm import (bpe, decontaminate, jaccard_join, language_id, line_dedup, pii, quality_net, quality_rules,
                           secrets, url_filter)
from framelake.llm.queries import tokenizer_path

RULES = [("net/", "block"), ("a.b/c/", "allow")]


def one_for_each(docs, labels, items):
    return {
        "url": url_filter.judge(docs, RULES, url_col="text"),
        "url many": url_filter.judge(docs, RULES, url_col="text", inline=0),
        "bpe": bpe.encode(docs, tokenizer_path()),
        "secrets": secrets.find(docs),
        "pii": pii.find(docs),
        "rules": quality_rules.judge(docs, quality_rules.fit(docs, labels)),
        "jaccard": jaccard_join.link(docs),
        "net": quality_net.score(docs, quality_net.fit(docs, labels)),
        "language": language_id.identify(docs, language_id.fit(docs)),
        "lines": line_dedup.drop_lines(docs),
        "lines joined": line_dedup.drop_lines(docs, broadcast_decisions=-1, min_docs=2),
    }


def test_a_row_for_each_row(odd, labels, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the same text stands here twice,"), (3, "x")],
                                  "item_id bigint, text string")
    for name, out in one_for_each(odd, labels, items).items():
        rows = out.collect()
        assert len(rows) == 11, name
        ids = sorted((r["doc_id"] for r in rows), key=str)
        assert ids == sorted([0, 1, 2, None, 3, 3, 4, 5, 6, 7, 8], key=str), name
    hits = {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.find(odd, items).collect()}
    assert hits == {(3, 3, 6), (4, 3, 6), (7, 3, 1)}
    left = decontaminate.drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == 7


@pytest.mark.parametrize("empty_labels", [True, False])
def test_empty_tables(odd, labels, spark, empty_labels):
    none, items = odd.limit(0), spark.createDataFrame([], "item_id bigint, text string")
    for name, out in one_for_each(none, labels.limit(0) if empty_labels else labels, items).items():
        assert out.count() == 0, name
    assert decontaminate.find(odd, items).count() == 0 and decontaminate.find(none, items).count() == 0


def test_defined_results_for_empty_texts(odd, labels):
    got = {r["doc_id"]: r for r in jaccard_join.link(odd).collect()}
    assert [tuple(got[i])[1:] for i in (0, 1, 2)] == [(0, 0, 0), (0, 1, 0), (0, 2, 0)]
    assert got[4]["component_id"] == 3 and got[4]["n_links"] == 2 and got[None]["component_id"] is None
    lines = {r["doc_id"]: r for r in line_dedup.drop_lines(odd).collect()}
    assert (lines[0]["text"], lines[0]["n_lines"], lines[0]["n_dropped"]) == ("", 1, 0)
    langs = {r["doc_id"]: r for r in language_id.identify(odd, language_id.fit(odd)).collect()}
    assert all(langs[i]["lang_pred"] == "und" and langs[i]["score"] == 0 for i in (0, 1, 2, 8))
    assert langs[6]["lang_pred"] == "fr"
    coded = {r["doc_id"]: r for r in bpe.encode(odd, tokenizer_path()).collect()}
    assert all((coded[i]["n_tokens"], coded[i]["ids"], coded[i]["decoded"]) == (0, [], "") for i in (0, 1, 2))


def test_near_duplicates_by_row(spark, odd):
    import corpus_pipeline

    copy, near, own = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "a", "b"))
    near = near.replace("a59", "z")
    lone, twin = " ".join(f"c{i}" for i in range(20)), " ".join(f"d{i}" for i in range(20))
    rows = [(1, copy), (2, near), (2, own), (3, lone), (3, lone), (None, twin), (None, twin), (None, twin + " more"),
            (None, near), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string").repartition(16)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert out.columns == docs.columns and len([1 for i, t in got if i is None and t in (twin, twin + " more")]) == 1
    assert [r for r in got if r[0] is not None] == sorted(
        [(1, copy), (2, own), (3, lone), (4, ""), (4, ""), (5, None)], key=str) and len(got) == 7
    left = sorted((r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, odd, "").collect()), key=str)
    assert left == sorted([0, 1, 2, None, 3, 5, 6, 7, 8], key=str)
    assert corpus_pipeline.near_duplicates(spark, odd.limit(0), "").count() == 0


def test_columns_named_like_helpers_keep_their_values(spark):
    import corpus_pipeline

    names = ["won", "at", "second", "lost", "doc", "key", "__won", "__url", "__lost", "__doc", "__key", "won_", "key_"]
    line = "a line of some length that many documents have in common"
    rows = [(i, f"http://spam{i % 3}.example.net/x\n{line}\nown words {i} " + f"w{i} " * 30) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    patterns = [("spam*.*/", "block"), ("casino*.*/", "block")]
    for out in (url_filter.judge(docs, RULES, patterns, url_col="text"),
                url_filter.judge(docs, RULES, patterns, url_col="text", inline=0),
                line_dedup.drop_lines(docs, broadcast_decisions=-1), line_dedup.drop_lines(docs),
                corpus_pipeline.near_duplicates(spark, docs, "")):
        found = out.collect()
        assert len(found) == 6
        for r in found:
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in names)


def test_patterns_are_filed_under_what_tokens_begin_with(spark):
    assert url_filter.compile_rule("spam*.*/")[1] == ["spam*"]
    assert url_filter.compile_rule("*spam.net/")[1] == ["net"] and url_filter.compile_rule("*x*/")[1] == [""]
    urls = ["http://spammy.net/", "http://a.spam.org/x", "http://notspam.org/", "http://x.adults.com/spam", "http://spam/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "doc_id bigint, url string")
    patterns = [("spam*.*/", "block"), ("adult*.*/", "block")]
    for inline in (64, 0):
        got = {r["doc_id"]: r["pattern"] for r in url_filter.judge(pages, [], patterns, inline=inline).collect()}
        assert got == {0: "spam*.*/", 1: "spam*.*/", 2: None, 3: "adult*.*/", 4: None}
