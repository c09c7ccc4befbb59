"""The registered text queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import os
import re

import pytest
from check import compare

from framelake.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, Q.queries()[name], Q.oracle_sql()[name], SMALL) is None


def test_pipeline(spark):
    import corpus_pipeline as P
    from test_texts import plain_lines, plain_links

    from framelake.llm import decontaminate
    from framelake.llm.common import table
    from framelake.session import stage

    docs = table(spark, SMALL, "documents")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    columns, seen = docs.columns, [texts(docs)]
    for name, step in P.STAGES[:-1]:
        docs = stage(step(spark, docs, SMALL), "t")
        assert docs.columns == columns, name
        seen.append(texts(docs))
    raw, good, deduped, alone, clean = seen
    quality = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    assert sum(quality.get(i) == 1 for i in raw.keys() - good.keys()) <= 2
    assert deduped == {i: t for i, (t, _, _) in plain_lines(list(good.items())).items()}
    groups = plain_links(list(deduped.items()), 5, 80)
    assert alone == {i: t for i, t in deduped.items() if groups[i][1] == i}
    items = [re.findall(r"\S+", r["text"].lower()) for r in table(spark, SMALL, "benchmark").collect()]
    dirty = {i for i, t in alone.items() for item in items if any(
        decontaminate.similarity([w.encode() for w in words[s:s + len(item)]], [w.encode() for w in item]) >= 0.8
        for words in [t.lower().split()] if set(item) & set(words)
        for s in range(len(words) - len(item) + 1) if len(set(words[s:s + len(item)]) & set(item)) > len(set(item)) / 2)}
    assert clean == {i: t for i, t in alone.items() if i not in dirty}
    out = P.STAGES[-1][1](spark, docs, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and {r["doc_id"] for r in out.collect()} == set(clean)
