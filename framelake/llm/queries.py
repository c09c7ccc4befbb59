"""The named queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import (bpe, decontaminate, jaccard_join, language_id, line_dedup, main_text, periodic, pii, quality_net,
                           quality_rules, secrets, spelling, url_filter)
from framelake.llm.common import table
from framelake.llm.labelled import folded

#: Rules that the url query applies, and the patterns where none of them fits.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL_PATTERNS = [("spam*.*/", "block"), ("adult*.*/", "block"), ("casino*.*/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    judged = url_filter.judge(table(spark, d, "pages").select("page_id", "url"), URL_RULES, URL_PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


def op2_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), tokenizer_path(), digests=True, cached=bpe.CACHED_ALONE)


def op4_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.find(table(spark, d, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.size("linked").cast("bigint").alias("n_linked"),
                        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.span_text(F.concat("base", "linked")).alias("spans"))


def op5_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(table(spark, d, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
                        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"),
                        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, d, "labels")))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_net.Model:
    """The network with labels of the rows that are not held out."""
    return quality_net.fit(docs, labels, allowed=folded("id", 3) != 1)


def op7_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.link(table(spark, d, "documents"), words=4, percent=85)


def op8_quality_net(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = quality_net.score(docs, quality_model(docs, table(spark, d, "labels")))
    return scored.select("doc_id", F.coalesce(folded("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = language_id.fit(docs, allowed=F.coalesce(folded("doc_id", 5) != 0, F.lit(False)))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(folded("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred",
                        "score", "bits_per_char", "rejected")


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    done = line_dedup.drop_lines(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that op11's contract asks for: where h = crc32(doc_id) is a multiple of 10, the words from
    a = (h div 10) mod n on repeat the first 1 + (n - a) div (3 + (h div 10) mod 8) of them.  Null ids change nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), F.when(
        (h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    sized = planted.withColumn("a", F.expr("if(size(w) > 0, cast(g % size(w) as int), null)"))
    period = sized.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    again = F.expr("flatten(array_repeat(slice(w, a + 1, p), cast(ceil((size(w) - a) / p) as int)))")
    text = F.array_join(F.concat(F.expr("slice(w, 1, a)"), F.slice(again, F.lit(1), F.expr("size(w) - a"))), " ")
    return period.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic.find(with_planted_periods(table(spark, d, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", periodic.strongest(F.col("runs")).alias("r")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "r.start", "r.length", "r.period",
        F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_typing_errors(doc_id: object) -> Callable[[str], str]:
    """The change of words that op12's contract asks for: with h = crc32 of ``<doc_id>:<word>`` a multiple of 97, the
    word loses its code point h % length.  Null ids change nothing."""
    if doc_id is None:
        return lambda word: word
    before = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), before)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1:]

    return change


def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.group(table(spark, d, "documents"), change=planted_typing_errors)


def op13_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    urls = pages.select("page_id", "url", "html")
    found = main_text.extract(urls.select(F.struct("page_id", "url").alias("page"), "html"), "page")
    return found.select("page.page_id", "page.url", F.col("main_text").alias("text"),
                        F.length("main_text").cast("bigint").alias("n_chars"))


_LINE_SQL = r"""
with lines as (
  select row, doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos
  from (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents)
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select k.*, f.key is not null and k.doc_id <> f.keeper as gone from keyed k left join frequent f using (key)
)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by row, doc_id
"""

_LINK_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from words
), sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from pairs join sizes p on x = p.doc_id join sizes q on y = q.doc_id where 100 * k >= 85 * (p.n + q.n - k)
), ways as (select x, y from links union all select y, x from links),
reach(d, c) as (select doc_id, doc_id from documents union select r.d, b.y from reach r join ways b on r.c = b.x)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(n_links, 0) as n_links
from documents d left join sizes using (doc_id)
  left join (select d as doc_id, min(c) as component_id from reach group by d) using (doc_id)
  left join (select x as doc_id, count(*) as n_links from ways group by x) using (doc_id)
"""

_URL_SQL = r"""
with parts as (
  select page_id, coalesce(url, '') as u, position('://' in coalesce(url, '')) as pos from pages
), cut as (
  select page_id, case when pos > 0 then substring(u, pos + 3) else '' end as rest from parts
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut
), fits as (
  select *, (host = 'net' or host like '%.net') and starts_with(path, '/') as r1,
    (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') as r2,
    (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') as r3,
    (host = 'org' or host like '%.org') and starts_with(path, '/fr/') as r4,
    regexp_matches(host || path, '(?s)^([^/]*\.)?spam[^/]*\.[^/]*/') as p1,
    regexp_matches(host || path, '(?s)^([^/]*\.)?adult[^/]*\.[^/]*/') as p2,
    regexp_matches(host || path, '(?s)^([^/]*\.)?casino[^/]*\.[^/]*/') as p3 from split
), ruled as (
  select *, case when r3 then 'example.com/de/' when r2 then 'example.net/en/' when r4 then 'org/fr/' when r1 then 'net/' end as rule from fits
)
select page_id, host, path, rule,
  case when rule is not null then null when p3 then 'casino*.*/' when p2 then 'adult*.*/' when p1 then 'spam*.*/' end as pattern,
  case when rule in ('example.com/de/', 'net/') then 'block' when rule is not null then 'allow'
    when p1 or p2 or p3 then 'block' else 'allow' end as verdict
from ruled
"""



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    named = [op1_url_filter, op2_decontaminate, op3_bpe, op4_secrets, op5_pii, op6_quality_rules, op7_jaccard_join,
             op8_quality_net, op9_language_id, op10_line_dedup, op11_periodic_runs, op12_spelling_variants,
             op13_main_text]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _URL_SQL, "op7_jaccard_join": _LINK_SQL, "op10_line_dedup": _LINE_SQL}
