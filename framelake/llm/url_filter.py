"""URL filter: rules indexed by their rarest literal token, regular expressions only on fetched candidates.

A rule is ``host/path``: it fits its host and all subdomains where the url's path starts with the rule's path; ``*``
stands for any run of characters.  Each rule is filed under one of the tokens (runs of ASCII letters and digits) that
every url it fits must contain whole (or, for lack of one, must begin a token with), the one that fewest urls have.  A url's own tokens fetch the rules filed under
them, and only those rules' regular expressions run.  DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import free_names
from framelake.session import stage

INLINE_TOKENS = 64  #: up to so many index tokens the index is a literal inside the scan stage
BROADCAST_RULES = 200_000  #: up to so many rules the index is broadcast, beyond it is shuffled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<length:int,rule:string,verdict:string,kind:int,regex:string>"


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def tokens(target: Column, beginnings: list[int] = ()) -> Column:
    """The distinct runs of ASCII letters and digits, their beginnings of the given lengths (marked by a star), and the
    empty token that files rules without any."""
    whole = F.split(target, "[^0-9A-Za-z]+")
    parts = [F.transform(whole, _begin(n)) for n in beginnings]
    return F.array_distinct(F.concat(whole, *parts, F.array(F.lit(""))))


def _begin(length: int):
    return lambda token: F.concat(F.left(token, F.lit(length)), F.lit("*"))


def compile_rule(rule: str) -> tuple[str, list[str]]:
    """The regular expression over host + path, and the tokens every fitting url has whole, or if there is none the
    literals that tokens of every fitting url begin with (``spam*``)."""
    head, slash, tail = rule.partition("/")
    head = head.translate(str.maketrans(_UPPER, _LOWER))
    quote = lambda text, gap: gap.join(re.escape(x) for x in text.split("*"))
    regex = "^(?:[^/]*\\.)?" + quote(head, "[^/]*") + ("(?:/|$)" if not slash else "/" + quote(tail, ".*"))
    text = f".{head}/{tail if slash else ''}"
    found = [m for m in re.finditer("[0-9A-Za-z]+", text) if text[m.start() - 1] != "*"]
    whole = [m[0] for m in found if m.end() < len(text) and text[m.end()] != "*"]
    begun = [m[0] + "*" for m in found if m.end() == len(text) or text[m.end()] == "*"]
    return "(?s)" + regex, list(dict.fromkeys(whole)) or list(dict.fromkeys(begun)) or [""]


def beginnings(wanted: list[str]) -> list[int]:
    """The lengths of the token beginnings among index tokens."""
    return sorted({len(t) - 1 for t in wanted if t.endswith("*")})


def index(rules: list[tuple[str, str, int]], counts: dict[str, int]) -> dict[str, list[tuple]]:
    """Rules filed under their rarest token: token -> (length, rule, verdict, kind, regex)."""
    filed: dict[str, list[tuple]] = {}
    for rule, verdict, kind in rules:
        regex, whole = compile_rule(rule)
        token = min(whole, key=lambda t: (t == "", counts.get(t, 0), t))
        filed.setdefault(token, []).append((len(rule), rule, verdict, kind, regex))
    return filed


def token_counts(pages: DataFrame, url_col: str, wanted: list[str]) -> dict[str, int]:
    """In how many rows of the whole table each wanted token occurs; at most one row per wanted token is collected."""
    spark = pages.sparkSession
    asked = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = (pages.select(F.explode(tokens(F.concat(host(url_col), path(url_col)), beginnings(wanted))).alias("token"))
            .groupBy("token").count())
    found = seen.join(F.broadcast(asked) if len(wanted) <= BROADCAST_RULES else asked, "token", "left_semi")
    return {r["token"]: r["count"] for r in found.collect()}


def _best(candidates: Column) -> Column:
    """The winning candidate: exact rules before patterns, then the longest, then the smallest text."""
    return F.array_max(candidates)


def judge(pages: DataFrame, rules: list[tuple[str, str]], patterns: list[tuple[str, str]] = (), default: str = "allow",
          url_col: str = "url", inline: int = INLINE_TOKENS, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``pattern`` and ``verdict`` (replacing columns of these names).

    ``rules`` and ``patterns`` are (rule, verdict) pairs.  The longest fitting rule decides; where no rule fits, the
    longest fitting pattern; else ``default``.  ``rule`` is null unless a rule decided, ``pattern`` unless a pattern
    did.  Null urls and urls without ``://`` have empty host and path and get the default.  Repeated rows stay.
    """
    made = {"host", "path", "rule", "pattern", "verdict"}
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made or c == url_col])
    listed = [(r, v, 1) for r, v in rules] + [(p, v, 0) for p, v in patterns]
    wanted = sorted({t for r, _, _ in listed for t in compile_rule(r)[1]} - {""})
    filed = index(listed, token_counts(base, url_col, wanted) if wanted else {})
    own = free_names(base, "won")[0]
    out = (base.withColumn(own, _inline(filed, url_col)) if len(filed) <= inline else
           _joined(base, filed, url_col, broadcast_rules, own))
    kind, verdict = F.col(f"{own}.kind"), F.col(f"{own}.verdict")
    return out.select(*[F.col(f"`{c}`") for c in base.columns], host(url_col).alias("host"), path(url_col).alias("path"),
                      F.when(kind == 1, F.col(f"{own}.rule")).alias("rule"),
                      F.when(kind == 0, F.col(f"{own}.rule")).alias("pattern"),
                      F.coalesce(verdict, F.lit(default)).alias("verdict"))


def _order(c: Column) -> Column:
    """A struct that sorts as the rules rank."""
    return F.struct(c["kind"].alias("kind"), c["length"].alias("length"), c["rule"].alias("rule"),
                    c["verdict"].alias("verdict"))


def _inline(filed: dict[str, list[tuple]], url_col: str) -> Column:
    """Few index tokens: one array of (token, rules) literals; a url takes the rules of the tokens it has."""
    target = F.concat(host(url_col), path(url_col))
    if not filed:
        return F.lit(None).cast("struct<kind:int,length:int,rule:string,verdict:string>")
    groups = []
    own = tokens(target, beginnings(list(filed)))
    for token, entries in sorted(filed.items()):
        tried = [F.when(target.rlike(regex), F.struct(F.lit(kind).alias("kind"), F.lit(length).alias("length"),
                                                      F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
                 for length, rule, verdict, kind, regex in entries]
        groups.append(F.when(F.array_contains(own, token), F.array_max(F.array(*tried))))
    return F.array_max(F.array(*groups))


def _joined(base: DataFrame, filed: dict[str, list[tuple]], url_col: str, broadcast_rules: int, own: str) -> DataFrame:
    """``base`` with the winner as ``own``.

    Many index tokens: distinct urls meet the index in a hash join on the token; verdicts return to the rows.  Urls that
    make up a thousandth of all rows or more (so at most a thousand of them) get theirs from a broadcast, so that no
    task holds all copies of one url.
    """
    spark = base.sparkSession
    rows = [(t, *e) for t, entries in filed.items() for e in entries]
    table = spark.createDataFrame(rows, "token string,length int,rule string,verdict string,kind int,regex string")
    table = F.broadcast(table) if len(rows) <= broadcast_rules else table
    counted = base.filter(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n"))
    target = F.concat(host("url"), path("url"))
    fits = stage(counted.withColumn("target", target).withColumn("token", F.explode(tokens(target, beginnings(list(filed)))))
                 .join(table, "token").filter(F.expr("target rlike regex"))
                 .groupBy("url", "n").agg(F.max(F.struct("kind", "length", "rule", "verdict")).alias("won")), "judged-urls")
    total = base.count()
    at, second = free_names(base.withColumn(own, F.lit(0)), "at", "second")
    won_of = lambda some, name: some.select(F.col("url").alias(at), F.col("won").alias(name))
    hot = F.broadcast(won_of(fits.filter(F.col("n") * 1000 >= total), own))
    cold = won_of(fits.filter(F.col("n") * 1000 < total), second)
    first = base.join(hot, F.col(f"`{url_col}`") == F.col(at), "left").drop(at)
    rest = first.filter(F.col(own).isNull()).drop(own).join(cold, F.col(f"`{url_col}`") == F.col(at), "left")
    return first.filter(F.col(own).isNotNull()).unionByName(rest.drop(at).withColumnRenamed(second, own))
