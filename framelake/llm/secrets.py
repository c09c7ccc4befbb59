"""Secret scan with multipart linking.

Workers propose parts of credentials in each whole text: strong ones (assignments, access identifiers, long hex) are
reported as they are; weak ones (short assignments, key-like words, endpoints) only when a complementary part lies in
the same scope.  Parts are linked in Spark by an interval join: positions are cut into buckets as wide as the scope, a
part is filed under all buckets from its start to one behind its end, meets the starts of others there, and both are
held to the exact gap and line scope.  Parts have any length, and may overlap, as a user and a password within an
address do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import chunks, texts_of, trimmed

#: Order of kinds where spans start together: base kinds first, then linked ones.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint", "linked_id")
SCOPE_CHARS = 400  #: from the end of one part of a credential to the start of the other at most
SCOPE_LINES = 6  #: and at most so many line ends

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_BREAK = re.compile("\n")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: weak parts: a name of an account beside a value, a 40-character key word, an endpoint
_WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{4,})""", re.A | re.I)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}", re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong kinds, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(role, kind number, start, end): parts that count only together, and the strong ones in their roles."""
    weak = [("id", 5, m.start(), m.end()) for m in _WEAK_ID.finditer(text)] if ":" in text or "=" in text else []
    weak += [("secret", 3, m.start(), m.end()) for m in _WEAK_SECRET.finditer(text)
             if not m[0].isalpha() and not m[0].islower()]
    if "://" in text:
        weak += [("endpoint", 4, m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    if any(k in text.lower() for k in _KEYWORDS):
        taken = {s for s, kind, _ in strong if kind == 0}
        weak += [("secret", 3, m.start(), m.end()) for m in _ASSIGN.finditer(text)
                 if 4 <= len(m[2]) < 8 and m.start() not in taken]
    return [*weak, *(("id" if kind == 1 else "secret", kind, s, e) for s, kind, e in strong)] if weak else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            rows = {"base": [], "parts": []}
            for text in texts_of(part):
                strong = base_spans(text)
                parts = weak_parts(text, strong)
                roles = {p[0] for p in parts}
                if len(roles) < 2:
                    parts = []
                breaks = [m.start() for m in _BREAK.finditer(text)] if parts else []
                rows["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in strong])
                rows["parts"].append([{"role": r, "kind": k, "start": s, "end": e, "line": bisect_left(breaks, s)}
                                      for r, k, s, e in parts])
            span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
            piece = pa.struct([("role", pa.string()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                               ("line", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(rows["base"], pa.list_(span)), pa.array(rows["parts"], pa.list_(piece))],
                names=["id", "base", "parts"])


_SPANS = "array<struct<start:bigint,kind:int,`end`:bigint>>"
_PARTS = "array<struct<role:string,kind:int,start:bigint,`end`:bigint,line:bigint>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` spans and ``parts`` (empty unless two roles occur in the text).

    Null texts are empty and have neither.  Offsets are code points, ends exclusive.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(_scan), f"id {kind}, base {_SPANS}, parts {_PARTS}")


def link(parts: DataFrame, key: str = "row", scope_chars: int = SCOPE_CHARS, scope_lines: int = SCOPE_LINES) -> DataFrame:
    """Weak parts with a complementary part (another role) in scope: (key, start, kind, end), once each.

    ``parts`` has key, role, kind, start, end, line.  Of two parts in scope the one that starts later does so between
    the start of the other and ``scope_chars`` behind its end.  Interval join on position buckets: whichever part is
    weak, the earlier one stands in all buckets that it reaches and the later one in that of its start.
    """
    bucket = lambda place: F.floor(F.col(place) / scope_chars)
    reached = F.sequence(bucket("start"), bucket("end") + 1)
    at = lambda side, buckets: F.transform(buckets, lambda b: F.struct(F.lit(side).alias("side"), b.alias("bucket")))
    weak = parts.filter("kind >= 3").withColumn("at", F.explode(F.concat(at(0, reached), at(1, F.array(bucket("start"))))))
    other = parts.select(F.col(key).alias("o_key"), F.col("role").alias("o_role"), F.col("start").alias("o_start"),
                         F.col("end").alias("o_end"), F.col("line").alias("o_line"),
                         F.explode(F.concat(at(0, F.array(bucket("start"))), at(1, reached))).alias("o_at"))
    after = lambda later, start, end: (F.col(later) >= F.col(start)) & (F.col(later) - F.col(end) <= scope_chars)
    in_scope = F.when(F.col("at.side") == 0, after("o_start", "start", "end")).otherwise(after("start", "o_start", "o_end"))
    near = ((F.col(key) == F.col("o_key")) & (F.col("at.side") == F.col("o_at.side"))
            & (F.col("at.bucket") == F.col("o_at.bucket")) & (F.col("role") != F.col("o_role"))
            & in_scope & (F.abs(F.col("line") - F.col("o_line")) <= scope_lines))
    return weak.join(other, near, "left_semi").select(key, "start", "kind", "end").distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``linked`` spans (arrays of start, kind number, end).

    Repeated rows are scanned and linked each for itself; null ids are kept.
    """
    from framelake.session import stage

    found = stage(scan(docs, id_col, text_col), "secrets").withColumn(
        "row", F.when(F.size("parts") > 0, F.xxhash64("id", "base", "parts")))
    parts = found.filter("row IS NOT NULL").select("row", "parts").dropDuplicates(["row"]).select(
        "row", F.explode("parts").alias("p")).select("row", "p.*")
    linked = link(parts).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    with_parts = found.filter("row IS NOT NULL").join(linked, "row", "left")
    without = found.filter("row IS NULL").withColumn("linked", F.lit(None).cast(_SPANS))
    both = without.unionByName(with_parts)
    return both.select(F.col("id").alias(id_col), "base", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked"))


def span_text(spans) -> "F.Column":
    """``kind:start:end``, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")
