"""Personal data: patterns propose spans, validators confirm them, words nearby move the score.

Every pattern is run so that it takes time in proportion to the text, whatever the text holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import chunks, texts_of, trimmed

KINDS = ("email", "ip", "card", "phone", "iban")  #: in the order used where spans start together
CONTEXT_CHARS = 48  #: how far around a span context words count
BASE_SCORE = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
STEP = 0.2  #: what a supporting word adds and a contrary word takes away
CONTEXT = {
    "email": (("mail", "contact", "correo", "courriel"), ()),
    "ip": (("ip", "address", "host", "server", "adresse"), ("version", "release", "section")),
    "card": (("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"), ("isbn", "order", "serial", "id")),
    "phone": (("phone", "call", "tel", "mobile", "fax", "telefon"), ("version", "code")),
    "iban": (("iban", "bank", "account", "konto", "compte", "cuenta"), ()),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: characters of an account number by country
_IBAN_LENGTH = {c: n for n, several in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in several.split()}
_DIGITS = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """From each ``@``: leftwards over the local part (not into the last match), rightwards over a dotted domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if place % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def ibans(text: str) -> list[tuple[int, int]]:
    """Where a country, check digits and groups begin: up to the end of a group that makes a valid number.

    The pattern also takes upper-case words and numbers behind it, so every end of a group counts: the country's length
    first, then the others from the longest.  What begins inside a rejected stretch is tried for itself.
    """
    out, found = [], _IBAN.search(text)
    while found:
        start, stop = found.span()
        usual, end, size, rest = _IBAN_LENGTH.get(text[start:start + 2]), None, 4, 0
        # mod-97: country and check digits moved behind, letters as 10 to 35, remainder 1
        head = _DIGITS[text[start]] * 10000 + _DIGITS[text[start + 1]] * 100 + int(text[start + 2:start + 4])
        for at in range(start + 4, stop):
            if text[at] == " ":
                continue
            value = _DIGITS[text[at]]
            rest = (rest * (100 if value > 9 else 10) + value) % 97
            size += 1
            if size >= 15 and (at + 1 == stop or text[at + 1] == " ") and (rest * 1_000_000 + head) % 97 == 1:
                end = at + 1
                if size == usual:
                    break
        if end:
            out.append((start, end))
        found = _IBAN.search(text, end or start + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
        out += [(s, 4, e) for s, e in ibans(text)]
    out.sort()
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's base score, one step up for supporting and down for contrary words nearby, within 0 to 1."""
    around = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(around)}
    good, bad = CONTEXT[kind]
    value = BASE_SCORE[kind] + STEP * any(w in words for w in good) - STEP * any(w in words for w in bad)
    return round(min(1.0, max(0.0, value)), 6)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        for part in chunks(batch, 1):
            rows = [[{"start": s, "kind": k, "end": e, "score": score(t, KINDS[k], s, e)} for s, k, e in spans(t)]
                    for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["id", "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans`` (start, kind number, end, score), by start and then kind.

    Offsets are code points, ends exclusive.  Null and empty texts have none; repeated rows stay.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(_scan), f"id {kind}, spans array<struct<start:bigint,kind:int,`end`:bigint,score:double>>"
    ).withColumnRenamed("id", id_col)


def span_text(found) -> "F.Column":
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"],
                                                                 s["end"])), ",")
