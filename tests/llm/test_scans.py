"""URL rules, secrets and personal data against plain readings of their definitions."""

import random
import re

import pytest

from framelake.llm import pii, secrets, url_filter

HOSTS = ["net", "example.net", "a.example.net", "example.com", "b.c.example.com", "org", "x.org", "Xnet", "EXAMPLE.NET:80"]
PATHS = ["", "/", "/en/", "/en", "/de/5?x=/fr/", "/fr/#a", "?net/", "/EN/"]
URLS = [f"https://{h}{p}" for h in HOSTS for p in PATHS] + [None, "", "net/", "ftp://", "://net/", "a://b://net/"]


def plain_verdict(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best[0] if best else None, best[1] if best else default


@pytest.mark.parametrize("inline", [64, 0])
def test_url_rules(spark, inline):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    pages = spark.createDataFrame(list(enumerate(URLS)) * 2, "page_id bigint, url string")
    got = url_filter.judge(pages, rules, inline=inline).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], rules, "allow"), r["url"]


def test_rarest_token_files_a_rule():
    filed = url_filter.index([("example.net/en/", "allow", 1), ("net/ab", "block", 1), ("/", "block", 1)],
                             {"example": 9, "net": 5, "en": 2, "ab": 1})
    assert set(filed) == {"en", "net", ""}  # ab may be the start of a longer run


def test_no_python_in_the_url_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = url_filter.judge(pages, [("net/", "block")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def random_texts(alphabet, words, n=1500):
    draw = random.Random(4)
    return ["".join(draw.choice(words) if draw.random() < 0.4 else draw.choice(alphabet)
                    for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_secret_base_spans():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    words = ["token", "Secret", "passWd=", "api_key: ", "apikey", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "= ", '"', "abcdefgh"]
    for text in random_texts("=: '\"aF9-Zé\n", words):
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secrets.base_spans(text) == sorted(want), text


def test_weak_parts_need_a_complement(spark):
    far = "\n" * 3 + "x" * 500
    texts = ["user = alice\nurl postgres://db.example.com/x", "user = alice only", "user = alice" + far + " postgres://db/x",
             "see postgres://db.example.com/x and wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    got = {r["doc_id"]: r for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    kinds = {i: sorted(secrets.KINDS[s["kind"]] for s in r["linked"]) for i, r in got.items()}
    assert kinds == {0: ["linked_endpoint", "linked_id"], 1: [], 2: [], 3: ["linked_endpoint", "linked_secret"]}


def test_weak_parts_of_any_length(spark):
    long = "https://store.example.com/a?" + "x" * 900 + "&signature=abc"
    name = "account: " + "n" * 700
    hexed = "0123456789abcdef" * 60
    texts = [f"user = alice {long} end", f"{name} {hexed}", f"{hexed}{' ' * 400}user = robert", f"{hexed}{' ' * 401}user = robert",
             f"user = robert{' ' * 400}{hexed}", f"user = robert{' ' * 401}{hexed}", f"{long}\nlogin: carol"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: sorted(texts[r["doc_id"]][s["start"]:s["end"]] for s in r["linked"]) for r in secrets.find(docs).collect()}
    assert got == {0: sorted([long, "user = alice"]), 1: [name], 2: ["user = robert"], 3: [], 4: ["user = robert"], 5: [],
                   6: sorted([long, "login: carol"])}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_personal_data_base_spans():
    words = ["a@b.c", "x.y@", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-6789", "+", "@", "00"]
    for text in random_texts("0123456789.-@ +()ab%\n", words):
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                 if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            want += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and plain_luhn(d) else []
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                 if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [s for s in pii.spans(text) if s[1] < 4] == sorted(want), text


def test_iban_and_context():
    text = "bank account GB82 WEST 1234 5698 7654 32 here, not GB82 WEST 1234 5698 7654 33"
    found = [s for s in pii.spans(text) if s[1] == 4]
    assert [text[s:e] for s, _, e in found] == ["GB82 WEST 1234 5698 7654 32"]
    assert pii.score(text, "iban", found[0][0], found[0][2]) == 1.0
    assert pii.score("version 1.2.3.4", "ip", 8, 15) == 0.3


@pytest.mark.parametrize(("text", "want"), [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 EUR 20", ["DE89370400440532013000"]),
    ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]),
    ("FILE AB12 2024 DE89 3704 0044 0532 0130 00 OK", ["DE89 3704 0044 0532 0130 00"]),
    ("NO93 8601 1117 947 NOK 500", ["NO93 8601 1117 947"]),
    ("DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX", []),
])
def test_iban_before_other_words(text, want):
    assert [text[s:e] for s, kind, e in pii.spans(text) if kind == 4] == want
