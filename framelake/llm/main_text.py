"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page.  The length of text over a sliding window of lines surges
where the article begins and dives where it ends; the text between is kept.  A line counts with its text outside links.
What is known not to be article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, by element or by words of their class, id or role) leaves empty lines, so the distribution dives there.  Where
a page marks its article (``article``, ``main`` or ``articleBody``), lines outside it count as empty and the lines inside
as long as the threshold at least, so every one of them lies behind the surge, however short.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from framelake.llm.common import map_texts

WINDOW = 3  #: lines whose lengths are summed
SURGE = 86  #: characters in a window with which text begins
_CHUNK = 1 << 20

#: Element names of the HTML standard.
_DROPPED = frozenset("head nav header footer aside form button select textarea fieldset menu dialog noscript template svg "
                     "math iframe object canvas audio video map".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())  # hold text without markup
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HOLDS = frozenset("html body article main section div table tbody thead tfoot ul ol dl blockquote figure details center "
                   "search hgroup".split()) | _DROPPED
_BREAKS = frozenset("article main section div table tbody thead tfoot tr caption ul ol li dl dt dd blockquote figure "
                    "figcaption details summary center address p pre h1 h2 h3 h4 h5 h6 hr hgroup body html search "
                    "option legend".split()) | _DROPPED
_SPACES = frozenset("br td th wbr img".split())
_ENDED = frozenset("li dt dd tr td th option".split())  #: ended by the next of their kind

#: Words that name what is not article.
_NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer foot masthead header "
    "topbar toolbar comment comments disqus respond replies reply share sharing social related recommended "
    "recommendations pagination pager login search copyright complementary contentinfo skip".split())
_OF_ARTICLE = frozenset("article post entry story".split())  #: with these, "header" and "foot" words name its own parts
_LAYOUT = frozenset("has with no without is not".split())  #: class words that begin so describe a layout

_TAG = re.compile(r"<(?:!--|[!?]|/?[A-Za-z]|/)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")  # a quote counts after an equals sign
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_END_RAW = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in _RAW}


class _Element:
    """An open element; ``dropped`` tells that it and what it holds is no article (``surely``: by its kind, not only by
    its class), ``marked`` that it marks one."""

    __slots__ = ("name", "dropped", "surely", "marked", "parent", "muted")

    def __init__(self, name: str, dropped: bool, surely: bool, marked: int, parent: _Element | None):
        self.name, self.dropped, self.surely, self.marked, self.parent = name, dropped, surely, marked, parent
        self.muted = dropped and name not in _BREAKS or parent is not None and parent.muted  # noise within a line


class _Line:
    __slots__ = ("parts", "linked", "holder")

    def __init__(self, holder: _Element | None):
        self.parts: list[str] = []
        self.linked = 0
        self.holder = holder


def _describes_noise(attributes: dict[str, str]) -> bool:
    for value in (attributes.get("class", ""), attributes.get("id", ""), attributes.get("role", "")):
        for name in value.split():
            words = _WORD.findall(_HUMP.sub(" ", name).lower())
            if not words or words[0] in _LAYOUT:
                continue
            found = _NOT_TEXT.intersection(words)
            if found and not (found <= {"header", "foot", "footer"} and _OF_ARTICLE.intersection(words)):
                return True
    return False


def lines_of(page: str) -> list[_Line]:
    """The page's blocks in order, dropped ones as empty lines."""
    out = [_Line(None)]
    holder: _Element | None = None
    names: Counter[str] = Counter()
    links = 0
    at, size = 0, len(page)
    last = page.rfind(">")  # behind it no tag ends

    def add(text: str) -> None:
        if holder is not None and holder.muted:
            return
        line = out[-1]
        line.parts.append(text)
        if links:
            line.linked += len(text)

    def leave() -> None:
        nonlocal holder
        names[holder.name] -= 1
        holder = holder.parent

    while at < size:
        found = _TAG.search(page, at) if at < last else None
        if found is None:
            add(page[at:])
            break
        start = found.start()
        if start > at:
            add(page[at:start])
        kind = found.group()
        if kind == "<!--":
            end = page.find("-->", start + 2)  # "<!-->" is a whole comment
            at = end + 3 if end >= 0 else size
            continue
        if kind in ("<!", "<?", "</"):
            at = page.find(">", start) + 1 or size
            continue
        rest = _REST.match(page, start)
        end = rest.end() - 1 if rest else page.find(">", start)
        closing = kind[1] == "/"
        name = _NAME.match(page, start + (2 if closing else 1)).group().lower()
        tag, at = page[start:end], end + 1
        if name in _SPACES:
            add(" ")
        if closing:
            if name == "a":
                links = 0
            if names[name]:
                while holder.name != name:
                    leave()
                leave()
                if name in _BREAKS:
                    out.append(_Line(holder))
            elif name in _BREAKS:
                out.append(_Line(holder))
            continue
        if name == "a":
            links = 1
        if name in _BREAKS:
            links = 0
        if holder is not None and (holder.name == "p" and name in _BREAKS or holder.name == name and name in _ENDED):
            leave()
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(tag)} if "=" in tag else {}
        if name in _RAW:
            close = _END_RAW[name].search(page, at)
            at = page.find(">", close.end()) + 1 or size if close else size
            continue
        sure = name in _DROPPED
        noise = not sure and name not in ("html", "body", "main") and _describes_noise(attributes)
        if (name in _HOLDS or noise or names[name]) and name not in _VOID:
            marked = (3 if attributes.get("itemprop", "").lower() == "articlebody" else 2 if name == "article" else
                      1 if name == "main" or attributes.get("role", "").lower() == "main" else 0)
            marked = 0 if noise or sure else marked
            if marked:  # what holds the article is not noise, whatever its class says
                above = holder
                while above is not None and above.dropped and not above.surely and not above.marked:
                    above.dropped = False
                    above = above.parent
            holder = _Element(name, sure or noise, sure, marked, holder)
            names[name] += 1
        if name in _BREAKS:
            out.append(_Line(holder))
    return out


def _standing(element: _Element | None, known: dict[int, tuple[bool, int]]) -> tuple[bool, int]:
    """Whether an element or one around it is dropped, and the strongest mark of an article on it or around it."""
    path = []
    while element is not None and id(element) not in known:
        path.append(element)
        element = element.parent
    state = known[id(element)] if element is not None else (False, 0)
    for e in reversed(path):
        state = (state[0] or e.dropped, max(state[1], e.marked))
        known[id(e)] = state
    return state


def between(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and the dive that follows.

    Text begins with the first line that is not empty in a window whose lengths sum up to ``surge`` or more and goes on up to the first
    window without any; the empty lines of that window are not part of it.  If no window surges, the stretch between
    empty windows with most text is taken.
    """
    n = len(lengths)
    total = np.concatenate(([0], np.cumsum(lengths)))
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:-1]
    alive = np.concatenate(([False], sums > 0, [False]))
    edge = np.diff(alive.astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.zeros(n, dtype=bool)
    if not len(begins):
        return keep
    best = np.array([sums[b:e].max() for b, e in zip(begins, ends, strict=True)])
    chosen = np.flatnonzero(best >= surge)
    if not len(chosen):
        chosen = [int(np.argmax(total[ends] - total[begins]))]
    for k in chosen:
        b, e = int(begins[k]), int(ends[k])
        strong = np.flatnonzero(sums[b:e] >= surge)
        b += int(strong[0]) if len(strong) else 0
        keep[b + int(np.argmax(lengths[b:e] > 0)):e] = True
    return keep


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page, its blocks joined by line ends."""
    known: dict[int, tuple[bool, int]] = {}
    rows: list[tuple[str, int, int]] = []
    for line in lines_of(page):
        dropped, marked = _standing(line.holder, known)
        text = "" if dropped else " ".join(unescape("".join(line.parts)).split())
        rows.append((text, max(0, len(text) - line.linked) if not dropped else -1, marked))
    strongest = max((m for text, _, m in rows if text), default=0)
    texts, lengths = [], []
    for text, free, marked in rows:
        if free < 0:  # a dropped line cuts the distribution
            texts.append("")
            lengths.append(0)
            if len(lengths) < window or any(lengths[-window:]):
                texts += [""] * (window - 1)
                lengths += [0] * (window - 1)
        elif text:
            texts.append(text)
            lengths.append(0 if marked < strongest else max(free, surge) if strongest else free)
    keep = between(np.array(lengths, dtype=np.int64), window, surge)
    return "\n".join(t for t, k, n in zip(texts, keep.tolist(), lengths, strict=True) if k and t and (n or not strongest))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: the id and ``main_text``, the article's blocks joined by line ends (empty if there is none).

    Within a block character references are decoded and white space becomes one space.  Null and empty pages have the
    empty text; repeated rows stay; other columns are ignored; pages are read whole, in time that follows their length.
    """
    return map_texts(pages, id_col, html_col, "main_text string",
                     lambda: lambda texts: [[main_text(t) for t in texts]], limit=_CHUNK)
