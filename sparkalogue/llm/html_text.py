"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags.

A page is read as a sequence of words and tags. Words score positive and tags negative;
how much is learned from labelled pages: the log odds that a token of its kind stands in
the main text (a word in plain text, in a link; an opening or closing tag by name). Blocks
whose tag, class, id or role names page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments ...) are kinds too; where labelled pages hold such blocks
outside the main text only, their words count as tags do, and they aren't part of the text.
A name counts as a whole or as a part of a compound, unless another part denies it ("no-ads",
"with-sidebar"); some names count only for blocks of which a third are links. A block that holds
an article or main element, or most of the page's words outside links, is no furniture, but for
comments.
One linear scan finds the contiguous region with the largest sum; its words are the text.

Markup, scripts, styles and the page's head are never text. Character references are
decoded, white space inside a block becomes one space, blocks follow each other in page
order, joined by newlines. Null or empty html, and pages of nothing but furniture: empty text.
Malformed markup is read as far as it goes: unclosed tags end with the page, a tag without
an end is text, and pages of any length are read in time linear in it. Rows with equal ids are
pages each; columns other than page_id, url and html are ignored. An empty table gives no rows.
Of regions with equal sums the earliest counts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled_pages import PAGES

_MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*))")
_STOP = re.compile("[>\"']")
#: Elements whose content is never text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "canvas", "math"}
#: Elements beside RAW ones that a page's head may hold; any other ends a head that isn't closed.
IN_HEAD = {"meta", "link", "base", "basefont", "bgsound"}
#: Those that a slash may end at once.
FOREIGN = {"svg", "math"}
_HINTED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_PART = re.compile(r"[a-z]+")
#: Names of page furniture in class, id or role; kinds of block, whose weight the labelled pages give.
FURNITURE = {
    "menu": {"menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "skip", "topbar", "toolbar", "tabs"},
    "header": {"header", "masthead", "tagline", "banner", "logo"},
    "footer": {"footer", "copyright", "contentinfo", "imprint", "legal", "colophon"},
    "sidebar": {"sidebar", "aside", "widget", "complementary", "rail", "related", "recommended", "popular", "trending", "similar"},
    "notice": {"cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "overlay", "alert", "disclaimer"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "newsletter", "subscribe", "subscription"},
    "form": {"form", "login", "signin", "signup", "search", "searchbox"},
    "comment": {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion"},
    "share": {"share", "sharing", "social", "follow"},
}
#: Parts of a class name that say what a block lacks, or has beside its own content.
NEGATED = {"no", "not", "non", "without", "free", "with", "has", "is", "hide", "hidden", "show", "enabled", "disabled"}
#: Parts of a class name under which a header is an article's own.
CONTENT = {"entry", "post", "article", "story", "content"}
#: Elements that are furniture by name.
BY_NAME = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "dialog": "notice", "menu": "menu"}
#: Elements that hold an article whole whatever they are called.
WHOLE = {"html", "body", "main", "article"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Elements within a line; all others begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_SPACE = re.compile(r"\s+")
#: Least weight of a tag, against a plain word's of 1.
LEAST = 0.05
#: Names that blocks of text bear too; such a block is furniture only if a third of its words are links.
AMBIGUOUS = {"widget", "tabs", "popular", "similar", "trending", "rail", "banner", "search", "legal", "reply"}
#: A block of so many words outside links, and more than this share of the page's, is no furniture, but for comments.
LEAST_WORDS, MOST_WORDS = 50, 0.5
#: Kind of the furniture inside an article or main element: left out of the text, without a weight.
PASSED = "passed over"


@dataclass
class Token:
    kind: str  # what its weight is looked up by
    text: str = ""  # decoded characters of a text run
    block: bool = False  # begins or ends a block
    furniture: bool = False
    inside: bool = field(default=False, compare=False)  # between the marks of a labelled page


def furniture_of(name: str, attrs: str, linked: bool = True) -> str | None:
    """Kind of page furniture that an element is by its name, or by a name in its class, id or role.

    linked: whether a good part of its words are links, without which ambiguous names count for nothing.
    """
    if name in WHOLE:
        return None
    if name in BY_NAME:
        return BY_NAME[name]
    for m in _HINTED.finditer(attrs):
        for token in m[1].lower().strip("\"'").split():
            parts = set(_PART.findall(token))
            kind = None if parts & NEGATED else next((k for k, names in FURNITURE.items() if parts & (names if linked else names - AMBIGUOUS)), None)
            if kind and not (kind == "header" and parts & CONTENT):
                return kind
    return None


@dataclass
class Mark:
    """A run of text, a comment or a tag."""

    kind: str  # "text", "comment" or "tag"
    text: str = ""
    name: str = ""
    attrs: str = ""
    closing: bool = False
    single: bool = False


def marks_of(page: str) -> Iterator[Mark]:
    """The page from left to right; every character is looked at a bounded number of times."""
    at, tags_end, quoted, head = 0, True, True, False
    while at < len(page):
        start = page.find("<", at)
        if start != at and not head:
            yield Mark("text", page[at:] if start < 0 else page[at:start])
        if start < 0:
            return
        m = _MARK.match(page, start)
        if m is None:
            end = -1
        elif m["comment"]:
            end = page.find("-->", start + 2)  # <!--> is a whole one
            yield Mark("comment", page[m.end() :] if end < 0 else page[m.end() : end])
            at = len(page) if end < 0 else end + 3
            continue
        elif m["other"]:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            continue
        else:
            end = _tag_end(page, m.end(), quoted) if tags_end else -1
            if end < 0 and tags_end:
                # no end outside quotes: quotes count as plain characters from here on
                quoted, end = False, page.find(">", m.end())
                tags_end = end >= 0
        if end < 0:
            if not head:
                yield Mark("text", "<")
            at = start + 1
            continue
        name, attrs, closing = m["name"].lower(), page[m.end() : end], bool(m["close"])
        slash = attrs.rstrip().endswith("/")
        at = end + 1
        if name in RAW and not closing:
            if not (slash and name in FOREIGN):
                over = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = over.end() if over else len(page)
        elif name == "head":
            head = not closing
        elif name not in RAW and not (head and name in IN_HEAD):
            head = False
            yield Mark("tag", "", name, attrs, closing, name in VOID or slash)


def _tag_end(page: str, at: int, quoted: bool) -> int:
    """Where the tag's > stands, outside quotes; -1 if nowhere."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if quoted:
            close = page.find(m[0], at)
            if close < 0:
                return -1
            at = close + 1
    return -1


def _ends(marks: list[Mark]) -> list[int]:
    """Index of each opening tag's closing one, by the depth of its own name; the number of marks where it has none."""
    out, open_tags = [len(marks)] * len(marks), {}
    for i, m in enumerate(marks):
        if m.kind != "tag" or m.single:
            continue
        held = open_tags.setdefault(m.name, [])
        if not m.closing:
            held.append(i)
        elif held:
            out[held.pop()] = i
    return out


def tokens_of(page: str) -> list[Token]:
    out: list[Token] = []
    marks = list(marks_of(page))
    ends = _ends(marks)
    # index of the next opening tag of an article or main element
    following, upcoming = len(marks), [0] * len(marks)
    for i in range(len(marks) - 1, -1, -1):
        upcoming[i] = following
        if marks[i].name in ("article", "main") and not marks[i].closing:
            following = i
    # words outside and inside links before each mark
    plain, linked, link = [0], [0], 0
    for m in marks:
        words = len(m.text.split()) if m.kind == "text" else 0
        plain.append(plain[-1] + (0 if link else words))
        linked.append(linked[-1] + (words if link else 0))
        if m.name == "a":
            link = 0 if m.closing else 1
    kind, depth, name_open, links, inside = None, 0, "", 0, False
    article = whole = 0  # an article's own header holds its title; furniture inside a whole breaks no region
    for i, m in enumerate(marks):
        if m.kind == "comment":
            inside = True if m.text == "[" else False if m.text == "]" else inside
        elif m.kind == "text":
            run = html.unescape(m.text)
            out.append(Token(PASSED if kind and whole else f"word in {kind}" if kind else "word in link" if links else "word", run, False, kind is not None, inside))
        else:
            name, closing = m.name, m.closing
            found = None
            if kind is None and not closing and not m.single:
                own, own_linked = plain[ends[i]] - plain[i], linked[ends[i]] - linked[i]
                found = None if name == "header" and (article or whole) else furniture_of(name, m.attrs, 3 * own_linked >= own + own_linked)
                if found and (upcoming[i] < ends[i] or (found != "comment" and own >= max(LEAST_WORDS, MOST_WORDS * plain[-1]))):
                    found = None  # it holds the article, or most of what the page says
            if found:
                kind, depth, name_open = found, 0, name
            if kind and name == name_open and not m.single:
                depth += -1 if closing else 1
            if name == "a":
                links = 0 if closing else 1
            if name == "article":
                article = max(0, article + (-1 if closing else 1))
            if name in ("article", "main"):
                whole = max(0, whole + (-1 if closing else 1))
            label = PASSED if kind and whole else f"block {kind}" if kind else ("/" if closing else "") + name
            out.append(Token(label, "", name not in INLINE, kind is not None, inside))
            if kind and depth <= 0 and name == name_open:
                kind = None
            elif kind and closing and name in WHOLE:
                kind = None  # furniture left open ends with what holds it
    return out


def learn(pages: list[str]) -> dict[str, float]:
    """Log odds of each kind of token to stand in the main text, with half a token of each added."""
    held, other = Counter(), Counter()
    for page in pages:
        for t in tokens_of(page):
            (held if t.inside else other)[t.kind] += len(t.text.split()) if t.kind.startswith("word") else 1
    weights = {k: math.log((held[k] + 0.5) / (other[k] + 0.5)) for k in held | other if k != PASSED}
    # words score positive and tags negative: a plain word's odds scale all others
    word = max(weights.get("word", 1.0), LEAST)
    out = {}
    for k, w in weights.items():
        if k in ("word", "word in link"):
            out[k] = max(w / word, LEAST if k == "word in link" else 1.0)
        else:
            out[k] = min(w / word, -LEAST)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open range with the largest sum, the earliest and longest such; empty if no score is above 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and start == at[0] and total > 0):
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = tokens_of(page or "")
    default = -LEAST  # a tag that no labelled page holds
    scores = [0.0 if t.kind == PASSED else weights.get(t.kind, default) * (len(t.text.split()) if t.kind.startswith("word") else 1) for t in found]
    a, b = best_region(scores)
    blocks, line = [], []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for t in found[a:b]:
        if t.block or t.furniture:
            end()
        if t.text and not t.furniture:
            line.append(t.text)
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, labelled: list[str] = PAGES) -> DataFrame:
    """page_id, url, text: the main text of each page."""
    small_batches(pages.sparkSession)
    weights = learn(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
