"""Main text of HTML pages by line-block distribution.

The markup is stripped to lines, one per block element.  A line weighs the length of its text without link text;
text in elements that HTML itself defines as no main content (navigation, footers, scripts, ...) is left out,
and at their borders, as at those of articles, a gap of empty lines is left.  The weights are summed over sliding
windows of ``window`` lines; the distribution surges where the sum leaves zero and dives where it returns to zero.
The stretch between a surge and its dive that holds the most text decides where the main text is:

* in a ``<main>``: all lines of that element are kept, so all its articles and what stands beside them;
* in an ``<article>`` without ``<main>``: its lines, and those that stand beside it in a container of their own;
* else the largest stretch, the stretches whose windows reach ``surge`` characters, and shorter ones unless they lie in a
  container with a class or id that the largest has nothing of.  Linked lines at their ends are kept where they share the
  container of the line beside them.

Elements of a form are controls, but a form may wrap a whole page: its other lines count if they are more than half of
the page's text.  An anchor is a link if it refers to something; one without an end tag ends with its block.

Class names and ids are hints, not rules: a line inside an element whose name says menu, sidebar, cookie notice,
advert, comments or the like (all of its parts, so ``no-sidebar``, ``share-price`` or ``article-header`` say nothing)
weighs nothing and isn't kept, unless nothing else on the page has any weight.

Cases: a null or empty page gives an empty text; markup cut off at the end is closed there; optional end tags, unquoted
values and stray quotes are read as HTML says; unknown or broken character references stay as they are; pages of any
length are read whole, in one pass; repeated rows are extracted each; a null page_id or url is kept; other columns,
whatever their names, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_batches

#: A comment, a declaration, or a tag: closing mark, name, attributes.  Nothing is tried twice, so any page takes one pass.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?|[\s/=])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Their content is no markup: it ends at the closing tag alone.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math", "canvas", "object"}
#: No main content, as blocks and within a line.
OFF_BLOCKS = {"head", "nav", "footer", "aside", "dialog", "menu"}
OFF_INLINE = {"button", "select", "label", "legend", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What a line's neighbours share.
CONTAINERS = {"div", "section", "article", "main", "body", "html", "header", "blockquote", "figure", "center", "details"}
BLOCKS = CONTAINERS | OFF_BLOCKS | {"form", "fieldset", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "address", "figcaption", "summary", "hgroup", "search"}
LISTS = {"ul", "ol", "menu"}
#: Elements that end where the next one of their group begins.
GROUPS = {"li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HINTS = set("ad ads advert adverts advertisement advertisements sponsored sponsor promo cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comments comment disqus newsletter pagination related".split())
#: Words that may stand beside a hint in a name and leave its sense.
BESIDE = set("site main page top bottom left right global primary secondary mobile sub box block list area wrap wrapper container section inner content bar link links banner notice item items unit slot header articles posts signup".split())
BLANKS = re.compile(r"\s+")
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
REFERENCE = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)
NAMED = re.compile(r"(?:^|[\s/\"'])(?:class|id)\s*=", re.I)


def hinted(names: str) -> bool:
    """Whether a class or id says boilerplate: every part of one of its names does, or stands beside one that does."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if "content" in parts and not {"main", "page", "site"}.isdisjoint(parts):
            continue  # what holds the main content may name its neighbours too
        if any(p in HINTS for p in parts) and all(p in HINTS or p in BESIDE for p in parts):
            return True
    return False


def judged(attributes: str) -> str:
    """``off`` for hidden elements and roles outside the main content, ``hint`` for names of boilerplate, else empty."""
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    out = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "off"
        if name in ("class", "id") and hinted(value):
            out = "hint"
    return out


@dataclass(slots=True)
class Line:
    """A block's text and its length without links; the article, main element, form and container that hold it, and the chain of named containers around it."""

    text: str = ""
    weight: float = 0.0
    region: int = 0
    container: int = 0
    hint: bool = False
    main: int = 0
    form: int = 0
    beside: int = 0  # the container that holds the article
    named: tuple = ()  # (nearest named container, its chain)


class Place(NamedTuple):
    """An open structural element, and what lines in it have in common."""

    tag: str = ""
    judgement: str = ""
    region: int = 0
    main: int = 0
    form: int = 0
    container: int = 0
    beside: int = 0
    named: tuple = ()  # (nearest named container, its chain)


class Stripper:
    """Turns a page into lines; borders of other content become ``gap`` empty lines."""

    def __init__(self, gap: int):
        self.gap, self.lines = gap, []
        self.piece: list[str] = []
        self.linked: list[str] = []
        self.stack: list[Place] = []
        self.open: Counter = Counter()
        self.off = self.hints = self.in_link = self.number = 0

    def flush(self, gap: bool = False) -> None:
        text = BLANKS.sub(" ", _html.unescape("".join(self.piece))).strip()
        if text:
            links = len(BLANKS.sub(" ", _html.unescape("".join(self.linked))).strip())
            at = self.stack[-1] if self.stack else Place()
            self.lines.append(Line(text, float(max(len(text) - links, 0)), at.region, at.container, self.hints > 0, at.main, at.form, at.beside, at.named))
        self.piece.clear()
        self.linked.clear()
        if gap and self.lines and self.lines[-1].text:
            self.lines.extend(Line() for _ in range(self.gap))

    def push(self, tag: str, judgement: str, named: bool) -> None:
        at = self.stack[-1] if self.stack else Place()
        self.number += 1
        changed = {"tag": tag, "judgement": judgement}
        if tag == "article" and not at.region:
            changed |= {"region": self.number, "beside": at.container}
        if tag in ("main", "form") and not getattr(at, tag):
            changed[tag] = self.number
        if tag in CONTAINERS and tag not in ("html", "body"):
            changed["container"] = self.number
            if named:
                changed["named"] = (self.number, at.named)
        self.stack.append(at._replace(**changed))
        self.open[tag] += 1
        self.off += judgement == "off"
        self.hints += judgement == "hint"

    def pop(self) -> str:
        tag, judgement = self.stack.pop()[:2]
        self.open[tag] -= 1
        self.off -= judgement == "off"
        self.hints -= judgement == "hint"
        return tag

    def anchor(self, attributes: str, page: str, at: int) -> None:
        """A link, if it refers to something; without an end tag of its own it ends with the block."""
        following = ANCHOR.search(page, at)
        closed = following is not None and following[1]
        self.in_link = 0 if not REFERENCE.search(attributes) else 1 if closed else 2

    def close_implied(self, tag: str) -> None:
        """Ends the elements that a start tag ends."""
        if tag in BLOCKS and self.stack and self.stack[-1][0] == "p":
            self.flush()
            self.pop()
        for k in range(len(self.stack) - 1, -1, -1):
            below = self.stack[k][0]
            if tag in GROUPS.get(below, ()):
                self.flush()
                while len(self.stack) > k:
                    self.pop()
            elif below in LISTS or below in CONTAINERS or below in OFF_BLOCKS or below in ("table", "form"):
                break

    def start(self, tag: str, attributes: str) -> None:
        if self.stack:
            self.close_implied(tag)
        judgement = "off" if tag in OFF_BLOCKS or tag in OFF_INLINE or tag == "header" and not (self.open["article"] or self.open["main"]) else ""
        block = tag in BLOCKS
        if not judgement and attributes and tag not in ("html", "body", "main", "article"):
            judgement = judged(attributes)
            if not block and judgement == "hint":
                judgement = ""
        if block:
            self.flush((bool(judgement) or tag in ("article", "main", "body", "form")) and not self.off)
            self.in_link = self.in_link % 2
        elif tag == "br":
            self.piece.append(" ")
        # an element within a judged one of its name is counted too, so that its end tag does not end the outer one
        if tag == "form" and self.open["form"]:
            return  # forms don't nest
        if tag not in VOID and (judgement or tag in CONTAINERS or tag in LISTS or tag in ("table", "form") or self.open[tag]):
            self.push(tag, judgement, tag in CONTAINERS and NAMED.search(attributes) is not None)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in BLOCKS and not self.off:
            self.flush()
            self.in_link = self.in_link % 2
        if not self.open[tag]:
            return
        was_off, border = self.off, tag in ("article", "main", "body", "form")
        while True:
            border |= bool(self.stack[-1].judgement) and self.stack[-1].tag in BLOCKS
            if self.pop() == tag:
                break
        if border and (not was_off or not self.off):
            self.flush(True)

    def strip(self, page: str) -> list[Line]:
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            stop = m.start() if m else end
            if stop > at and not self.off:
                self.piece.append(page[at:stop])
                if self.in_link:
                    self.linked.append(page[at:stop])
            if not m:
                break
            at = max(m.end(), m.start() + 1)
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW and not (tag in ("svg", "math") and m[3].endswith("/")):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            else:
                self.start(tag, m[3])
                if tag == "a":
                    self.anchor(m[3], page, at)
        self.flush()
        return self.lines


def stretches(weights: list[float], window: int) -> list[tuple[int, int, float, float]]:
    """(surge, dive, text length, largest sum) of every stretch where the windowed sums stay above zero."""
    if not weights:
        return []
    w = np.asarray(weights)
    total = np.concatenate([[0.0], np.cumsum(w)])
    n = len(w)
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    above = np.concatenate([[False], sums > 1e-9, [False]])
    turns = np.flatnonzero(above[1:] != above[:-1])
    return [(int(a), int(b), float(total[b] - total[a]), float(sums[a:b].max())) for a, b in zip(turns[::2], turns[1::2])]


def form_lines(lines: list[Line]) -> set[int]:
    """Forms that wrap no more than half of the page's text: what stands in them is not main text."""
    total, by_form = sum(x.weight for x in lines), Counter()
    for x in lines:
        if x.form:
            by_form[x.form] += x.weight
    return {f for f, w in by_form.items() if 2 * w <= total}


def kept_lines(lines: list[Line], window: int, surge: float) -> list[int]:
    """Numbers of the lines of the main text."""
    minor = form_lines(lines)
    weights = [0.0 if x.hint or x.form in minor else x.weight for x in lines]
    if not any(weights):  # nothing but hinted, linked or form text: the first kind that is there counts
        weights = [x.weight for x in lines] if any(x.weight for x in lines) else [float(len(x.text)) for x in lines]
        minor = set()
        for x in lines:
            x.hint = False
    found = stretches(weights, window)
    if not found:
        return []
    some = [i for i, x in enumerate(lines) if x.text and not x.hint and x.form not in minor]
    a, b, _, _ = max(found, key=lambda x: x[2])
    top = lines[max(range(a, b), key=lambda i: weights[i])]
    if top.main:
        return [i for i in some if lines[i].main == top.main]
    if top.region:
        return [i for i in some if lines[i].region == top.region or top.beside and not lines[i].region and lines[i].container == top.beside]
    heavy = [lines[i] for i in range(a, b) if weights[i]]
    around, named, may = {x.container for x in heavy}, set(), set(some)
    for x in heavy:
        chain = x.named
        while chain and chain[0] not in named:
            named.add(chain[0])
            chain = chain[1]
    out = []
    for a, b, _, largest in found:
        filled = [i for i in range(a, b) if weights[i]]
        first, last = filled[0], filled[-1]
        ends = lines[first], lines[last]
        if ends[0].region or largest < surge and not any(x.container in around or not x.named or x.named[0] in named for x in ends):
            continue
        while first > 0 and lines[first - 1].text and lines[first - 1].container == lines[first].container:
            first -= 1
        while last + 1 < len(lines) and lines[last + 1].text and lines[last + 1].container == lines[last].container:
            last += 1
        out += [i for i in range(max(first, out[-1] + 1 if out else 0), last + 1) if i in may and not lines[i].region]
    return out


def main_text(page: str | None, window: int = 3, surge: float = 80.0) -> str:
    lines = Stripper(window).strip(page or "")
    return "\n".join(lines[i].text for i in kept_lines(lines, window, surge))


def _extract(window: int, surge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2):
            texts = [main_text(x.as_py(), window, surge) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", window: int = 3, surge: float = 80.0) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; map-only, whole pages."""
    picked = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return picked.mapInArrow(_extract(window, surge), "page_id long, url string, text string, n_chars long")
