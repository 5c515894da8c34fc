"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of the page, with a gap of blank lines where a section of the page
begins or ends. A line weighs what its text is long, MARKED times that in an article or main part, and elsewhere
less its links; lines inside menus, headers, footers, sidebars, notices, adverts, forms, comments and the like
weigh nothing. Weights are summed over sliding windows of BLOCK lines. A stretch between the points where the
sums leave zero and where they dive to it again is text if the sums surge over a threshold in it. Where a page marks
its article, all of it that isn't flagged is text, however short.

Pages are read in one pass, with work in proportion to their length however broken their markup is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a sliding window, the weight over which a window surges, and how many times a marked line's length weighs.
BLOCK, SURGE, MARKED = 3, 86, 4
#: A class or id flags an element only up to this share of the page's text; more is a layout's wrapper.
WRAPPER = 0.6

#: Elements by what they mean for extraction.
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu fieldset datalist input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section aside nav header footer".split())
CONTAINERS = frozenset("html body main article section div td th li ul ol table blockquote figure dd header".split())
LISTS = frozenset("ul ol dl table select".split())
ITEMS = frozenset("li dt dd tr td th option".split())
#: Raw elements that end at their end tag only; the others hold markup and end there if there is one.
UNREAD = frozenset("script style".split())
#: Elements whose id is an anchor for links and whose text is the article's own; headings are not flagged by a class either.
TEXTUAL = frozenset("p li dt dd td th blockquote pre figcaption caption".split()) | HEADINGS
#: Words that flag an element if they are its class or id, or all of it that isn't one of PLACES.
ALWAYS = frozenset("comment comments commentlist disqus respond replies".split())
FLAGS = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox adslot sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager sidebar sidenav aside widget widgets footer header masthead topbar banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations toolbar search skip copyright legal disclaimer".split()
)
PLACES = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer box bar block list item items container wrapper wrap section area zone slot unit group row col column "
    "content body panel module links link buttons button btn icons icon inline mobile desktop small large fixed sticky post article entry story".split()
)

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"""[^>"']*""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Line:
    __slots__ = ("button", "flag", "heading", "link", "main", "parts", "size")

    def __init__(self):
        self.parts, self.size, self.link, self.button, self.flag, self.main, self.heading = [], 0, 0, 0, 0, False, False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of comments (no name) and tags; send() a place to go on there.

    A tag ends at the first > outside quotes. Once there is none for a tag, quotes no longer count.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        end, name, attributes = -1, "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif at > last:
            return
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.index(">", at) + 1
        elif found := _NAME.match(page, at):
            name, place = found[1].lower(), found.end()
            while quotes:
                place = _PLAIN.match(page, place).end()
                if page[place : place + 1] == ">":
                    break
                close = page.find(page[place], place + 1) if place < len(page) else -1
                if close < 0:
                    quotes, place = False, found.end()
                else:
                    place = close + 1
            place = page.find(">", place)
            if place < 0:
                return
            end, attributes = place + 1, page[found.end() : place]
        if end < 0:
            at += 1
            continue
        jump = yield at, end, name, page[at + 1] == "/", attributes
        at = end
        if jump is not None:
            at = jump
            yield 0, 0, "", False, ""


def _flag(tag: str, attributes: str) -> str | None:
    """'always', 'weak' (unless it is a wrapper) or None: whether an element isn't the article's."""
    if tag in DROPPED:
        return "always"
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attributes)} if attributes.strip() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return "always"
    if tag in ("html", "body", "main", "article"):
        return None
    if tag == "header":
        return "header"
    if found.get("role", "").lower() in ROLES:
        return "always"
    if tag in HEADINGS:
        return None
    kinds = {_meaning(name) for name in (found.get("class", "") + (" " + found.get("id", "") if tag not in TEXTUAL else "")).split()}
    return "always" if "always" in kinds else "weak" if "weak" in kinds else None


def _meaning(name: str) -> str | None:
    """What one class or id says: only names of known words mean something, so market-share doesn't and site-footer does."""
    words = {w.lower() for w in _WORD.findall(name)}
    if not words or words - ALWAYS - FLAGS - PLACES:
        return None
    return "always" if words & ALWAYS else "weak" if words & FLAGS else None


#: A button in a sentence, as it stands among the open elements.
INSIDE = "button in text"


class _Open:
    """The open elements, with what is asked of them kept up to date as they open and close."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.groups = {CONTAINERS: [], LISTS: []}
        self.flagged, self.main, self.heading, self.link, self.button = [0], 0, 0, 0, 0
        #: By number of a flagged element: its kind, the flagged element around it, text before it and at its end.
        self.kinds, self.around, self.begun, self.ended = [""], [0], [0], [0]

    def push(self, tag: str, kind: str | None, total: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        for group, places in self.groups.items():
            if tag in group:
                places.append(len(self.stack))
        if kind:
            self.around.append(self.flagged[-1])
            self.flagged.append(len(self.kinds))
            self.kinds.append(kind)
            self.begun.append(total)
            self.ended.append(-1)
        self.stack.append((tag, self.flagged[-1] if kind else 0))
        self._count(tag, 1)

    def _count(self, tag: str, step: int) -> None:
        self.main += step * (tag in ("article", "main"))
        self.heading += step * (tag in HEADINGS)
        self.link += step * (tag == "a")
        self.button += step * (tag == INSIDE)

    def close(self, tag: str, total: int, within: frozenset | None = None) -> bool:
        """Close the innermost tag and all in it, unless it lies outside the innermost element of within."""
        if not self.places.get(tag) or (within and self.groups[within] and self.groups[within][-1] > self.places[tag][-1]):
            return False
        last = self.places[tag][-1]
        while len(self.stack) > last:
            name, number = self.stack.pop()
            self.places[name].pop()
            for group, places in self.groups.items():
                if name in group:
                    places.pop()
            if number:
                self.flagged.pop()
                self.ended[number] = total
            self._count(name, -1)
        return True

    def dropped(self, total: int) -> tuple[list[bool], list[bool]]:
        """By number: whether it or one around it is flagged off; whether one is a header. A wrapper's class flags nothing."""
        off, header = [False], [False]
        for n in range(1, len(self.kinds)):
            size = (total if self.ended[n] < 0 else self.ended[n]) - self.begun[n]
            own = self.kinds[n] == "always" or (self.kinds[n] == "weak" and size <= WRAPPER * max(1, total))
            off.append(own or off[self.around[n]])
            header.append(self.kinds[n] == "header" or header[self.around[n]])
        return off, header


def lines_of(page: str) -> list[_Line]:
    """The page's blocks in order, with what they lie in; blank lines where sections begin and end. flag: whether it is left out."""
    lines: list[_Line] = []
    opened, line, total = _Open(), _Line(), 0
    unclosed: set[str] = set()  # raw elements without an end tag from here on

    def flush(gap: bool = False) -> None:
        nonlocal line
        if line.parts:
            lines.append(line)
        if gap:
            lines.extend(_Line() for _ in range(BLOCK))
        line = _Line()

    def text(raw: str) -> None:
        nonlocal total
        if not raw or not (value := html.unescape(raw)):
            return
        size = len("".join(value.split()))
        if not line.parts:
            if not size:
                return
            line.flag, line.main, line.heading = opened.flagged[-1], opened.main > 0, opened.heading > 0
        line.parts.append(value)
        total += size
        line.size += size
        line.link += size * (opened.link > 0)
        line.button += size * (opened.button > 0)

    at, tags = 0, _tags(page)
    for start, end, tag, closing, attributes in tags:
        text(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "button" and (opened.button if closing else line.parts or opened.places.get("p")):
            # In a sentence it is a word of it; a line of nothing but buttons is left out in the end.
            if closing:
                opened.close(INSIDE, total)
            else:
                opened.push(INSIDE, None, total)
        elif closing:
            if tag not in INLINE and tag not in VOID:
                flush(tag in SECTIONS)
            opened.close(tag, total)
        elif tag in RAW:
            if tag not in UNREAD and attributes.rstrip().endswith("/"):
                continue
            found = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            if found is None:
                unclosed.add(tag)
                if tag == "head":
                    found = re.compile("(?=<body)", re.I).search(page, end)
            if found is not None or tag in UNREAD:
                at = found.end() if found else len(page)
                tags.send(at)
        elif tag in ("br", "hr", "wbr", "img"):
            if tag == "hr":
                flush()
            elif tag == "br" and line.parts:
                line.parts.append(" ")
        else:
            if tag not in INLINE:
                flush(tag in SECTIONS)
                opened.close("p", total, CONTAINERS)
                if tag in ITEMS:
                    opened.close(tag, total, LISTS)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                opened.push(tag, _flag(tag, attributes), total)
    text(page[at:])
    flush()
    off, header = opened.dropped(total)
    for x in lines:
        # A heading in an article's header stays.
        x.flag = off[x.flag] or (header[x.flag] and not (x.main and x.heading)) or (x.size > 0 and x.button == x.size)
    return lines


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by two line feeds, empty if there is none."""
    lines = lines_of(page or "")
    shown = [" ".join("".join(x.parts).split()) for x in lines]
    weight = [0 if x.flag else MARKED * len(s) if x.main else max(0, len(s) - 2 * x.link) for x, s in zip(lines, shown, strict=True)]
    sums = [sum(weight[i : i + BLOCK]) for i in range(len(weight))]
    marked = any(x.main and w for x, w in zip(lines, weight, strict=True))
    threshold = min(SURGE * MARKED if marked else SURGE, max(sums, default=0) / 2)
    out: list[str] = []
    i = 0
    while i < len(sums):
        end = i
        while end < len(sums) and sums[end] > 0:
            end += 1
        # Between surge and dive only flagged lines are left out, and outside articles lines that are all links.
        text = any(x > threshold for x in sums[i:end])
        out += [s for x, s in zip(lines[i : end + 1], shown[i : end + 1], strict=True) if s and not x.flag and (x.main or (text and x.link < 0.9 * len(s)))]
        i = end + 1
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; null or empty html has the empty text.

    Rows stay one to one, with null or repeated ids and null urls; other columns are ignored. Whole pages are
    read, whatever their length; markup that is cut off ends the page.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
