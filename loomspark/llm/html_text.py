"""Main text of web pages by the distribution of line blocks.

Markup is cut into lines at block tags. Menus, headers, footers, asides, adverts, comments of readers and the like
give no lines; forms and regions with a telling class name give none unless they hold the article, or over half of
the page's text; if the page names its article, only the lines in it are looked at. The
lengths, without what is linked, are summed over windows of lines; where the sums surge past a threshold a
stretch begins (with the lines right before it, such as a title) and where they fall to nothing it ends. The
text between is kept, of every such stretch, and the main heading (h1) of a named article.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60

RAW = frozenset("script style noscript template iframe svg canvas object textarea select option math title".split())
NAME = re.compile(r"<(/?)([A-Za-z][\w:-]*)")
ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav footer aside menu dialog button head datalist".split())
HOLDS = frozenset("form fieldset label audio video map".split())  # hold what surrounds an article, or all of it
IMPLIED = frozenset("p li dd dt tr td th option".split())
HOLDERS = frozenset("ul ol dl table tbody section select".split())
MAIN = frozenset("article main".split())
ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: parts of class or id names that tell what surrounds an article
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner\w*|promo\w*|sponsor\w*|sidebar\w*|side|aside|rail|menu\w*|nav|navbar|navigation|breadcrumbs?|topbar|header|masthead|footer|foot|cookies?|consent|gdpr|notices?|notification\w*|alerts?|warning|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|register|search|popup|modal|overlay|widgets?|toolbar|pagination|pager|skip|copyright|legal|disclaimer|paywall|teaser|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)


#: names that only look like one of these
OWN = re.compile(r"side-by-side|related[_-]works?", re.I)
NO, SURE, UNLESS = range(3)  # a region stays, goes, or goes unless it turns out to hold the article
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion)(?=$|[\s_-])", re.I)


def _around(name: str, attrs: str, inside: bool) -> int:
    """Whether an element holds what surrounds an article."""
    if name in DROP or (name == "header" and not inside):
        return SURE
    if name in HOLDS:
        return UNLESS
    if not attrs.strip() or name in ("html", "body", "article", "main", "h1"):
        return NO
    out = NO
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if key in ("class", "id"):
            value = OWN.sub(" ", value)
            if inside and name == "section" and value.strip().lower() == "discussion":  # a part of a paper
                continue
        if key == "role" and value.lower() in ROLE or key in ("class", "id") and AROUND.search(value):
            out = max(out, SURE if READERS.search(value) else UNLESS, key=lambda x: (x == SURE, x))
    if out == NO and re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
        return SURE
    return out


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag; name is empty for comments, declarations and what holds no
    text. Every character is looked at a bounded number of times, however broken the page is."""
    at, gone, low = 0, set(), None
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        m = NAME.match(page, start)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        if ">" in gone or (first := page.find(">", start)) < 0:
            return  # no tag ends any more
        end = k = m.end() if m else start
        while m and (end := _next(page, k)) >= 0 and page[end] != ">":  # past quoted values
            quote = page[end]
            k = -1 if quote in gone else page.find(quote, end + 1)
            if k < 0:
                gone.add(quote)
                break
            k += 1
        if not m or end < 0 or page[end] != ">":
            end = first  # a quote that does not close, or a declaration
        at = end + 1
        name = m[2].lower() if m else ""
        if name in RAW and not m[1]:
            low = page.lower() if low is None else low
            if len(low) != len(page):  # lower() lengthens one character only
                low = page.replace("İ", "i").lower()
            shut = -1 if name in gone else low.find(f"</{name}", at)
            if shut < 0:
                gone.add(name)
            at = len(page) if shut < 0 else (page.find(">", shut) + 1 or len(page))
            yield start, at, False, "", ""
            continue
        yield start, at, bool(m and m[1]), name, page[m.end() : end] if m else ""


_STOP = re.compile(r"[\"'>]")


def _next(page: str, at: int) -> int:
    m = _STOP.search(page, at)
    return m.start() if m else -1


class Line(NamedTuple):
    """A block: its text, characters outside links (all those of an h1, and of a paragraph of a named article), in a
    named article, h1, the region right around it."""

    text: str
    size: int
    main: bool
    title: bool
    region: int


class Regions:
    """Elements that hold what surrounds an article, as they open and close; a region has the region around it."""

    def __init__(self):
        self.kind, self.parent = [], []
        self.open: list[list] = []  # name, depth, number, articles open at its start
        self.named: Counter = Counter()

    def top(self) -> int:
        return self.open[-1][2] if self.open else -1

    def _pop(self):
        self.named[self.open.pop()[0]] -= 1

    def start(self, name: str, kind: int, main: int) -> None:
        self.parent.append(self.top())
        self.kind.append(kind)
        self.open.append([name, 1, len(self.kind) - 1, main])
        self.named[name] += 1

    def opened(self, name: str) -> None:
        """Another element of the name inside: it has to close first, or its start ends the one before it."""
        if self.open and self.open[-1][0] == name:
            if name in IMPLIED:
                self._pop()
            else:
                self.open[-1][1] += 1

    def closed(self, name: str, main: int) -> None:
        if name in ("body", "html"):
            self.open.clear()
            self.named.clear()
        elif name in MAIN:
            while self.open and main and self.open[-1][3] >= main:  # an article ends that began before the region
                if self.kind[self.top()] == UNLESS and self.open[-1][0] in ("form", "div", "section"):
                    break
                self._pop()
        elif name in HOLDERS:
            while self.open and self.open[-1][0] in IMPLIED:  # an item without an end
                self._pop()
        if self.named[name]:
            while self.open[-1][0] != name:  # what was left open inside ends too
                self._pop()
            self.open[-1][1] -= 1
            if not self.open[-1][1]:
                self._pop()

    def kept(self, out: list[Line]) -> list[bool]:
        """Whether each region stays: it holds the only article, or over half of what is not surely around one."""
        n = len(self.kind)
        dead = [False] * (n + 1)  # the last stands for no region
        for r in range(n):
            dead[r] = self.kind[r] == SURE or dead[self.parent[r]]
        own, article = [0] * (n + 1), [False] * (n + 1)
        for x in out:
            if not dead[x.region]:
                own[x.region] += x.size
                article[x.region] |= x.main and x.size > 0
        free, every = article[-1], sum(own)
        for r in range(n - 1, -1, -1):
            if not dead[r] and self.parent[r] >= 0:
                article[self.parent[r]] |= article[r]
        stay = [False] * n + [True]
        for r in range(n):
            stay[r] = not dead[r] and stay[self.parent[r]] and (article[r] and not free or 2 * own[r] > every)
        return stay


def lines(page: str) -> list[Line]:
    """The blocks of the page, without those in regions that hold what surrounds an article."""
    out: list[Line] = []
    text: list[str] = []
    plain, link, main, title, block = 0, False, 0, False, ""
    regions = Regions()

    def close():
        nonlocal plain
        said = " ".join(_html.unescape("".join(text)).split())
        if said:
            out.append(Line(said, len(said) if title or main and block == "p" else min(plain, len(said)), main > 0, title, regions.top()))
        text.clear()
        plain = 0

    def say(piece):
        nonlocal plain
        text.append(piece)
        if not link:
            plain += len(_html.unescape(piece).strip())

    at = 0
    for start, end, shut, name, attrs in tags(page):
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK or regions.named[name]:
            close()
            block = "" if shut else name
        if shut:
            if name in BLOCK:
                link = False  # a link that was not closed ends with its block
            regions.closed(name, main)
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            kind = _around(name, attrs, main > 0)
            if kind:
                close()
            if not kind or name in IMPLIED:
                regions.opened(name)
            if kind:
                regions.start(name, kind, main)
        if name == "h1":
            title = not shut
        elif name == "a":
            link = not shut and bool(re.search(r"(?:^|\s)href\s*=", attrs, re.I))
        elif name in MAIN:
            main = max(0, main + (-1 if shut else 1))
    say(page[at:])
    close()
    stay = regions.kept(out)
    return [x for x in out if stay[x.region]]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by a space; empty for a null or empty page and for one without text."""
    if not page:
        return ""
    got = lines(page)
    named = any(x.main and x.size for x in got)
    if named:
        got = [x for x in got if x.main]
    size = [x.size for x in got]
    n = len(got)
    if not any(size):
        return ""
    total = [sum(size[i : i + WINDOW]) for i in range(n)]
    least = min(SURGE, max(total) / 4)
    keep, i = [named and x.title for x in got], 0
    while i < n:
        if total[i] <= least:
            i += 1
            continue
        a = b = i
        while not size[b]:
            b += 1
        if not any(size[max(0, b - WINDOW) : b]) and b >= WINDOW:  # after a list of links
            a = b
        while a and size[a - 1] > 0:
            a -= 1
        while b < n and total[b] > 0:
            b += 1
        if named and n - b < WINDOW:  # the article ends before the sums would fall
            b = n
        keep[a:b] = [True] * (b - a)
        i = b
    return " ".join(x.text for x, k in zip(got, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, url, text, n_chars``, one row per row.

    A null page gives an empty text; null ids and urls stay null; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result. Pages stay in their partition; the work on a page is linear in its
    length, however broken its markup is.
    """

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b.column("html").to_pylist()]
            size = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
