"""Main text of HTML pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's parser is fed piece by piece; its events build lines, one
per block element.  A line's ratio is its text length over its number of tags.
Ratios are smoothed with a Gaussian over neighbouring lines, and lines above the
threshold (the standard deviation of the smoothed ratios times ``LAMBDA``, at
most the largest ratio) are content.  The content region is the smallest element
that holds nearly all of the content lines, or the page's article or main
element if that holds most of them, and all lines of the region belong to the
text but those inside elements that are never article text: menus, headers,
footers, asides, scripts, styles.  Forms, and elements whose class, id or role is made of words for adverts, notices, reader
comments and the like, are left out too, unless one holds the page's largest article or main element, or
``MARKED_SHARE`` of its text: then it is a wrapper of the page.  Where such a word is only part of a name
(``share-price``, ``notice-of-motion``) the ratios decide: the element is left out if none of its lines is content.

Defined results: null and empty pages and pages without text give an empty text;
broken markup is read as far as the parser gets, unclosed paragraphs end at the
next block; unknown declarations and marked sections are markup and go; a tag or declaration that the page breaks off
in goes; repeated rows are read one by one; character references are decoded; of elements with equal text the
last article and the first other one count as larger; an empty table gives an empty table; pages of any length and
nesting are read whole, in time linear in both.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import contextlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
SIGMA = 2.0
LAMBDA = 0.5
REGION_SHARE = 0.9
ARTICLE_SHARE = 0.4
MARKED_SHARE = 0.8

# fixed values: element names of the HTML standard
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
                   "summary table tbody td tfoot th thead title tr ul option caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside audio button canvas datalist dialog embed footer head header iframe menu nav noscript object "
                  "script search select style svg template textarea title video".split())
HOLDERS = frozenset("article blockquote body details div dl figure html main ol section table tbody td tr ul".split())
# words in class or id that mark an element as something else than article text
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices banner "
                  "popup modal overlay newsletter subscribe signup login comment comments commentlist disqus respond replies "
                  "reply related recommended recommendations share sharing social widget widgets toolbar pagination pager "
                  "copyright disclaimer skip".split())
# fixed values: words that say nothing of their own beside a mark
PLAIN = frozenset("area bar block bottom box button buttons center col column container content cta form global group header inner item "
                  "items left links list main module new outer page panel primary region right row secondary section site slot small "
                  "text title top unit widget wrap wrapper zone".split())
CONTENT = frozenset("content article post main story entry".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_DOCTYPE = re.compile(r"<!doctype[^>\[]*\[[^\]]*\]\s*>", re.IGNORECASE)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_WHITE = re.compile(r"\s+")


class _Line:
    __slots__ = ("parts", "tags", "holder")

    def __init__(self, holder: int):
        self.parts: list[tuple[int, str]] = []                # innermost marked element (0: none) and text
        self.tags = 0
        self.holder = holder


class Reader(HTMLParser):
    """Lines of a page and the tree of elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.parent = [-1]
        self.kind = [""]
        self.marked_in = [-1]                               # for each marked element, the one around it
        self.sure = [False]                                 # whether its name is all marks
        self.open: Counter[str] = Counter()                 # elements on the stack
        self.ending = False
        self.articles: list[tuple[int, int]] = []           # holder and marked element around each article or main
        self.stack: list[tuple[str, int, bool, int]] = []   # element, holder, never article text, marked element
        self.current = _Line(0)

    def parse_html_declaration(self, i: int) -> int:
        """Skips a declaration or marked section of whatever kind; -1: its end is not there yet."""
        raw = self.rawdata
        if raw.startswith("<!--", i):
            return self.parse_comment(i)
        if raw.startswith("<![CDATA[", i):
            end = raw.find("]]>", i) + 2
            end = -1 if end == 1 else end
        elif (found := _DOCTYPE.match(raw, i)) is not None:
            return found.end()
        elif raw[i:i + 9].lower() == "<!doctype" and "[" in raw[i:(raw.find(">", i) if raw.find(">", i) >= 0 else len(raw))] and not self.ending:
            return -1
        else:
            end = raw.find(">", i)
        if end < 0 and self.ending:
            end = raw.find(">", i)
            return len(raw) if end < 0 else end + 1
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        self.ending = True
        super().close()

    def _hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def _mark(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def _holder(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def flush(self) -> None:
        if self.current.parts:
            self.lines.append(self.current)
            tags = 0
        else:
            tags = self.current.tags                          # tags without text count for the next line
        self.current = _Line(self._holder())
        self.current.tags = tags

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.current.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag == "p" or tag in BLOCKS:
            self._close_implied(tag)
        elif tag not in NEVER:
            return
        if tag in VOID:
            self.flush()
            return
        never = self._hidden() or tag in NEVER or _unseen(attrs)
        holder, mark, named = self._holder(), self._mark(), _marked(attrs)
        if tag == "form" or (named and tag not in ("html", "body", "main", "article")):
            self.marked_in.append(mark)
            self.sure.append(tag == "form" or named == 2)
            mark = len(self.marked_in) - 1
        if tag in HOLDERS:
            self.parent.append(holder)
            self.kind.append("article" if tag in ("article", "main") or ("role", "main") in attrs else tag)
            holder = len(self.parent) - 1
            if self.kind[-1] == "article" and not named and not never:
                self.articles.append((holder, mark))
        if tag in BLOCKS:
            self.flush()
        self.stack.append((tag, holder, never, mark))
        self.open[tag] += 1
        self.current.holder = holder

    def _close_implied(self, tag: str) -> None:
        """Elements the standard closes when this one begins."""
        if self.stack and (top := self.stack[-1][0]) and (
                top == "p" or (top == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"))
                or (top in ("dd", "dt") and tag in ("dd", "dt")) or (top in ("td", "th") and tag in ("td", "th", "tr"))):
            self._pop(len(self.stack) - 1)
            if tag == "tr" and self.stack and self.stack[-1][0] == "tr":
                self._pop(len(self.stack) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in NEVER | BLOCKS:
            return
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.current.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):         # what it passes is closed, so each element is passed once
            if self.stack[i][0] == tag:
                self._pop(i)
                return

    def _pop(self, i: int) -> None:
        self.flush()
        self.open.subtract(e[0] for e in self.stack[i:])
        del self.stack[i:]
        self.current.holder = self._holder()

    def handle_data(self, data: str) -> None:
        if not self._hidden() and (self.current.parts or not data.isspace()):
            self.current.parts.append((self._mark(), data))


def _marked(attrs: list[tuple[str, str | None]]) -> int:
    """2: a class, id or role is made of marks; 1: a mark is part of one; 0: none."""
    names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).split()
    if not names or CONTENT & {n.lower() for n in names}:
        return 0
    found = 0
    for name in names:
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        if words & MARKS:
            found = max(found, 2 if words <= MARKS | PLAIN else 1)
    return found


def _unseen(attrs: list[tuple[str, str | None]]) -> bool:
    return any(k == "hidden" or (k == "aria-hidden" and v == "true")
               or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the ends are weighed by what is there."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def blocks_of(html: str) -> list[str]:
    """The main text's blocks in page order."""
    reader = Reader()
    with contextlib.suppress(AssertionError):                 # the parser's own, on markup it cannot go on with
        for at in range(0, len(html), PIECE):
            reader.feed(html[at:at + PIECE])
        left = _UNFINISHED.search(reader.rawdata)             # a tag that the page breaks off in is no text
        if left:
            reader.rawdata = reader.rawdata[:left.start()]
        reader.close()
    reader.flush()
    out = _left_out(reader)
    texts, lines, tags = [], [], 0
    for line in reader.lines:
        line.tags += tags
        parts = [data for mark, data in line.parts if not out[mark]]
        tags = 0 if parts else line.tags                      # tags without text count for the next line
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            texts.append(text)
            lines.append(line)
    if not texts:
        return []
    length = np.array([len(t) for t in texts], dtype=float)
    smoothed = smooth(length / np.maximum([line.tags for line in lines], 1))
    content = smoothed >= min(LAMBDA * smoothed.std(), smoothed.max())
    doubtful = _without_content(reader, out, lines, content)
    stays = [any(not out[mark] and not doubtful[mark] for mark, _ in line.parts) for line in lines]
    mass = np.zeros(len(reader.parent))
    for line, n, c in zip(lines, length, content, strict=True):
        mass[line.holder] += n * c
    for i in range(len(mass) - 1, 0, -1):                     # an element comes after the one that holds it
        mass[reader.parent[i]] += mass[i]
    region = _region(reader, mass)
    inside = np.zeros(len(mass), dtype=bool)
    inside[region] = True
    for i in range(1, len(mass)):
        inside[i] |= inside[reader.parent[i]]
    return [t for t, line, s in zip(texts, lines, stays, strict=True) if s and inside[line.holder]]


def _without_content(reader: Reader, out: list[bool], lines: list[_Line], content: np.ndarray) -> list[bool]:
    """For each element of which a mark is only part of the name, whether none of its lines is content."""
    some = [False] * len(reader.marked_in)
    for line, c in zip(lines, content, strict=True):
        for mark, _ in line.parts:
            some[mark] |= bool(c)
    for i in range(len(some) - 1, 0, -1):
        some[reader.marked_in[i]] |= some[i]
    empty = [False] * len(some)
    for i in range(1, len(some)):
        empty[i] = empty[reader.marked_in[i]] or not (some[i] or reader.sure[i] or out[i])
    return empty


def _left_out(reader: Reader) -> list[bool]:
    """For each marked element, whether its text is no article text."""
    n = len(reader.marked_in)
    mass, held = [0] * n, [0] * len(reader.parent)
    for line in reader.lines:
        for mark, data in line.parts:
            size = len(_WHITE.sub("", data))
            mass[mark] += size
            held[line.holder] += size
    for sums, outer in ((mass, reader.marked_in), (held, reader.parent)):
        for i in range(len(sums) - 1, 0, -1):                 # an element comes after the one that holds it
            sums[outer[i]] += sums[i]
    wraps = [False] * n
    if reader.articles:
        at = max(reader.articles, key=lambda a: held[a[0]])[1]
        while at > 0:
            wraps[at], at = True, reader.marked_in[at]
    out = [False] * n
    for i in range(1, n):
        out[i] = out[reader.marked_in[i]] or (reader.sure[i] and not (wraps[i] or mass[i] >= MARKED_SHARE * mass[0]))
    return out


def _region(reader: Reader, mass: np.ndarray) -> list[int]:
    """The elements whose lines are the main text."""
    articles = [i for i, k in enumerate(reader.kind) if k == "article"]
    if articles:
        best = max(articles, key=lambda i: (mass[i], i))
        if mass[best] >= ARTICLE_SHARE * mass[0]:
            return [best]
    if not mass[0]:
        return [0]
    # at most one element inside another holds so large a share
    inner = {}
    for i in range(len(mass) - 1, 0, -1):
        if mass[i] >= REGION_SHARE * mass[0]:
            inner[reader.parent[i]] = i
    at = 0
    while at in inner:
        at = inner[at]
    return [at]


def extract(html: str | None) -> str:
    return "\n\n".join(blocks_of(html)) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
