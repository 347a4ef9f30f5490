"""Main text of web pages: parser events make lines, the text-to-tag ratio of
the lines is smoothed by a Gaussian, and a threshold clusters lines into
content regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattle.llm.textkit import ship_package

# Elements whose text is not shown, or is code.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select "
                   "option datalist".split())
# Elements around the article.
AROUND = frozenset("nav aside footer form menu dialog button".split())
# Words of class, id or role that mark such parts, if a whole name consists of
# them and of words that only tell where or what kind of box it is.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
MARKS = COMMENTS | ADVERTS | frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe signup share sharing social "
    "related recommended teaser teasers widget toolbar pagination search login complementary contentinfo".split())
BOXES = frozenset("site page main top bottom left right upper lower box bar block container wrapper wrap inner outer "
                  "list lists item items link links section area region slot unit panel column col row group header "
                  "head holder zone module thread post posts article articles story stories more primary secondary "
                  "global mobile desktop sticky fixed content buttons icons form js id".split())
HEADERS = BOXES - frozenset("post posts article articles story stories content item items section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that begin and end a line of their own.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul aside menu dialog noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(("article", "main"))
# Elements that group blocks; lists, tables and their parts belong to what holds them.
REGIONS = frozenset("html body div section center fieldset details".split())
# Text of another article, as a share of the longest one's, from which on it counts.
SECOND = 0.5
# A line's ratio is spread over its neighbours by this standard deviation.
SIGMA = 1.0
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> set[str]:
    """The marks among the names of an element. A heading has none; inside an
    article the id of a section is the anchor of its subject, so only comments
    and adverts are told by it."""
    found: set[str] = set()
    if tag in HEADINGS:
        return found
    for key, value in attrs:
        for name in value.split() if key in ("class", "id", "role") and value else ():
            words = {w.lower() for w in _WORDS.findall(name)}
            marks = words & (COMMENTS | ADVERTS if inside and key == "id" else MARKS)
            if marks and words <= MARKS | BOXES:
                found |= marks
            elif "header" in words and words <= HEADERS:
                found.add("header")
    return found


class Lines(HTMLParser):
    """Collects lines: (text, number of tags, shown, container, region, direct).
    A container is the number of the innermost article or main element, 0
    outside; a region that of the innermost grouping element, 0 outside, and
    direct tells that no block lies between it and the line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, bool]] = []
        self.stack: list[tuple[str, bool, bool, int, int, bool]] = []  # tag, hidden, around, container, region, direct
        self.parents = [0]  # of the regions; each number is above its parent's
        self.holders = [0]  # of the containers
        self.text: list[str] = []
        self.tags = 0

    def state(self) -> tuple[bool, bool, int, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, False, 0, 0, True)

    def flush(self) -> None:
        hidden, around, container, region, direct = self.state()
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, not (hidden or around), container, region, direct))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self.flush()
            return
        hidden, around, container, region, direct = self.state()
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
            if tag in BLOCKS:  # a paragraph ends where the next block begins
                holder = next((t[0] for t in reversed(self.stack) if t[0] in BLOCKS), None)
                if holder == "p":
                    self.close_to("p")
                    hidden, around, container, region, direct = self.state()
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.close_to("li")
                hidden, around, container, region, direct = self.state()
        self.tags += 1
        marks = marked(tag, attrs, container > 0)
        # A header is part of the article inside it, and around it elsewhere.
        outside = tag in AROUND or ((tag == "header" or "header" in marks) and not container)
        outside |= bool(marks & MARKS) and tag not in ("html", "body", "main")
        if tag in CONTAINERS and not (around or outside):
            self.holders.append(container)
            container = len(self.holders) - 1
        if tag in REGIONS:
            self.parents.append(region)
            region, direct = len(self.parents) - 1, True
        elif tag in BLOCKS:
            direct = False
        # A shell for a page's hidden parts ends with it, so a stray body shows again.
        self.stack.append((tag, (hidden or tag in HIDDEN) and tag != "body", around or outside, container,
                           region, direct))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.flush()
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCKS or tag in HIDDEN:
            self.close_to(tag)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i]
                return
            if self.stack[i][0] in BLOCKS:
                return

    def handle_data(self, data):
        if not self.state()[0]:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of each line and its neighbours, normalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weight


def lines_of(html: str) -> tuple[list[tuple[str, int, bool, int, int, bool]], list[int], list[int]]:
    """The lines of a page, the parents of its regions and of its containers."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines, parser.parents, parser.holders


def common_region(regions: list[int], direct: list[bool], dense: np.ndarray, parents: list[int]) -> list[bool]:
    """Which lines lie in the nearest region that holds every dense one. A
    region of one line of its own text is a paragraph, so its parent counts."""
    def inside(top: int) -> list[bool]:
        held = [True] * len(parents) if not top else [False] * len(parents)
        for i in range(top, len(parents)):
            held[i] = i == top or held[parents[i]]
        return [held[r] for r in regions]

    seeds = np.flatnonzero(dense)
    top = regions[seeds[0]]
    for other in {regions[i] for i in seeds}:
        while top != other:
            top, other = min(top, other), parents[max(top, other)]
    keep = inside(top)
    while top and sum(keep) == 1 and direct[seeds[0]]:
        top = parents[top]
        keep = inside(top)
    return keep


def articles(lines: list[tuple], dense: np.ndarray, holders: list[int]) -> list[bool] | None:
    """Which lines belong to the article or main element with the most dense
    text, or to another one with nearly as much; None if none has any.

    What such an element holds is kept whole. Around it, in an element that
    holds it, dense lines that adjoin are of its cluster, as a title that
    stands before it.
    """
    mass = [0] * len(holders)
    for (text, _, _, container, *_), d in zip(lines, dense, strict=True):
        if container and d:
            mass[container] += len(text)
    if not any(mass):
        return None
    kept = [m >= SECOND * max(mass) for m in mass]
    above = set()
    for c in range(len(mass)):
        if kept[c]:
            above.add(up := holders[c])
            while up:
                above.add(up := holders[up])
        kept[c] = kept[c] or (c > 0 and kept[holders[c]])
    kept[0] = False
    keep = [kept[x[3]] for x in lines]
    for step in (1, -1):
        order = range(len(lines))[::step]
        before = False
        for i in order:
            if not keep[i] and before and dense[i] and lines[i][3] in above - {0}:
                keep[i] = True
            before = keep[i]
    return keep


def main_text(html: str | None) -> str:
    """Content regions of a page, one line a block.

    Lines in hidden elements and in parts that are marked as standing around
    the article never count. Of the rest, a line is dense if its smoothed
    ratio is at least the standard deviation of the page's ratios (or half the
    largest, if that is less). Where dense lines lie in article or main
    elements, the one with the most of them is kept whole; another page keeps
    whole the nearest grouping element around all dense lines, so lists, tables
    and short paragraphs stay wherever they stand in it.
    """
    if not html:
        return ""
    found, parents, holders = lines_of(html)
    lines = [x for x in found if x[2]]
    if not lines:
        return ""
    ratio = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]))
    dense = ratio >= min(ratio.std(), ratio.max() / 2)
    keep = articles(lines, dense, holders)
    if keep is None:
        keep = common_region([x[4] for x in lines], [x[5] for x in lines], dense, parents)
    return "\n".join(text for (text, *_), k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, from the
    whole html; other columns are ignored, whatever their names.

    Null, empty and textless html give the empty text and 0. Broken markup is
    parsed as far as the parser's events go, unclosed elements end with their
    parents. Repeated rows are extracted each.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0), "url": batch.column(1),
                "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()),
            })

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
