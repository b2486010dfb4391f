"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. What a block looks like (where it stands, how much of it is link
text, how long it is) gives the cost of calling it content or boilerplate; these costs are the
capacities to the two ends of a flow network. Blocks that follow each other or stand close in the
document tree are tied by further edges, which cost something when the labels differ. The minimum
cut is the cheapest labelling.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh_name, on_workers

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu "
    "nav noscript object ol optgroup option p pre search section select summary table tbody td template "
    "textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
SILENT_TAGS = frozenset("script style noscript template head title textarea select option svg math iframe object".split())
#: Elements that hold no main text.
SIDE_TAGS = frozenset("nav footer aside form button menu dialog search fieldset label".split())
#: Those of them, and of the roles, that pages also put around their main text.
WRAPPING = frozenset(("form", "fieldset"))
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that may stand in the head of a page; any other ends it, closed or not.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words in class and id names. A word counts as a whole part of the name, as in `post-comments`.
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification notifications pager pagination popup promo promoted promotion recommended "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription tags teaser toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article body content entry main post prose story text".split())
#: Elements that end an open paragraph when they begin, as browsers do.
_ENDS_PARAGRAPH = BLOCK_TAGS - {"button", "iframe", "object", "option", "optgroup"}
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div article section main body nav aside footer header form".split())
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Evidence against main text that an element of those kinds brings; no length or tie outweighs it.
SIDE = 12.0
#: What is left of it, once for all of them, for elements around the main text.
WRAPPER = 0.5
#: An element of a side name without main elements in it is around the main text if it holds this share of the words.
MOST = 0.8
#: Strength of the ties between blocks, and how far back siblings are tied.
TIE = 1.2
SIBLINGS = 2
#: What is left of a tie between a block in an element of the side kinds and one that is not.
ACROSS = 0.1


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    depth: int
    side: float  # evidence against main text from this element and those above
    main: float  # evidence for it
    silent: bool
    link: bool
    strong: float = 0.0  # evidence against main text from this element alone
    weak: float = 0.0  # the same from names, which may be those of an element around the main text


@dataclass
class Block:
    home: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Reader(HTMLParser):
    """Blocks of a page in order, with the element that each stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = Element("", None, 0, 0.0, 0.0, False, False)
        self.elements = [self.at]
        self.blocks: list[Block] = []
        self.open: Block | None = None

    def _break(self) -> None:
        self.open = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self._end_head()
        if tag in _ENDS_PARAGRAPH:
            self._close_one({"p"})
        if tag in _SAME_ENDS:
            self._close_one(_SAME_ENDS[tag])
        strong, weak, main = _evidence(tag, attrs, self.at)
        side = self.at.side + strong + weak
        apart = tag in BLOCK_TAGS or side > self.at.side
        if apart:
            self._break()
        elif tag == "br" and self.open:
            self.open.parts.append("\n")
        if tag in VOID_TAGS:
            return
        self.at = Element(
            tag, self.at, self.at.depth + 1, side, main, self.at.silent or tag in SILENT_TAGS, self.at.link or tag == "a",
            strong, weak,
        )
        self.elements.append(self.at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _leave(self) -> None:
        gone = self.at
        self.at = gone.parent
        if gone.tag in BLOCK_TAGS or gone.side > self.at.side:
            self._break()

    def _end_head(self) -> None:
        """Close an open head, as browsers do when the body begins without a tag."""
        up = self.at
        while up.silent and up.tag not in ("head", "template"):
            up = up.parent
        if up.tag == "head":
            stop = up.parent
            while self.at is not stop:
                self._leave()

    def _close_one(self, tags: set[str]) -> None:
        """Close the nearest open element of these tags, unless a container lies between."""
        up = self.at
        while up.parent and up.tag not in tags:
            if up.tag in _SCOPES:
                return
            up = up.parent
        if up.parent:
            stop = up.parent
            while self.at is not stop:
                self._leave()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID_TAGS:
            return
        up = self.at
        while up.parent and up.tag != tag:
            up = up.parent
        if up.parent:
            stop = up.parent
            while self.at is not stop:
                self._leave()
        elif tag in BLOCK_TAGS:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._end_head()
        if self.at.silent or not data:
            return
        if self.open is None or not _same_block(self.open.home, self.at):
            if not data.strip():
                return
            self.open = Block(_block_home(self.at))
            self.blocks.append(self.open)
        self.open.parts.append(data)
        if self.at.link:
            self.open.linked += len(data.split())


def _block_home(e: Element) -> Element:
    """The element that an inline element's text stands in."""
    while e.parent and e.tag not in BLOCK_TAGS and e.side <= e.parent.side:
        e = e.parent
    return e


def _same_block(home: Element, at: Element) -> bool:
    return home is _block_home(at)


def _evidence(tag: str, attrs: list[tuple[str, str | None]], above: Element) -> tuple[float, float, float]:
    """Evidence against main text, strong and weak, of this element alone, and evidence for it with those above."""
    strong, weak, main = 0.0, 0.0, above.main
    if tag in WRAPPING:
        weak += SIDE
    elif tag in SIDE_TAGS:
        strong += SIDE
    elif tag == "header":
        # The head of a page, not of its article.
        strong += SIDE if above.main < 3.0 else 0.0
    if tag in MAIN_TAGS:
        main = max(main, 3.0)
    for name, value in attrs:
        words = {w.lower() for w in _NAME.findall(value or "")}
        value = (value or "").strip().lower()
        if name in ("class", "id"):
            if tag not in ("html", "body") and tag not in MAIN_TAGS:
                weak += SIDE * bool(words & SIDE_WORDS)
            if words & MAIN_WORDS and not words & SIDE_WORDS:
                main = max(main, 2.0)
        elif name == "role":
            if value in WRAPPING:
                weak += SIDE
            else:
                strong += SIDE * (value in SIDE_ROLES)
            main = max(main, 3.0 * (value in ("main", "article")))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            strong += SIDE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            strong += SIDE
    return strong, weak, main


def _unwrap(elements: list[Element], blocks: list[Block]) -> None:
    """Take back most of the evidence of side names whose elements are around the main text.

    Such an element holds more of the words in article and main elements than stand elsewhere, and
    more words than stand elsewhere without any evidence against them; or nearly all words, with no
    article or main element beside it. Elements come parents first.
    """
    if not any(e.weak for e in elements):
        return
    place = {id(e): i for i, e in enumerate(elements)}
    above = [place[id(e.parent)] if e.parent else -1 for e in elements]
    here = [0] * len(elements)
    for b in blocks:
        here[place[id(b.home)]] += len(b.text.split())
    # Words below each element: free of evidence, free of strong evidence, and those of the latter in main elements.
    clean, named, marked = list(here), list(here), [n if e.main >= 3.0 else 0 for n, e in zip(here, elements)]
    for i in range(len(elements) - 1, 0, -1):
        e, up = elements[i], above[i]
        if not e.strong:
            named[up] += named[i]
            marked[up] += marked[i]
            clean[up] += 0 if e.weak else clean[i]
    # The same outside each element.
    outside = [(0, 0, 0)] * len(elements)
    for i in range(1, len(elements)):
        e, up = elements[i], above[i]
        own = (0 if e.strong or e.weak else clean[i], *((0, 0) if e.strong else (named[i], marked[i])))
        outside[i] = tuple(o + w - x for o, w, x in zip(outside[up], (clean[up], named[up], marked[up]), own))
    # Inner elements first: what one around the main text holds counts for those around it.
    words, main = list(here), [0] * len(elements)
    around = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        e, up = elements[i], above[i]
        if e.main >= 3.0 and elements[up].main < 3.0:
            main[i] = words[i]
        if e.weak:
            free, rest, others = outside[i]
            holds = main[i] > others and words[i] > free
            most = words[i] >= MOST * (words[i] + rest) and (not others or elements[up].main >= 3.0)
            around[i] = words[i] > 0 and (holds or most)
        if not e.strong and (not e.weak or around[i]):
            words[up] += words[i]
            main[up] += main[i]
    wrapped = [False] * len(elements)
    for i in range(1, len(elements)):
        e, up = elements[i], above[i]
        wrapped[i] = wrapped[up] or around[i]
        inherited = elements[up].side - WRAPPER * wrapped[up]
        e.side = inherited + e.strong + (0.0 if around[i] else e.weak) + WRAPPER * wrapped[i]


def read_blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    for b in reader.blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in reader.blocks if b.text]
    _unwrap(reader.elements, blocks)
    return blocks


def content_score(block: Block) -> float:
    """How much dearer it is to call the block boilerplate than content."""
    words = len(block.text.split())
    linked = min(1.0, block.linked / words)
    # Text is content unless something speaks against it, and the longer the surer.
    size = min(3.0, 0.5 * math.log2(1 + words)) - 0.25
    return size + block.home.main - block.home.side - 3.0 * linked


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements of the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, weaker the further apart in the tree, and near siblings."""
    found = []
    before: dict[int, list[int]] = {}

    def tie(i: int, j: int, weight: float) -> None:
        same = (blocks[i].home.side >= SIDE) == (blocks[j].home.side >= SIDE)
        found.append((i, j, weight if same else weight * ACROSS))

    for i, b in enumerate(blocks):
        if i:
            tie(i - 1, i, TIE / (1 + _distance(blocks[i - 1].home, b.home)))
        family = before.setdefault(id(b.home.parent or b.home), [])
        for j in family[-SIBLINGS:]:
            tie(j, i, TIE / 3)
        family.append(i)
    return found


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: those with positive scores, changed where ties are dearer.

    Maximum flow by shortest augmenting paths in layers. A node with a positive score is fed by
    that much from the source; one with a negative score drains into the sink.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0.0)
        elif s < 0:
            connect(i, sink, -s, 0.0)
    for a, b, w in edges:
        connect(a, b, w, w)

    tiny = 1e-9
    while True:
        layer = [-1] * (n + 2)
        layer[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and layer[to[e]] < 0:
                    layer[to[e]] = layer[u] + 1
                    queue.append(to[e])
        if layer[sink] < 0:
            return [layer[i] >= 0 for i in range(n)]
        arc = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if room[e] <= tiny)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            while arc[u] < len(out[u]):
                e = out[u][arc[u]]
                if room[e] > tiny and layer[to[e]] == layer[u] + 1:
                    break
                arc[u] += 1
            if arc[u] < len(out[u]):
                path.append(out[u][arc[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                back = path.pop()
                u = to[back ^ 1]
                arc[u] += 1


def main_text(html: str | None) -> str:
    """The main text of one page: content blocks in order, joined by one space."""
    blocks = read_blocks(html or "")
    if not blocks:
        return ""
    content = minimum_cut([content_score(b) for b in blocks], ties(blocks))
    return " ".join(b.text for b, keep in zip(blocks, content) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with a column `text_col`: the main text of `html_col`, '' if there is none or it is null.

    Each page is read whole and by itself. Character references are decoded, white space within a
    block becomes one space, blocks are joined by one space; nothing else is changed or cut. A
    column of the name `text_col` is replaced; all others stay.
    """
    on_workers(pages.sparkSession)
    page = fresh_name(pages, "_page")

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    kept = [c for c in pages.columns if c.lower() != text_col.lower()]
    found = pages.withColumn(page, extract(F.col(f"`{html_col}`").cast("string")))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col(page).alias(text_col))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
