"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with the tag path from the root to
its block element (inline markup is not a level; paths are interned numbers).  For
every path the length of its text outside links and its punctuation are aggregated
and divided by its blocks; both ratios are smoothed along the page and fused by
multiplication; a path loses by the share of its text that links hold.  Half the
standard deviation of the fused ratios is the threshold.

The ratios decide twice.  The paths above the threshold locate the article: it is the article or
main element around them, or else the deepest element that holds all of them, and its
wrappers as long as no block of links stands in them.  Inside the article, where text is
content unless shown otherwise, a path drops out below the threshold's ``INSIDE``
power: lists of links and the like go, short lists and captions stay.  Headings go
with the block that they head.

Menus, footers, sidebars, scripts and the parts of forms are left out by their tags.
Other tags, roles and names (class or id) are weaker.  An element whose tag or role says form, banner or the like is left
out unless it holds most of the page's prose (text outside links, in paths with punctuation).  One that its name says is
an advert, sidebar, notice or comments is left out unless it holds most and there is no other text.
A name that only may say so (it has a content name too, or is a
word of texts as well, as in ``related-work``) leaves the element to the ratios: it
is content if its text outside blocks of links and blocks without punctuation
outweighs the rest.  A name that is negated (``no-comments``) says nothing.

Defined results: null and empty pages have the empty text; so has a page with
boilerplate only; what is cut off inside a tag or comment is dropped; unclosed and
stray tags are tolerated; nothing is capped; repeated rows have equal results; time
and memory are linear in the page, nested elements included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS = lambda s: frozenset(s.split())

# Fixed by HTML: kinds of elements.
VOID = WORDS("area base br col embed hr img input link meta param source track wbr")
RAW = WORDS("script style textarea title noscript xmp iframe noembed noframes")
INLINE = WORDS(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr"
)
CLOSES_P = WORDS(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul"
)
CLOSES_SAME = {"li": WORDS("ul ol menu"), "dt": WORDS("dl"), "dd": WORDS("dl"), "tr": WORDS("table"), "td": WORDS("tr table"), "th": WORDS("tr table"), "option": WORDS("select"), "thead": WORDS("table"), "tbody": WORDS("table"), "tfoot": WORDS("table")}

# What says that an element is not the article: never it, or not unless most of the prose is there.
NOT_CONTENT_TAGS = WORDS(
    "head nav footer aside button select option script style textarea title noscript template iframe svg canvas object "
    "xmp noembed noframes audio video map label datalist"
)
DOUBTFUL_TAGS = WORDS("form fieldset dialog menu")
NOT_CONTENT_ROLES = WORDS("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
NOT_CONTENT_NAMES = WORDS(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr "
    "notice notices alert sidebar side aside rail widget widgets related recommended share sharing social menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer foot bottom comment comments reply replies disqus respond newsletter subscribe subscription "
    "signup login form popup modal overlay pagination pager paging toolbar copyright legal disclaimer"
)
# Those that are words of articles too, or of parts of them.
AMBIGUOUS_NAMES = WORDS(
    "side bottom foot header form legal notice notices alert banner related recommended share sharing social reply replies copyright disclaimer "
    "consent promotion promotions subscription"
)
NEGATIONS = WORDS("no not non without with has have hide hidden")
CONTENT_TAGS = WORDS("article main")
CONTENT_NAMES = WORDS("article content post entry story main text body")
HEADINGS = WORDS("h1 h2 h3 h4 h5 h6")
PAGE = WORDS("body html #root")

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?P<shut>>)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?P<shut2>>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：]")

#: Weights of a block's neighbours in smoothing.
SMOOTH = np.array([0.25, 0.5, 0.25])
#: The threshold in standard deviations, and its power inside the article.
CUT = 0.5
INSIDE = 0.25


@lru_cache(4096)
def names_say(said: tuple[tuple[str, ...], ...], inside: bool) -> str:
    """Whether the names of an element, each in its parts, exclude it: "no", "doubt" or nothing."""
    sure = doubt = content = False
    for parts in said:
        parts = parts[: next((k for k, x in enumerate(parts) if x in NEGATIONS), len(parts))]
        pairs = [a + b in NOT_CONTENT_NAMES for a, b in zip(parts, parts[1:])]
        hits = [x for x in parts if x in NOT_CONTENT_NAMES]
        if not hits and not any(pairs):
            content = content or any(x in CONTENT_NAMES for x in parts)
        elif parts[-1] in NOT_CONTENT_NAMES - AMBIGUOUS_NAMES or (pairs and pairs[-1]):
            sure = True  # The last part is the noun: post-comments are comments.
        elif any(x in CONTENT_NAMES for x in parts):
            doubt = True
        elif any(pairs) or any(x not in AMBIGUOUS_NAMES for x in hits):
            sure = True
        elif inside or len(hits) < len(parts):
            doubt = True
        else:
            sure = True
    return "" if not (sure or doubt) else "no" if sure and not content else "doubt"


class Element:
    """An element, with what it takes over from its parent.  ``first`` and ``last`` are
    the numbers, in page order, of itself and of its last descendant."""

    __slots__ = ("tag", "parent", "path", "holder", "linked", "excluded", "weak", "named", "doubt", "article", "main", "depth", "first", "last")

    def __init__(self, tag: str, parent: "Element | None", path: int, said: tuple, role: str, hidden: bool, number: int):
        self.tag, self.parent, self.path = tag, parent, path
        self.first = self.last = number
        self.depth = parent.depth + 1 if parent else 0
        self.holder = parent.holder if parent and tag in INLINE else self
        self.linked = tag == "a" or (parent is not None and parent.linked)
        inside = parent is not None and parent.declared is not None
        # The outermost article and main elements around.
        self.article = parent.article if parent and parent.article else self if "article" in (tag, role) else None
        self.main = parent.main if parent and parent.main else self if "main" in (tag, role) else None
        self.excluded = tag in NOT_CONTENT_TAGS or hidden or (parent is not None and parent.excluded)
        root = tag in ("html", "body") or tag in CONTENT_TAGS
        self.weak = not root and (tag in DOUBTFUL_TAGS or role in NOT_CONTENT_ROLES or (tag == "header" and not inside))
        says = "" if root or tag in INLINE | HEADINGS | {"p", "header"} else names_say(said, inside)
        self.named, self.doubt = says == "no", says == "doubt"

    @property
    def declared(self) -> "Element | None":
        """The element that says it is the article, if this lies in one."""
        return self.article or self.main

    def holds(self, other: "Element") -> bool:
        return self.first <= other.first <= self.last


class Block:
    __slots__ = ("element", "text", "size", "linked", "marks")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked
        self.size = len("".join(text.split()))
        self.marks = len(PUNCTUATION.findall(text))

    @property
    def free(self) -> int:
        """Characters outside links."""
        return max(0, self.size - self.linked)


def _attributes(attrs: str) -> tuple[tuple[tuple[str, ...], ...], str, bool]:
    """The parts of class and id names, the role, and whether the element is hidden."""
    said: list[tuple[str, ...]] = []
    role, hidden = "", False
    if attrs.strip(" /\t\r\n"):
        for key, *values in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                said += [tuple(x.lower() for x in NAME_PARTS.findall(name)) for name in value.split()]
            elif key == "role":
                role = value.strip().lower()
            elif key == "aria-hidden":
                hidden = hidden or value.lower() == "true"
            elif key == "style":
                hidden = hidden or re.search(r"display\s*:\s*none", value) is not None
        hidden = hidden or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)) is not None
    return tuple(said), role, hidden


class Page:
    """The elements and text blocks of a page in order; script, style and the like are left out."""

    def __init__(self, page: str):
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.paths: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self._push("#root", "")
        self._read(page)
        self._flush()
        self._close_to(0)

    def _push(self, tag: str, attrs: str) -> None:
        parent = self.stack[-1] if self.stack else None
        said, role, hidden = _attributes(attrs)
        above = parent.path if parent else -1
        path = above
        if tag not in INLINE:
            names = sorted({x for parts in said for x in parts}) if tag in ("div", "section", "td") else []
            path = self.paths.setdefault((above, ".".join([tag, *names])), len(self.paths))
        e = Element(tag, parent, path, said, role, hidden, len(self.elements))
        self.elements.append(e)
        self.stack.append(e)
        self.open[tag] += 1

    def _close_to(self, k: int) -> None:
        if any(e.tag not in INLINE for e in self.stack[k:]):
            self._flush()
        for e in self.stack[k:]:
            e.last = len(self.elements) - 1
            self.open[e.tag] -= 1
        del self.stack[k:]

    def _close_open(self, tags: frozenset[str], within: frozenset[str]) -> None:
        if any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    self._close_to(k)
                    return
                if self.stack[k].tag in within:
                    return

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._say(" ")
        elif not self.open[tag]:
            if tag == "p":
                self._flush()
        else:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._close_to(k)
                    return
                if tag in INLINE and self.stack[k].tag not in INLINE:
                    return

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.blocks.append(Block(self.stack[-1].holder, text, self.linked))
        self.parts.clear()
        self.linked = 0

    def _say(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.stack[-1].linked:
                self.linked += len("".join(html.unescape(text).split()))

    def _read(self, page: str) -> None:
        at = 0
        while True:
            found = MARKUP.search(page, at)
            if found is None:
                self._say(page[at:])
                return
            self._say(page[at : found.start()])
            at = found.end()
            tag = (found["name"] or found["name2"] or "").lower()
            if not tag:
                continue
            if not (found["shut"] or found["shut2"]):
                return
            attrs = found["attrs"] if found["name"] else found["attrs2"]
            if found["end"] or found["end2"]:
                self._end(tag)
            elif tag in VOID:
                if tag in INLINE:
                    self._say(" " if tag in ("br", "img") else "")
                else:
                    self._flush()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                if tag not in INLINE:
                    if tag in CLOSES_P:
                        self._close_open(frozenset({"p"}), frozenset({"table", "td", "th", "button"}))
                    if tag in CLOSES_SAME:
                        self._close_open(frozenset({tag}) | ({"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else set()), CLOSES_SAME[tag])
                    self._flush()
                self._push(tag, attrs)


def blocks_of(page: str) -> list[Block]:
    return Page(page).blocks


def _of_links(b: Block) -> bool:
    return 2 * b.linked > b.size


def _sums(page: Page, amounts: dict[int, float]) -> list[float]:
    """For each element, what the blocks in it have together; ``amounts`` is by element number."""
    total = [amounts.get(k, 0) for k in range(len(page.elements))]
    for e in reversed(page.elements):
        if e.parent is not None:
            total[e.parent.first] += total[e.first]
    return total


def _by_element(blocks: list[Block], amount) -> dict[int, float]:
    out: dict[int, float] = {}
    for b in blocks:
        out[b.element.first] = out.get(b.element.first, 0) + amount(b)
    return out


def candidates(page: Page) -> list[Block]:
    """The blocks that neither tags nor names leave out."""
    left = [b for b in page.blocks if not b.element.excluded]
    marked = {b.element.path for b in left if b.marks}
    prose = _sums(page, _by_element([b for b in left if b.element.path in marked and not _of_links(b)], lambda b: b.free))
    outweighs = _sums(page, _by_element([b for b in left if b.element.tag not in HEADINGS], lambda b: len(b.text) if b.marks and not _of_links(b) else -len(b.text)))
    text = _sums(page, _by_element(left, lambda b: b.free))
    # Text that no name says is something else.
    under, rest = [False] * len(page.elements), text[0]
    for e in page.elements:
        above = e.parent is not None and under[e.parent.first]
        under[e.first] = above or e.named
        rest -= text[e.first] if e.named and not above else 0
    out = [False] * len(page.elements)
    for e in page.elements:
        most = 2 * prose[e.first] > prose[0] > 0
        leave = (e.weak and not most) or (e.named and not (most and rest <= 0)) or (e.doubt and outweighs[e.first] < 0)
        # No name above a main element excludes it.
        out[e.first] = leave or (e.main is not e and e.parent is not None and out[e.parent.first])
    return [b for b in left if not out[b.element.first]]


def fused_ratios(found: list[Block]) -> dict[int, float]:
    """Each path's ratios of text length and punctuation, smoothed along the blocks, fused, and less by the share of links;
    under -1 the threshold."""
    paths: dict[int, list[float]] = {}
    for b in found:
        sums = paths.setdefault(b.element.path, [0, 0, 0, 0])
        for k, x in enumerate((1, b.free, b.marks, b.size)):
            sums[k] += x
    length = np.array([paths[b.element.path][1] / paths[b.element.path][0] for b in found], dtype=float)
    marks = np.array([paths[b.element.path][2] / paths[b.element.path][0] for b in found], dtype=float)
    free = np.array([paths[b.element.path][1] / paths[b.element.path][3] for b in found], dtype=float)
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), SMOOTH, mode="valid")
    fused = smooth(length) * (1 + smooth(marks)) * free
    score: dict[int, float] = {}
    for b, x in zip(found, fused.tolist()):
        score[b.element.path] = score.get(b.element.path, 0.0) + x / paths[b.element.path][0]
    return score | {-1: CUT * float(fused.std())}


def article_of(chosen: list[Block], found: list[Block]) -> Element:
    """The article around the content nodes."""
    own = [b for b in chosen if b.element.declared]
    if 2 * sum(len(b.text) for b in own) >= sum(len(b.text) for b in chosen):
        chosen = own
        if len({id(b.element.declared) for b in own}) == 1:
            return own[0].element.declared
    # The deepest element that holds all content nodes.
    article = chosen[0].element
    low, high = min(b.element.first for b in chosen), max(b.element.first for b in chosen)
    while not article.first <= low <= high <= article.last:
        article = article.parent
    # A single paragraph's or list's holder is not yet the article.
    while article.parent is not None and article.tag in HEADINGS | {"p", "li", "ul", "ol", "dl", "blockquote", "pre", "td", "tr", "tbody", "table"}:
        article = article.parent
    if article.declared:
        return article.declared
    # What stands beside it in one wrapper belongs to it, unless links are there: they are the page's.
    links = [b.element for b in found if _of_links(b) and not article.holds(b.element)]
    before = max((e.first for e in links if e.first < article.first), default=-1)
    after = min((e.first for e in links if e.first > article.last), default=1 << 60)
    while article.tag not in PAGE and article.parent.tag not in PAGE and article.parent.first > before and article.parent.last < after:
        article = article.parent
    return article


def main_blocks(page: Page, ratios=fused_ratios) -> list[Block]:
    """The content among the blocks of a page."""
    found = candidates(page)
    if not found:
        return []
    mean = ratios(found)
    least = mean[-1]
    path = lambda b: b.element.path
    chosen = [b for b in found if mean[path(b)] >= least and mean[path(b)] > 0] or found
    article = article_of(chosen, found)
    at = [k for k, b in enumerate(found) if article.holds(b.element)]
    if article.tag in PAGE:
        # Nothing wraps the article: what content paths span.
        picked = {id(b) for b in chosen}
        span = [k for k in at if id(found[k]) in picked]
        at = list(range(span[0], span[-1] + 1))
    # The title may stand right before the article.
    while at[0] > 0 and found[at[0] - 1].element.tag in HEADINGS and (article.tag in PAGE or found[at[0]].element.tag not in HEADINGS):
        at.insert(0, at[0] - 1)
    inside = least**INSIDE if least > 1 else least
    good = {k: mean[path(found[k])] > 0 and mean[path(found[k])] >= inside for k in at}
    if not any(good.values()):
        return [found[k] for k in at]
    # A heading goes with the next block that isn't one; the last ones with what is before them.
    follows = True
    for k in reversed(at):
        if found[k].element.tag in HEADINGS:
            good[k] = follows
        else:
            follows = good[k]
    return [found[k] for k in at if good[k]]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in main_blocks(Page(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: a row per page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
