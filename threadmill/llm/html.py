"""Main text of HTML pages by two passes over their blocks.

A page is cut into blocks at block-level tags. Pass one looks at each block alone: the share of text in links, its length and its
density of stop words call it good or bad, or leave it open; elements and class words that name what is not the article count as
evidence against it. Pass two gives each open block the label of its nearest decided neighbour: nearest in the element tree
first (the innermost element around the block that holds a decided one), then in page order. Of two that are as near, a heading
takes the one below and other blocks the bad one, or the good one inside an article element; an article without any decided block is good.

Where the good text inside article and main elements is at least as long as that outside, the rest of the page goes; else such
elements are teasers, and only those of their blocks stay that pass one calls good.

Edge cases: null or empty html, and pages without a good block, give the empty text; unclosed tags, comments, scripts
and broken references are read as browsers do; repeated pages are treated alike; empty tables give no rows; extra columns are ignored.
Time and memory grow with the page's length alone, however deep its elements nest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Frequent words of the languages handled, elements that start a block, and those never shown.
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "le la les et des en un une du que qui dans pour pas est par sur au plus avec ce il sont se ou "
    "el los de y una del las con por para su al lo como más pero sus ya o fue este si son".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
HIDDEN = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|button|select"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words of class, id and role that mark what is not the article.
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
BAD_WORDS = frozenset(
    "ad adbox ads adslot adunit advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "login masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar usercomments widget contentinfo complementary "
    "alert overlay reviews feedback teaser teasers".split())
#: A word that takes the meaning from the one behind it: "content-with-sidebar" is no sidebar.
TURNS = frozenset("with has no without".split())
GOOD_TAGS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a later sibling or the parent's end closes.
IMPLIED = frozenset("p li dt dd tr td th option".split())
LONG, SHORT, DENSE, SPARSE, LINKED = 140, 50, 0.25, 0.1, 0.5
GOOD, BAD, OPEN = 1, 0, 2

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: int
    shared: int = 0  # elements around it that were around the block before, too
    heading: bool = False
    label: int = OPEN


def marked(attributes: str) -> bool:
    """Whether a class, id or role names what is not the article."""
    for a in _MARK.finditer(attributes):
        before = ""
        for w in _WORDS.findall((a[1] or a[2] or a[3] or "").lower()):
            if w in BAD_WORDS and before not in TURNS:
                return True
            before = w
    return False


def blocks(page: str) -> list[Block]:
    """Blocks with text in page order; ``article`` numbers the article or main element around it, 0 for none."""
    out: list[Block] = []
    text: list[str] = []
    linked = links = low = 0
    stack: list[tuple[str, bool, int]] = []  # tag, bad, article
    open_: dict[str, int] = {}  # how many of a tag the stack holds
    bad, article, articles, at = False, 0, 0, 0

    def flush() -> None:
        nonlocal linked, low
        if text:
            t = _BLANK.sub(" ", "".join(text)).strip()
            if t:
                out.append(Block(t, min(linked, len(t)), bad, article, low, bool(stack) and stack[-1][0] in HEADINGS))
                low = len(stack)
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if links:
                linked += len(t.strip())

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            links = 0 if m["end"] else 1
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"]:
            if open_.get(tag, 0):
                while stack:
                    t, bad, article = stack.pop()
                    open_[t] -= 1
                    if t == tag:
                        break
            links = 0
        elif tag not in VOID:
            while stack and stack[-1][0] in IMPLIED and (stack[-1][0] == tag or stack[-1][0] == "p"):
                t, bad, article = stack.pop()
                open_[t] -= 1
            stack.append((tag, bad, article))
            open_[tag] = open_.get(tag, 0) + 1
            foreign = tag in BAD_TAGS or ("=" in m["rest"] and tag not in ("body", "html", "main") and marked(m["rest"]))
            if tag in GOOD_TAGS and not bad and not foreign:
                articles += 1
                article = articles
            # a header inside an article may hold its title
            bad = bad or foreign or (tag == "header" and not article)
        low = min(low, len(stack) - (not m["end"] and tag not in VOID))
    say(page[at:])
    flush()
    return out


def judge(b: Block) -> int:
    """Pass one."""
    n = len(b.text)
    if b.bad or b.linked > LINKED * n:
        return BAD
    words = b.text.split()
    dense = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
    if n >= LONG:
        return GOOD if dense >= SPARSE else OPEN
    return GOOD if n >= SHORT and dense >= DENSE else OPEN


def settle(found: list[Block]) -> None:
    """Both passes, in place."""
    for b in found:
        b.label = judge(b)
    decided, n = [b.label for b in found], len(found)
    # of each open block, the decided one before and behind it and how many elements hold both
    before, behind = [(-1, -1)] * n, [(-1, -1)] * n
    at, depth = -1, -1
    for i in range(n):
        depth = min(depth, found[i].shared)
        before[i] = (at, depth)
        if decided[i] != OPEN:
            at, depth = i, 1 << 30
    at, depth = -1, -1
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            depth = min(depth, found[i + 1].shared)
        behind[i] = (at, depth)
        if decided[i] != OPEN:
            at, depth = i, 1 << 30
    vouched = {b.article for b in found if b.article and not b.bad and b.label != OPEN}
    for i, b in enumerate(found):
        if b.label != OPEN:
            continue
        (l, x), (r, y) = before[i], behind[i]
        if b.article and b.article not in vouched:
            b.label = GOOD
        elif l < 0 and r < 0:
            b.label = BAD
        elif r < 0 or (l >= 0 and (x, l - i) > (y, i - r)):
            b.label = decided[l]
        elif l < 0 or (y, i - r) > (x, l - i) or b.heading:
            b.label = decided[r]
        else:
            b.label = max(decided[l], decided[r]) if b.article else min(decided[l], decided[r])


def main_text(page: str | None) -> str:
    """The good blocks, one on a line."""
    found = blocks(page or "")
    settle(found)
    inside = [b for b in found if b.label == GOOD and b.article]
    outside = [b for b in found if b.label == GOOD and not b.article]
    if sum(len(b.text) for b in inside) >= sum(len(b.text) for b in outside):  # what surrounds an article is not part of it
        return "\n".join(b.text for b in inside)
    return "\n".join(b.text for b in found if b.label == GOOD and (not b.article or judge(b) == GOOD))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    small_batches(pages.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
