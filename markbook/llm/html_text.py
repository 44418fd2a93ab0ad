"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and runs of words.  Every token has a weight: words count for or against
the main text by the block they stand in, whether they are link text, and whether a container such as
a menu or an advert holds them; tags cost.  The weights are log-odds from labelled pages, those that
mark their main text with exactly one ``article`` or ``main`` element.  Where a page has such elements
and the word weights find at least half of its main text in them, words inside weigh more by the learned
log-odds that such elements and word weights agree, and words outside of a single one less; between
several, words that weigh against don't count.  Elsewhere (teasers, comments) the word weights decide
alone.  Words that containers hold aside weigh nothing.  One linear scan finds the
contiguous region with the largest sum.  Blocks in the region, without those held by containers that
never belong to the main text, make up the result.

Weights are fitted on a bounded sample of labelled pages (``SAMPLE``); every page is scanned whole.
Defined results: null, empty or text-free html gives an empty text; a page whose words all count against
gives an empty text; of regions with equal sums the first, and longest, is taken; rows are independent,
and an empty table gives an empty table.  Malformed markup is read as browsers do: an unfinished
comment, script or tag runs to the end, unknown closing tags are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages to fit on, and the longest one taken, in bytes.
SAMPLE = 2_000
LONGEST = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+(?<=/)>"
    r"|<(?P<raw>script|style|template|textarea|title|svg|iframe|noscript|select|annotation|annotation-xml)(?=[\s/>])"
    r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9-]*)(?P<rest>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)"
    r"|<[/!?](?=[A-Za-z!?/\[])[^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr "
    # Formulas are read as their letters, numbers and signs.
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mpadded mphantom mstyle menclose mtable mtr mtd merror".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that the next block ends.
SIMPLE = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr td th option".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that never hold main text.
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
_ASIDE_NAME = re.compile(
    r"(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|notice|notices|alert|cookie"
    r"|cookies|consent|banner|ad|ads|adv|advert|advertisement|adsense|sponsor|sponsored|promo|comment|comments|"
    r"respond|replies|reply|disqus|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|widget|popup|modal"
    r"|overlay|newsletter|subscribe|signup|login|search|toolbar|pagination|pager|skip|complementary|contentinfo)"
    r"s?",
    re.I,
)


def _set_aside(name: str, rest: str, within: bool) -> bool:
    """Whether an element holds no main text; an article keeps its own header."""
    if name in ASIDE and not (name == "header" and within):
        return True
    if name in MAIN or name in ("body", "html") or not rest:
        return False
    if _HIDDEN.search(rest):
        return True
    return _named_aside(name, rest, within)


def _named_aside(name: str, rest: str, within: bool) -> bool:
    """Whether a whole class, id, role or label says so.  Within the main element an id of a section or
    heading names its topic, and no name sets a heading aside."""
    if within and name in HEADINGS:
        return False
    for kind, *values in _NAMED.findall(rest):
        if within and name == "section" and kind.lower() == "id":
            continue
        if any(map(_ASIDE_NAME.fullmatch, "".join(values).split())):
            return True
    return False


class Page:
    """Tokens of one page: (feature, number of words, block, held aside, inside the main element)."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, int, int, bool, bool]] = []
        self.blocks: list[list[str]] = []
        self.mains = 0
        open_tags: list[tuple[str, bool, bool]] = []
        #: Elements that a name alone sets aside: depth, first token, main elements before it.
        named: list[tuple[int, int, int]] = []
        spans: list[tuple[int, int, int]] = []
        aside = within = links = 0
        tag, own = "body", False
        block: list[str] = []

        def close() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def words(text: str) -> None:
            text = html.unescape(text) if "&" in text else text
            if not text:
                return
            block.append(text)
            n = len(text.split())
            if n:
                held = aside + own
                feature = f"{tag}{'|link' if links else ''}"
                self.tokens.append((feature, n, len(self.blocks), held, within > 0))

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                words(source[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if m["end"] else 1
                continue
            if name == "br":
                block.append(" ")
                continue
            close()
            links = 0
            if not m["end"]:
                tag, own = name, False
                if name in SIMPLE:
                    own = _set_aside(name, m["rest"], within > 0)
                elif name not in VOID:
                    held = _set_aside(name, m["rest"], within > 0)
                    if held and name not in ASIDE and not _HIDDEN.search(m["rest"]):
                        named.append((len(open_tags), len(self.tokens), self.mains))
                    open_tags.append((name, held, name in MAIN))
                    aside += held
                    within += name in MAIN
                    self.mains += name in MAIN and within == 1
            elif name not in SIMPLE and any(t[0] == name for t in open_tags):
                while True:
                    last, held, main = open_tags.pop()
                    aside -= held
                    within -= main
                    if named and named[-1][0] == len(open_tags):
                        _, first, before = named.pop()
                        spans.append((first, len(self.tokens), self.mains - before))
                    if last == name:
                        break
                tag, own = (open_tags[-1][0] if open_tags else "body"), False
            elif name in SIMPLE:
                tag, own = (open_tags[-1][0] if open_tags else "body"), False
            self.tokens.append((f"<{m['end']}{name}>", 0, -1, aside, within > 0))
        if at < len(source):
            words(source[at:])
        close()
        spans += [(first, len(self.tokens), self.mains - before) for _, first, before in named]
        # A name does not set aside what holds the page's main elements.
        less = [0] * (len(self.tokens) + 1)
        for first, end, mains in spans:
            if mains and mains == self.mains:
                less[first] += 1
                less[end] -= 1
        #: What containers hold, by any name.
        self.named = [held > 0 for _, _, _, held, _ in self.tokens]
        self.tokens = [
            (feature, n, block, held > free, inside)
            for (feature, n, block, held, inside), free in zip(self.tokens, accumulate(less))
        ]

    def text(self, number: int) -> str:
        return " ".join("".join(self.blocks[number]).split())


#: What a page's weights start from: counts of words or tags inside and outside of main text.
PRIOR = {
    "p": (4, 1), "p|link": (2, 2), "div": (2, 2), "td": (1, 1), "li": (2, 2), "li|link": (1, 4),
    "h1": (3, 1), "h2": (3, 1), "h3": (3, 1), "blockquote": (3, 1), "pre": (3, 1), "section": (2, 2),
}


#: Log-odds that main elements and word weights agree, and the pages that they start from.
MAIN_TAG = "=main"
AGREED = 30


def fit(pages: list[str]) -> dict[str, float]:
    """Log-odds of words and tags from pages with one main element; others are left out.

    Words weigh at most 3 either way.  Tags cost 0.05 at least: whatever crosses them should be worth it.
    """
    inside, outside = Counter(), Counter()
    marked = [page for page in map(Page, pages) if page.mains == 1]
    for page in marked:
        for feature, n, _, held, within in page.tokens:
            if held and n:
                continue
            (inside if within else outside)[feature] += n or 1
    weights = {}
    for feature in {*inside, *outside, *PRIOR}:
        a, b = PRIOR.get(feature, (1, 1))
        odds = math.log((inside[feature] + a) / (outside[feature] + b))
        tag = feature.startswith("<")
        weights[feature] = min(odds / 4, -0.05) if tag else max(-3.0, min(3.0, odds))
    agreed = sum(_agrees(page, weights) for page in marked)
    weights[MAIN_TAG] = max(0.0, math.log((agreed + AGREED + 1) / (len(marked) - agreed + 1)))
    return weights


def _weight(weights: dict[str, float], feature: str, n: int) -> float:
    return weights.get(feature, 0.2 if n else -0.2)


def _agrees(page: Page, weights: dict[str, float]) -> bool:
    """Whether word weights find at least half of a page's main text in its main elements."""
    sums = [0.0, 0.0]
    for feature, n, _, held, within in page.tokens:
        if n and not held:
            sums[within] += n * max(0.0, _weight(weights, feature, n))
    return page.mains > 0 and sums[True] >= sums[False]


def region(scores: list[float]) -> tuple[int, int]:
    """The first, longest run with the largest positive sum, as [start, end); (0, 0) without one."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0 or i == 0:
            total, start = 0.0, i
        total += x
        if total > best or (total == best and best > 0 and start == found[0]):
            best, found = total, (start, i + 1)
    return found


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Text of the best region: one line a block, white space inside a block as one space."""
    if not source:
        return ""
    page = Page(source)
    agrees = _agrees(page, weights)
    tag = weights.get(MAIN_TAG, 0.0) if agrees else 0.0
    several = agrees and page.mains > 1
    scores, blocks = [], []
    for (feature, n, block, held, within), named in zip(page.tokens, page.named):
        # Teasers and comments stay aside although they are all that is marked.
        held = held if agrees else named
        weight = _weight(weights, feature, n)
        apart = several and not within and (weight < 0 or not n)
        if held and n or apart:
            weight = 0.0
        elif n:
            weight += tag if within else 0.0 if several else -tag
        scores.append(n * weight if n else weight)
        blocks.append(block if n and not held and not apart else None)
    start, end = region(scores)
    chosen = dict.fromkeys(b for b in blocks[start:end] if b is not None)
    return "\n".join(page.text(b) for b in chosen)


def labelled(pages: DataFrame) -> list[str]:
    """A bounded sample of pages that mark their main text, by a hash of the id."""
    marked = pages.where(F.octet_length("html") <= LONGEST).where(F.col("html").rlike(r"(?i)<(?:article|main)\b"))
    ids = marked.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = marked.select("page_id", "html").join(F.broadcast(ids.distinct()), "page_id", "left_semi")
    return [r["html"] for r in rows.select("html").limit(2 * SAMPLE).collect()]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = fit(labelled(pages))

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s, weights) for s in sources], dtype=object)

    texts = pages.select("page_id", "url", extract("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
