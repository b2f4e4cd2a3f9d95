"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Each has a weight: words score by what they
stand in, tags mostly cost. The run with the largest sum is the main content; a linear
scan finds it. Weights are learned from labelled pages, those that mark their main
content themselves (an article or main element, or such a role): for every kind of
token, the log of how much more often it occurs inside the marked region than outside.
Counts are grouped over all labelled pages of the table; kinds are tag names and the
enclosing element of a word, a few hundred at most, so the model is small at any scale.

Only what is never text is left out beforehand (``NO_TEXT``: head, scripts, styles, drawings).
Navigation, footers, sidebars, forms, adverts, comments and the like (``SIDE``, ``SIDE_ROLES``,
``NEVER``, hidden elements) are kinds of their own, ``side`` and a name: their words are scanned
like all others, with learned weights, and count as outside in learning. So the scan
chooses the region. A run cannot leave out what lies within it: such elements inside
the run are cut as holes afterwards. They cost the run no more than ``HOLE_WORDS`` words each,
so that an advert does not part an article, and nothing within a region the page marks. An element that holds an article or main
element is no side matter, nor is a form or fieldset that holds half the page's words.
Other names that hint at navigation and the like (``HINTS``) make words a kind of their own too,
but no hole. Classes and ids count as whole names. A role, or a name of ``HINTS``, says nothing
on headings, sections and inline elements of the marked region. Pages the parser cannot
close are read as browsers do: an open element ends with its parent, a new block ends a paragraph.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: element names of HTML, and words in class, id and role attributes. ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
NO_TEXT = frozenset(
    "head title script style noscript iframe noembed noframes template svg annotation annotation-xml embed canvas audio video "
    "select textarea input".split()
)
SIDE = frozenset("nav footer aside form button fieldset dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br"}
INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd mark q s samp small span strong sub sup tt u var".split())
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header section".split())
WRAPPERS = frozenset("form fieldset header".split())  # of SIDE and the like, those that may stand around the article
HALF = frozenset("form fieldset".split())  # and those that do where they hold half the page's words
ADS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle ad-banner ad-box ad-container ad-slot "
    "ad-unit ad-wrapper google-ad sponsored share share-bar share-buttons sharing sharing-buttons social-share".split()
)
COMMENTS = frozenset(
    "comments comments-area comments-list comments-section comment-form comment-list commentlist comment-respond disqus "
    "disqus-thread".split()
)
NEVER = ADS | COMMENTS
HINTS = frozenset(
    "adv banner sponsor promo promotion promoted "
    "nav navbar nav-bar main-nav site-nav navigation main-navigation site-navigation menu menubar main-menu breadcrumb "
    "breadcrumbs header site-header page-header masthead footer site-footer page-footer sidebar side-bar aside toc "
    "pagination pager notice notices cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr alert popup "
    "modal overlay newsletter newsletter-signup subscribe subscription signup login "
    "comment respond reply replies discussion "
    "social social-links related related-posts related-articles recommended recommendations widget widget-area toolbar "
    "search searchbox search-box search-form hidden".split()
)
SIDE_ROLES = frozenset("banner navigation menu menubar toolbar search contentinfo complementary alert".split())
MAIN_ROLES = frozenset(["main", "article"])
# --- End of fixed values. ---

HOLE_WORDS = 20  # of a side element that count, at most

KNOWN = BLOCKS | INLINE | VOID | RAW | SIDE | NO_TEXT | frozenset(
    "html page data time label legend output progress meter picture object param ruby rp rt del ins slot font acronym "
    "big center strike tt dfn optgroup map area search".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_BARE = re.compile(r"\b(hidden)\b(?!\s*=)", re.I)


class Token:
    """A tag of the page, or the text between two tags.

    ``inside`` says whether it lies in the region that the page marks itself, ``side`` whether in
    a side element, and ``hole`` whether that one is within the region; ``words`` are those that count.
    """

    __slots__ = ("kind", "inside", "side", "hole", "text", "words")

    def __init__(self, kind: str, inside: bool, side: bool, hole: bool, text: str | None = None, words: int = 0):
        self.kind, self.inside, self.side, self.hole, self.text, self.words = kind, inside, side, hole, text, words


def _attributes(text: str) -> dict[str, str]:
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(text)} if "=" in text else {}
    if "hidden" in text and _BARE.search(text):
        found.setdefault("hidden", "")
    return found


KEPT, HINTED, SIDE_UNLESS_MAIN, SIDE_UNLESS_ARTICLE, SIDE_ANYWAY, NEVER_TEXT = range(6)


def _fate(name: str, attributes: dict[str, str], in_main: bool) -> tuple[int, str]:
    """Whether an element stays, is of a hinted kind, is a side element (unless it holds such an element), or no text; the kind."""
    if name in NO_TEXT:
        return NEVER_TEXT, name
    if name in SIDE or (name == "header" and not in_main):
        return (SIDE_UNLESS_ARTICLE if name in WRAPPERS else SIDE_ANYWAY), name
    if not attributes or name in ("html", "body", "article", "main"):
        return KEPT, name
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return SIDE_ANYWAY, "hidden"
    style = attributes.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return SIDE_ANYWAY, "hidden"
    marks = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().replace("_", "-").split()
    if not COMMENTS.isdisjoint(marks):
        return SIDE_UNLESS_MAIN, "comments"
    if not ADS.isdisjoint(marks):
        return SIDE_UNLESS_ARTICLE, "ads"
    if in_main and (name in SECTIONS or name in INLINE):
        return KEPT, name
    roles = SIDE_ROLES.intersection(attributes.get("role", "").lower().split())
    if roles:
        return SIDE_UNLESS_ARTICLE, min(roles)
    return (KEPT if HINTS.isdisjoint(marks) else HINTED), name


def tokens(page: str) -> list[Token]:
    """The page's tags and texts, in order, without what is never text.

    A text's kind names its block element and whether it is hinted at, or the side element
    it lies in; a tag's kind is the tag, within side elements ``side`` and their name.
    """
    holders: set[int] = set()
    out = _tokens(page, holders)
    return _tokens(page, holders) if holders else out


class _Element:
    """An open element: what holds below it, and the words so far."""

    __slots__ = ("name", "omitted", "side", "inside", "hinted", "fate", "start", "hole", "words", "counted")

    def __init__(self, name, omitted, side, inside, hinted, fate, start, hole):
        self.name, self.omitted, self.side, self.inside, self.hinted, self.hole = name, omitted, side, inside, hinted, hole
        self.fate, self.start, self.words, self.counted = fate, start, 0, 0


_PAGE = _Element("page", False, "", False, False, KEPT, -1, False)


def _tokens(page: str, holders: set[int]) -> list[Token]:
    """The tokens, where elements that start at a place in ``holders`` stay; adds those found to hold the article."""
    spared = frozenset(holders)
    out: list[Token] = []
    stack: list[_Element] = []
    forms: list[_Element] = []
    position = words = 0
    while position < len(page):
        match = _TOKEN.match(page, position)
        if match is None:  # a tag that never ends
            break
        position = match.end()
        cdata, closing, name, rest, text = match.groups()
        top = stack[-1] if stack else _PAGE
        if text is not None or cdata is not None:
            if not top.omitted:
                shown = cdata if text is None else html.unescape(text)
                count = len(shown.split())
                words += count
                if top.side:
                    for element in stack:
                        if element.fate in (SIDE_UNLESS_MAIN, SIDE_UNLESS_ARTICLE, SIDE_ANYWAY):
                            element.words += count
                    outer = next(e for e in stack if e.side)
                    counts = max(0, min(count, HOLE_WORDS - outer.counted))
                    outer.counted += counts
                    out.append(Token("word side " + top.side, False, True, top.hole, shown, counts))
                else:
                    block = next((e.name for e in reversed(stack) if e.name not in INLINE and e.name not in MATH), "page")
                    block = block if block in KNOWN else "other"
                    out.append(Token(("hint " if top.hinted else "word ") + block, top.inside, False, False, shown, count))
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if open_at is None:
                if name in ("p", "br") and not top.omitted:
                    out.append(_tag("/" + name, top))
                continue
            closed = stack[open_at]
            del stack[open_at:]
            if not closed.omitted and name not in MATH:
                out.append(_tag("/" + name, closed if closed.side else stack[-1] if stack else _PAGE))
            continue
        if name in CLOSES_P:
            # A block ends an open paragraph, and with it what is open inside it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCKS or stack[i].name in ("button", "object"):
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in ends:
                    del stack[i:]
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "tr", "select", "menu"):
                    break
        top = stack[-1] if stack else _PAGE
        attributes = _attributes(rest)
        marked = name in ("article", "main") or attributes.get("role") in MAIN_ROLES
        marked = marked or attributes.get("itemprop") == "articleBody"
        fate, kind = _fate(name, attributes, top.inside)
        if match.start() in spared or (marked and fate == HINTED):
            fate = KEPT
        aside = SIDE_UNLESS_MAIN <= fate <= SIDE_ANYWAY
        gone = bool(top.side) or top.omitted or fate > HINTED
        hinted = fate == HINTED or (not marked and top.hinted)
        # The outermost side element names the kind.
        side = top.side or (kind if aside else "")
        element = _Element(name, top.omitted or fate == NEVER_TEXT, side, not gone and (top.inside or marked), hinted, fate, match.start(), top.hole or (top.inside and bool(side)))
        if not element.omitted and name not in MATH:
            out.append(_tag(name, element if side else top))
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, position)
            position = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            continue
        if name in VOID or rest.rstrip().endswith("/") and name not in BLOCKS:
            continue
        around = [e for e in stack if e.fate > HINTED]
        if marked and around and fate <= HINTED and all(e.fate < SIDE_ANYWAY for e in around):
            if name == "main" or attributes.get("role") == "main" or all(e.fate != SIDE_UNLESS_MAIN for e in around):
                holders.update(e.start for e in around)
        if aside and name in HALF:
            forms.append(element)
        stack.append(element)
    holders.update(e.start for e in forms if 2 * e.words >= words > 0 and e.start not in spared)
    return out


def _tag(name: str, within: _Element) -> Token:
    kind = "side " + within.side if within.side else name if name.lstrip("/") in KNOWN else "other"
    return Token(kind, within.inside, bool(within.side), within.hole)


def counted(page: str) -> Counter:
    """Occurrences by (kind, inside) on a page that marks its main content; else none."""
    found = tokens(page)
    if not any(t.inside for t in found):
        return Counter()
    counts: Counter = Counter()
    for token in found:
        counts[token.kind, token.inside] += token.words if token.text is not None else 1
    return +counts


def _start(kind: str) -> float:
    """A kind's weight before anything is learned."""
    if kind.startswith(("word side ", "hint ")):
        return -1.0
    return 1.0 if kind.startswith("word ") else -2.0


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of a kind's tokens lying inside rather than outside; smoothed, at most 6 either way.

    Words score positive, hinted words, words of side elements and tags negative unless the
    labelled pages clearly say otherwise: a word's weight starts at 1, a hinted or side one's
    at -1, a tag's at -2, and what is learned counts as n / (n + 20) of it.
    """
    out = {}
    for kind in {k for k, _ in counts}:
        within, without = counts.get((kind, True), 0), counts.get((kind, False), 0)
        prior = _start(kind)
        learned = math.log((within + 0.5) / (without + 0.5))
        trust = (within + without) / (within + without + 20)
        out[kind] = max(-6.0, min(6.0, (1 - trust) * prior + trust * learned))
        if not kind.startswith(("word ", "hint ")):
            out[kind] = min(out[kind], -0.1)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; the first of equal ones, (0, 0) if none is positive."""
    best, start, end = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run without its holes, white space folded, one per line."""
    found = tokens(page or "")
    scores = []
    for token in found:
        if token.hole:
            scores.append(0.0)
        elif token.text is None:
            scores.append(weights.get(token.kind, -2.0))
        else:
            scores.append(token.words * weights.get(token.kind, _start(token.kind)))
    start, end = best_run(scores)
    lines, line = [], []
    for token in found[start:end]:
        if token.side:
            continue
        if token.text is not None:
            line.append(token.text)
        elif token.kind.lstrip("/") in BLOCKS:
            lines.append("".join(line))
            line = []
    lines.append("".join(line))
    folded = (" ".join(x.split()) for x in lines)
    return "\n".join(x for x in folded if x)


def learn(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of the table; without any, the starting ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                counts.update(counted(page.as_py() or ""))
        kinds = sorted(counts)
        columns = [pa.array([k for k, _ in kinds], pa.string()), pa.array([i for _, i in kinds], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in kinds], pa.int64())], ["kind", "inside", "n"])

    each = pages.select(F.col(html_column).alias("html")).mapInArrow(run, "kind string, inside boolean, n long")
    # Kinds are known names of elements, roles and the like, and a common one for made-up elements.
    totals = each.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["kind"], r["inside"]): r["n"] for r in totals})


def extract(pages: DataFrame, weights: dict[str, float], html_column: str = "html") -> DataFrame:
    """The columns of ``pages`` but the HTML, and ``text`` and ``n_chars``; columns of these names are replaced.

    Null, empty and text-free pages have an empty text. Whole pages are read.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py(), weights) for page in batch.column("__html")]
            columns = [*(batch.column(c) for c in kept), pa.array(found, pa.string())]
            columns.append(pa.array([len(t) for t in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    rows = pages.select(*kept, F.col(html_column).alias("__html"))
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars long")
