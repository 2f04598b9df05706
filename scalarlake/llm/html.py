"""Main text of web pages by the distribution of text over line blocks (operator 2)."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarlake.llm.common import pieces

#: Elements whose whole content is no text of the page.
HIDDEN = frozenset("script style noscript template svg math head title iframe object audio video canvas select textarea".split())
#: Elements that never belong to the article.
ASIDE = frozenset("nav footer aside form button dialog menu".split())
#: Elements that end a line block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open <p>, and elements beyond which they do not look for it.
ENDS_P = BLOCK - frozenset("body button caption dialog html legend option tbody td tfoot th thead title tr".split()) | frozenset(
    "dialog dir listing plaintext pre search xmp".split())
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
_sections = frozenset("caption colgroup tbody tfoot thead".split())
#: Start tags that end the open elements of the first set, as far as the next open element of the second.
IMPLIED = {
    "li": (frozenset(("li",)), BLOCK - frozenset(("address", "div", "p", "li")) | SCOPE),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), BLOCK - frozenset(("address", "div", "p", "dt", "dd")) | SCOPE)),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th", "caption", "colgroup")), frozenset(("tr", "table")))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    **dict.fromkeys(_sections, (_sections | frozenset(("tr", "td", "th")), frozenset(("table",)))),
    **dict.fromkeys(("rt", "rp"), (frozenset(("rt", "rp")), frozenset(("ruby",)))),
}
#: Start tags that leave <head> open; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is raw text up to the end tag.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Words of class, id and role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended "
    "related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Compounds of them that do; other compounds (no-sidebar, comments-open) say something about the element that has them.
COMPOUNDS = frozenset(
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad breadcrumb-nav comment-list comment-respond comments-area "
    "comments-section cookie-banner cookie-bar cookie-consent cookie-notice footer-nav main-menu main-nav nav-bar nav-menu newsletter-signup "
    "page-footer page-sidebar popup-overlay related-articles related-links related-posts right-sidebar left-sidebar share-bar share-buttons "
    "share-links sidebar-left sidebar-right site-footer site-header site-nav site-navigation skip-link social-links social-media "
    "social-share sponsored-content top-bar top-nav widget-area".split())
#: Marks that inside an article are part of it.
HEADS = frozenset(("header", "masthead"))
#: These never are what surrounds an article, whatever their class says.
ARTICLE = frozenset(("article", "main", "body", "html"))

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_display = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]*)", re.I)
_space = re.compile(r"\s+")

#: Lines in a window, and the text a window must hold to be part of the article.
WINDOW, SURGE = 3, 80
#: What a line inside <article> or <main> counts besides its letters.
INSIDE = 1 << 20


def _surrounds(name: str, attributes: str, inside: bool) -> bool:
    if name in ASIDE:
        return True
    if name in ARTICLE or not attributes:
        return False
    found: dict[str, str] = {}
    for m in _attribute.finditer(attributes):  # of a repeated attribute the first counts
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip().lower())
    if found.get("hidden", "until-found") != "until-found" or found.get("aria-hidden") == "true":
        return True
    if (shown := _display.findall(found.get("style", ""))) and shown[-1].lower() == "none":
        return True
    tokens = {t for k in ("class", "id", "role") for t in found.get(k, "").split()}
    marks = tokens & MARKS - HEADS if inside else tokens & MARKS
    return bool(marks) or any(t.replace("_", "-") in COMPOUNDS for t in tokens)


#: A block element as (depth, place of its tag, the block element around it).
Block = tuple[int, int, "Block | None"]
Line = tuple[str, int, bool, Block]
ROOT: Block = (0, -1, None)


def lines_of(page: str) -> list[Line]:
    """Line blocks of a page after stripping markup: text, letters in links, whether inside <article> or <main>, and the
    block element around it.

    Blocks that belong to the surroundings (menus, adverts, forms ...) are left out.  What holds the only article is
    none of these: if no line inside <article> or <main> is left, and one that is hidden has more text than all that is
    left, the elements that hide it are read as plain ones.
    """
    out, wrapped = _scan(page, frozenset())
    if wrapped and not any(x[2] for x in out):
        size, wrappers = max(wrapped, key=lambda x: x[0])
        if size > sum(len(x[0]) for x in out):
            out, _ = _scan(page, wrappers)
    return out


def _scan(page: str, plain: frozenset[int]) -> tuple[list[Line], list[tuple[int, frozenset[int]]]]:
    """Lines of lines_of(), and per hidden <article> or <main> the size of its text and the start tags that hide it.

    plain: places of start tags that hide nothing.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether it hides what it holds, place of its tag
    opened: Counter[str] = Counter()  # how many of them have a name
    around: list[Block] = []  # the block elements among them
    wrapped: dict[int, tuple[int, frozenset[int]]] = {}
    hidden = link = inside = linked = 0

    def flush() -> None:
        nonlocal linked
        text = _space.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, linked, inside > 0, around[-1] if around else ROOT))
        parts.clear()
        linked = 0

    def close(start: int, end: int | None = None) -> None:
        """End open elements, from the last one on if no end is given; the only place where elements leave the stack."""
        nonlocal hidden, link, inside
        for closed, hides, place in reversed(stack[start:end]):
            if around and around[-1][1] == place:
                around.pop()
            opened[closed] -= 1
            hidden -= hides
            link -= closed == "a"
            inside -= closed in ("article", "main")
        del stack[start:end]

    def imply(names: frozenset[str], within: frozenset[str]) -> None:
        """End the outermost open element of these names that is nearer than any of `within`, and all that it holds."""
        if not any(opened[x] for x in names):
            return
        found = None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                found = k
            elif stack[k][0] in within:
                break
        if found is not None:
            close(found)

    at = 0
    while True:
        m = _token.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if stack and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not hidden:
            parts.append(text)
            if link:
                linked += len(text.strip())
        elif text and inside and (size := len(text.strip())):
            for _, _, place in stack:
                if place in wrapped:
                    wrapped[place] = (wrapped[place][0] + size, wrapped[place][1])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes the nearest open element of its name
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in IMPLIED:
            imply(*IMPLIED[name])
        if name in ENDS_P:
            imply(frozenset(("p",)), SCOPE)
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if name in VOID:
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a" and link:  # links do not nest: an unclosed one ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    close(k, k + 1)
                    break
        hides = name in HIDDEN or (name == "header" and not inside) or _surrounds(name, m[3], inside > 0)
        hides = hides and m.start() not in plain
        if hidden and name in ("article", "main"):
            wrapped[m.start()] = (0, frozenset(place for _, hiding, place in stack if hiding))
        stack.append((name, hides, m.start()))
        opened[name] += 1
        if name in BLOCK:
            around.append((len(around) + 1, m.start(), around[-1] if around else ROOT))
        hidden += hides
        link += name == "a"
        inside += name in ("article", "main")
    flush()
    return out, list(wrapped.values())


def _common(a: Block, b: Block) -> Block:
    """The nearest block element around both."""
    while a[1] != b[1]:
        if a[0] >= b[0]:
            a = a[2]
        else:
            b = b[2]
    return a


def _joined(lines: list[Line], own: list[int], stretches: list[tuple[int, int]], best: int) -> tuple[int, int]:
    """The stretch `best` with what belongs to it on a page that does not mark its article, as a range of lines.

    The next stretch belongs to it if all lines between have text of their own, or if one of its long lines has the same
    parent element as one of this article.  Then come the lines with text of their own before and after, as
    far as they lie in the element that holds the long lines: headings, lists, short last paragraphs.
    """
    long = [n >= SURGE // 2 for n in own]
    bare = list(accumulate((not n for n in own), initial=0))  # lines without text of their own before each line
    parents = lambda a, b: {(lines[i][3][2] or ROOT)[1] for i in range(a, b) if long[i]}
    start, end = stretches[best]
    known = parents(start, end)
    for others in (stretches[best + 1:], stretches[best - 1::-1] if best else ()):
        for a, b in others:
            gap = bare[a] - bare[end] if a >= end else bare[start] - bare[b]
            if not gap or parents(a, b) & known:
                known |= parents(a, b)
                start, end = min(start, a), max(end, b)
    held = [lines[i][3] for i in range(start, end) if long[i]] or [x[3] for x in lines[start:end]]
    top = held[0]
    for x in held[1:]:
        top = _common(top, x)
    if all(x[1] == top[1] for x in held):  # one element holds all long lines: look into its parent
        top = top[2] or ROOT
    within = lambda i: own[i] and _common(lines[i][3], top)[1] == top[1]
    while start and within(start - 1):
        start -= 1
    while end < len(lines) and within(end):
        end += 1
    return start, end


#: What stands between two blocks in the text of the query.
BREAK = "\n\n"


def main_text(page: str | None, between: str = "\n") -> str:
    """The article of a page, blocks joined by `between`; empty if there is none.

    Each line block counts its letters outside links.  Sums over WINDOW lines rise to SURGE where an
    article begins and fall below it where it ends; of the stretches between surge and dive the one with most text
    is kept, from its first to its last line with text of its own, with the stretches and short lines that belong to
    it, see _joined().  Lines inside <article> or <main> always reach
    the surge, so short paragraphs there are kept; pages without these elements go by the distribution alone.
    A page too short for any surge keeps all its lines.
    """
    lines = lines_of(page) if page else []
    if not lines:
        return ""
    own = [max(0, len(text) - link) + INSIDE * inside if 2 * link < len(text) or inside else 0 for text, link, inside, _ in lines]
    sums = [sum(own[i:i + WINDOW]) for i in range(len(own))]
    stretches, start = [], None
    for i, s in enumerate([*sums, 0]):
        if start is None and s >= SURGE and own[i]:
            start = i
        elif start is not None and (s < SURGE and (i == len(sums) or own[i] < SURGE // 2)):
            stretches.append((start, i))
            start = None
    if not stretches:
        return between.join(x[0] for x, n in zip(lines, own) if n)
    if any(x[2] for x in lines):
        return between.join(x[0] for x in lines if x[2])
    best = max(range(len(stretches)), key=lambda k: (sum(own[slice(*stretches[k])]), -k))
    start, end = _joined(lines, own, stretches, best)
    while not own[end - 1]:
        end -= 1
    return between.join(x[0] for x in lines[start:end])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [main_text(x, BREAK) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (main text of the whole html, two line
    breaks between blocks), n_chars (its code points).

    A null or empty page, and one of markup alone, has an empty text.  Ids and urls pass through, nulls and repeated
    rows included; other columns are left.  Nothing is shuffled.
    """
    ids = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return ids.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
