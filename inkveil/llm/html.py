"""Main text of web pages by container paths that the pages of a host agree on.

1. Each page is read once into blocks of text, each with its chain of elements.
   Elements are named by tag and first class, digits generalised, so that
   ``post-17`` and ``post-18`` are one.  Every container gets the text of its
   blocks, less what is links, and passes half of it up.  From the best one the
   page climbs while the container above holds only more text (``widened``);
   where that ends is the page's vote.
2. Spark counts the votes per host and path.  A path with at least
   ``WINNING_SHARE`` of a host's votes wins; hosts may have several layouts.
3. Each page is read again: its text is what lies in its best container among
   the winning paths, or in its own best one if it has none of them, widened
   again, with parts beside it that are text.  Menus,
   headers, footers, sidebars, notices, adverts, forms and comments are left
   out wherever they stand: by tag, or by a whole name in class, id or role
   (``sidebar``, ``site-header``, not ``has-sidebar``).  A name doesn't count on
   what holds the ``main`` or most of the page's text (``read_again``), nor does a
   tag such as ``form`` around the whole page (``opened_again``).

Time and memory are linear in a page's length, however deep its elements nest:
paths are numbers, and what lies in an element is a range of its page's blocks.

Edge cases: NULL or empty html gives an empty text; pages without a host (NULL
or odd urls) share one; pages cut off anywhere are read to their end; a page
without any container gives all its text that is no boilerplate; repeated rows
vote each; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inkveil.llm.common import batch_udf, small_or_all, staged

WINNING_SHARE = 0.1
# Characters of a block that make a part beside the best container text, and the
# share of that container's text that a part needs where it stands in the body.
PARAGRAPH, BESIDE = 80, 0.2

# Elements whose content is no text, or never part of an article.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = {
    "nav", "header", "footer", "aside", "form", "button", "select", "noscript", "template", "iframe", "svg", "dialog", "menu",
    "object", "canvas", "audio", "video", "head", "fieldset", "datalist", "annotation", "annotation-xml",
} | RAW
# Of these, what can stand around a whole page.
WRAPPING = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}
# A form is read if it holds so many times the text of all else that is read.
WHOLE_FORM = 2
FORMULA = {
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom",
    "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr",
    "mtd", "semantics", "annotation", "annotation-xml",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "br", "wbr", "img",
} | FORMULA
# Blocks that hold text themselves; all other blocks are containers.
LEAVES = {"p", "pre", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "address", "summary"} | HEADINGS
# Words in class, id or role that mark boilerplate.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation"
    " menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary widget cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup comment comments disqus"
    " replies share sharing social related recommended recommendations pagination pager toolbar login search hidden".split()
)
COMMENTS = {"comment", "comments", "disqus", "replies"}
# Marks of what is never an article, however long it is.
APART = COMMENTS | set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs pagination pager share sharing promo promoted promotion sponsor sponsored cookie cookies consent gdpr popup modal"
    " newsletter subscribe subscription signup related recommended recommendations".split()
)
# Words that can stand before and after a mark in one name: ``site-header``, ``comment-list``.
BEFORE = set(
    "site page main primary secondary tertiary top bottom left right global local sub user blog post posts article entry content section"
    " story news mobile desktop sticky fixed floating inline side web app wp block td js google dfp the my mega drop dropdown off canvas email"
    " mail legal privacy eu push in".split()
)
AFTER = set(
    "primary secondary left right top bottom list lists item items box boxes area block blocks bar bars slot slots unit units section sections"
    " wrap wrapper wrappers container containers inner outer holder row rows column link links icon icons button buttons btn form field input"
    " thread threads body text title heading content contents meta count counter template label leaderboard zone space frame iframe image"
    " images panel pane group post posts article articles story stories stack strip tray toggle message messages dialog window prompt policy"
    " trail nav logo brand reply respond desktop mobile".split()
)
KEPT_WHATEVER = {"html", "body", "main"} | HEADINGS

# Quotes count behind an equals sign only, and then up to the next one; no part of a tag is tried twice.
_GIVEN = r"(?>[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*|(?=>|\Z)))?+|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_GIVEN})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Element:
    tag: str
    name: str
    path: int  # a number per path of names
    up: Element | None
    dropped: Element | None  # the nearest dropped element, itself included
    link: bool
    first: int = 0  # of the page's blocks those from here
    last: int = 0  # up to here lie in it
    in_main: bool = False  # these three with the element itself
    in_article: bool = False
    wrapped: bool = False  # dropped by what can stand around a page only
    number: int = 0  # of a dropped element, in page order
    score: float = 0.0
    unread: int = 0  # characters that are no link, of a dropped element's own text
    holds_page: bool = False  # of a dropped element: a ``main``, an article or a paragraph lies in it
    mark: Element | None = None  # the nearest element, itself included, that its name marks as boilerplate
    apart: int = 0  # 1: marked as what is never an article, 2: as comments
    has_main: bool = False  # of a marked element: a ``main`` lies in it


@dataclass(slots=True)
class Block:
    element: Element
    place: int  # among all blocks of the page
    text: list[str] = field(default_factory=list)
    linked: int = 0
    cleaned: str | None = None


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    containers: list[Element]
    paths: dict[tuple[int, str], int]

    def path_of(self, path: str) -> int | None:
        """The number of a path, if the page has it."""
        number: int | None = 0
        for name in path.split("/")[1:]:
            number = self.paths.get((number, name))
            if number is None:
                return None
        return number

    def between(self, first: int, last: int) -> list[Block]:
        """The blocks with places from ``first`` to before ``last``."""
        return self.blocks[bisect_left(self.blocks, first, key=lambda b: b.place) : bisect_left(self.blocks, last, key=lambda b: b.place)]


def path_of(element: Element) -> str:
    names = []
    while element.up is not None:
        names.append(element.name)
        element = element.up
    return "".join(f"/{n}" for n in reversed(names))


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and "=" in text or "hidden" in text else {}


@functools.lru_cache(maxsize=65536)
def marks_of(name: str) -> frozenset[str]:
    """The marks in a class, id or role: the whole name, or a compound of marks with ``BEFORE`` and ``AFTER`` words.

    Names of layout and state (``has-sidebar``, ``overflow-hidden``, ``search-results``) have none.
    """
    if re.search(r"[^\w-]", name):  # ``md:hidden`` holds under a condition
        return frozenset()
    parts = [w for p in _PARTS.findall(name) if len(w := p.lower()) > 1]
    at = [i for i, w in enumerate(parts) if w in MARKS]
    if not at or any(w not in BEFORE and w not in MARKS for w in parts[: at[0]]) or any(w not in AFTER and w not in MARKS for w in parts[at[0] :]):
        return frozenset()
    return frozenset(parts[i] for i in at) if len(at) < 2 or parts[-1] != "hidden" else frozenset(["hidden"])


def is_dropped(tag: str, given: dict[str, str]) -> bool:
    """Boilerplate by its tag, or hidden."""
    return tag in DROPPED or tag not in KEPT_WHATEVER and ("hidden" in given or given.get("aria-hidden") == "true")


def marks(tag: str, given: dict[str, str]) -> set[str]:
    """The words in class, id and role that mark an element as boilerplate."""
    if not given or tag in KEPT_WHATEVER:
        return set()
    found = {m for key in ("class", "id", "role") for name in given.get(key, "").split() for m in marks_of(name)}
    return found & COMMENTS if tag == "article" else found


def read_again(blocks: list[Block], marked: list[Element]) -> set[int]:
    """Marked elements that are read nevertheless, by ``id``.

    Those that hold a ``main`` or more unlinked text than all else that is read,
    articles counting threefold, unless they are ``APART``.  While a page has no
    text, the outermost one with most of it; text that is ``APART`` counts a
    quarter there, and comments only if there is nothing else.
    """
    read: set[int] = set()
    for e in marked:
        outer = []
        while e is not None:
            outer.append(e)
            e = e.up.mark if e.up is not None else None
        if outer[0].has_main and not any(o.apart for o in outer):
            read.update(id(o) for o in outer)
    weighed = []  # unlinked text, and the marked elements it lies in, from the outermost
    for block in blocks:
        size, chain = len(clean(block)), []
        gain = max(0.0, size - 2.0 * min(block.linked, size))
        mark = block.element.mark
        while mark is not None:
            chain.append(mark)
            mark = mark.up.mark if mark.up is not None else None
        weighed.append((gain * (3 if block.element.in_article else 1), chain[::-1]))
    while True:
        seen, own, under = 0.0, dict.fromkeys(map(id, marked), 0.0), dict.fromkeys(map(id, marked), 0.0)
        for gain, chain in weighed:
            left = [e for e in chain if id(e) not in read]
            if not left:
                seen += gain
            else:
                under[id(left[0])] += gain
                own[id(left[0])] += gain if len(left) == 1 else 0.0
        closed = [e for e in marked if id(e) not in read]
        if seen > 0:
            most = max((e for e in closed if not e.apart), key=lambda e: own[id(e)], default=None)
            if most is None or own[id(most)] <= seen:
                return read
        else:
            most = max((e for e in closed if under[id(e)] > 0), key=lambda e: (e.apart < 2, under[id(e)] * (1 if e.apart else 4)), default=None)
            if most is None:
                return read
        read.add(id(most))


def opened_again(page: Page, dropped: list[Element]) -> set[int]:
    """Numbers of dropped elements that stand around the page and are read nevertheless, with those around them.

    A form with ``WHOLE_FORM`` times the text of all else, if it holds paragraphs
    or an article; any other of ``WRAPPING`` only while the page has no text.
    """
    seen = sum(max(0, len(clean(b)) - 2 * b.linked) for b in page.blocks)
    able = [e for e in dropped if e.wrapped and e.holds_page and e.unread > (WHOLE_FORM * seen if e.tag in ("form", "fieldset") else 0)]
    most = max((e for e in able if not seen or e.tag in ("form", "fieldset")), key=lambda e: e.unread, default=None)
    opened = set()
    while most is not None:
        opened.add(most.number)
        most = most.up.dropped if most.up is not None else None
    return opened


def page_of(html: str) -> Page:
    """Text blocks outside boilerplate in page order, and the containers."""
    opened: set[int] = set()
    while True:
        page, marked, dropped = parsed(html, opened)
        more = opened_again(page, dropped)
        if not more:
            break
        opened |= more  # at least doubles the text that is read
    if not marked:
        return page
    read = read_again(page.blocks, marked)
    is_read: dict[int, bool] = {}
    for e in marked:  # outer ones come first
        around = e.up.mark if e.up is not None else None
        is_read[id(e)] = id(e) in read and (around is None or is_read[id(around)])

    def kept(element: Element) -> bool:
        return element.mark is None or is_read[id(element.mark)]

    return Page([b for b in page.blocks if kept(b.element)], [e for e in page.containers if kept(e)], page.paths)


def parsed(html: str, opened: set[int]) -> tuple[Page, list[Element], list[Element]]:
    """The page, its marked elements and its dropped ones; dropped elements with numbers in ``opened`` are plain ones."""
    root = Element("", "", 0, None, None, False)
    at, now = 0, root
    block: Block | None = None
    blocks: list[Block] = []
    containers: list[Element] = []
    marked: list[Element] = []
    dropped: list[Element] = []
    paths: dict[tuple[int, str], int] = {}
    still_open: Counter[str] = Counter()
    size, numbers = len(html), 0

    def say(text: str) -> None:
        nonlocal block
        if not text:
            return
        if now.dropped is not None:
            if not now.link:
                now.dropped.unread += len(text.strip())
            return
        if block is None:
            holder = now
            while holder.tag in INLINE:
                holder = holder.up
            block = Block(holder, len(blocks))
            blocks.append(block)
        block.text.append(text)
        if now.link:
            block.linked += len(text)

    def close_to(element: Element) -> None:
        nonlocal now
        while now is not element:
            still_open[now.tag] -= 1
            now.last = len(blocks)
            now = now.up

    for match in _TOKEN.finditer(html):
        if match.start() < at:
            continue
        say(html[at : match.start()])
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say("\n")
            continue
        inline = tag in INLINE
        if not inline:
            block = None
        if match[1]:
            if not still_open[tag]:
                continue
            seen = now
            while seen.up is not None and seen.tag != tag:
                if inline and seen.tag not in INLINE:
                    seen = root
                    break
                seen = seen.up
            if seen.up is not None:
                close_to(seen.up)
            continue
        if not inline:
            # A block ends what can't hold it: open inline elements in a paragraph, and the paragraph.
            seen = now
            while seen.up is not None and (seen.tag in INLINE or seen.tag in LEAVES):
                if seen.tag == "p" or seen.tag in HEADINGS or seen.tag == tag and tag in ("li", "td", "th", "dt", "dd"):
                    close_to(seen.up)
                    break
                if seen.tag not in INLINE:
                    break
                seen = seen.up
        if tag in VOID:
            continue
        given = attributes(match[3])
        name = tag
        if label := given.get("class", "").split():
            name += "." + _DIGITS.sub("#", label[0])
        elif label := given.get("id", ""):
            name += "#" + _DIGITS.sub("#", label)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else size
            continue
        if match[3].endswith("/") and tag not in INLINE and tag not in LEAVES:
            continue
        path = now.path
        for part in name.split("/"):
            path = paths.setdefault((path, part), len(paths) + 1)
        outer, now = now, Element(tag, name, path, now, now.dropped, now.link or tag == "a", len(blocks), mark=now.mark)
        still_open[tag] += 1
        is_main = tag == "main" or given.get("role") == "main"
        now.in_main, now.in_article = outer.in_main or tag == "main", outer.in_article or tag == "article"
        if is_dropped(tag, given):
            numbers += 1
            if numbers not in opened:
                visible = tag in WRAPPING and "hidden" not in given and given.get("aria-hidden") != "true"
                now.wrapped = visible and (outer.dropped is None or outer.dropped.wrapped)
                now.dropped, now.number = now, numbers
                dropped.append(now)
        if now.dropped is not None:
            now.dropped.holds_page |= is_main or tag in ("article", "p")
            continue
        if is_main and now.mark is not None:
            now.mark.has_main = True
        elif found := marks(tag, given):
            now.mark, now.apart = now, 2 if found & COMMENTS else 1 if found & APART else 0
            marked.append(now)
        if not inline and tag not in LEAVES:
            containers.append(now)
    rest = html[at:]
    say(rest[: rest.rfind("<")] if re.search(r"<[/a-zA-Z!?][^>]*\Z", rest) else rest)
    close_to(root)
    root.last = len(blocks)
    return Page(blocks, containers, paths), marked, dropped


def clean(block: Block) -> str:
    """Character references decoded, white space turned into single blanks."""
    if block.cleaned is None:
        block.cleaned = " ".join(unescape("".join(block.text)).split())
    return block.cleaned


def holder(element: Element | None) -> Element | None:
    """The nearest container."""
    while element is not None and (element.tag in INLINE or element.tag in LEAVES):
        element = element.up
    return element if element is not None and element.up is not None else None


def best_container(page: Page, allowed: set[int | None] | None = None) -> Element | None:
    """The container with the highest score, not widened; ties to the first.  ``allowed`` limits the paths."""
    for element in page.containers:
        element.score = 0.0
    for block in page.blocks:
        text = "".join(block.text)
        gain = max(0.0, len(text) - 2.0 * block.linked)
        element = holder(block.element)
        while element is not None and gain >= 1:
            element.score += gain
            gain /= 2
            element = holder(element.up)
    weight = {"article": 3.0, "main": 2.5}
    chosen = [e for e in page.containers if e.score > 0 and (allowed is None or e.path in allowed)]
    return max(chosen, key=lambda e: e.score * weight.get(e.tag, 1.0), default=None)


def below(element: Element, above: Element) -> Element:
    """The child of ``above`` that an element in it lies in, the element itself if that is ``above``."""
    while element is not above and element.up is not above:
        element = element.up
    return element


def widened(best: Element, page: Page) -> tuple[Element, list[Block]]:
    """The container around ``best`` that holds the whole text, and blocks beside it that are text, too.

    It climbs while all else in the container above is text: what isn't mostly
    links, with a block of ``PARAGRAPH`` characters in each part, or anything not
    mostly links inside an article or ``main``.  An article is left for a ``main``
    around it only.  Nothing climbs to the body; of other parts, also of the
    body's, those that are text are taken in alone.
    """
    at, beside = best, []

    def said(first: int, last: int) -> list[tuple[Block, int, int]]:
        return [(b, len(t), min(b.linked, len(t))) for b in page.between(first, last) if (t := clean(b))]

    least = BESIDE * sum(n - linked for _, n, linked in said(best.first, best.last))
    top = best
    while top.up is not None:
        top = top.up
    while at.tag not in ("html", "body", "main"):
        if at.tag == "article" and not at.in_main:
            break
        above = holder(at.up) or top
        parts: dict[int, list[tuple[Block, int, int]]] = {}
        # What lies in the container above, but not in this one, is met at this step only.
        for b, n, linked in said(above.first, at.first) + said(at.last, above.last):
            child = below(b.element, above)
            # Blocks that stand in ``above`` itself are parts of their own.
            parts.setdefault(id(b) if child is above else id(child), []).append((b, n, linked))
        parts = {k: v for k, v in parts.items() if any(b.element.tag not in HEADINGS for b, _, _ in v)}
        whole = above.up is not None and above.tag not in ("html", "body")

        def is_text(part: list[tuple[Block, int, int]]) -> bool:
            size, linked = sum(n for _, n, _ in part), sum(x for _, _, x in part)
            return 4 * linked <= size and any(n >= PARAGRAPH for b, n, _ in part if b.element.tag not in HEADINGS) and (whole or size - linked >= least)

        texts = [v for v in parts.values() if is_text(v)]
        marked = at.tag != "article" and (at.up.in_article or at.up.in_main)
        loose = marked and 2 * sum(x for v in parts.values() for _, _, x in v) < sum(n for v in parts.values() for _, n, _ in v)
        if whole and best is at and (loose or len(texts) == len(parts)):
            best, beside = above, []
        else:
            beside += [b for v in texts for b, _, _ in v]
        at = above
        if not whole:
            break
    return best, beside


def vote(html: str | None) -> str | None:
    """The path of a page's best container."""
    if not html:
        return None
    page = page_of(html)
    best = best_container(page)
    return path_of(widened(best, page)[0]) if best else None


def extract(html: str | None, winners: list[str] | None) -> str:
    """A page's main text, a line per block."""
    if not html:
        return ""
    page = page_of(html)
    blocks = page.blocks
    best = (best_container(page, {*map(page.path_of, winners)}) if winners else None) or best_container(page)
    if best is not None:
        best, beside = widened(best, page)
        taken = {b.place for b in beside}
        upto = 0
        for e in page.containers:  # in page order, so one inside another begins no earlier
            if e.path == best.path and e.last > upto:
                taken.update(b.place for b in page.between(max(e.first, upto), e.last))
                upto = e.last
        blocks = [b for b in blocks if b.place in taken]
    return "\n".join(text for b in blocks if (text := clean(b)))


@batch_udf("string")
def _votes(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([vote(h) for h in batch], dtype=object)


@batch_udf("string")
def _texts(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, winners in pages:
        yield pd.Series([extract(h, None if w is None else list(w)) for h, w in zip(html, winners)], dtype=object)


def host_of(url: Column) -> Column:
    """The host of a url in lower case without ``www.``; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]*)", 1)
    return F.coalesce(host, F.lit(""))


def host_paths(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """``host, paths``: the winning paths; votes are counted map-side, a row per host and path is shuffled."""
    votes = pages.select(host.alias("host"), _votes(html).alias("path")).where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").count()
    by_host = counted.groupBy("host").agg(F.sum("count").alias("all"), F.max(F.struct("count", "path")).alias("most"))
    won = counted.join(by_host, "host").where((F.col("count") >= WINNING_SHARE * F.col("all")) | (F.col("path") == F.col("most.path")))
    return won.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def main_texts(pages: DataFrame, host: Column, html: str = "html", into: str = "main_text") -> DataFrame:
    """Add the main text of each page."""
    paths = staged(host_paths(pages, host, html), "html-paths").select(F.col("host").alias(f"{into}_host"), F.col("paths").alias(f"{into}_paths"))
    joined = pages.withColumn(f"{into}_key", host).join(small_or_all(paths), F.col(f"{into}_key") == F.col(f"{into}_host"), "left")
    return joined.withColumn(into, _texts(html, f"{into}_paths")).drop(f"{into}_key", f"{into}_host", f"{into}_paths")
