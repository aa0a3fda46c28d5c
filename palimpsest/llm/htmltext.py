"""Main text of web pages by composite text density.

Every element of the document tree has a text density: its characters per tag, adjusted by the share of them
that links hold, in relation to the whole body. The sum of the densities of an element's children is highest for the element that
holds the main text directly. The threshold is the least density on the path from the body to the element of
greatest density sum. Where the main text lies is for the densities to say: around that element, the region grows to take in others of a like sum, and
the headline before it. From the region down, each element that reaches the threshold gives its subtree of greatest density sum.
What by its tag is no part of an article (menus, forms, scripts and so on) isn't measured at all; nor is what its class says stands aside,
unless it holds most of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCK = CLOSES_P | frozenset("body html head li dt dd tr td th thead tbody tfoot caption option legend title".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements that never hold main text.
NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea input menu dialog title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of class, id and role that mark what stands beside the main text.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?<!(?<![^\s_-])has[_-])(?<!(?<![^\s_-])no[_-])(?<!(?<![^\s_-])with[_-])(?<!(?<![^\s_-])without[_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|popup|modal|nav\w*|menu\w*|breadcrumbs?|sidebar|widget\w*"
    r"|comments?|disqus|replies|footer|masthead|site-header|page-header|share\w*|social|related|recommend\w*|newsletter|subscri\w*|pagination|pager|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: A tag's attributes. A quoted value follows "=" alone; possessive, so that no text is read twice.
ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)?+)*+")
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
COMMENT_END = re.compile(r"--!?>")
SPACE = re.compile(r"\s+")
#: Share of the greatest density sum at which an element beside the densest one belongs to the main text too.
PEAK = 0.4


class Element:
    __slots__ = ("chars", "density", "doubted", "link_chars", "link_tags", "name", "nodes", "parent", "pruned", "tags", "total")

    def __init__(self, name: str, parent: Element | None, pruned: bool = False, doubted: bool = False) -> None:
        self.name, self.parent, self.pruned, self.doubted = name, parent, pruned, doubted
        self.nodes: list[Element | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _aside(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element stands beside the main text for sure, and whether the words of its class, id or role say so."""
    if name in NEVER:
        return True, False
    if not attrs or attrs.isspace():
        return False, False
    doubted = False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main") and ASIDE.search(value):
            doubted = True
    return False, doubted


def _settle(root: Element) -> None:
    """Prune what its words say stands aside, unless it holds an article, main or h1 or most of the body's text."""
    order = _ordered(root)
    held: dict[int, tuple[int, bool]] = {}
    for x in reversed(order):
        chars = sum(len(n) - n.count(" ") for n in x.nodes if isinstance(n, str) and not n.isspace())
        inner = [held[id(n)] for n in x.nodes if isinstance(n, Element) and not n.pruned]
        held[id(x)] = chars + sum(c for c, _ in inner), x.name in ("article", "main", "h1") or any(m for _, m in inner)
    for x in order:
        chars, marked = held[id(x)]
        if x.doubted and not marked and 2 * chars <= held[id(root)][0]:
            x.pruned = True


class Open:
    """The elements that are open, with the depths of each name, so that no tag walks up the tree."""

    def __init__(self, root: Element) -> None:
        self.stack, self.depths = [root], {}

    def deepest(self, names) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def push(self, x: Element) -> None:
        self.depths.setdefault(x.name, []).append(len(self.stack))
        self.stack.append(x)

    def close(self, depth: int) -> None:
        while depth and len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()

    def close_within(self, names, scope) -> None:
        """Close the deepest of ``names`` unless one of ``scope`` was opened in it."""
        depth = self.deepest(names)
        if depth > self.deepest(scope):
            self.close(depth)


def parse(source: str) -> Element:
    """The document tree below a body. Broken markup is read leniently: what is unclosed ends with its parent, a tag cut off by the end is dropped."""
    root = Element("body", None)
    opened, pos, end = Open(root), 0, len(source)
    while pos < end:
        at = source.find("<", pos)
        if at < 0 or at + 1 >= end:
            opened.stack[-1].nodes.append(source[pos:])
            break
        closes = source[at + 1] == "/"
        named = NAME.match(source, at + 1 + closes)
        if named is None and source[at + 1] not in "!?/":  # no markup
            opened.stack[-1].nodes.append(source[pos : at + 1])
            pos = at + 1
            continue
        if at > pos:
            opened.stack[-1].nodes.append(source[pos:at])
        if source.startswith("<!--", at):
            done = COMMENT_END.search(source, at + 2 if source.startswith(("<!-->", "<!--->"), at) else at + 4)
            pos = done.end() if done else end
            continue
        if named is None:
            pos = source.find(">", at) + 1 or end
            continue
        attrs = ATTRIBUTES.match(source, named.end())
        pos = attrs.end() + 1
        if pos > end:  # the tag isn't closed
            break
        name = named[0].lower()
        if closes:
            opened.close(opened.deepest((name,)))
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            opened.close_within(("p",), ("button", "td", "th", "table"))
        if name in CLOSED_BY_SAME:
            opened.close_within(CLOSED_BY_SAME[name], ("ul", "ol", "dl", "table", "select"))
        parent = opened.stack[-1]
        new = Element(name, parent, *_aside(name, attrs[0]))
        if name == "header" and not opened.deepest(("article", "main")):
            new.pruned = True
        parent.nodes.append(new)
        if name in VOID or attrs[0].endswith("/"):
            continue
        if name in RAW_TEXT:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, pos)
            pos = source.find(">", close.end()) + 1 or end if close else end
            continue
        opened.push(new)
    _settle(root)
    return root


def _ordered(root: Element) -> list[Element]:
    """In page order, so parents before children; pruned subtrees left out."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(n for n in reversed(x.nodes) if isinstance(n, Element) and not n.pruned)
    return out


def measure(root: Element) -> list[Element]:
    """Counts, densities and density sums of all elements that aren't pruned."""
    order = _ordered(root)
    for x in reversed(order):
        for n in x.nodes:
            if isinstance(n, str):
                x.chars += len(n) - n.count(" ") if not n.isspace() else 0
            elif not n.pruned:
                x.chars, x.tags = x.chars + n.chars, x.tags + n.tags + 1
                x.link_chars, x.link_tags = x.link_chars + n.link_chars, x.link_tags + n.link_tags
        if x.name == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
    body = root.link_chars / max(1, root.chars)
    for x in order:
        plain = max(1, x.chars - x.link_chars)
        density = x.chars / max(1, x.tags)
        if density:
            base = math.log(x.chars / plain * x.link_chars + body * x.chars + math.e)
            density *= math.log(x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags) + 1) / math.log(base + 1)
        x.density = density
    for x in order:
        x.total = sum(n.density for n in x.nodes if isinstance(n, Element) and not n.pruned)
    return order


def _inner(x: Element) -> list[Element]:
    return [n for n in x.nodes if isinstance(n, Element) and not n.pruned]


def _path(x: Element | None) -> list[Element]:
    out = []
    while x is not None:
        out.append(x)
        x = x.parent
    return out


def _joined(x: Element, y: Element) -> Element:
    """The least element that holds both."""
    above = {id(z) for z in _path(x)}
    return next(z for z in _path(y) if id(z) in above)


def densest(order: list[Element]) -> tuple[Element, dict[int, float], dict[int, Element]]:
    """The element of greatest density sum, the sums, and of each element the one of greatest sum in its subtree. Text that stands in no child counts as a child."""
    sums = {id(x): x.total + (x.chars - sum(n.chars for n in _inner(x))) for x in order}
    best_of: dict[int, Element] = {}
    for x in reversed(order):
        best = x
        for n in _inner(x):
            if sums[id(best_of[id(n)])] > sums[id(best)]:
                best = best_of[id(n)]
        best_of[id(x)] = best
    best = best_of[id(order[0])]
    while best.name not in BLOCK and best.parent is not None:
        best = best.parent
    return best, sums, best_of


def choose(root: Element) -> tuple[list[Element], float]:
    """The subtrees of the main text, in page order, and the density threshold.

    The region is the least element that holds the one of greatest density sum, all those beside it of at least ``PEAK`` of that sum, and
    the last h1 before it; an article around the region that is dense enough takes its place. A region that is the
    densest element itself is taken whole. In a larger one, each element no less dense than the threshold is followed, and its
    subtree of greatest density sum is taken.
    """
    order = measure(root)
    best, sums, best_of = densest(order)
    path = _path(best)

    def plain(x: Element) -> float:
        return x.chars / max(1, x.tags)

    threshold, plain_threshold = min(x.density for x in path), min(map(plain, path))

    def dense(x: Element) -> bool:
        # composite density grows with an element's size: a short lead reaches the path's characters per tag alone
        return x.density >= threshold or plain(x) >= plain_threshold and x.chars >= 2 * x.link_chars

    above, before = {id(x) for x in path}, None
    place = {id(x): i for i, x in enumerate(order)}
    peaks = [best]
    for x in order:
        if id(x) in above or not x.chars:
            continue
        if x.name == "h1" and x.chars > 2 * x.link_chars and place[id(x)] < place[id(best)]:
            before = x
        elif x.name in BLOCK and sums[id(x)] >= PEAK * sums[id(best)] and dense(x):
            peaks.append(x)
    if before is not None:
        peaks.append(before)
    peaks.sort(key=lambda x: place[id(x)])
    region = _joined(peaks[0], peaks[-1])  # in page order, what holds the first and the last holds all
    article = next((x for x in _path(region) if x.name == "article"), None)
    if article is not None and dense(article):
        return [article], threshold
    if region is best:
        return [best], threshold
    taken: set[int] = set()
    followed: set[int] = {id(region)}
    stack = [region]
    while stack:
        x = stack.pop()
        chosen = best_of[id(x)]
        while chosen.name not in BLOCK and chosen.parent is not None:
            chosen = chosen.parent
        if x is not region or chosen is not region:
            taken.add(id(chosen))
        for n in _inner(x):
            if n.name in HEADINGS and n.chars > 2 * n.link_chars:
                taken.add(id(n))  # a headline is short, so never dense
            elif n.chars and (id(n) in above or dense(n)):
                followed.add(id(n))
                stack.append(n)
    # an element within a taken one goes with it; text that stands loose among followed ones is a block of its own
    out: list[Element] = []
    walk: list[Element] = [region]
    while walk:
        x = walk.pop()
        if id(x) in taken or not x.tags and x.name == "#text":
            out.append(x)
            continue
        for n in reversed(x.nodes):
            if isinstance(n, str):
                if id(x) in followed and len(n) - n.count(" ") >= plain_threshold:
                    loose = Element("#text", x)
                    loose.nodes.append(n)
                    walk.append(loose)
            elif not n.pruned:
                walk.append(n)
    return out, threshold


def blocks_of(x: Element, threshold: float = 0.0) -> list[str]:
    """Texts of the blocks below ``x`` in page order; linked lists and other link-only blocks under the threshold are left out."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(current))).strip()
        current.clear()
        if text:
            out.append(text)

    stack: list[tuple[Element | str, bool]] = [(x, False)]
    while stack:
        n, leaving = stack.pop()
        if isinstance(n, str):
            current.append(n)
        elif leaving:
            flush()
        elif n.name == "br":
            current.append(" ")
        elif not n.pruned and not (n is not x and n.density < threshold and n.link_chars * 2 > n.chars):
            if n.name in BLOCK:
                flush()
                stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.nodes))
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks joined by a blank line. Empty for an empty page, or one without text."""
    if not source:
        return ""
    chosen, threshold = choose(parse(source))
    return "\n\n".join(b for x in chosen for b in blocks_of(x, threshold))


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones left out,
    and the others joined by two line feeds. A null html counts as empty, with an empty text; null ids and urls are
    passed on; repeated rows are extracted alike. Other columns play no part. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
