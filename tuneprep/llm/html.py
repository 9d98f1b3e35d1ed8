"""Main text of web pages by tag-path ratios.

Method: text length and punctuation are summed per root-to-leaf tag path and divided by the
path's number of text blocks; both ratios are smoothed over the blocks in page order, fused by
their geometric mean, and the paths above a threshold are the content paths. Blocks on content
paths are the article; what stands with them in the same element (headings, lists, short
paragraphs) belongs to it. Several elements with content paths are all returned.

Parts that are never article text are left out before: scripts, styles, forms, menus, page
headers and footers, sidebars, and elements whose class, id or role names such a part, unless
they hold nearly all of the page's text. Words that name article parts as well (``WEAK``) only
halve the score of their paths.

Each page is its own row of work; nothing is shuffled. Defined results: null, empty and
text-free pages give an empty text; unclosed and misnested tags are closed as browsers do for
paragraphs, list items and table cells; very long and deeply nested pages take time in proportion
to their length; paths of equal score are content alike; repeated rows give equal rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tuneprep.llm.common import map_with_ids, plain_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
          "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr"}
NEVER = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "object",
               "canvas", "dialog", "menu", "audio", "video", "map", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
         "menu", "menubar", "form", "alertdialog"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comment\w*|consent|cookies?|"
    r"disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notice|paywall|pagination|popup|promo\w*|repl(?:y|ies)|shar(?:e|ing)|"
    r"sidebar|signup|sponsor\w*|subscribe|toolbar)(?:$|[\s_-])", re.I)
WEAK = re.compile(
    r"(?:^|[\s_-])(?:alert|banner|disclaimer|related|respond|social|widget)(?:$|[\s_-])", re.I)
PAGE_PARTS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
OUTER = {"html", "body", "main", "article"}
PARAGRAPH_ENDS = {"p", "div", "article", "section", "ul", "ol", "dl", "table", "pre", "blockquote",
                  "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "aside", "form",
                  "main", "figure", "hr", "address", "fieldset"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Parts of a text; the element around them is what the text stands in.
STRUCTURE = HEADINGS | {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
                        "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption"}
LOOSE = {"", "html", "body"}
PUNCTUATION = re.compile(r"[.,;:!?，。；：！？、…]")


class Node:
    """One element. ``path`` numbers its tag path, ``[start, end)`` the elements in it, ``base`` is
    the element that a text in it stands in, ``article`` and ``weak`` the outermost article and the
    outermost element with a weak name around it."""

    __slots__ = ("tag", "path", "parent", "skip", "article", "base", "named", "weak", "start", "end")

    def __init__(self, tag: str, path: int, parent: Node | None, skip: bool, named: bool, weak: bool,
                 start: int):
        self.tag, self.path, self.parent, self.named, self.start = tag, path, parent, named, start
        self.end = None
        self.skip = skip or (parent is not None and parent.skip)
        weaker = parent.weak if parent is not None else None
        self.weak = weaker if weaker is not None else (self if weak else None)
        above = parent.article if parent is not None else None
        self.article = above if above is not None else (self if tag == "article" else None)
        inner = parent is not None and (tag in STRUCTURE or tag in INLINE)
        self.base = parent.base if inner else self

    def holds(self, other: Node) -> bool:
        return self.start <= other.start < self.end


def _verdict(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never text, names a page part, and has a weak name."""
    if tag in NEVER or (tag == "header" and not inside):
        return True, False, False
    if not attributes:
        return False, False, False
    found = {k.lower(): next((v for v in values if v), "")
             for k, *values in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, False, False
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True, False, False
    if tag in OUTER:
        return False, False, False
    names = f"{found.get('class', '')} {found.get('id', '')}"
    named = found.get("role", "").lower() in ROLES or bool(
        NAMED.search(names) or (not inside and PAGE_PARTS.search(names)))
    return False, named, bool(WEAK.search(names))


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(element, text, characters inside links) of the blocks in page order; named elements."""
    top = Node("", 0, None, False, False, False, 0)
    stack, solid, opened = [top], [0], Counter()
    out, named, parts, linked, links = [], [], [], 0, 0
    paths: dict[tuple[int, str], int] = {}
    owner, made, mains = top, 1, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((owner, text, linked))
        parts, linked = [], 0

    def close_to(at: int) -> None:
        nonlocal owner, links, mains
        for node in stack[at:]:
            links -= node.tag == "a"
            mains -= node.tag == "main"
            opened[node.tag] -= 1
            node.end = made
        if solid[-1] >= at:
            flush()
            while solid[-1] >= at:
                solid.pop()
            owner = stack[solid[-1]]
        del stack[at:]

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at and not stack[-1].skip:
            text = html.unescape(page[at:token.start()])
            parts.append(text)
            linked += len(text) if links > 0 else 0
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            if opened[tag] > 0:
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        attributes = token[3] or token[6] or ""
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDS else set())
        for i in reversed(solid) if ends else ():
            if i > 0 and stack[i].tag in ends:
                close_to(i)
                break
            if stack[i].tag != "p":
                break
        if tag not in INLINE and tag not in RAW:
            flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "object"):
            continue
        parent = stack[-1]
        skip, page_part, weak = _verdict(tag, attributes, mains > 0 or parent.article is not None)
        path = parent.path
        if tag not in INLINE:
            names = re.search(r"\bclass\s*=\s*[\"']?([^\"'>]*)", attributes, re.I)
            path = paths.setdefault((path, f"{tag}.{names[1]}" if names else tag), len(paths) + 1)
        node = Node(tag, path, parent, skip, page_part, weak, made)
        made += 1
        if page_part:
            named.append(node)
        stack.append(node)
        opened[tag] += 1
        links += tag == "a"
        mains += tag == "main"
        if tag not in INLINE:
            solid.append(len(stack) - 1)
            owner = node
    if at < len(page) and not stack[-1].skip:
        parts.append(html.unescape(page[at:]))
    flush()
    for node in stack:
        node.end = made
    return out, named


class Sizes:
    """Text length and number of the blocks inside an element."""

    def __init__(self, blocks: list[tuple[Node, str, int]]):
        order = sorted((n.start, len(t)) for n, t, _ in blocks)
        self.starts = [k for k, _ in order]
        self.sums = np.concatenate([[0], np.cumsum([v for _, v in order])])

    def number(self, node: Node) -> int:
        return bisect_left(self.starts, node.end) - bisect_left(self.starts, node.start)

    def text(self, node: Node) -> int:
        return int(self.sums[bisect_left(self.starts, node.end)]
                   - self.sums[bisect_left(self.starts, node.start)])


def without_parts(blocks: list[tuple[Node, str, int]], named: list[Node],
                  most: float) -> list[tuple[Node, str, int]]:
    """The blocks outside of named page parts that hold less than ``most`` of the page's text."""
    sizes = Sizes(blocks)
    total, covered, out = sizes.sums[-1], -1, []
    gone = []
    for node in sorted((n for n in named if sizes.text(n) < most * total), key=lambda n: n.start):
        if node.end > covered:
            gone.append((node.start, node.end))
            covered = node.end
    starts = [a for a, _ in gone]
    for block in blocks:
        i = bisect_left(starts, block[0].start + 1) - 1
        if i < 0 or block[0].start >= gone[i][1]:
            out.append(block)
    return out


def _smooth(values: np.ndarray, radius: int) -> np.ndarray:
    """Gaussian smoothing in page order; the weights at both ends are renormalised."""
    kernel = np.exp(-0.5 * np.square(np.arange(-radius, radius + 1) / max(radius / 2, 0.5)))
    around = np.convolve(values, kernel)[radius:radius + len(values)]
    return around / np.convolve(np.ones(len(values)), kernel)[radius:radius + len(values)]


def path_ratios(blocks: list[tuple[Node, str, int]]) -> dict[int, tuple[float, float]]:
    """Text length outside of links and punctuation of each path, per block."""
    length, marks, number = defaultdict(float), defaultdict(float), defaultdict(int)
    for node, text, linked in blocks:
        length[node.path] += max(len(text) - linked, 0)
        marks[node.path] += len(PUNCTUATION.findall(text))
        number[node.path] += 1
    return {p: (length[p] / number[p], marks[p] / number[p]) for p in number}


def path_scores(blocks: list[tuple[Node, str, int]], ratios: dict[int, tuple[float, float]],
                radius: int) -> tuple[dict[int, float], float]:
    """Mean smoothed and fused ratio of each path, and the deviation over the blocks."""
    sizes, marks = (_smooth(np.array([ratios[node.path][k] for node, _, _ in blocks]), radius)
                    for k in (0, 1))
    fused = np.sqrt(sizes * (0.1 + marks))
    score, total = defaultdict(float), defaultdict(float)
    for (node, text, _), value in zip(blocks, fused):
        score[node.path] += (0.5 if node.weak is not None else 1.0) * value * len(text)
        total[node.path] += len(text)
    return {p: score[p] / total[p] for p in score}, float(np.std(fused))


def content_paths(blocks: list[tuple[Node, str, int]], radius: int, threshold: float,
                  least: float) -> set[int]:
    """Paths whose score reaches ``threshold`` deviations, or is the best.

    A path next to long text profits from the smoothing; its own fused ratio has to reach
    ``least`` times the best one as well.
    """
    ratios = path_ratios(blocks)
    scores, deviation = path_scores(blocks, ratios, radius)
    own = {p: (length * (0.1 + marks)) ** 0.5 for p, (length, marks) in ratios.items()}
    floor = least * max(own.values())
    usable = {p: scores[p] for p in scores if own[p] > 0 and own[p] >= floor}
    limit = min(threshold * deviation, max(usable.values(), default=0.0))
    return {p for p, v in usable.items() if v >= limit}


def _home(node: Node, sizes: Sizes) -> Node:
    """The element that a block's text stands in: its article, or what holds it and others."""
    if node.article is not None:
        return node.article
    if node.base is node and node.parent is not None and sizes.number(node) < 2:
        return node.parent.base
    return node.base


def _common(a: Node, b: Node) -> Node:
    while not a.holds(b):
        a = a.parent
    return a


def main_text(page: str | None, radius: int = 2, threshold: float = 1.0, least: float = 0.15,
              share: float = 0.7, most: float = 0.9) -> str:
    """Main text of one page; blocks joined by one space.

    The element around all content blocks is taken whole if they are ``share`` of its text;
    otherwise each content block's own element, and what stands between them.
    """
    blocks = without_parts(*blocks_of(page or ""), most)
    chosen = content_paths(blocks, radius, threshold, least) if blocks else set()
    picked = [i for i, (node, _, _) in enumerate(blocks) if node.path in chosen]
    if not picked:
        return ""
    sizes = Sizes(blocks)
    homes = sorted({id(h): h for h in (_home(blocks[i][0], sizes) for i in picked)}.values(),
                   key=lambda h: h.start)
    home = _common(homes[0], homes[-1])
    around = home.tag not in LOOSE
    whole = around and sum(len(blocks[i][1]) for i in picked) >= share * sizes.text(home)
    tops: list[Node] = []
    for h in homes:
        if h.tag not in LOOSE and not (tops and tops[-1].holds(h)):
            tops.append(h)
    starts = [h.start for h in tops]
    loose = any(h.tag in LOOSE for h in homes)
    trusted = {id(blocks[i][0].weak) for i in picked}

    def belongs(i: int, node: Node, text: str, linked: int) -> bool:
        if node.path in chosen:
            return True
        if id(node.weak) not in trusted and node.weak is not None:
            return False
        if linked >= 0.8 * len(text) and node.tag not in HEADINGS | {"p"}:
            return False
        if whole and home.holds(node):
            return True
        k = bisect_left(starts, node.start + 1) - 1
        if k >= 0 and tops[k].holds(node):
            return True
        if loose and node.base.tag in LOOSE and node.tag in STRUCTURE:
            return True
        return around and home.holds(node) and picked[0] <= i <= picked[-1]

    taken = [i for i, block in enumerate(blocks) if belongs(i, *block)]
    for i in range(taken[0] - 1, -1, -1):
        if blocks[i][0].tag not in HEADINGS:
            break
        taken.insert(0, i)
    return " ".join(blocks[i][1] for i in taken)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
            **options) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, **options) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    base = plain_columns(pages, {"page_id": page_id, "url": url, "html": page})
    kind = base.schema["url"].dataType.simpleString()
    return map_with_ids(base, run, "page_id", f"page_id {{}}, url {kind}, text string, n_chars bigint")
