"""Main-text extraction by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf tag path (tags with their class). Only what
is never shown as text (head, scripts, styles, controls, hidden elements) is left out beforehand.
For each path, text length without links and punctuation are taken per block; both ratios are
smoothed along the page, averaged by path and fused. A path's fused value counts less outside
`article` and `main` where a page has them, and by as much less as its text lies in elements
whose tag, role, class or id names boilerplate (navigation, footers, forms, adverts, notices,
comments ...), unless such an element holds the article or most of the page. Paths at a good part of
the best value are content paths, and these alone decide: elements with a name of boilerplate, or
with a word of it somewhere in their class or id, go if most of their text is off these paths;
content paths select every `article`, or `main` whose articles hold too little, that they fill for
the most part, with all its remaining blocks, so that headings and short paragraphs stay, and what
else lies on them; where these hold too little, the innermost element that holds most of the
content paths' text; where no element stands out, the content paths' blocks.

Defined results: null, empty or tag-only html and pages of nothing but boilerplate give an empty
text; unclosed scripts, styles and comments end with the page, other unclosed elements with their
parent; a very long or deeply nested page is read whole; of equally heavy elements the deepest
counts; null page_id or url stay null; repeated rows are each extracted; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, table

TOKEN = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'](?=[^"']*\Z))*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PAIRED = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Never text of a page, and elements of a page's frame.
OUT_TAGS = frozenset("head button select input dialog canvas audio video map datalist".split())
FRAME_TAGS = frozenset("nav footer aside form menu search fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status tablist".split())
#: Words of class and id that name what isn't the article.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead "
    "header footer sidebar aside rail related recommended recommendations "
    "notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist discussion disqus replies reply respond reader-comments "
    "widget search form copyright legal disclaimer skip hidden".split()
)
#: Of these, the words that articles also use for their own parts; like words that only are part of a
#: class or id ('has-sidebar'), they cut nothing unless the path ratios agree.
DOUBTFUL = frozenset(
    "header footer aside rail related recommended recommendations notice notices alert legal disclaimer copyright discussion reply replies respond "
    "social share sharing search form widget overlay hidden skip promotion sponsor banner menu subscription comment login signup consent".split()
)
#: Compounds that name boilerplate as surely as the other words.
KNOWN = (OUT_WORDS - DOUBTFUL) | frozenset(
    "ad-box ad-container ad-slot ad-wrapper site-header site-footer site-nav page-header page-footer main-nav main-menu nav-bar nav-menu side-bar cookie-banner cookie-notice cookie-consent "
    "related-posts related-articles share-buttons social-share sharing-buttons comment-list comments-area comments-section newsletter-signup reader-comments".split()
)
COMMENTS = frozenset("comment comments commentlist comment-list comments-area comments-section reader-comments disqus reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
THRESHOLD, SHARE = 0.25, 0.6
#: What a path's value counts for outside all `article` and `main` of a page that has them.
OUTSIDE = 0.5
#: What text in elements that name boilerplate counts.
NAMED = 0.05


class Node:
    """An element; path is the number of its tag path, given out by `paths`, which a page's nodes share.
    word: what its tag, role, class or id says: "" nothing, "frame" of the page, "known" or "doubtful"
    boilerplate, "comments"."""

    __slots__ = ("tag", "parent", "paths", "path", "depth", "out", "word", "weight", "around", "in_article")

    def __init__(self, tag: str, parent: Node | None, label: str, out: bool, word: str = "") -> None:
        self.tag, self.parent, self.word, self.weight = tag, parent, word, 0.0
        self.paths: dict[tuple[int, str], int] = parent.paths if parent else {}
        self.path = self.paths.setdefault((parent.path if parent else -1, label), len(self.paths))
        self.depth = parent.depth + 1 if parent else 0
        self.out = out or bool(parent and parent.out)
        # The nearest article or main above, and whether an article is.
        self.around: Node | None = parent if parent and parent.tag in ("article", "main") else parent and parent.around
        self.in_article = bool(parent and (parent.tag == "article" or parent.in_article))


Block = tuple[Node, str, int]


def _names(value: str) -> set[str]:
    return {w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    label, out, word = tag, tag in OUT_TAGS, ""
    if attributes and not attributes.isspace():
        got = {}
        for name, *values in ATTRIBUTE.findall(attributes):
            got.setdefault(name.lower(), next((v for v in values if v), ""))
        if got.get("class"):
            label = f"{tag}.{'.'.join(got['class'].split())}"
        style = got.get("style", "").replace(" ", "").lower()
        out = out or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        role = got.get("role", "").lower()
        word = "known" if role == "form" else "frame" if role in OUT_ROLES else ""
        if tag not in ("html", "body", "main") and tag not in HEADINGS:
            tokens = {*got.get("class", "").lower().split(), *got.get("id", "").lower().split()}
            names = _names(got.get("class", "")) | _names(got.get("id", ""))
            if tag == "article":
                word = "comments" if tokens & COMMENTS else word
            elif tokens & KNOWN:
                word = "comments" if tokens & COMMENTS else word or "known"
            elif names & OUT_WORDS:
                word = word or "doubtful"
    if tag in FRAME_TAGS or tag == "header" and not (parent.around or parent.tag in ("article", "main")):
        word = word if word == "comments" else "known" if tag in ("form", "fieldset") else "frame"
    return Node(tag, parent, f"{label} {word}" if word else label, out, word)


def blocks_of(page: str) -> list[Block]:
    """Element, text and characters in links of every block that markup doesn't rule out."""
    root = Node("", None, "", False)
    stack, found, held = [root], [], []
    at, size, in_link, linked = 0, len(page), 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                found.append((stack[-1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].out:
            text = _html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if in_link:
                linked += len(text)

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    in_link = 0
                continue
            if tag == "br":
                held.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    in_link = 0
                    break
            else:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at) if not m[3].endswith("/") or tag not in ("svg", "math") else None
            if end:
                at = end.end()
            elif not (m[3].endswith("/") and tag in ("svg", "math")):
                at = size
            held.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            if m[3] and not stack[-1].out and ((mark := _opened(tag, m[3], stack[-1])).out or mark.word in ("frame", "known", "comments")):
                # A hidden or boilerplate inline element: what it holds is skipped as far as it closes.
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end and "<" not in page[at : end.start()]:
                    at, in_link = end.end(), 0
            continue
        if tag in VOID:
            if tag in ("hr",):
                flush()
            else:
                held.append(" " if tag != "wbr" else "")
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("div", "article", "section", "main", "body", "td", "li", "blockquote"):
                    break
        elif tag in LIKE:
            same, bounds = PAIRED.get(tag, (tag,)), LIKE[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    close(i)
                    break
                if stack[i].tag in bounds:
                    break
        flush()
        in_link = 0
        stack.append(_opened(tag, m[3], stack[-1]))
    flush()
    return found


def path_values(blocks: list[Block], named: Callable[[Node], bool] = lambda node: False) -> dict[int, float]:
    """The fused ratio of every path; named tells elements that count as boilerplate."""
    total: dict[int, list[float]] = defaultdict(lambda: [0, 0.0, 0.0, 0.0, 0.0])
    for node, text, linked in blocks:
        t = total[node.path]
        t[0] += 1
        t[1] += len(text) - linked
        t[2] += len(PUNCTUATION.findall(text))
        t[3] += len(text)
        t[4] += len(text) * (NAMED if named(node) else 1)
    ratios = [(t[1] / t[0], t[2] / t[0]) for t in (total[node.path] for node, _, _ in blocks)]
    smooth: dict[int, list[float]] = defaultdict(lambda: [0, 0.0, 0.0])
    last = len(ratios) - 1
    for i, (node, _, _) in enumerate(blocks):
        before, here, after = ratios[max(i - 1, 0)], ratios[i], ratios[min(i + 1, last)]
        s = smooth[node.path]
        s[0] += 1
        s[1] += (before[0] + 2 * here[0] + after[0]) / 4
        s[2] += (before[1] + 2 * here[1] + after[1]) / 4
    return {path: s[1] / s[0] * (1 + log1p(s[2] / s[0])) * total[path][4] / total[path][3] for path, s in smooth.items()}


def extract(page: str | None) -> str:
    blocks = [b for b in blocks_of(page) if not b[0].out] if page else []
    named = _below(_boilerplate(blocks))
    if all(named(b[0]) for b in blocks):
        return ""
    blocks = _unnamed(blocks, named, _content(blocks, named))
    blocks = _within(blocks, _content(blocks, named)) if blocks else []
    return "\n\n".join(text for _, text, _ in blocks)


def _below(nodes: set[Node]) -> Callable[[Node], bool]:
    """Whether an element is one of nodes or in one."""
    known: dict[Node | None, bool] = {None: False}

    def inside(node: Node) -> bool:
        line, up = [], node
        while up not in known:
            line.append(up)
            up = up.parent
        got = known[up]
        for n in reversed(line):
            got = known[n] = got or n in nodes
        return known[node]

    return inside


def _weighed(blocks: list[Block], content: set[int] | None = None) -> tuple[float, list[Node]]:
    """The text without links of all blocks (of these paths), and all elements with theirs as weight."""
    whole, order = 0.0, {}
    for node, text, linked in blocks:
        weight = float(len(text) - linked) * (content is None or node.path in content)
        whole += weight
        up: Node | None = node
        while up and up not in order:
            order[up], up.weight = None, 0.0
            up = up.parent
        node.weight += weight
    for node in sorted(order, key=lambda n: -n.depth):
        if node.parent:
            node.parent.weight += node.weight
    return whole, list(order)


def _boilerplate(blocks: list[Block]) -> set[Node]:
    """The elements that name boilerplate. One that holds the article, or else most of the page (but
    for parts of its frame), is none, whatever its name."""
    whole, order = _weighed(blocks)
    words = [n for n in order if n.word in ("frame", "known", "comments")]
    if not words:
        return set()
    named = sorted((n for n in order if n.tag in ("article", "main") and n.word != "comments" and n.weight), key=lambda n: -n.weight)
    held: dict[Node, float] = {}
    for n in named:
        for up in _above(n):
            if up in held:
                break  # a heavier one, and all above it
            held[up] = n.weight
    cut = set()
    for node in words:
        here = _below({node})
        inside = 0.0 if node.in_article else held.get(node, 0.0)
        around = node.around.weight if node.around else 0.0 if named else whole
        beside = next((n.weight for n in named if not here(n) and not _below({n})(node)), 0.0)
        most = around and node.word != "frame" and node.weight >= (0.8 if node.word == "known" else 1) * around
        if not most and (not inside or beside and (beside > inside or node.word == "comments")):
            cut.add(node)
    return cut


def _content(blocks: list[Block], named: Callable[[Node], bool]) -> set[int]:
    """Paths whose value, which counts less outside `article` and `main`, is a good part of the best."""
    values = path_values(blocks, named)
    inside = {b[0].path for b in blocks if b[0].around or b[0].tag in ("article", "main")}
    fused = {path: v * (OUTSIDE if inside and path not in inside else 1) for path, v in values.items()}
    limit = THRESHOLD * max(fused.values(), default=0)
    return {path for path, v in fused.items() if v >= limit and v}


def _unnamed(blocks: list[Block], named: Callable[[Node], bool], content: set[int]) -> list[Block]:
    """blocks without those of elements that name boilerplate, or hold a word of it in their names, and
    have most of their text off the content paths."""
    _, order = _weighed(blocks)
    own = {n: n.weight for n in order}
    length: dict[Node, int] = defaultdict(int)
    for node, text, _ in blocks:
        length[node] += len(text) * (node.path in content)
    _weighed(blocks, content)
    holds = {up for n in order if n.tag in ("article", "main") and own[n] and n.word != "comments" and not named(n) for up in _above(n)}
    suspects = [n for n in order if n.word and (n.word == "doubtful" and n not in holds or n.word != "doubtful" and named(n))]
    cut = {n for n in suspects if n.weight < own[n] / 2 or not own[n] and not length[n]}
    gone = _below(cut)
    return [b for b in blocks if not gone(b[0])]


def _within(blocks: list[Block], content: set[int]) -> list[Block]:
    whole, order = _weighed(blocks)
    own = {n: n.weight for n in order}
    whole, order = _weighed(blocks, content)
    if not whole:
        return blocks
    # Every article that content paths fill, and every main whose articles hold too little: with it all its blocks.
    named = [n for n in order if n.tag in ("article", "main") and n.weight and 2 * n.weight >= own[n]]
    best = {n for n in named if n.tag == "article"}
    inner: dict[Node, float] = defaultdict(float)
    for n in best:
        if not n.in_article or not any(a in best for a in _above(n)):
            up = n.around
            while up:
                inner[up] += n.weight
                up = up.around
    best |= {n for n in named if n.tag == "main" and inner[n] < SHARE * n.weight}
    chosen = _below(best)
    if best and sum(n.weight for n in best if not chosen(n.parent)) >= 0.3 * whole:
        # Content paths elsewhere stay too, with the headings right before them.
        out: list[Block] = []
        heads: list[Block] = []
        for b in blocks:
            if chosen(b[0]):
                out.append(b)
                heads = []
            elif b[0].path in content and 2 * b[2] < len(b[1]):
                out += [h for h in heads if h[0].parent is b[0].parent]
                out.append(b)
                heads = []
            else:
                heads = [*heads, b] if b[0].tag in HEADINGS else []
        return out
    holds = [n for n in order if n.weight >= SHARE * whole and n.tag not in ("", "html", "body", "p")]
    if holds:
        inside = _below({min(holds, key=lambda n: (n.weight, -n.depth))})
        return [b for b in blocks if inside(b[0]) and (b[1] and b[2] < 0.6 * len(b[1]) or b[0].path in content)]
    return [b for b in blocks if b[0].path in content or b[0].tag in ("h1", "h2", "h3") and b[2] < 0.6 * len(b[1])]


def _above(node: Node) -> Iterator[Node]:
    up = node.parent
    while up:
        yield up
        up = up.parent


def with_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text of html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = pick(pages, "page_id", "url", "html")
    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op10_html(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return with_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

