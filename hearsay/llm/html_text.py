"""Main text of web pages by tree scoring.

Blocks of running text pass points for their length and commas to the elements around them, halved
at each step; links take points away. The element with most points, with what its ancestors
add while that is hardly linked, its siblings that score nearly as well, or read like paragraphs, and
headings, lists and other small parts between or before these make the article. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8

# Fixed values of the HTML language: elements without content, with raw content, that end an open
# paragraph, and that stand inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|noembed|noframes|xmp"
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
SCOPES = frozenset("html table td th caption button object".split())
# Elements that hold no main text, and the words in class, id or role that mark the same.
SKIPPED = frozenset(
    "head nav footer aside form script style noscript template iframe button select option "
    "textarea input svg canvas object embed dialog menu audio video".split()
)
NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "comment comments cookie cookies consent copyright disclaimer discuss disqus dialog footer gdpr "
    "header hidden masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted promotion related respond replies reply rss search share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget alert alertdialog complementary contentinfo "
    "form alerts notices notification notifications recommended outbrain taboola skip "
    "discussion discussions".split()
)
# In a name that also speaks of the article, only these at its ends say that it is no text of it:
# "post-comments" and "comment-body" are not, "article-header" and "entry-notice" are.
ARTICLE_WORDS = frozenset("article body content entry example lead main post research story text".split())
NOT_OF_IT = frozenset(
    "ad ads advert adverts advertisement comment comments discussion footer nav navigation newsletter "
    "pagination promo related replies respond share sharing sidebar social sponsored subscribe "
    "toolbar widget".split()
)
# Names of headers, which may hold the headline; elements that no name takes out, and those that
# only a whole one does ("ad", not "ad-example").
HEADERS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("p pre blockquote".split())
LAYOUT = frozenset("has with no without is".split())
HEADER_MAY_STAND_IN = frozenset("article main section".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</[^a-zA-Z>][^>]*(?:>|\Z)|</>",
    re.DOTALL,
)
RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW.split("|")
}
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")

# Small parts of an article that may score nothing.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup p ul ol dl blockquote pre figure table".split())
LEAST_LENGTH = 25
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("name", "parent", "children", "score", "length", "linked", "skipped", "named",
                 "odd", "headed")

    def __init__(self, name: str, parent: Node | None, skipped: bool = False) -> None:
        self.name, self.parent, self.skipped = name, parent, skipped
        self.named = self.odd = self.headed = False
        self.children: list[Node | str] = []
        self.score = 0.0
        self.length = self.linked = 0


def _boilerplate(name: str, attrs: str, open_names: set[str]) -> str:
    """Why an element is no part of any article: "sure" by its name or hiding; "named" by a word in
    class, id or role, which a wrapper around the article may have too, or "headed" if that word is
    of a header, which may hold the headline; "" without a reason."""
    if name in SKIPPED or (name == "header" and not open_names & HEADER_MAY_STAND_IN):
        return "sure"
    if not attrs or name in ("html", "body"):
        return ""
    reason = ""
    for key, value in ATTRIBUTE.findall(attrs):
        key = key.lower()
        if name in ("article", "main") and key not in ("class", "id", "role"):
            continue
        if key == "hidden" or (key == "aria-hidden" and "true" in value.lower()):
            return "sure"
        if key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "sure"
        if key in ("class", "id", "role"):
            for token in html.unescape(value).strip("\"'").split():
                words = WORDS.findall(CAMEL.sub(r"\1 \2", token).lower())
                # "has-sidebar" says something of the layout around the text.
                if not words or words[0] in LAYOUT or (name in RUNNING and len(words) > 1):
                    continue
                marks = NOT_TEXT.intersection(words)
                if not ARTICLE_WORDS.isdisjoint(words):
                    marks &= NOT_OF_IT.intersection((words[0], words[-1]))
                if marks - HEADERS:
                    reason = "named"
                elif marks and not reason and not open_names & HEADER_MAY_STAND_IN:
                    reason = "headed"
    return reason


def parse(page: str) -> Node:
    """Tree of elements and decoded texts. Never fails: stray end tags are ignored, missing ones
    are supplied, a raw element without end runs to the end of the page."""
    root = Node("#root", None)
    node, at = root, 0
    open_names: dict[str, int] = {}

    def close(target: Node) -> Node:
        nonlocal node
        while True:
            ended, node = node, node.parent
            open_names[ended.name] -= 1
            if ended is target:
                return node

    def innermost(names: frozenset[str], stop: frozenset[str]) -> Node | None:
        found = node
        while found is not root and found.name not in stop:
            if found.name in names:
                return found
            found = found.parent
        return None

    while at < len(page):
        token = page.find("<", at)
        match = TOKEN.match(page, token) if token >= 0 else None
        if match is None:
            end = len(page) if token < 0 else token + 1
            # A lone "<" is text.
            node.children.append(html.unescape(page[at:end]))
            at = end
            continue
        if token > at:
            node.children.append(html.unescape(page[at:token]))
        at = match.end()
        name = match["name"]
        if not name:
            continue
        name = name.lower()
        if match["end"]:
            if name == "p" and not open_names.get("p"):
                node.children.append(Node("p", node))
            elif open_names.get(name):
                limit = frozenset() if name in SCOPES else SCOPES
                found = innermost(frozenset((name,)), limit)
                if found is not None:
                    close(found)
            continue
        if name in CLOSES_P and open_names.get("p"):
            found = innermost(frozenset(("p",)), SCOPES)
            if found is not None:
                close(found)
        elif name in ("li", "dd", "dt", "option"):
            same = frozenset(("dd", "dt")) if name[0] == "d" else frozenset((name,))
            found = innermost(same, SCOPES | {"ul", "ol", "dl", "select", "menu"})
            if found is not None:
                close(found)
        elif name in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            same = {"td", "th"} if name in ("td", "th") else {"td", "th", "tr"}
            if name[0] == "t" and name not in ("td", "th", "tr"):
                same |= {"tbody", "thead", "tfoot"}
            while (found := innermost(frozenset(same), frozenset(("table",)))) is not None:
                close(found)
        attrs = match["attrs"]
        names = {k for k in HEADER_MAY_STAND_IN if open_names.get(k)}
        reason = _boilerplate(name, attrs, names)
        child = Node(name, node, node.skipped or reason == "sure")
        # An article or main with such a name (a comment, say) is not skipped for it itself.
        child.odd = reason == "named"
        child.headed = reason == "headed"
        child.named = bool(reason) and name not in ("article", "main") and name not in HEADINGS
        node.children.append(child)
        if name in VOID:
            continue
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            child.skipped = True
            continue
        if attrs.endswith("/") and name in ("svg", "path", "use", "g", "circle", "rect"):
            continue
        open_names[name] = open_names.get(name, 0) + 1
        node = child
    return root


def blocks(top: Node) -> list[tuple[str, Node, int]]:
    """Texts of the unskipped blocks under ``top`` in page order, the block element of each, and how
    many of its characters are links. White space runs are one space."""
    found: list[tuple[str, Node, int]] = []
    buffer: list[str] = []
    linked = 0
    owner = top

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            found.append((text, owner, min(linked, len(text))))
        buffer.clear()
        linked = 0

    # An explicit stack: pages may nest deeper than Python calls.
    stack: list[tuple[Node, int, bool]] = [(top, 0, False)]
    while stack:
        node, i, in_link = stack.pop()
        if i == len(node.children):
            if node.name not in INLINE:
                flush()
                owner = stack[-1][0] if stack else top
                while owner.name in INLINE and owner.parent is not None:
                    owner = owner.parent
            continue
        stack.append((node, i + 1, in_link))
        child = node.children[i]
        if isinstance(child, str):
            buffer.append(child)
            if in_link:
                linked += len(child.strip())
        elif child.name == "br":
            buffer.append("\n")
        elif not child.skipped:
            if child.name not in INLINE:
                flush()
                owner = child
            stack.append((child, 0, in_link or child.name == "a"))
    flush()
    return found


def skip_named(root: Node) -> None:
    """Skips the elements whose names say that they hold no main text, except those around an article
    or main element or, where a page has none, around most of the unlinked text that is left; and
    except headers that hold the page's only h1."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str) and not c.skipped]
    # Where an article has no such name, others that have one (comments, say) are not it.
    if any(node.name == "article" and not node.odd for node in order):
        for node in order:
            node.named = node.named or (node.name == "article" and node.odd)
    if not any(node.named for node in order):
        return
    plain = {id(node): 0 for node in order}
    for text, owner, links in blocks(root):
        plain[id(owner)] += len(text) - links
    holds = set()
    for node in reversed(order):
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
            if id(node) in holds or (node.name in ("article", "main") and not node.odd):
                holds.add(id(node.parent))
    headlines = [node for node in order if node.name == "h1"]
    up = headlines[0] if len(headlines) == 1 else None
    while up is not None:
        up.named = up.named and not up.headed
        up = up.parent
    # From outside in: what is skipped, and all below it, no longer counts.
    total = plain[id(root)]
    for node in order:
        if node.parent is not None and node.parent.skipped:
            node.skipped = True
        elif node.named and id(node) not in holds and (holds or 2 * plain[id(node)] <= total):
            node.skipped = True


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    scored: list[Node] = []
    for text, owner, links in blocks(root):
        up: Node | None = owner
        while up is not None:
            up.length += len(text)
            up.linked += links
            up = up.parent
        if len(text) < LEAST_LENGTH or owner.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = (1 + min(len(text) / 100, 3) + text.count(",")) * (1 - links / len(text))
        up, share = owner if owner.name in ("body", "#root") else owner.parent, 1.0
        for _ in range(5):
            if up is None:
                break
            if up.score == 0.0:
                scored.append(up)
            up.score += points * share
            up, share = up.parent, share / 2
    if not scored:
        return []

    def worth(node: Node) -> float:
        return node.score * (1 - node.linked / max(1, node.length))

    best = max(scored, key=worth)
    # What is marked as the article holds its parts together, however they are nested.
    up = best
    while up is not None:
        if up.name in ("article", "main"):
            best = up
            break
        up = up.parent
    else:
        best = _climb(best)
    if best.parent is None:
        return [best]
    least = worth(best) * SIBLING_SHARE
    beside = []
    for node in best.parent.children:
        if isinstance(node, str):
            # Loose text of the parent stands as a node of its own.
            text = node
            if not text.strip():
                continue
            node = Node("span", best.parent)
            node.children, node.length = [text], len(text.strip())
        if not node.skipped:
            beside.append(node)
    keep = [
        node is best or worth(node) >= least
        or (node.name == "p" and _reads(node, node.linked / max(1, node.length)))
        or (node.name == best.name == "article" and not node.odd and 2 * node.linked < node.length)
        for node in beside
    ]
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    small = [
        (node.name in PARTS or node.name in INLINE) and 2 * node.linked < max(1, node.length)
        for node in beside
    ]
    while first and small[first - 1]:
        first -= 1
    return [
        node for i, node in enumerate(beside) if keep[i] or (first <= i <= last and small[i])
    ]


def _climb(best: Node) -> Node:
    """The outermost ancestor that ``best`` reaches while what stands beside it is mostly unlinked
    text. Below the body any such text is of the article; in the body itself it must be a share of
    it, for small texts there belong to the site. Children that are mostly links are skipped."""
    while best.parent is not None and best.name != "body":
        up = best.parent
        prose = 0
        menus = []
        for node in up.children:
            if isinstance(node, str):
                prose += len(node.strip())
            elif node is not best and not node.skipped and node.name not in INLINE:
                if 2 * node.linked > node.length:
                    menus.append(node)
                else:
                    prose += node.length - node.linked
        further, linked = up.length - best.length, up.linked - best.linked
        if up.name in ("body", "html", "#root"):
            if prose < SIBLING_SHARE * (best.length - best.linked):
                return best
        elif further and 4 * linked >= further:
            return best
        for node in menus:
            node.skipped = True
        best = up
    return best


def _reads(node: Node, density: float) -> bool:
    """A paragraph beside the article that reads like prose."""
    return node.length >= 80 and density < 0.25


def main_text(page: bytes) -> str:
    """The article of a page, its blocks in page order joined by one space; '' where there is none.

    A page whose blocks are all too short to score gives all its unskipped blocks.
    """
    root = parse(page.decode("utf-8", "replace"))
    skip_named(root)
    nodes = main_nodes(root) or [root]
    return " ".join(text for node in nodes for text, _, _ in blocks(node))


def extract_text(
    pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (its code points) of every page.

    Null and empty pages give ''. Whole pages, no shuffle; repeated rows stay repeated.
    """
    schema = T.StructType(
        [pages.schema[c] for c in keep]
        + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            texts = [x.encode("utf-8", "replace").decode("utf-8") for x in texts]
            columns = [
                *batch.columns[:-1],
                pa.array(texts, pa.string()),
                pa.array([len(x) for x in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*keep, utf8(html_column).alias("_llm_html")).mapInArrow(run, schema)
