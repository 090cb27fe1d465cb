"""Main text of web pages by composite text density.

Each page becomes a tree (tags need not be closed). For every block its link-adjusted characters
per tag are taken: characters over tags, weighted by a logarithm of the share of plain text
against linked text, whose base falls with the page's own share of links; menus and the like
count here, and inline elements other than links belong to the block around them. A node's
density sum adds the densities of its children, with its own text as one of them; the node with
the largest sum is the core of the article.

The way from the body to the core gives the thresholds: the core's subtree grows to its parents
as long as their density is no less than the geometric mean of the body's and the core's. For a
parent marked as article or main the body's own density is enough, and the subtree does not grow
beyond it. The largest such subtree is the result, less what is never article text: scripts,
styles, menus, page headers and footers, asides, hidden parts, by their element; and forms,
notices, adverts, sidebars and reader comments, by role or by a word of their class or id. These
are not added to density sums either.

Such a word is evidence, not proof, and the text decides. An element that is only named so stays
if it is around the page's main article, or if it holds half of the page's unlinked text and no main
article stands elsewhere. The main article is the article or main element with the most unlinked
text; where all of them are in named elements, it must have a quarter of the page's. One that is
named as comments stays only if it holds all but a little of the article around it, or of the
page where no article stands outside named elements.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones left out, and the rest joined by one line feed in page order. The time is in
proportion to the page, however deep it is nested.

Defined results: null or empty html, or a page without text, gives an empty text; of equal
density sums the first in page order counts, and where all are 0 the whole page; repeated rows are treated alike; null page_id and
url are kept; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.worker import enter
from calibrant.session import ship

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of HTML: elements without content, with raw content, blocks, and what their start closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
_TABLE = {"table"}
_KIND = {tag: i for i, tag in enumerate(_CLOSES)}
_KINDS = [(closed, _SCOPE.get(tag, _TABLE)) for tag, closed in _CLOSES.items()]
_TOUCHES = frozenset().union(*(a | b for a, b in _KINDS))
_NO_TOPS: tuple = (None,) * len(_KINDS)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_P_ENDS = _BLOCK - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
_P_SCOPE = frozenset("html body table td th caption button object div article section main blockquote li ul ol dl dd dt aside nav header footer form fieldset figure figcaption details".split())

# Elements, roles and name parts of what is not article text.
_OUT_TAGS = frozenset("head nav footer aside button select input textarea svg canvas object embed iframe dialog menu noscript template script style audio video map label fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
_OUT_NAMES = re.compile(
    r"(?:^|[\s_]|(?<!\bwith)(?<!\bhas)(?<!\bno)-)(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|adsense|sponsor|sponsored|promo|promotion|promoted|banner"
    r"|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|toc"
    r"|sidebar|side|aside|widget|widgets|related|recommended|recommendations|popular|trending"
    r"|cookie|cookies|consent|gdpr|notice|notices|alert|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|disclaimer"
    r"|share|sharing|social|footer|footnav|masthead|site-header|page-header|topbar|toolbar|skip|login|search|hidden|sr-only|visually-hidden)(?:$|[\s_-])",
    re.I,
)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_]|(?<!\bwith)(?<!\bhas)(?<!\bno)-)(?:comment|comments|commentlist|discussion|disqus|reply|replies|respond|reader-comments)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KEEP_TAGS = frozenset(("html", "body", "article", "main"))

#: What speaks against an element: nothing, its name, a name of comments, its kind.
CLEAN, NAMED, COMMENTS, NEVER = range(4)
#: Shares of the page's unlinked text: of a main article, of a named element that stays, of one named as comments; and of an article's, of one named as comments in it.
MAIN_SHARE, NAMED_SHARE, COMMENTS_SHARE, INSIDE_SHARE = 0.25, 0.5, 0.9, 0.98


class Node:
    __slots__ = ("tag", "parent", "kids", "mark", "out", "plain", "block", "in_article", "p", "tops", "inline", "chars", "tags", "link_chars", "link_tags", "own_chars", "own_links", "own_link_chars", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int) -> None:
        self.tag, self.parent, self.mark, self.out = tag, parent, mark, False
        self.kids: list[Node | str] = []
        self.block = tag in _BLOCK
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        #: The open paragraph that a block's start would close.
        self.p = self if tag == "p" else None if parent is None or tag in _P_SCOPE else parent.p
        #: For each kind of start tag that closes others, the outermost open element that it closes.
        self.tops = parent.tops if parent is not None else _NO_TOPS
        if tag in _TOUCHES:
            self.tops = tuple(None if tag in scope else old if old is not None else self if tag in closed else None for old, (closed, scope) in zip(self.tops, _KINDS))
        #: Open inline elements by tag, since the block around them began.
        self.inline: dict[str, int] = {} if self.block or parent is None else parent.inline


def _mark(tag: str, attrs: str, inside_article: bool) -> int:
    if tag in _OUT_TAGS or (tag == "header" and not inside_article):
        return NEVER
    found = NAMED if tag == "form" else CLEAN
    if not attrs or tag in _KEEP_TAGS:
        return found
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return NEVER
        if name in ("class", "id"):
            if _COMMENT_NAMES.search(value):
                found = COMMENTS
            elif _OUT_NAMES.search(value):
                found = max(found, NAMED)
        elif name == "role" and value.lower() in _OUT_ROLES:
            found = max(found, NAMED)
    return found


def parse(html: str) -> Node:
    """The page's tree; scripts and the like are not kept."""
    root = Node("html", None, CLEAN)
    at, pos = root, 0
    blocks: dict[str, int] = {}  # open ones by tag
    find = _TAG.search

    def close(upto: Node) -> Node:
        """Close all elements inside the parent of upto, and say which element is open then."""
        node = at
        while True:
            if node.block:
                blocks[node.tag] -= 1
            else:
                node.inline[node.tag] -= 1
            if node is upto:
                return node.parent
            node = node.parent

    while True:
        m = find(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text:
            at.kids.append(text)
        if not m:
            return root
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if tag == "br":
                at.kids.append("\n")
            elif tag in _BLOCK:
                if blocks.get(tag):
                    node = at
                    while node.tag != tag:
                        node = node.parent
                    at = close(node)
            elif at.inline.get(tag):  # an inline end tag does not close blocks
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(node)
            continue
        if tag == "html" or (tag == "body" and blocks.get("body")):
            continue
        if tag in _P_ENDS and at.p is not None:
            at = close(at.p)
        if tag == "body":
            at = root if at is root else close(_top(at))
        kind = _KIND.get(tag)
        if kind is not None and at.tops[kind] is not None:
            at = close(at.tops[kind])
        if tag in _VOID:
            at.kids.append("\n" if tag == "br" else Node("hr", at, CLEAN) if tag == "hr" else "")
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(html, pos)
            pos = html.find(">", end.end()) + 1 if end else len(html)
            pos = pos or len(html)
            continue
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        node = Node(tag, at, _mark(tag, attrs, at.in_article))
        at.kids.append(node)
        if node.block:
            blocks[tag] = blocks.get(tag, 0) + 1
        else:
            node.inline[tag] = node.inline.get(tag, 0) + 1
        at = node


def _top(node: Node) -> Node:
    while node.parent.parent is not None:
        node = node.parent
    return node


def _order(root: Node) -> list[Node]:
    """Nodes in page order, parents first; without recursion, as pages may be nested deeply."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Link-adjusted characters per tag; share: of linked characters in the whole page."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    weight = math.log(chars / max(1, link_chars) * tags / max(1, link_tags)) / math.log(max(base, 2.0))
    return chars / tags * max(weight, 0.0)


def leave_out(nodes: list[Node]) -> None:
    """Say which elements are left out, from what speaks against them and their share of the unlinked text. nodes: in page order."""
    for n in reversed(nodes):
        own = 0 if n.mark == NEVER or n.tag == "a" else sum(k.plain if isinstance(k, Node) else len("".join(k.split())) for k in n.kids)
        n.plain = own
    whole = nodes[0].plain
    named: set[int] = set()  # these and what is in them
    for n in nodes:
        n.out = n.mark == NEVER or (n.parent is not None and n.parent.out)
        if n.mark in (NAMED, COMMENTS) or id(n.parent) in named:
            named.add(id(n))
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.out and n.plain]
    clean = max((n for n in articles if id(n) not in named), key=lambda n: n.plain, default=None)
    for n in nodes:
        if n.mark == COMMENTS:
            up = n
            while up is not None and up is not clean:
                up = up.parent
            n.out |= n.plain < (COMMENTS_SHARE * whole if clean is None else whole + 1 if up is None else INSIDE_SHARE * clean.plain)
        n.out |= n.parent is not None and n.parent.out
    most = clean or max((n for n in articles if not n.out and n.plain >= MAIN_SHARE * whole), key=lambda n: n.plain, default=None)
    around, up = set(), most
    while up is not None:
        around.add(id(up))
        up = up.parent
    inside = {id(most)} if most is not None else set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        if n.mark == NAMED and not (id(n) in around or (n.plain >= NAMED_SHARE * whole and (most is None or id(n) in inside))):
            n.out = True
        n.out = n.out or (n.parent is not None and n.parent.out)


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, their linked parts, densities and density sums; nodes in page order."""
    nodes = _order(root)
    leave_out(nodes)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = n.own_chars = n.own_links = n.own_link_chars = 0
        for k in n.kids:
            if isinstance(k, str):
                size = len("".join(k.split()))
                n.chars += size
                n.own_chars += size
                continue
            n.chars += k.chars
            n.tags += k.tags + (k.block or k.tag == "a")
            n.link_chars += k.link_chars
            n.link_tags += k.link_tags + (k.tag == "a")
            if not k.block and not k.out:
                n.own_chars += k.own_chars
                n.own_links += k.own_links + (k.tag == "a")
                n.own_link_chars += k.own_link_chars
        if n.tag == "a":
            n.link_chars, n.own_link_chars = n.chars, n.own_chars
    share = root.link_chars / max(1, root.chars)
    for n in reversed(nodes):
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        # an inline element's blocks belong to the block around it, and so does its text
        n.total = sum((k.density if k.block else k.total) for k in n.kids if isinstance(k, Node) and not k.out)
        if n.block:
            n.total += density(n.own_chars, n.own_links, n.own_link_chars, n.own_links, share)
    return nodes


def chosen(root: Node) -> Node | None:
    """The subtree that is the article."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    core = max((n for n in nodes if n.block and not n.out and (n is not root or body is root)), key=lambda n: n.total, default=root)
    if not core.total:  # nothing but a character here and there
        core = root
    least, mean = body.density, math.sqrt(body.density * core.density)
    top = core
    while top.tag not in ("article", "main", "body", "html"):
        up = top.parent
        while not up.block:
            up = up.parent
        if up.tag in ("body", "html") or up.density < (least if up.tag in ("article", "main") else mean):
            break
        top = up
    return top if top.chars else None


def _blocks(top: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(top, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.block:
            flush()
        while i < len(node.kids):
            k = node.kids[i]
            i += 1
            if isinstance(k, str):
                run.append(k)
            elif not k.out:
                stack.append((node, i))
                stack.append((k, 0))
                break
        else:
            if node.block:
                flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    top = chosen(parse(html))
    return "\n".join(_blocks(top)) if top is not None else ""


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("html_text")
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
