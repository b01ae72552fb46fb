"""Main text of web pages by composite text density.

The page becomes a tree (end tags that HTML lets authors leave out are implied). Parts that say what
they are (menus, footers, asides, forms, scripts, adverts, comments, notices by tag, role, class or id)
are cut. A class or id alone doesn't cut an article or main element or what encloses one (unless it names
comments, which are often articles too), nor what holds most of the page's characters outside links (nearly all of
them where it has no other word, as an advert longer than the text). For every node the composite density is

    C / T * log base ln(C / N * L + Lb / Cb * C + e) of (C / L * T / M)

with C characters, T tags, L characters in links, M links (all at least 1), N = C - L and Lb, Cb
those of the body. A node's sum adds its children's densities. The path from the node of the largest sum to
the body gives the threshold (the least density on it); of the nodes at or above it, the one with the
largest sum is the main text. Where an article or main element encloses it, that is taken whole.

Defined results: null or empty html, or a page without such a node, gives the empty text; broken
markup never fails: what isn't a tag is text. Null ids and urls are kept; repeated rows are treated alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(id|class|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag on the left ends open elements on the right, up to the nearest of the last group.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select input textarea head object embed canvas dialog menu option label fieldset title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu topbar toolbar "
    "sidebar sidebars side aside rail widget widgets footer foot masthead breadcrumb breadcrumbs crumbs pagination pager comment comments commentlist respond reply replies disqus "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations popular trending search skip disclaimer copyright legal".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Share of the page's characters outside links beyond which a node isn't cut for its class or id, by named().
MOST = {1: 0.5, 2: 0.9, 3: 0.9}
KEEPS = frozenset("html body main article".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("kids", "parent", "sum", "tag", "c", "t", "l", "m", "density", "noise", "named")

    def __init__(self, tag: str, parent):
        self.tag, self.parent, self.kids, self.noise, self.named = tag, parent, [], False, 0
        self.c = self.t = self.l = self.m = 0
        self.density = self.sum = 0.0


def is_noise(tag: str, attrs: str, parent: Node) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag == "header":
        up = parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    if not attrs or tag in KEEPS and tag != "article":
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"' ")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name == "itemprop" and value.lower() == "comment":
            return True
    return False


def named(tag: str, attrs: str) -> int:
    """Of class and id: 3 with a word for comments, 2 with noise words only, 1 with one among others, else 0."""
    if not attrs or tag in KEEPS and tag != "article":
        return 0
    words = {w.lower() for name, value in ATTR.findall(attrs) if name.lower() in ("id", "class") for w in PARTS.findall(value)}
    if words.isdisjoint(NOISE_WORDS):
        return 0
    return 3 if not words.isdisjoint(COMMENT_WORDS) else 2 if all(w in NOISE_WORDS or w.isdigit() for w in words) else 1


def cut_named(root: Node) -> None:
    """Noise by class or id, judged by what it would take away."""
    nodes = order(root)
    if not any(n.named for n in nodes):
        return
    free, holds = {}, set()
    for n in reversed(nodes):
        if n.tag in ("article", "main") or any(k in holds for k in n.kids):
            holds.add(n)
        free[n] = 0 if n.tag == "a" else sum(len(k) - k.count(" ") if isinstance(k, str) else free.get(k, 0) for k in n.kids)
    for n in nodes:
        if n.named:
            n.noise = not (n.named < 3 and n in holds or free[n] > MOST[n.named] * free[root])


def parse(page: str) -> Node:
    """The tree; kids are nodes and decoded texts in page order."""
    root = Node("html", None)
    at, here, end = 0, root, len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            here.kids.append(html.unescape(page[a:b]))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            up = here
            while up is not root and up.tag != tag:
                if up.tag in BLOCK and tag not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag in ("p", "br"):
                here.kids.append(Node("br", here))
            continue
        if tag in ("html", "body", "head") and here.tag == tag:
            continue
        if tag in CLOSES_P:
            up = here
            while up is not root and up.tag != "p" and up.tag not in ("td", "th", "button", "object", "table", "div", "article", "section", "li"):
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag == "body" and here.tag == "head":
            here = here.parent
        if tag in IMPLIED:
            ended, bound = IMPLIED[tag]
            up, last = here, None
            while up is not root and up.tag not in bound:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        node = Node(tag, here)
        node.noise, node.named = is_noise(tag, attrs, here), named(tag, attrs)
        here.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if close is None:
                break
            if tag not in ("script", "style"):
                node.kids.append(html.unescape(page[at : close.start()]))
            at = close.end()
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            here = node
    return root


def order(root: Node) -> list[Node]:
    """Nodes without what is known as noise, parents first (no recursion: trees may be deep)."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        found.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.noise]
    return found


def measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        n.c += sum(len(k) - k.count(" ") for k in n.kids if isinstance(k, str))
        if n.tag == "a":
            n.l, n.m = n.c, n.m + 1
        if n.parent is not None:
            p = n.parent
            p.c, p.t, p.l, p.m = p.c + n.c, p.t + n.t + 1, p.l + n.l, p.m + n.m
    body = nodes[0]
    lb, cb = body.l, max(body.c, 1)
    for n in nodes:
        if n.c:
            c, t, l, m = n.c, max(n.t, 1), max(n.l, 1), max(n.m, 1)  # noqa: E741
            base = math.log(c / max(c - n.l, 1) * n.l + lb / cb * c + math.e)
            n.density = c / t * math.log(max(c / l * t / m, 1.0)) / max(math.log(base), 1e-6) if base > 1.0001 else c / t * math.log(max(c / l * t / m, 1.0)) / 1e-4
        if n.parent is not None:
            n.parent.sum += n.density
    for n in nodes:
        if not any(isinstance(k, Node) and not k.noise for k in n.kids):
            n.sum = n.density


def choose(root: Node) -> Node | None:
    nodes = order(root)
    measure(nodes)
    best = max(nodes, key=lambda n: n.sum)
    if best.c == 0:
        return None
    least, up = best.density, best
    while up is not None:
        least, up = min(least, up.density), up.parent
    best = max((n for n in nodes if n.density >= least), key=lambda n: n.sum)
    for tag in ("article", "main"):
        up, outer = best, None
        while up is not None:
            outer = up if up.tag == tag else outer
            up = up.parent
        if outer is not None:
            return outer
        inner = [n for n in nodes if n.tag == tag and best in ancestors(n)]
        if inner and max(n.c for n in inner) >= 0.5 * best.c:
            return max(inner, key=lambda n: n.c)
    return best


def ancestors(n: Node):
    while n is not None:
        yield n
        n = n.parent


def text_of(root: Node) -> str:
    """Blocks in page order, white space in each made one space, joined by one space."""
    out, todo = [], [root]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.noise or k is root:
            if k.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo += reversed(k.kids)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    cut_named(root)
    chosen = choose(root)
    return text_of(chosen) if chosen is not None else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(batches):
        for b in batches:
            found = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.transform(common.in_workers, run, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
