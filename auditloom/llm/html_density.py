"""Main text of web pages by composite text density.

For every DOM node: characters per tag, adjusted by how much of the text stands in links (composite text
density, Sun et al. 2011), and the sum of its children's densities.  The node of greatest sum holds the
article; the least density on its path up to the body is the threshold.  Every node that reaches it has its
own text kept and its subtree searched for the greatest sum in the same way.  So menus, link blocks, notices
and other scraps of text fall away by their density, whatever they are called.

What the markup itself declares to be something else (navigation, footers, asides, forms, hidden parts, and
class or id names that say nothing but that) is never part of the article, even where its text is dense, as
reader comments are.  Such names are read as whole words, and neither they nor forms, asides and dialogs ever take
a node that holds the page's heading or most of its text.  The logarithm's base is at least e: below that, as a page's links vanish, the published formula grows
without bound for the shortest scraps.

Defined cases: a null or empty page has no text; unclosed and misnested tags are closed as browsers do for
paragraphs, list items and table cells; a page without elements is one block; of nodes with equal sums (a
tie) the outermost counts, and of siblings the first; a very long page is read whole, in time and memory in
proportion to it; repeated rows are read row by row; an empty table gives an empty result; columns named in
``keep`` are carried along (one named ``text`` or ``n_chars`` there is an error), others do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.arrow_map import add_columns
from auditloom.llm.text_blocks import Block

_UNCLOSED = re.compile(r"(?:<!--|<!\[CDATA\[).*()()()", re.S)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
#: A name with its value, which is taken whole, so that nothing in a value passes for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile(r"class|id|role|hidden", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What an opening tag closes, and the tags beyond which it closes nothing.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KEPT = frozenset("article main body html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNSEEN_TAGS = frozenset("head script style noscript template iframe svg canvas object textarea xmp noembed noframes audio video map".split())
_NOISE_TAGS = _UNSEEN_TAGS | frozenset("nav footer button select input menu search".split())
#: Tags that are noise unless, like noise by name, they hold the heading or most of the page: whole sites stand in a form.
_GUARDED_TAGS = frozenset("aside form dialog".split())
#: Words that class and id names of what is not the article are made of, words that may stand beside them, and roles.
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_BESIDE_WORDS = frozenset("area articles bar block bottom box buttons container content form group inner left links list main outer overlay page panel posts primary right secondary section site slot text thread top wrap wrapper".split())
_NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


class _Node:
    __slots__ = ("tag", "parent", "children", "noise", "named_noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "keeps", "unseen", "open", "marked")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.noise = self.named_noise = self.keeps = self.unseen = self.open = self.marked = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        if parent:
            parent.children.append(self)


def _noise_name(name: str) -> bool:
    """Whether a class or id name says nothing but that it is not the article: ``cookie-notice``, ``site-footer``;
    not ``related-work``, whose second word may mean anything."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return not _NOISE_WORDS.isdisjoint(words) and all(w in _NOISE_WORDS or w in _BESIDE_WORDS for w in words)


def _named_noise(attributes: str) -> bool:
    if not _TELLING.search(attributes):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in _NOISE_ROLES or name in ("class", "id") and any(map(_noise_name, value.split())):
            return True
    return False


def parse(page: str) -> tuple[_Node, list[_Node], list[tuple[_Node, str]]]:
    """The root, all nodes in page order, and the text blocks with the block-level nodes that they stand in."""
    root = _Node("html", None)
    nodes, stack, blocks, buffer = [root], [root], [], []
    links = unseen = 0  # open links and open elements that are not shown
    raw_end = 0
    standing = Counter(["html"])  # open elements by tag, so that nothing is looked for in vain

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            holder = next((n for n in reversed(stack) if n.tag not in _INLINE), root)
            blocks.append((holder, text))

    def add(text: str) -> None:
        if unseen:
            return
        if "&" in text:
            text = html.unescape(text)
        node = stack[-1]
        n = len(text) - text.count(" ") - text.count("\n")
        if n:
            node.chars += n
            if links:
                node.link_chars += n
        buffer.append(text)

    def close(depth: int) -> None:
        nonlocal links, unseen
        if buffer and any(x.tag not in _INLINE for x in stack[depth:]):
            flush()
        for x in stack[depth:]:
            links -= x.tag == "a"
            unseen -= x.unseen
            standing[x.tag] -= 1
        del stack[depth:]

    at, last = 0, page.rfind(">")
    # Beyond the last ">" nothing is a tag, but an unclosed comment or section may stand there.
    while m := (_TOKEN if max(at, raw_end) <= last else _UNCLOSED).search(page, max(at, raw_end)):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            for depth in range(len(stack) - 1, 0, -1) if standing[tag] else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag in _INLINE and stack[depth].tag not in _INLINE:
                    break
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in ("html", "body") and any(n.tag == tag for n in stack[(tag == "html") :]):
            continue
        if tag == "body":
            close(1)
        if tag in _CLOSES_P and standing["p"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if depth and all(n.tag in _INLINE for n in stack[depth + 1 :]):
                close(depth)
        elif tag in _CLOSES:
            closed, bound = _CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(standing[t] for t in closed) else ():
                if stack[depth].tag in closed:
                    close(depth)
                    break
                if stack[depth].tag in bound:
                    break
        if buffer and tag not in _INLINE:
            flush()
        node = _Node(tag, stack[-1])
        nodes.append(node)
        node.unseen = tag in _UNSEEN_TAGS
        node.noise = tag in _NOISE_TAGS or tag == "header" and not any(n.tag in ("article", "main") for n in stack)
        node.named_noise = tag in _GUARDED_TAGS or bool(m[3]) and tag not in _KEPT and tag not in _HEADINGS and _named_noise(m[3])
        if tag in _VOID or m[3].endswith("/") and tag not in _INLINE | _CLOSES_P:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = raw_end = end.start() if end else len(page)
        stack.append(node)
        standing[tag] += 1
        links += tag == "a"
        unseen += node.unseen
    if at < len(page):
        add(page[at:])
    flush()
    return root, nodes, blocks


def _composite(node: _Node, body_chars: int, body_links: int) -> float:
    if not node.chars:
        return 0.0
    c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + body_links / body_chars * c + math.e)
    return max(0.0, c / t * math.log(max(c / lc * (t / lt), 1e-9)) / math.log(max(base, math.e)))


def measure(root: _Node, nodes: list[_Node]) -> None:
    """Counts, densities and sums of all nodes. Counts are of all that is shown; noise adds to no sum and is not
    chosen, nor do inline children add to a sum, being part of their parent's text."""
    for node in reversed(nodes):
        node.keeps |= node.tag in ("main", "h1")
        if node.unseen:
            node.chars = node.tags = node.link_chars = node.link_tags = 0
        elif node.parent:
            up = node.parent
            up.keeps |= node.keeps
            up.chars, up.link_chars = up.chars + node.chars, up.link_chars + node.link_chars
            up.tags, up.link_tags = up.tags + node.tags + 1, up.link_tags + node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), root)
    for node in nodes:
        node.noise |= node.named_noise and not node.keeps and 2 * node.chars <= body.chars
        node.noise |= node.parent is not None and node.parent.noise
    all_chars, all_links = max(body.chars, 1), body.link_chars
    for node in reversed(nodes):
        node.density = _composite(node, all_chars, all_links)
        node.total = sum(c.density for c in node.children if c.tag not in _INLINE and not c.noise)
        for child in node.children:
            if not child.noise and child.best.total > node.best.total:
                node.best = child.best


def mark(root: _Node, nodes: list[_Node]) -> None:
    """Marks the chosen subtrees, and opens the nodes on the way to them, whose own text counts."""
    body = next((n for n in nodes if n.tag == "body"), root)
    chosen = body.best
    threshold, node = chosen.density, chosen
    while node is not body and node.parent:
        node = node.parent
        threshold = min(threshold, node.density)
    todo = [body]
    while todo:
        node = todo.pop()
        if node.noise or node.density < threshold:
            continue
        node.open = node.best.marked = True
        if node.best is not node:
            todo += node.children
    for node in nodes:
        node.marked |= node.parent is not None and node.parent.marked


def extract(page: str) -> str:
    """The article of one page; a line a block."""
    root, nodes, blocks = parse(page)
    measure(root, nodes)
    mark(root, nodes)
    return "\n".join(text for node, text in blocks if (node.marked or node.open) and not node.noise)


def extract_pages(pages: DataFrame, text: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every whole page; no shuffle."""

    def run(block: Block) -> list[pa.Array]:
        found = [extract(block.text(i).decode()) for i in range(block.hi - block.lo)]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return add_columns(pages, text, run, "text string, n_chars long", keep)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
