"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; elements of the same name, id and class that repeat under one parent fold into one
node. The trees of a host's pages are aligned pairwise by simple tree matching and merged: a node whose text never changes is part
of the host's template, one whose text varies is a slot. Trees merge within each task first, then in two grouped steps, so a host
may own any share of all pages; a template has at most ``MOST_NODES`` nodes, those that most pages have.

The slots say where the content is: from the root one goes down to the child that holds at least ``DOMINANT`` of the text in slots, links apart, until
the blocks of text are the children themselves, or no child holds so much. Every page is aligned with its host's template, and the
blocks below that node are joined in page order, constant ones too, with the headings beside the way to it. Names only settle what is left: inside the
content they drop elements that say they are menus, headers, footers, sidebars, notices, adverts, forms or comments, and blocks of a few words that are
the same on all pages and name such things; where no child dominates, articles and main elements are preferred; outside of these, blocks that are mostly links are dropped. A page
that has nothing at its host's content node is judged by its own tree, as are pages of hosts with few pages.

Defined results: null or empty html, or html without text, gives an empty text; a null url has the empty host; a host with fewer than
``MIN_PAGES`` pages has no constant nodes; unclosed and stray tags are closed or skipped, and elements nested to any depth; repeated rows are extracted each; an empty table
gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Generator, Iterator
from typing import Any
from html import unescape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded_batches, each, written
from .urls import host_of

MIN_PAGES = 3
#: The share of a node's text in slots that a child must hold to be gone down to.
DOMINANT = 0.8
#: Beyond so many nodes a template loses those that the fewest pages have.
MOST_NODES = 4096
#: Groups of tasks whose templates of one host are merged first.
SPREAD = 64

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(id|class|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|\d+")
#: Element names by what they do to the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg object canvas textarea select button math audio video".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: What an open element of this name is closed by, if it opens again within the given parents.
AGAIN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
SKIPPED_TAGS = frozenset("nav header footer aside form menu dialog head fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu topbar breadcrumb breadcrumbs sidebar aside widget footer header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert popup modal newsletter subscribe subscription signup login search share sharing social related recommended comment comments reply replies respond disqus discussion pagination pager copyright legal disclaimer toolbar skip".split()
)
#: Beside these a word of SKIPPED_WORDS tells how the page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("has with no without layout page wrapper container".split())
#: In an article these name its own head.
HEAD_WORDS = frozenset(("header", "masthead"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_WORDS = frozenset(("articlebody", "main"))
VARIES = -1
#: A constant node in the content, no heading, is dropped if it has at most so many words, one of them in SKIPPED_WORDS.
LABEL_WORDS = 4


class Node:
    """A folded element: its key, children, the hash of its text (None: no text yet, VARIES), pages that have it, characters and those in links."""

    __slots__ = ("chars", "children", "cursor", "key", "links", "pages", "text")

    def __init__(self, key: str) -> None:
        self.key, self.children = key, []
        self.text: int | None = None
        self.pages, self.chars, self.links, self.cursor = 1, 0, 0, 0

    def child(self, key: str) -> Node:
        """The folded child of this key at or after the cursor, or a new one there."""
        for i in range(self.cursor, len(self.children)):
            if self.children[i].key == key:
                self.cursor = i
                found = self.children[i]
                found.cursor = 0
                return found
        if self.cursor < len(self.children):
            self.cursor += 1
        found = Node(key)
        self.children.insert(self.cursor, found)
        return found

    def see(self, text: str, links: int) -> None:
        h = zlib.crc32(text.encode()) << 16 | len(text) & 0xFFFF
        self.text = h if self.text in (None, h) else VARIES
        self.chars, self.links = self.chars + len(text), self.links + links

    def below(self) -> list[tuple[Node, int]]:
        """All nodes, parents first, with the place of their parent in the list (-1 for this one)."""
        out: list[tuple[Node, int]] = [(self, -1)]
        waiting = [(c, 0) for c in reversed(self.children)]
        while waiting:
            node, parent = waiting.pop()
            out.append((node, parent))
            waiting += [(c, len(out) - 1) for c in reversed(node.children)]
        return out

    def dump(self) -> str:
        return json.dumps([[n.key, n.text, n.pages, n.chars, n.links, p] for n, p in self.below()])

    @staticmethod
    def load(data: str) -> Node:
        nodes: list[Node] = []
        for key, text, pages, chars, links, parent in json.loads(data):
            n = Node(key)
            n.text, n.pages, n.chars, n.links = text, pages, chars, links
            nodes.append(n)
            if parent >= 0:
                nodes[parent].children.append(n)
        return nodes[0]


def describe(tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """(key, skip, main) of an element, ``inside`` a main one or not: digits in ids and classes do not count."""
    skip, main = tag in SKIPPED_TAGS and not (inside and tag == "header"), tag in ("article", "main")
    if not attributes:
        return tag, skip, main
    key = tag
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        words = WORD.findall(value)
        key += f" {name}={'-'.join(w for w in words if not w.isdigit())}"
        if name == "role":
            skip, main = skip or value in SKIPPED_ROLES, main or value == "main"
        elif tag in ("body", "html", "article", "main"):
            continue
        elif (found := SKIPPED_WORDS.intersection(words)) and LAYOUT_WORDS.isdisjoint(words):
            skip = skip or not (inside and found <= HEAD_WORDS)
        elif name == "itemprop" and not MAIN_WORDS.isdisjoint(words):
            main = True
    return key, skip, main


def parse(html: str) -> tuple[Node, list[tuple[str, Node, bool, bool]]]:
    """The folded tree, and every block of text in page order as (text, node, skipped, in the main element)."""
    root = Node("")
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    blocks: list[tuple[str, Node, bool, bool]] = []
    held: list[str] = []
    in_links = in_link = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal in_links
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, node, skip, main = stack[-1]
                node.see(text, min(in_links, len(text)))
                blocks.append((text, node, skip, main))
        in_links = 0

    def add(text: str) -> None:
        nonlocal in_links
        if "&" in text:
            text = unescape(text)
        held.append(text)
        if in_link:
            in_links += len(text.strip())

    while at < size:
        start = html.find("<", at)
        found = TOKEN.match(html, start) if start >= 0 else None
        if start < 0 or found is None:  # text to the end, or a bare <
            stop = size if start < 0 else start + 1
            add(html[at:stop])
            at = stop
            continue
        if start > at:
            add(html[at:start])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in RAW or tag == "title":
            if not closing:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        break
                continue
            if tag in AGAIN:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in AGAIN[tag]:
                        break
                    if stack[i][0] == tag or {tag, stack[i][0]} in ({"dt", "dd"}, {"td", "th"}):
                        del stack[i:]
                        break
            elif tag in ENDS_P and stack[-1][0] == "p":
                stack.pop()
            if tag in ("html", "body") and any(s[0] == tag for s in stack):
                continue
            if stack[-1][0] == "head" and tag == "body":
                stack.pop()
            _, parent, skipped, inside = stack[-1]
            key, skip, main = describe(tag, found[3], inside)
            node = parent.child(key)
            stack.append((tag, node, skipped or skip, inside or (main and not skipped)))
    flush()
    return root, blocks


Steps = Generator["Steps", Any, Any]


def settled(steps: Steps) -> Any:
    """The result of a generator that yields generators for their results: recursion of any depth on a stack of our own."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def matching(a: list[Node], b: list[Node], known: dict[tuple[int, int], int]) -> Steps:
    """Simple tree matching of two child lists: pairs of positions, in order, with the most matching nodes below."""
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = 0
            if x.key == y.key and (both := known.get((id(x), id(y)))) is None:
                both = known[id(x), id(y)] = yield weight(x, y, known)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + both)
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def weight(x: Node, y: Node, known: dict[tuple[int, int], int]) -> Steps:
    """How many nodes of two trees with equal roots match."""
    total = 1
    for i, j in (yield matching(x.children, y.children, known)):
        if (both := known.get((id(x.children[i]), id(y.children[j])))) is None:
            both = yield weight(x.children[i], y.children[j], known)
        total += both
    return total


def match(a: list[Node], b: list[Node], known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    return settled(matching(a, b, known))


def merge(into: Node, other: Node) -> Node:
    """``into`` with the nodes, texts and counts of ``other``; nodes without a match are inserted in order."""
    waiting, known, kept = [(into, other)], {}, []
    while waiting:
        x, y = waiting.pop()
        x.pages, x.chars, x.links = x.pages + y.pages, x.chars + y.chars, x.links + y.links
        if y.text is not None:
            x.text = y.text if x.text in (None, y.text) else VARIES
        pairs = {j: i for i, j in match(x.children, y.children, known)}
        out, done = [], 0
        for j, child in enumerate(y.children):
            if j in pairs:
                out += x.children[done : pairs[j] + 1]
                done = pairs[j] + 1
                waiting.append((out[-1], child))
            else:
                out.append(child)
        kept.append(x.children)  # so that no id is used again while ``known`` is
        x.children = out + x.children[done:]
    return into


def pruned(root: Node, most: int = MOST_NODES) -> Node:
    """``root`` with at most about ``most`` nodes: those of the fewest pages go, with all below them, which have no more. Their pages' blocks are slots then."""
    nodes = [n for n, _ in root.below()]
    if len(nodes) <= most:
        return root
    least = sorted((n.pages for n in nodes), reverse=True)[most]
    for n in nodes:
        n.children = [c for c in n.children if c.pages > least]
    return root


def content_path(root: Node) -> tuple[list[Node], bool]:
    """The nodes from the root to the one whose text in slots is the content, and whether its blocks are the content themselves (else its children compete)."""
    nodes = root.below()
    few = root.pages < MIN_PAGES

    def volumes(constant_too: bool) -> list[int]:
        out = [max(0, n.chars - n.links) if constant_too or few or n.text == VARIES or n.pages < MIN_PAGES else 0 for n, _ in nodes]
        for at in range(len(nodes) - 1, 0, -1):
            out[nodes[at][1]] += out[at]
        return out

    whole = volumes(False)
    if not whole[0]:
        whole = volumes(True)
    by_node = {id(n): v for (n, _), v in zip(nodes, whole, strict=True)}
    path = [root]
    while True:
        node = path[-1]
        total = by_node[id(node)]
        inner = [c for c in node.children if c.children]
        own = total - sum(by_node[id(c)] for c in inner)  # what its leaves, and it itself, hold
        if 2 * own >= total:
            return path, True
        top = max(inner, key=lambda c: by_node[id(c)])
        if by_node[id(top)] < DOMINANT * total:
            return path, False
        path.append(top)


def labels_itself(text: str) -> bool:
    """Whether a block's few words name boilerplate."""
    words = WORD.findall(text.lower())
    return len(words) <= LABEL_WORDS and not SKIPPED_WORDS.isdisjoint(words)


def content_blocks(page: Node, blocks: list[tuple[str, Node, bool, bool]], template: Node, path: list[Node], own: bool) -> list[str]:
    """The texts of a page's blocks that are content by the template's path to it; empty if the page has none there."""
    on_path, target = {id(n): k for k, n in enumerate(path)}, path[-1]
    inside: dict[int, Node | None] = {}  # page nodes in the content, with their template nodes
    heads: set[int] = set()
    waiting: list[tuple[Node, Node | None, bool]] = [(page, template, template is target)]
    known: dict[tuple[int, int], int] = {}
    while waiting:
        node, seen, here = waiting.pop()
        if here:
            inside[id(node)] = seen
        pairs = dict(match(node.children, seen.children, known)) if seen is not None and (here or id(seen) in on_path) else {}
        for i, child in enumerate(node.children):
            other = seen.children[pairs[i]] if seen is not None and i in pairs else None
            if here or other is target or (other is not None and id(other) in on_path):
                waiting.append((child, other, here or other is target))
            elif child.key.partition(" ")[0] in HEADINGS:
                heads.add(id(child))
    found = [(text, node, skip, main, id(node) in heads) for text, node, skip, main in blocks if id(node) in inside or id(node) in heads]
    if not any(not head for *_, head in found):
        return []
    named = [b for b in found if not b[2]]
    if not own and (inner := [b for b in named if b[3]]):
        named = inner

    def links_only(block: tuple[str, Node, bool, bool, bool]) -> bool:
        seen = inside.get(id(block[1])) or block[1]
        return not (block[3] or block[4] or block[1].key.partition(" ")[0] in HEADINGS) and 2 * seen.links > seen.chars

    named = [b for b in named if not links_only(b)] or named
    named = named or found

    def label(block: tuple[str, Node, bool, bool, bool]) -> bool:
        text, node, _, _, _ = block
        seen = inside.get(id(node))
        constant = seen is not None and seen.pages >= MIN_PAGES and seen.text == node.text and node.text not in (None, VARIES)
        return constant and node.key.partition(" ")[0] not in HEADINGS and labels_itself(text)

    return [b[0] for b in named if not label(b)] or [b[0] for b in named]


def main_text(html: str | None, template: Node | None, path: tuple[list[Node], bool] | None = None) -> str:
    """The content of a page; ``path`` is that of the template, if it is known already."""
    root, blocks = parse(html or "")
    if not blocks:
        return ""
    if template is not None and (texts := content_blocks(root, blocks, template, *(path or content_path(template)))):
        return " ".join(texts)
    return " ".join(content_blocks(root, blocks, root, *content_path(root)) or [b[0] for b in blocks])


def induce(pages: DataFrame) -> DataFrame:
    """(host, template), written, from (host, html)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Node] = {}
        for hosts, htmls in each(batches, "host", "html"):
            for host, html in zip(hosts.to_pylist(), htmls.to_pylist(), strict=True):
                tree = parse(html or "")[0]
                own[host] = pruned(merge(own[host], tree)) if host in own else pruned(tree)
        lane = TaskContext.get().partitionId() % SPREAD
        yield pa.RecordBatch.from_pydict({"host": pa.array(own.keys(), pa.string()), "lane": pa.array([lane] * len(own), pa.int32()), "template": pa.array([t.dump() for t in own.values()], pa.string())})

    def joined(templates: pa.Table) -> pa.Table:
        whole = None
        for t in templates["template"].to_pylist():
            tree = Node.load(t)
            whole = tree if whole is None else pruned(merge(whole, tree))
        return pa.table({"host": templates["host"][:1].cast(pa.string()), "template": pa.array([whole.dump()], pa.string())})

    first = pages.mapInArrow(partial, "host string, lane int, template string")
    schema = "host string, template string"
    second = first.groupBy("host", "lane").applyInArrow(joined, schema)
    return written(second.groupBy("host").applyInArrow(joined, schema), "templates")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row."""
    bounded_batches(df.sparkSession)
    pages = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    templates = induce(pages.select("host", "html"))
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, links, htmls, known in each(batches, "key", "url", "html", "template"):
            # A batch may hold a host's template for each of its pages; it is parsed once.
            loaded: dict[str | None, tuple] = {None: (None, None)}
            out = []
            for page, t in zip(htmls.to_pylist(), known.to_pylist(), strict=True):
                if t not in loaded:
                    loaded[t] = (tree := Node.load(t), content_path(tree))
                out.append(main_text(page, *loaded[t]))
            yield batch(schema, key=keys, url=links, text=out, n_chars=[len(x) for x in out])

    joined = pages.join(templates, "host", "left").select("key", "url", "html", "template")
    return joined.mapInArrow(texts, "key long, url string, text string, n_chars long")
