"""Main text of web pages by tree scoring.

The page becomes a tree; boilerplate (by element, role and class or id words) is cut. Every paragraph-like block passes points,
one plus its commas plus up to three for length, discounted by the share of its text inside links, to its ancestors: whole to the
parent, half to the grandparent, less beyond. The ancestor with the most points, or the article around it, is kept with those of
its siblings that score well or read like prose.

A class or id word may also name what a wrapper has (`has-sidebar`, `no-comments`). An element cut for such a word alone is spared
where no article or main lies outside it and it holds one, or most of the page's text outside links. A word inside a name that
says something else too (`social-science`, `notice-board-history`) is weak evidence: such an element goes only if it doesn't read
like prose.

Null and empty html give an empty text; damaged markup is closed where it breaks off, a tag that never ends takes the rest with
it; repeated rows and other columns don't matter. Parsing, scoring and output take time in proportion to the page, however deep or
broken it is: the parser keeps the places of open elements by tag, and points pass up once per element.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: After "<": a tag's slash, name and attributes. Quotes count after "=" only. Nothing is tried twice, and a tag without end fails once.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?<=\s)(hidden)(?=[\s/>]|$)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
CUT = RAW | frozenset("nav footer aside form head svg math button select option dialog menu object canvas audio video fieldset label datalist map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 figcaption".split())
#: An opening tag closes an open element of these, unless one of the second set lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BLOCKS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table td th button caption html template article section main div body".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo promotion cookie cookies consent gdpr banner notice popup modal overlay "
    "sidebar comment comments commentlist disqus respond reply menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip print alert outbrain taboola copyright".split()
)
#: Words of class names that say where or how something stands, not what it is.
LAYOUT_WORDS = frozenset(
    "box bar list area section wrapper wrap container slot block inner outer item items link links post posts article articles button buttons icon icons "
    "unit top bottom left right main site page form holder panel group content col column row region module view title text head body global primary "
    "secondary mobile desktop has no js elementor wp entry the in with by".split()
)
KEEP = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "parent", "items", "attributes", "score", "text", "links", "cut")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes, self.items = tag, parent, attributes, []
        self.score, self.text, self.links, self.cut = 0.0, 0, 0, False


class Stack:
    """Open elements, with the places of each tag."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}
        self.scopes, self.cells = [], []

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, node: Node) -> None:
        for kind in self._kinds(node.tag):
            kind.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.nodes) > at:
            for kind in self._kinds(self.nodes.pop().tag):
                kind.pop()

    def _kinds(self, tag: str) -> list[list[int]]:
        return [self.places.setdefault(tag, [])] + [self.scopes] * (tag in SCOPE) + [self.cells] * (tag in ("td", "th", "table"))


def parse(page: str) -> Node:
    root = Node("#root", None)
    stack, at, n = Stack(root), 0, len(page)
    while at < n:
        here, mark = stack.nodes[-1], page.find("<", at)
        if mark < 0:
            here.items.append(entities.unescape(page[at:]))
            break
        if mark > at:
            here.items.append(entities.unescape(page[at:mark]))
        kind = page[mark + 1 : mark + 2]
        if kind in ("!", "?"):
            opens, closes = next(((a, b) for a, b in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(a, mark)), (page[mark : mark + 2], ">"))
            end = page.find(closes, mark + len(opens))
            if opens == "<![CDATA[":
                here.items.append(page[mark + 9 : end if end >= 0 else n])
            at = end + len(closes) if end >= 0 else n
            continue
        if not (kind.isascii() and kind.isalpha()) and not re.match(r"/[a-zA-Z]", page[mark + 1 : mark + 3]):
            here.items.append("<")
            at = mark + 1
            continue
        m = TAG.match(page, mark + 1)
        if m is None:
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            i = stack.last(tag)
            if tag == "br":
                here.items.append(Node("br", here))
            elif i > 0 and not (tag in INLINE and stack.cells and stack.cells[-1] > i):
                stack.cut(i)
            continue
        if tag in BLOCKS and (p := stack.last("p")) > (stack.scopes[-1] if stack.scopes else -1):
            stack.cut(p)
        if tag in CLOSES and (i := stack.last(*CLOSES[tag][0])) > stack.last(*CLOSES[tag][1]):
            stack.cut(i)
        here = stack.nodes[-1]
        child = Node(tag, here, m[3])
        here.items.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif not m[3].endswith("/") or tag not in ("svg", "path", "use"):
            stack.push(child)
    return root


def _attributes(node: Node) -> dict[str, str]:
    if not node.attributes or node.attributes == "/":
        return {}
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(node.attributes)}


def unwanted(node: Node, inside: bool) -> bool:
    """Boilerplate by tag, role or visibility; inside: below an article or main."""
    if node.tag in CUT or node.tag == "header" and not inside:
        return True
    found = {} if node.tag in KEEP else _attributes(node)
    return bool(found) and bool("hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) or found.get("role") in ROLES)


def named(node: Node) -> int:
    """3: a class or the id is a bad word; 2: one is made of such a word and words of layout; 1: one has such a word among others; 0: none."""
    if node.tag in KEEP:
        return 0
    found = _attributes(node)
    best = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if any(p in BAD_WORDS for p in parts):
            best = max(best, 3 if name in BAD_WORDS else 2 if all(p in BAD_WORDS or p in LAYOUT_WORDS for p in parts) else 1)
    return best


def by_name(root: Node) -> set[int]:
    """The elements to cut for their class or id, without those that hold the page's own text."""
    order, stack, kinds = [], [(root, False, False)], {}
    while stack:
        node, link, inside = stack.pop()
        if node.tag != "#root":
            if unwanted(node, inside):
                continue
            if kind := named(node):
                kinds[id(node)] = kind
        link, inside = link or node.tag == "a", inside or node.tag in ("article", "main")
        order.append((node, link))
        stack += [(x, link, inside) for x in node.items if isinstance(x, Node)]
    if not kinds:
        return set()
    text: dict[int, int] = {}
    linked: dict[int, int] = {}
    stops: dict[int, int] = {}
    held: dict[int, int] = {}
    for node, link in reversed(order):
        own, strings = [x for x in node.items if isinstance(x, Node)], [x for x in node.items if isinstance(x, str)]
        size, i = sum(len(x.strip()) for x in strings), id(node)
        text[i] = sum(text.get(id(x), 0) for x in own) + (0 if link else size)
        linked[i] = sum(linked.get(id(x), 0) for x in own) + (size if link else 0)
        stops[i] = sum(stops.get(id(x), 0) for x in own) + sum(x.count(".") + x.count("!") + x.count("?") + x.count("。") for x in strings)
        held[i] = sum(held.get(id(x), 0) for x in own) + (node.tag in ("article", "main"))
    cut, whole = set(), id(root)
    for x, kind in kinds.items():
        if kind == 1 and text[x] >= 80 and stops[x] and 3 * linked[x] < text[x]:  # reads like prose
            continue
        most = 10 * text[x] > 9 * text[whole] and text[x] >= 250 if kind == 3 else 2 * text[x] > text[whole]
        if held[x] < held[whole] or not held[x] and not most:
            cut.add(x)
    return cut


def measure(root: Node) -> list[Node]:
    """Cuts boilerplate, counts text inside and outside links, and passes points up. Returns the nodes that got points."""
    order, stack, cut = [], [(root, False)], by_name(root)
    while stack:
        node, inside = stack.pop()
        if node.tag != "#root" and (id(node) in cut or unwanted(node, inside)):
            node.cut, node.items = True, []
            continue
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside) for x in node.items if isinstance(x, Node)]
    own: dict[int, int] = {}
    commas: dict[int, int] = {}
    for node in reversed(order):
        n = c = direct = 0
        for x in node.items:
            if isinstance(x, str):
                size = len(x.strip())
                direct += size
                n += size
                c += x.count(",") + x.count("、") + x.count("，") + x.count("،")
            else:
                n += x.text
                c += commas.get(id(x), 0)
                node.links += x.links
                if x.tag in INLINE:
                    direct += own.get(id(x), 0)
        node.text, own[id(node)], commas[id(node)] = n, direct, c
        if node.tag == "a":
            node.links = n
    points: dict[int, list[float]] = {id(node): [0.0, 0.0, 0.0] for node in order}  # own, from children, from further below
    for node in order:
        if node.text and (node.tag in PARAGRAPH or node.tag not in INLINE and node.tag not in ("#root", "html", "body", "h1", "br", "ul", "ol", "tr", "table", "tbody") and own[id(node)] >= 25):
            to = node.parent if node.tag in PARAGRAPH else node
            points[id(to)][0] += max((1 + commas[id(node)] + min(node.text // 100, 3)) * (1 - node.links / node.text), 0.0)
    scored = []
    for node in reversed(order):  # below before above: half to the parent, a sixth to the grandparent, half of that to the next
        first, second, rest = points[id(node)]
        if node.parent is not None:
            up = points[id(node.parent)]
            up[1] += first / 2
            up[2] += second / 3 + rest / 2
            node.score = first + second + rest
            if node.score > 0:
                scored.append(node)
    return scored[::-1]


def density(node: Node) -> float:
    return node.links / node.text if node.text else 0.0


def chosen(root: Node) -> list[Node]:
    scored = measure(root)
    best = max(scored, key=lambda x: x.score * (1 - density(x)), default=None)
    if best is None:
        x = root
        for name in ("main", "article", "body"):
            found = next((y for y in walk(root) if y.tag == name and y.text), None)
            if found:
                x = found
        return [x]
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        best = up
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least, kept = max(10.0, best.score * 0.2), []
    for x in best.parent.items:
        if not isinstance(x, Node) or x.cut:
            continue
        prose = x.tag == "p" and (x.text > 80 and density(x) < 0.25 or 0 < x.text <= 80 and density(x) == 0 and "." in flat([x]))
        if x is best or x.score * (1 - density(x)) >= least or prose:
            kept.append(x)
    return kept


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in reversed(x.items) if isinstance(y, Node)]


def flat(nodes: list[Node]) -> str:
    """Text of the nodes in page order; blocks are parted by a space, inline elements aren't."""
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut:
            if x.tag in INLINE:
                stack += reversed(x.items)
            else:
                out.append(" ")
                stack.append(" ")
                stack += reversed(x.items)
    return " ".join("".join(out).split())


def extract(page: str | None) -> str:
    return flat(chosen(parse(page))) if page and page.strip() else ""


def main_text(pages: DataFrame) -> DataFrame:
    """Returns page_id, url, text, n_chars (code points)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
