"""A small HTML tree, shared by main-text extraction and media sequences."""

from __future__ import annotations

import re
from html import unescape

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
TAG_STOP = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
QUOTES_OR_BLANK = ("", '"', "'", " ", "\t", "\n", "\r", "\f")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag of the key's kind ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
NO_P = frozenset("caption dd dt figcaption html body legend li summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - NO_P
SCOPE = frozenset("html body table td th caption button object template".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Node:
    """An element; holds: an article or main element lies below it; share: characters and those in links, once counted; apart: what a caller found out about it; before, after, last, prose: its neighbours, its last child so far, and whether paragraphs stand in it, for callers that fill them."""

    __slots__ = ("tag", "attrs", "parent", "children", "holds", "share", "apart", "before", "after", "last", "prose")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.holds, self.share, self.apart = tag, attrs, parent, [], False, None, None
        self.before = self.after = self.last = self.prose = None
        if tag in ("article", "main"):
            while parent is not None and not parent.holds:
                parent.holds = True
                parent = parent.parent

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attrs):
            out.setdefault(m[1].lower(), unescape(next((g for g in m.groups()[1:] if g is not None), "")))
        return out


class Open:
    """The open elements, and where those of each tag stand among them, so that the nearest one is found at once."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.boxes = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.boxes.append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.boxes.pop()

    def end(self, names, stops) -> None:
        """Close the nearest element among names, unless one of the stops is nearer."""
        place = self.nearest(names)
        if place and place > self.nearest(stops):
            self.cut(place)


def tag_end(html: str, at: int, quoted: bool) -> int:
    """Where the tag that is open at `at` has its >; signs in quotes that begin a value don't count, if quoted. -1 if it has none."""
    first = at
    while quoted:
        m = TAG_STOP.search(html, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        before, at = m.start() - 1, m.end()
        while before >= first and html[before].isspace():
            before -= 1
        if html[before] == "=":
            at = html.find(m[0], at) + 1
            if at == 0:
                return -1
    return html.find(">", at)


def parse(html: str) -> Node:
    """The element tree; texts are decoded, comments and raw elements (scripts, styles) leave no text. Open and stray tags are mended as browsers do it in common cases.

    One scan from left to right. Once a quote or a tag is found to stay open up
    to the end, quotes count no more from there on; a tag that has no > at all
    ends the page, as does a comment that stays open.
    """
    root = Node("#root", "", None)
    open_ = Open(root)
    at, begun, n, quoted = 0, 0, len(html), True  # begun: where the text that isn't added yet began

    def add(upto: int) -> None:
        if upto > begun:
            text = html[begun:upto]
            open_.nodes[-1].children.append(unescape(text) if "&" in text else text)

    while (at := html.find("<", at)) >= 0:
        sign = html[at + 1 : at + 2]
        if sign in ("!", "?"):
            add(at)
            end = html.find("-->", at + 2) if html.startswith("<!--", at) else html.find(">", at)
            at = begun = n if end < 0 else end + (3 if html.startswith("<!--", at) else 1)
            continue
        closing = sign == "/"
        m = NAME.match(html, at + 1 + closing)
        if m is None:
            at += 1
            continue
        add(at)
        end = tag_end(html, m.end(), quoted)
        if end < 0 and quoted:
            quoted = False
            end = tag_end(html, m.end(), quoted)
        if end < 0:
            begun = n
            break
        name, attrs = m[0].lower(), html[m.end() : end]
        at = begun = end + 1
        if name == "br":
            open_.nodes[-1].children.append(" ")
        elif closing:
            place = open_.nearest((name,))
            if place and (name in BLOCK or not open_.boxes or place > open_.boxes[-1]):
                open_.cut(place)
        elif name in RAW:
            end_tag = RAW_END[name].search(html, at)
            end = html.find(">", end_tag.end()) if end_tag else -1
            at = begun = end + 1 if end >= 0 else n
        else:
            if name in CLOSES_P and open_.places.get("p"):
                open_.end(("p",), SCOPE)
            if name in ENDS:
                open_.end(*ENDS[name])
            child = Node(name, attrs, open_.nodes[-1])
            open_.nodes[-1].children.append(child)
            if name not in VOID and not (attrs.endswith("/") and attrs[-2:-1] in QUOTES_OR_BLANK):
                open_.push(child)
    add(n)
    return root


def blocks(node: Node, skip) -> list[str]:
    """The texts of the blocks below node in page order, white space made single, empty ones left out. skip(element) leaves an element out."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            out.append(text)
        buffer.clear()

    stack: list = [iter(node.children)]
    owners = [node]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if owners.pop().tag in BLOCK:
                flush()
        elif isinstance(child, str):
            buffer.append(child)
        elif not skip(child):
            if child.tag in BLOCK:
                flush()
            stack.append(iter(child.children))
            owners.append(child)
        elif child.tag in BLOCK:
            flush()
    flush()
    return out
