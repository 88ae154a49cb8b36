"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshvec.llm.markup import BLOCK, Node, blocks, parse

#: Elements that are never part of an article.
APART = frozenset("head script style noscript template nav header footer aside form button select option input textarea label iframe object embed svg canvas map dialog menu audio video".split())
ROLES = frozenset("banner navigation complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id attributes that name what stands beside an article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices alert footer header masthead topbar menu nav navbar navigation newsletter pagination pager popup modal overlay promo promotion promoted related recommended recommendations share sharing sidebar sidebars aside social sponsor sponsored subscribe subscription toolbar widget widgets legal disclaimer copyright login signin signup register search trending hidden".split()
)
KEPT_TAGS = frozenset(("html", "body", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names are judged part by part.
BOX_TAGS = frozenset("div section ul ol dl center fieldset table tbody details search figure".split())
#: Parts of a name that only say what kind of box it is.
BOXES = frozenset("area bar block bottom box body btn button buttons column container content div form global group holder icon icons inner item items left line link links list main message outer page panel post posts primary rail right row section site slot stories story the this thread top unit wrap wrapper zone".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
WORDS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
#: Boxes that stand beside the article if they are lists of links, from so many links on.
LIST_TAGS, LEAST_LINKS = frozenset("div section ul ol dl table center".split()), 3
#: Names of BESIDE that an article's box may bear, too: such a box prevails by its share of the page alone, others from so many characters on.
DOUBTFUL = frozenset("alert copyright disclaimer header hidden legal masthead notice notices register registers related replies search social topbar widget widgets".split())
LEAST_PREVAILING = 250
#: Words of headings and names that announce links to something else.
ELSEWHERE = frozenset("archive archives categories category follow latest links more navigation news next other popular previous read recent recommended related share sponsored stories story tags topics trending".split())
PROSE_TAGS = frozenset("p pre blockquote".split())
#: Points by which containers start.
START = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}


def named(name: str, words: frozenset[str]) -> bool:
    """Is a class or id as a whole such a word, or one with parts that only say what kind of box it is (cookie-notice, ad-slot-2)?"""
    parts = [w.lower() for w in WORDS.findall(name)]
    return any(w in words for w in parts) and all(w in words or w in BOXES or w.isdigit() for w in parts)


def beside(node: Node, total: int) -> bool:
    """Does an element stand beside the article? total: the characters of the page's text.

    By its tag or role alone, menus, forms and the like do. A name that only
    says so (cookie-notice, ad-slot-2) counts unless the element holds more
    than half of the page's text that is no links, and, if its name can't be an
    article's, LEAST_PREVAILING characters: then it is what the page is about,
    or a wrapper of that. A word of a longer name (related-work,
    hidden-markov-models) counts for boxes whose text is links for the most
    part; headings, paragraphs, items and inline elements stay, and their ids,
    which are slugs of their texts, are not looked at. Boxes that are lists of
    links stand beside, unless they are a part of prose (see in_prose).
    """
    return by_kind(node) or named_beside(node, total) or link_list(node)


def apart(node: Node) -> bool:
    """What scored found out."""
    return node.apart


def by_kind(node: Node) -> bool:
    if node.tag in APART and not (node.tag == "form" and node.holds):
        return True
    if not node.attrs.strip():
        return False
    a = node.attributes()
    role = a.get("role", "").lower()
    return role in ROLES and not (role == "form" and node.holds) or a.get("aria-hidden") == "true" or "hidden" in a or bool(re.search(r"display\s*:\s*none", a.get("style", "")))


def named_beside(node: Node, total: int) -> bool:
    if not node.attrs.strip() or node.tag in KEPT_TAGS or node.holds and node.tag != "article":  # a name such as has-sidebar on what wraps the article
        return False
    a = node.attributes()
    classes, ident = a.get("class", "").split(), a.get("id", "")
    if any(named(c, COMMENTS) for c in ([*classes, ident] if node.tag in BOX_TAGS or node.tag == "article" else classes)):
        return node.tag not in HEADINGS or any(c.lower() in COMMENTS for c in classes)
    if node.tag == "article":
        return False
    if node.tag in HEADINGS:
        return any(c.lower() in BESIDE - {"header"} for c in classes)
    if node.tag not in BOX_TAGS:
        return any(named(c, BESIDE) for c in classes)
    section = node.tag == "section" or "section" in classes
    if any(named(c, BESIDE) for c in (classes if section else [*classes, ident])):
        sure = any(w.lower() in BESIDE - DOUBTFUL for c in (classes if section else [*classes, ident]) if named(c, BESIDE) for w in WORDS.findall(c))
        return linked(node) or 2 * node.share[0] <= total or sure and node.share[0] < LEAST_PREVAILING
    words = {w.lower() for w in WORDS.findall(f"{a.get('class', '')} {ident}")}
    return bool(words & BESIDE) and linked(node)


def link_list(node: Node) -> bool:
    """Is a box made of LEAST_LINKS links or more, which hold half of its text or more?"""
    return node.tag in LIST_TAGS and linked(node) and node.share[2] >= LEAST_LINKS and not in_prose(node)


def prose(x: Node | str) -> bool:
    """Is this a paragraph, or the like, that is no links for the most part?"""
    return not isinstance(x, str) and x.tag in PROSE_TAGS and x.share is not None and not linked(x)


def announced(heading: Node) -> bool:
    """Does a heading not say that something else follows?"""
    words, todo = [], [heading]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words += WORDS.findall(x)
        else:
            todo += x.children
    return not {w.lower() for w in words} & ELSEWHERE


def beside_prose(node: Node) -> bool:
    """Does a paragraph stand beside an element, in the same box? Asked once for each box, as boxes may have very many lists."""
    up = node.parent
    if up.prose is None:
        up.prose = any(prose(x) for x in up.children)
    return up.prose


def in_prose(node: Node) -> bool:
    """Is a list of links a part of the article, such as its references?

    It is if no name of it says that it leads elsewhere, and a heading that
    doesn't say so either stands before it, or, in a section of its own, as its
    first element, and paragraphs stand beside it or its section; or if a
    paragraph comes right before it and another right after it.
    """
    up = node.parent
    if up is None or named_elsewhere(node):
        return False
    if node.tag in ("div", "section"):
        first = next((x for x in node.children if not isinstance(x, str) or x.strip()), None)
        return beside_prose(node) and isinstance(first, Node) and first.tag in HEADINGS and announced(first)
    before, after = node.before, node.after
    if before is None:
        return False
    if before.tag in HEADINGS and announced(before):
        return beside_prose(node) or up.tag in ("div", "section") and up.parent is not None and not named_elsewhere(up) and beside_prose(up)
    return prose(before) and after is not None and prose(after)


def named_elsewhere(node: Node) -> bool:
    if not node.attrs.strip():
        return False
    a = node.attributes()
    return bool({w.lower() for w in WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")} & (ELSEWHERE | BESIDE))


def measure(root: Node) -> None:
    """Give every element its share: characters other than spaces, those inside links, and the number of links with text. What is apart by its kind counts nothing."""
    stack = [(root, iter(root.children))]
    root.share = [0, 0, 0]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if isinstance(child, str):
            node.share[0] += len(child) - child.count(" ")
        elif child is not None:
            child.share = [0, 0, 0]
            child.before = node.last
            if child.before is not None:
                child.before.after = child
            node.last = child
            if not by_kind(child):
                stack.append((child, iter(child.children)))
        else:
            stack.pop()
            if node.tag == "a" and node.share[0]:
                node.share[1:] = node.share[0], max(1, node.share[2])
            if stack:
                up = stack[-1][0].share
                for i in range(3):
                    up[i] += node.share[i]


def linked(node: Node) -> bool:
    """Is half of an element's text or more inside links? An element without text counts as linked."""
    return 2 * node.share[1] >= node.share[0]


def scored(root: Node) -> dict[Node, float]:
    """Points of containers, discounted by the share of their text that is links.

    A paragraph is an element's run of own text and inline elements. It gives 1
    point, 1 for each comma and up to 3 for its length to its container; every
    container passes half of what it has got on to its parent, so a paragraph
    counts half for the next ancestor, a quarter for the one above, and so on.
    One pass from the leaves up: the work follows the size of the page, not its
    depth.
    """
    got: dict[Node, float] = {}

    def pay(owner: Node, text: str) -> None:
        text = " ".join(text.split())
        if text:
            to = owner.parent if owner.tag in ("p", "pre", *HEADINGS) and owner.parent is not None else owner
            got[to] = got.get(to, 0.0) + 1 + text.count(",") + text.count("、") + min(3.0, len(text) / 100)

    stack: list[tuple[Node, Iterator]] = [(root, iter(root.children))]
    runs: list[list[str]] = [[]]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK or not stack:
                pay(node, "".join(runs.pop()))
            if stack and node in got:
                up = stack[-1][0]
                got[up] = got.get(up, 0.0) + got[node] / 2
        elif isinstance(child, str):
            runs[-1].append(child)
        else:
            child.apart = beside(child, root.share[0])
            if child.apart:
                continue
            if child.tag in BLOCK:
                runs.append([])
            stack.append((child, iter(child.children)))
    return {x: (p + START.get(x.tag, 0.0)) * (1 - x.share[1] / max(1, x.share[0])) for x, p in got.items()}


def _with_others(article: Node) -> Node:
    """The article, or the main element around it if that holds another one."""
    up = article.parent
    while up is not None and up.tag != "main":
        up = up.parent
    todo = [] if up is None or article.tag == "main" else list(up.children)
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x is article or x.apart:
            continue
        if x.tag == "article" and not linked(x):
            return up
        todo += x.children
    return article


def main_text(html: str | None) -> str:
    """The blocks of the best container and its siblings, one a line; empty if a page has none.

    An article or main element around the best container is taken whole, but
    for what stands beside the article inside it. If a main element holds
    further articles, all of it is taken, so they come in page order; articles
    that are links for the most part, such as teasers, don't count there.
    """
    if not html:
        return ""
    root = parse(html)
    measure(root)
    points = scored(root)
    if not points:
        return ""
    best = max(points, key=points.__getitem__)
    x: Node | None = best
    while x is not None and x.tag not in ("article", "main"):
        x = x.parent
    if x is not None:
        return "\n".join(blocks(_with_others(x), apart))
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(blocks(best, apart))
    out: list[str] = []
    for s in best.parent.children:
        if isinstance(s, str) or apart(s):
            continue
        prose = s.tag in ("p", "pre", "blockquote") and 4 * s.share[1] < s.share[0]
        if s is best or s.tag in HEADINGS or prose or points.get(s, 0.0) >= max(4.0, 0.2 * points[best]):
            out += blocks(s, apart)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, the article's text, and its code points.

    Paragraphs pass points for length and commas up to their ancestors,
    discounted by the share of link text; the container with most, or the
    article around it, is kept with its siblings of comparable score. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, lists of
    links and reader comments take no part. Time and memory follow the length
    of a page.

    Defined cases: null or empty html gives an empty text; null ids and urls
    stay; repeated rows have a result each; unclosed and stray tags are mended;
    an empty table gives an empty result; further columns are not used.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
