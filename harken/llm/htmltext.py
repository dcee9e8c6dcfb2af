"""HTML extraction (operator 8): tree scoring.

The page becomes a tree (lenient: unclosed, crossed and cut-off tags are all right). Parts that are never main text are cut:
scripts, styles, forms, menus, page headers, footers, sidebars, notices, adverts and comment sections, by element, role or the words of
their class and id. A name made of such words alone (``comments``, ``cookie-bar``) cuts, unless that leaves no text; a name that has other words too
(``related-work``) cuts only what consists of links, or a short note outside the article. Every paragraph then passes points for its length and
its commas to its parent, half as much to each level above; a container's points are discounted by its link density. The text is all
that is left, in page order, of the best container's article, else of its main element, else of the page; lists of links go where no article
says what belongs to it, unless they follow the text of the best container, as references do. Siblings of an article that score well, read like prose or are its
headings go with it. A form that holds more text than all the rest of the page is its frame and stays; so does a titled header within a part that is named as a post.

Every pass visits each node once, so time grows with the page's length, whatever its depth.

Edge cases: null and empty pages, and pages without text, give an empty string; plain text without tags is one block;
repeated pages get a row each; an empty table gives an empty table; columns other than id, url and html are not read.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, roles and words of class or id that never hold main text.
NEVER = frozenset("head script style noscript template nav button select input textarea iframe object embed svg canvas dialog menu title link meta".split())
#: Elements that hold main text only where nothing else does, or, a header, inside an article.
RARELY = frozenset("header footer aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sidebar sidebars sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay promo promotion sponsor sponsored social share sharing related recommended comment comments commentlist disqus replies reply respond form newsletter subscribe subscription signup login search widget widgets toolbar pagination pager skip".split()
)
#: Words that say nothing about what a part holds; with a word of WORDS they leave its meaning as it is.
PLAIN_WORDS = frozenset(
    "section box list bar area block container wrapper wrap content inner outer panel module slot unit button buttons link links text left right top bottom site page global primary secondary main item items body thread message policy privacy col column row group holder zone region sticky fixed media icons count user users reader readers post posts article articles story stories".split()
)
HEADERS = frozenset("header masthead banner".split())
#: Words of the class of a part that is an article by name.
NAMED_ARTICLES = frozenset("article post story entry".split())
TITLES = frozenset("h1 h2 h3".split())
#: Words of the class of an article that make it no part of the main text.
OTHER_ARTICLES = frozenset("ad ads advert advertisement related recommended comment comments reply replies respond".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>"']|"[^"<]*"|'[^'<]*')*>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
PARAGRAPHS = frozenset("p pre td blockquote li".split())
#: Share of the best container's points that makes a sibling of the article part of the text.
SIBLING_SHARE = 0.2
#: Share of text in links from which a part is a list of links.
DENSE = 0.5
#: Characters that a page must keep after a cut by words, those of a part that may take their place, and those of a short note.
SOME_TEXT, REAL_TEXT, NOTE = 25, 140, 80
#: Characters of a block from which it is text that a list of links may belong to.
PROSE = 40
KEEP, CUT, DOUBT = 0, 1, 2


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "points", "mark", "inside", "chars", "linked", "links")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.points, self.mark, self.inside, self.chars, self.linked, self.links = 0.0, KEEP, False, 0, 0, 0
        self.kids: list[Node | str] = []

    def density(self) -> float:
        return self.linked / max(1, self.chars)

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]


def parse(page: str) -> Node:
    """The page as a tree."""
    root = Node("html", "", None)
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where in open_ each tag is open
    held: list[int] = []  # where in open_ blocks are open
    pos = 0

    def shut(place: int) -> None:
        while len(open_) > place:
            places[open_.pop().tag].pop()
        while held and held[-1] >= place:
            held.pop()

    def up_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the last open one of ``names``, unless one of ``stop`` was opened after it."""
        last = max((places[x][-1] for x in names if places.get(x)), default=0)
        if last > max((places[x][-1] for x in stop if places.get(x)), default=0):
            shut(last)

    def said(piece: str) -> None:
        if piece:
            open_[-1].kids.append(entities.unescape(piece) if "&" in piece else piece)

    for m in TAG.finditer(page):
        if m.start() < pos:
            continue
        said(page[pos : m.start()])
        pos, tag = m.end(), m.group()
        if tag[1] in "!?" or not tag.endswith(">"):
            continue
        name = NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if places.get(name):
                # a block that was opened inside an inline element outlives that element's end
                if name in BLOCKS or name == "a" or not held or held[-1] < places[name][-1]:
                    shut(places[name][-1])
            elif name == "p":
                open_[-1].kids.append(Node("p", "", open_[-1]))
            continue
        if name in CLOSES_P:
            up_to({"p"}, {"button", "table", "td", "th", "caption"})
        if name in SAME:
            up_to(SAME[name], SCOPE[name])
        if name == "a":
            up_to({"a"}, {"table", "td", "th", "caption"})
        if name == "body":
            shut(1)
        if name == "html":
            continue
        node = Node(name, tag, open_[-1])
        open_[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
            inner, pos = page[pos : end.start() if end else len(page)], end.start() if end else len(page)
            if name in ("textarea", "title") and inner:
                node.kids.append(entities.unescape(inner))
            if end:
                close = page.find(">", end.end())
                pos = len(page) if close < 0 else close + 1
        elif name not in VOID and not (tag.endswith("/>") and name not in BLOCKS):
            places.setdefault(name, []).append(len(open_))
            if name in BLOCKS:
                held.append(len(open_))
            open_.append(node)
    said(page[pos:])
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(node.attrs)} if "=" in node.attrs else {}


def hidden(node: Node, attrs: dict[str, str]) -> bool:
    if attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return "hidden" in node.attrs and re.search(r"\shidden[\s=/>]", node.attrs) is not None


def names(attrs: dict[str, str]) -> list[set[str]]:
    """The words of each name of class and id."""
    each = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return [set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) for name in each]


def heads_post(node: Node) -> bool:
    """Whether it stands right in a part that is named as an article and has a title among its first elements."""
    above = node.parent
    if above is None or above.tag not in ("div", "section") or not any(w & NAMED_ARTICLES and not w & WORDS for w in names(attributes(above))):
        return False
    first, stack = 0, node.nodes()
    while stack and first < 40:
        n = stack.pop(0)
        if n.tag in TITLES:
            return True
        first, stack = first + 1, stack + n.nodes()[:8]
    return False


def named(node: Node, attrs: dict[str, str]) -> int:
    """What the words of class and id say."""
    out = KEEP
    for parts in names(attrs):
        found = parts & WORDS
        if not found or found <= HEADERS and (node.inside or parts & {"article", "post", "story"} or heads_post(node)):
            continue
        sure = parts <= WORDS | PLAIN_WORDS and (node.tag != "article" or parts & OTHER_ARTICLES)
        out = CUT if sure else out or DOUBT
    return out


def judged(node: Node) -> int | None:
    """KEEP, CUT, DOUBT, or None for what goes whatever else the page holds."""
    if node.tag in NEVER:
        return None
    if node.tag in ("html", "body", "main"):
        return KEEP
    attrs = attributes(node)
    if hidden(node, attrs):
        return None
    role = attrs.get("role", "").lower()
    if node.tag in RARELY and not (node.tag == "header" and (node.inside or heads_post(node))) or role in ROLES and not (role == "banner" and node.inside):
        return CUT
    return named(node, attrs) if "class" in attrs or "id" in attrs else KEEP


def walk(root: Node) -> list[Node]:
    """All nodes, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.nodes())
    return out


def measure(root: Node) -> None:
    """Characters of text, those in links, and the links, below each node."""
    for n in reversed(walk(root)):
        n.chars = n.linked = n.links = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(SPACE.sub(" ", k).strip(" "))
            else:
                n.chars, n.linked, n.links = n.chars + k.chars, n.linked + k.linked, n.links + k.links
        if n.tag == "a":
            n.linked, n.links = n.chars, n.links + 1


def framing(node: Node) -> bool:
    """Whether it is a form, and no name says which: some pages are forms as a whole."""
    return node.tag == "form" and named(node, attributes(node)) == KEEP


def prune(root: Node) -> None:
    """Cuts what is no main text."""
    stack = [root]
    while stack:
        n = stack.pop()
        kept: list[Node | str] = []
        for k in n.kids:
            if not isinstance(k, str):
                k.inside = n.inside or n.tag in ("article", "main")
                mark = judged(k)
                if mark is None:
                    continue
                k.mark = mark
                stack.append(k)
            kept.append(k)
        n.kids = kept
    measure(root)

    def outermost(top: Node) -> list[Node]:
        found, stack = [], top.nodes()
        while stack:
            n = stack.pop()
            if n.mark == CUT:
                found.append(n)
            else:
                stack += n.nodes()
        return found

    plain = lambda n: n.chars - n.linked
    cut = outermost(root)
    left = plain(root) - sum(map(plain, cut))
    largest = max(cut, key=plain, default=root)
    while largest.mark == CUT and framing(largest) and plain(largest) >= REAL_TEXT and plain(largest) > left:
        largest.mark = KEEP
        cut = outermost(root)
        left = plain(root) - sum(map(plain, cut))
        largest = max(cut, key=plain, default=root)
    queue = [(-plain(n), i, n) for i, n in enumerate(cut)]
    heapq.heapify(queue)
    while left < SOME_TEXT and queue and -queue[0][0] >= REAL_TEXT:  # its name misleads: it holds the text
        n = heapq.heappop(queue)[2]
        n.mark = KEEP
        inner = outermost(n)
        left += plain(n) - sum(map(plain, inner))
        for k in inner:
            heapq.heappush(queue, (-plain(k), id(k), k))
    stack = [root]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not (k.mark == CUT or k.mark == DOUBT and (k.density() > DENSE or not k.inside and k.chars < NOTE))]
        stack += n.nodes()
    measure(root)


def score(root: Node) -> Node:
    """Gives each node its points; the best container. A paragraph's points go to its parent, half of them to each level above."""
    said: dict[int, tuple[int, int]] = {}  # characters and commas of the text that belongs to the node's own block
    order = walk(root)
    own: dict[int, float] = {}
    for n in reversed(order):
        chars = commas = 0
        blocks_in = False
        points = 0.0
        for k in n.kids:
            if isinstance(k, str):
                a, b = len(SPACE.sub(" ", k).strip(" ")), k.count(",")
            else:
                points += own.get(id(k), 0.0) + k.points / 2
                a, b = said.pop(id(k), (0, 0))
                blocks_in = blocks_in or k.tag in BLOCKS
            chars, commas = chars + a, commas + b
        n.points = points
        if n.tag not in BLOCKS and n is not root:
            said[id(n)] = (chars, commas)
        elif chars:
            worth = min(1.0, chars / 25) + commas + min(chars / 100, 3.0)
            if blocks_in or n is root:
                n.points += worth
            else:
                own[id(n)] = worth
    return max(order, key=lambda n: n.points * (1 - n.density()))


def blocks(roots: list[Node | str]) -> list[str]:
    """The text of each block, in page order, white space inside folded."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if line := SPACE.sub(" ", "".join(held)).strip(" "):
            out.append(line)
        held.clear()

    stack: list[tuple[Node | str, bool]] = [(r, False) for r in reversed(roots)]
    while stack:
        n, after = stack.pop()
        if isinstance(n, str):
            held.append(n)
        elif after:
            close()
        elif n.tag == "br":
            held.append(" ")
        else:
            if n.tag in BLOCKS:
                close()
                stack.append((n, True))
            stack += [(k, False) for k in reversed(n.kids)]
    close()
    return out


def prose(n: Node | str) -> bool:
    return not isinstance(n, str) and n.tag in BLOCKS and n.density() <= DENSE and n.chars >= PROSE


def belongs(n: Node, k: Node, before: bool, after: bool) -> bool:
    """Whether a dense part k of n goes with the text beside it: a list that follows text, or a paragraph with words between its links.

    In the page itself, where menus follow the text too, it must stand between text.
    """
    if not before or n.tag in ("html", "body") and not after:
        return False
    said = " ".join(x for x in k.kids if isinstance(x, str))
    return k.tag in ("ul", "ol", "dl") or k.tag == "p" and re.search(r"[^\W\d_]{2,}", said) is not None


def main_parts(root: Node) -> list[Node | str]:
    """The best container's article, main element or page, and the siblings that go with it, in page order."""
    prune(root)
    best = score(root)
    line = [best]
    while line[-1].parent is not None:
        line.append(line[-1].parent)
    articles = [n for n in line if n.tag == "article"]
    scope = articles[-1] if articles else next((n for n in line if n.tag == "main"), root)
    if not articles:
        holds = {id(n) for n in line}
        whole: set[int] = set()
        near = holds | {id(n) for n in walk(best)}  # the best container, what it holds and what holds it
        stack = [scope]
        while stack:
            n = stack.pop()
            at = [i for i, k in enumerate(n.kids) if prose(k)] if id(n) in near else []
            kept = []
            for i, k in enumerate(n.kids):
                dense = not isinstance(k, str) and id(k) not in holds and k.tag in BLOCKS and k.links > 1 and k.density() > DENSE
                if not dense or at and belongs(n, k, at[0] < i, i < at[-1]):
                    kept.append(k)
                    whole |= {id(x) for x in walk(k)} if dense else set()
            n.kids = kept
            stack += [k for k in n.nodes() if id(k) not in whole]
    if scope.parent is None:
        return [scope]
    top, before, parts = best.points * (1 - best.density()), True, []
    for k in scope.parent.nodes():
        if k is scope:
            parts.append(k)
            before = False
        elif k.density() < DENSE / 2 and (
            k.points * (1 - k.density()) >= max(1.0, SIBLING_SHARE * top) or k.tag in PARAGRAPHS and k.chars > NOTE or before and k.tag in ("h1", "h2")
        ):
            parts.append(k)
    return parts


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_parts(parse(page)))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    pages = pages.select(id_col, url_col, html_col)
    bounded_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
