"""Main text of HTML pages by tree scoring.

A page is read into a tree of elements (void elements, implied ends of p, li, dt,
dd, tr, td and th, raw script and style). Each paragraph earns points for its length
and commas; its parent gets them whole, its grandparent half, and every further
ancestor half of what the one below it got. A container's points are discounted by
the share of its text that stands in links. The best container is kept, widened to
the article element that holds it, with those siblings that score near it or are
plain prose. Boilerplate elements (menus, headers, footers, asides, forms, adverts,
notices, comments) are cut before anything is scored. Inside an article headings and
paragraphs are never cut by their class or id, boxes only by a name that says nothing
else, and lists of links only if they are named like a menu. Reading and scoring take
time in proportion to the page, however deep its elements are nested.

Defined results: null or empty html gives an empty text; pages cut off anywhere are
read as far as they go, an unfinished tag at the end counts as markup; a page
without a scored paragraph gives what text its body has outside boilerplate.
Nothing is capped; repeated rows give equal results, extra columns stay out.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bracketry.llm.common import ship, table

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|$)", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# HTML elements by their part in the text.
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
CUT = frozenset("nav footer aside form button select option dialog menu head input label fieldset audio video canvas".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body h1 h2 h3 h4 h5 h6 figcaption".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body main blockquote".split())
# Words of class, id and role that mark boilerplate, and words that speak against it.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies disqus discussion footer foot gdpr consent header masthead menu modal nav navbar "
    "navigation newsletter notice notification notifications pager pagination paywall popup promo promoted promotion related recommended recommendations replies reply respond search share sharing shares sidebar sidebars sidenav skip social sponsor sponsored subscribe subscription "
    "toc toolbar topbar tracking widget widgets signup login outbrain taboola dialog alert reactions".split()
)
CONTENT = frozenset("article body content entry main post story text maincontent".split())
# Raw elements that may lack an end and those that may end themselves; inside an article, the elements that a class, role or id may cut, the ids that may, words that say nothing beside another, and names that mark a list of links as a menu.
OPEN_ENDED, FOREIGN = frozenset("object svg math".split()), frozenset("svg math".split())
CONTAINERS = frozenset("div section ul ol dl ins center".split())
BOX_IDS = frozenset("ad ads comments disqus nav navbar newsletter outbrain share sidebar taboola toc".split())
FURNITURE = frozenset("area articles bar block bottom box button buttons col column container content count desktop end float group holder icon icons inline inner item items large left link links list mobile outer panel posts primary right row section slot small stories strip thread toggle top unit wrap wrapper x zone".split())
MENUS = frozenset("breadcrumb breadcrumbs links menu menubar nav navbar navigation pager pagination related share social tabs tags toc".split())
#: A kept sibling has this share of the best score; prose has this length and at most this link density.
SIBLING_SHARE, PROSE_LENGTH, PROSE_LINKS = 0.2, 80, 0.25
#: A list or division inside the article that is named like a menu is one if more of its text than this is links.
MENU_LINKS = 0.6


class Node:
    __slots__ = ("chars", "children", "commas", "cut", "in_article", "in_main", "linked", "menu", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, cut: bool, menu: bool = False):
        self.tag, self.parent, self.cut, self.menu = tag, parent, cut, menu
        self.in_article = tag == "article" or parent is not None and parent.in_article
        self.in_main = tag == "main" or parent is not None and parent.in_main
        self.children: list[Node | str] = []
        self.chars = self.linked = self.commas = 0
        self.score = 0.0


def words_in(name: str) -> set[str]:
    """The words of a class, id or role: parts between other characters than letters, and of camel case."""
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}


def says_only(names: str, marks: frozenset[str]) -> bool:
    """Whether one of the names has a word of marks, and besides such words only furniture."""
    return any(own & marks and own <= marks | FURNITURE for own in map(words_in, names.split()))


def boilerplate(tag: str, attributes: str, inside_article: bool, inside_main: bool) -> bool:
    """Whether an element is cut by its name or by what its class, id or role say. Inside an article or main only containers are cut by these: by a class or role that says nothing else (a section by a whole one), a box by a whole id of BOX_IDS."""
    if tag in CUT or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    within = (inside_article or inside_main) and tag not in ("article", "main")
    words: set[str] = set()
    for name, *values in NAMED.findall(attributes):
        value, name = "".join(values), name.lower()
        low = value.lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "style" and re.search(r"display\s*:\s*none", low)):
            return True
        if not within:
            words |= words_in(value) if name in ("class", "id", "role") else set()
        elif tag in CONTAINERS and name == "id":
            if low.strip() in BOX_IDS:
                return True
        elif tag in CONTAINERS and name in ("class", "role") and (bool(set(low.split()) & BOILERPLATE) if tag == "section" else says_only(value, BOILERPLATE)):
            return True
    if within:
        return False
    return bool(words & BOILERPLATE) and not (words & CONTENT and tag in ("article", "main", "body")) and tag not in ("article", "main") or (tag == "article" and bool(words & {"comment", "comments", "reply"}))


def menu_named(attributes: str) -> bool:
    """Whether a class, id or role names a menu and nothing else."""
    return any(name.lower() in ("class", "id", "role") and says_only("".join(values), MENUS) for name, *values in NAMED.findall(attributes))


def parse(html: str) -> Node:
    """The page's element tree; text is decoded. Open elements are a stack, with the places of each tag and of the blocks in it, so no tag makes the reader walk up the tree."""
    root = Node("#root", None, False)
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}
    block_places: list[int] = []
    endless: set[str] = set()
    at, n = 0, len(html)

    def end_from(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().tag].pop()
            if block_places and block_places[-1] == len(stack):
                block_places.pop()

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or ""
        if not tag:
            continue
        if closing:
            # an inline end doesn't reach beyond a block
            if (own := places.get(tag)) and (tag in BLOCKS or not block_places or block_places[-1] < own[-1]):
                end_from(own[-1])
            continue
        ends_itself = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not (ends_itself and tag in FOREIGN) and tag not in endless:
                if end := re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(html, at):
                    at = end.end()
                elif tag in OPEN_ENDED:
                    endless.add(tag)
                else:
                    at = n
            continue
        if tag in BLOCKS:
            # a block ends an open p; li, dt, dd, tr, td and th end their like
            ends, k = ENDS_BEFORE.get(tag, frozenset()), len(block_places)
            while k and ((open_tag := stack[block_places[k - 1]].tag) == "p" or open_tag in ends):
                k -= 1
            if k < len(block_places):
                end_from(block_places[k])
        node = stack[-1]
        if tag in VOID:
            node.children.append(Node(tag, node, tag in CUT) if tag == "hr" else "\n" if tag == "br" else "")
            continue
        child = Node(tag, node, boilerplate(tag, attributes, node.in_article, node.in_main), bool(attributes) and menu_named(attributes))
        node.children.append(child)
        if not ends_itself or tag in BLOCKS:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                block_places.append(len(stack))
            stack.append(child)
    return root


def walk(root: Node):
    """Uncut elements in page order, each before its children."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)


def measure(root: Node) -> list[Node]:
    """Fill chars, linked and commas; returns the elements in page order."""
    nodes = list(walk(root))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
                node.commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.cut:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.chars
    return nodes


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def own_prose(node: Node) -> bool:
    """Whether text stands in the element itself or in inline elements right below it."""
    return any(c.strip() if isinstance(c, str) else c.tag not in BLOCKS and not c.cut and c.chars for c in node.children)


def kept(root: Node) -> list[Node]:
    """The best container and those siblings that belong to it, in page order."""
    nodes = measure(root)
    for node in reversed(nodes):
        # what the children passed is there: half of it goes on, with the element's own points
        points = 0.0
        if node.tag in PARAGRAPHS and node.chars >= 25 and own_prose(node):
            points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - density(node))
        if node.parent is not None:
            node.parent.score += points + node.score / 2
        if node.tag not in ("p", "li", "td", "dd"):
            node.score += points
    scored = [n for n in nodes if n.tag in BLOCKS and n.tag not in ("html", "p") and n.score]
    if not scored:
        return [next((n for n in nodes if n.tag == "body"), root)]
    best = max(scored, key=lambda n: n.score * (1 - density(n)))
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
        up = up.parent
    if best.tag == "body" or best.parent is None:
        return [best]
    least = max(10.0, SIBLING_SHARE * best.score * (1 - density(best)))
    out = []
    for c in best.parent.children:
        if isinstance(c, Node) and not c.cut:
            prose = c.tag == "p" and density(c) < PROSE_LINKS and (c.chars >= PROSE_LENGTH or c.commas)
            if c is best or prose or (c.tag in ("div", "section", "article", "main", "blockquote") and c.score * (1 - density(c)) >= least):
                out.append(c)
    return out


def blocks(node: Node) -> list[str]:
    """The texts of the element's blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.cut:
            if x is not node and x.menu and x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.chars and density(x) > MENU_LINKS:
                end()
                continue
            block = x.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(x.children))
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(b for node in kept(parse(html)) for b in blocks(node))


def extract(html: Column) -> Column:
    """The main text of each whole page."""

    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return F.arrow_udf(extracted, T.StringType())(html)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text in column `text`."""
    ship(pages.sparkSession)
    return pages.withColumn(text, extract(F.col(html)))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
