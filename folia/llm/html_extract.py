"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements.  Menus, headers, footers, side
bars, adverts, forms and reader comments are cut by element, role or name.
Every remaining block of text gives points for length and commas to its
ancestors, fewer with each level; an ancestor's points are discounted by the
share of its text that stands in links.  The best ancestor is kept, with the
siblings that score well or read like a paragraph.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
RAW = tuple("script style title noscript template textarea select iframe svg math object canvas audio video button".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
TAG = re.compile(r"</?[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I | re.A)
VOID = frozenset("hr area base br col embed img input link meta param source track wbr".split())
CUT_TAGS = frozenset("head nav aside footer form dialog menu fieldset search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|header|login|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|popup|promo|promos|promobox|promotional|related|replies|respond|share|sharing|"
    r"side-?bar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: A promotion is cut as the thing itself, not as what an article is about.
PROMOTION = re.compile(r"(?:^|[_-])promotions?(?:$|[_-](?:area|banner|bar|block|box|links?|unit|widget)(?:$|[_-]))", re.I)
#: Names of reader comments, and one that papers give to a section of their own.
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|reactions|responses)(?:$|[\s_-])", re.I)
DISCUSSION = re.compile(r"(?:^|[_-])discussions?(?:$|[_-])", re.I)
PAPER = re.compile(r"""\b(?:id|class)\s*=\s*["']?(?:abstract|introduction|methods?|materials-and-methods|results|conclusions?)\b""", re.I)
#: Names that say what a block lacks or shows, names of layout, and names of an article's own parts.
ABOUT = re.compile(r"(?:no|has|with|without|is|hide|show)[-_]", re.I)
LAYOUT = frozenset("article body container content entry hentry layout main page post story wrapper".split())
OWN_PART = re.compile(r"(?:article|content|entry|page|post|story)[-_]?(?:header|footer|banner)", re.I)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BASE = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}


#: Levels up to which a block's points pass, and up to which an item's end may be implied.
LEVELS, IMPLIED = 16, 64
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is cut: by names, elements and roles; by elements, roles and names of comments; by PARTS and names of comments.
ALL, FEWER, LEAST = 2, 1, 0
PARTS = frozenset("head nav aside footer menu search".split())
#: Characters that a page's text needs to count as an article where names didn't decide.
PROSE = 140


class Node:
    __slots__ = ("tag", "parent", "cut", "points", "chars", "linked", "depth", "scored", "kept", "article")

    def __init__(self, tag, parent, cut):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.points, self.chars, self.linked, self.scored, self.kept = 0.0, 0, 0, False, False
        self.depth = parent.depth + 1 if parent else 0
        self.article = (parent if parent.tag == "article" else parent.article) if parent else None


def tokens(page: str):
    """(start, end, closing, tag, attributes) of the page's markup in order; the tag is None for what is no element.

    Raw elements come as one token with their content.  One that closes itself
    ends there, one that nothing closes ends at the next block.  Every byte is
    looked at a bounded number of times: what a search did not find in the rest
    is not sought again, and once quotes are seen not to match they count no more.
    """
    missing: set[str] = set()
    quotes = True

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        k = page.find(what, at)
        if k < 0:
            missing.add(what)
        return k

    def tag_end(at: int) -> int:
        while quotes:
            m = TAG_STOP.search(page, at)
            if m is None:
                return -1
            if m[1] is None:
                return m.end()
            close = find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return find(">", at) + 1 or -1

    at = 0
    while (k := page.find("<", at)) >= 0:
        if page.startswith("<!--", k):
            short = page.startswith((">", "->"), k + 4)
            e = page.find(">", k) + 1 if short else find("-->", k + 4) + 3
            at = e if short or e > 2 else len(page)
            yield k, at, False, None, ""
            continue
        if page.startswith("<![CDATA[", k) and (e := find("]]>", k)) >= 0:
            at = e + 3
            yield k, at, False, None, ""
            continue
        m = TAG.match(page, k)
        if m is None:
            if not page.startswith(("<!", "<?", "</"), k):
                at = k + 1
                continue
            e = find(">", k) + 1
            if not e:
                return
            at = e
            yield k, at, False, None, ""
            continue
        e = tag_end(m.end())
        if e < 0 and quotes:
            quotes = False
            e = tag_end(m.end())
        if e < 0:
            return
        closing = page[k + 1] == "/"
        tag = m[0].lstrip("</").lower()
        attributes = page[m.end() : e - 1]
        at = e
        if tag in RAW_END and not closing and not attributes.endswith("/"):
            close = None if "</" + tag in missing else RAW_END[tag].search(page, e)
            if close:
                at = find(">", close.end()) + 1 or len(page)
            else:
                missing.add("</" + tag)
                block = BLOCK_TAG.search(page, e)
                at = block.start() if block else len(page)
        yield k, at, closing, tag, attributes


def unwanted(names: str, paper: bool) -> bool:
    """Whether class names or an id tell of a menu, an advert and the like."""
    cut = False
    for name in names.split():
        if name.lower() in LAYOUT:
            return False
        named = CUT_NAMES.search(name) or PROMOTION.search(name) or COMMENT_NAMES.search(name) or not paper and DISCUSSION.search(name)
        cut = cut or bool(named) and not ABOUT.match(name) and not OWN_PART.search(name)
    return cut


def is_cut(tag: str, attributes: str, node: Node, level: int, paper: bool) -> bool:
    if tag in (PARTS if level == LEAST else CUT_TAGS) or tag == "header" and node.article is None:
        return True
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if unwanted(value, paper) if level == ALL else COMMENT_NAMES.search(value):
                    return True
            if level == LEAST:
                continue
            if name == "role" and value.lower() in CUT_ROLES or name == "hidden" and value.lower() != "until-found":
                return True
            if level == ALL and (name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden",
                value, re.I)):
                return True
    return False


def text_blocks_of(page: str, level: int = ALL) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """(owner, text, characters in links) of every block outside what is cut, in page order; and all nodes, parents first."""
    root = Node("#root", None, False)
    here, links, at = root, 0, 0
    nodes, open_ = [root], {}
    parts: list[str] = []
    linked: list[str] = []
    blocks: list[tuple[Node, str, int]] = []
    paper = bool(PAPER.search(page))

    def flush():
        if parts:
            if not here.cut:
                text = " ".join("".join(parts).split())
                if text:
                    blocks.append((here, text, len(" ".join("".join(linked).split()))))
            parts.clear()
            linked.clear()

    def say(piece: str):
        if piece and not here.cut:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked.append(piece)

    def up_to(node: Node):
        """Close everything inside ``node``, and it."""
        nonlocal here
        while here is not node:
            open_[here.tag] -= 1
            here = here.parent
        open_[node.tag] -= 1
        here = node.parent

    for start, end, closing, tag, attributes in tokens(page):
        say(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in BLOCK:
            flush()
            if closing:
                if open_.get(tag):
                    node = here
                    while node.tag != tag:
                        node = node.parent
                    up_to(node)
                continue
            if open_.get("head") and tag not in ("head", "html"):
                node = here
                while node.tag != "head":
                    node = node.parent
                up_to(node)
            if tag in CLOSES:
                node, steps = here, 0
                while node.tag not in ("ul", "ol", "dl", "table", "#root", "menu") and steps < IMPLIED:
                    inner, node, steps = node, node.parent, steps + 1
                    if inner.tag in CLOSES[tag]:
                        up_to(inner)
                        if tag != "tr":
                            break
            elif here.tag == "p" or here.tag in HEADINGS and tag in HEADINGS:
                up_to(here)
            if tag not in VOID:
                here = Node(tag, here, here.cut)
                here.cut = here.cut or is_cut(tag, attributes, here, level, paper)
                nodes.append(here)
                open_[tag] = open_.get(tag, 0) + 1
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
    say(page[at:])
    flush()
    return blocks, nodes


def without_inner_articles(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """Blocks without articles inside an article that has as much text of its own: those are comments on it."""
    own: dict[Node, int] = {}
    inner: dict[Node, int] = {}
    for owner, text, _ in blocks:
        article = owner if owner.tag == "article" else owner.article
        if article is not None:
            own[article] = own.get(article, 0) + len(text)
            if article.article is not None:
                inner[article.article] = inner.get(article.article, 0) + len(text)
    late = {a for a in own if a.article is not None and own.get(a.article, 0) >= inner[a.article]}
    if not late:
        return blocks
    gone: set[Node] = set()
    for node in nodes:
        if node in late or node.parent in gone:
            gone.add(node)
    return [b for b in blocks if b[0] not in gone]


def best_and_siblings(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> list[str]:
    """The texts of the container with the most points and of its siblings that belong to it."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node = owner.parent if owner.tag in HEADINGS or owner.tag in ("p", "li", "pre", "td", "blockquote", "dd", "dt") else owner
        for level in range(LEVELS):
            if node.parent is None:
                break
            if not node.scored:
                node.scored = True
                node.points += BASE.get(node.tag, 0.0)
            node.points += points / (1, 2, 6, 9)[min(level, 3)] if level < 4 else points / (3 * level)
            node = node.parent
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    final = {n: n.points * (1 - n.linked / n.chars if n.chars else 1) for n in nodes if n.scored}
    if not final:
        return [text for _, text, _ in blocks]
    best = max(final, key=lambda n: (final[n], -n.depth))
    node = best
    while node is not None:  # an article's other parts belong to it
        if node.tag in ("article", "main"):
            best = node
        node = node.parent
    bar = max(10.0, final.get(best, 0.0) * 0.2)
    for n in nodes:
        n.kept = n is best or n.parent is not None and n.parent.kept or n.parent is best.parent and n in final and final[n] >= bar and n.tag not in ("ul", "ol", "dl")
    reads = lambda owner, text, linked: (
        owner.parent is best.parent and owner.tag == "p" and linked < len(text) / 4 and (len(text) > 80 or linked == 0 and text.rstrip()[-1:] in ".!?"))
    return [text for owner, text, linked in blocks if owner.kept or reads(owner, text, linked)]


def reads_as_prose(blocks: list[tuple[Node, str, int]]) -> bool:
    chars, linked = sum(len(text) for _, text, _ in blocks), sum(n for _, _, n in blocks)
    return chars >= PROSE and linked < 0.3 * chars and any(mark in text for _, text, _ in blocks for mark in ".!?,")


def main_text(page: str) -> str:
    """The main text of one page, blocks joined by an empty line; '' if there is none.

    Where what is cut leaves nothing, names but those of comments cut no more,
    and then roles and forms don't, if what they hold reads as prose.
    """
    for level in (ALL, FEWER, LEAST):
        blocks, nodes = text_blocks_of(page, level)
        if blocks and (level == ALL or reads_as_prose(blocks)):
            return "\n\n".join(best_and_siblings(without_inner_articles(blocks, nodes), nodes))
    return ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    Other columns are ignored.  A null or empty page, or one without text, gives
    an empty text.  Character references are decoded, white space inside a block
    becomes one space.  Rows are independent: repeated rows and nulls in the
    other columns pass through.  An empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
