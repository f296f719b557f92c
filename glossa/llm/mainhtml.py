"""Main text of web pages by scoring the element tree.

A page is cut into tags and text, and a light element tree is built with the implied ends that pages rely on (paragraphs,
list items, table cells); end tags without a start are passed over, what is open at the end of a cut page is closed. Menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go with all they hold, told by
their element or by a word of their class, id or role. Every run of text inside a block then passes points for its length
and its commas to the containers above it: all to the nearest, half to the next, less further up. A container's points are
discounted by the share of its text that stands in links, and its element counts for or against it. The best container is
kept with those of its siblings that score near it or are prose; where sibling paragraphs lie beside it they are kept too.

Defined results: a null or empty page, and one without text outside of what goes, gives an empty text; blocks are runs of text
between block elements, with white space as one space, joined by a line feed in page order; every row gives a row, repeated
or not. Pages are whole: nothing in them is cut off.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp plaintext".split())
#: Elements whose start and end part runs of text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements that go with all they hold.
DROPPED = set("aside button canvas dialog embed fieldset footer form frameset head header iframe input label map menu nav noembed noframes noscript object option script search select style svg template textarea title audio video".split())
#: Words of a class, id or role that tell the same.
DROPPED_WORDS = set(
    "ad ads adbox adsense adslot adunit advert adverts advertisement advertising advertorial alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer gdpr header login masthead menu menubar menuitem modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toc toolbar widget widgets".split()
)
#: Elements that hold the page or its article, whatever they are called; an article goes only if it is one of these.
HOLDERS = set("html body article main".split())
DROPPED_ARTICLES = set("ad advert advertisement comment promo promoted related reply sponsored".split())
WORTH = {"article": 30, "main": 25, "section": 5, "div": 3, "blockquote": 3, "td": 3, "li": -3, "dd": -3}
#: Elements that pass points on and get none: those that hold one text run, and the frames of lists and tables.
PASSING = set("p h1 h2 h3 h4 h5 h6 pre figcaption caption th dt summary".split())
FRAMES = set("ul ol dl menu dir table thead tbody tfoot tr".split())
GOOD_WORDS = set("article articlebody body content entry hentry main page post story text blog prose".split())
#: Points a text run has from the start, the most for its length, and the levels that share them.
BASE, MOST, CHARS, DEPTH = 1.0, 3, 100, 5
#: A sibling stays with this share of the best one's points; a sibling paragraph with so many characters or a full stop.
SIBLING, PROSE = 0.2, 80

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}


class Node:
    __slots__ = ("tag", "parent", "items", "words", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, words: frozenset = frozenset()):
        self.tag, self.parent, self.words = tag, parent, words
        self.items: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = 0


def _words(attributes: str) -> frozenset:
    """The words of class, id and role, parted at signs and at capitals, and each name whole."""
    out = set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in html.unescape(a or b or c).split():
            out.add(name.lower())
            out.update(w.lower() for w in _WORD.findall(name))
    return frozenset(out)


def tree(page: str) -> Node:
    root = open_ = Node("#page", None)
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            open_.items.append(page[at:])
            break
        if found.start() > at:
            open_.items.append(page[at : found.start()])
        at = found.end()
        if end := found[1]:
            open_ = _ended(open_, end.lower())
        elif found[2]:
            tag, attributes = found[2].lower(), found[3] or ""
            open_ = _begun(open_, tag)
            node = Node(tag, open_, _words(attributes) if "=" in attributes else frozenset())
            open_.items.append(node)
            if tag in RAW:  # up to its own end, whatever stands between
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag not in DROPPED:
                    node.items.append(page[at : close.start() if close else len(page)])
                at = close.end() if close else len(page)
            elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK and tag in {"svg", "path", "use"}):
                open_ = node
    return root


def _begun(node: Node, tag: str) -> Node:
    """The element that a new one of this tag goes into, after what its start ends."""
    if tag in BLOCK:  # a paragraph ends at the next block
        up = node
        while up.parent and up.tag not in BLOCK:
            up = up.parent
        if up.tag == "p" or (up.tag in {"h1", "h2", "h3", "h4", "h5", "h6"} and tag in {"h1", "h2", "h3", "h4", "h5", "h6"}):
            node = up.parent
    if tag in _ENDS:
        ended, within = _ENDS[tag]
        up, last = node, None
        while up.parent and up.tag not in within:
            if up.tag in ended:
                last = up
            up = up.parent
        if last:
            node = last.parent
    return node


def _ended(node: Node, tag: str) -> Node:
    """What stays open after an end tag; one of an inline element doesn't end a block."""
    up = node
    while up.parent:
        if up.tag == tag:
            return up.parent
        if tag not in BLOCK and up.tag in BLOCK:
            return node
        up = up.parent
    return node


def _in_article(node: Node) -> bool:
    up = node.parent
    while up and up.tag not in {"article", "main"}:
        up = up.parent
    return bool(up)


def _holds_article(node: Node) -> bool:
    todo = [node]
    while todo:
        for x in todo.pop().items:
            if not isinstance(x, str):
                if x.tag in {"article", "main"} and not _goes(x):
                    return True
                todo.append(x)
    return False


def _goes(node: Node) -> bool:
    if node.tag in HOLDERS:
        return node.tag == "article" and not node.words.isdisjoint(DROPPED_ARTICLES)
    named = node.words & DROPPED_WORDS
    if (node.tag in {"header", "label"} or named == {"header"}) and _in_article(node):
        return False  # an article's own header is part of it
    # A wrapper may be called after what it doesn't have.
    return node.tag in DROPPED or bool(named) and not _holds_article(node)


def prune(node: Node) -> None:
    """Takes out what goes, without recursion: trees of damaged pages may be deep."""
    todo = [node]
    while todo:
        here = todo.pop()
        here.items = [x for x in here.items if isinstance(x, str) or not _goes(x)]
        todo += [x for x in here.items if not isinstance(x, str)]


def runs(node: Node) -> list[tuple[str, Node, int]]:
    """The text blocks below a node in page order: (text, the element that holds it, characters of it in links)."""
    out: list[tuple[str, Node, int]] = []
    parts: list[str] = []
    state = [node, 0]

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, state[0], min(state[1], len(text))))
        parts.clear()
        state[1] = 0

    todo: list[tuple] = [(node, iter(node.items), node, False)]
    while todo:
        here, items, block, link = todo[-1]
        for x in items:
            if isinstance(x, str):
                parts.append(x)
                state[0] = block
                if link:
                    state[1] += len(x.strip())
            elif x.tag == "br":
                parts.append(" ")
            else:
                inner = x.tag in BLOCK
                if inner:
                    close()
                todo.append((x, iter(x.items), x if inner else block, link or x.tag == "a"))
                break
        else:
            todo.pop()
            if here.tag in BLOCK:
                close()
    close()
    return out


def score(blocks: list[tuple[str, Node, int]]) -> list[Node]:
    """The containers that got points, with their points before the discount, their characters and those in links."""
    seen: dict[int, Node] = {}
    for text, block, linked in blocks:
        points = BASE + text.count(",") + text.count("，") + text.count("、") + min(len(text) // CHARS, MOST)
        alone = block.tag in PASSING or block.tag in {"td", "li", "dd"}  # what stands in a cell or item itself belongs to what holds the list
        up, level = block.parent if alone and block.parent else block, 0
        while up:
            if up.tag in FRAMES:
                up = up.parent
                continue
            if level < DEPTH:
                if id(up) not in seen:
                    seen[id(up)] = up
                    up.score = float(WORTH.get(up.tag, 0)) + (25 if not up.words.isdisjoint(GOOD_WORDS) and up.tag not in {"html", "body"} else 0)
                up.score += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
        up = block
        while up:
            up.chars += len(text)
            up.linked += linked
            up = up.parent
    return list(seen.values())


def _final(node: Node) -> float:
    return node.score * (1 - node.linked / node.chars) if node.chars else 0.0


def _sibling_stays(node: Node, best: Node, least: float) -> bool:
    if node.score and _final(node) >= least:
        return True
    if best.tag in {"article", "main"}:
        return False
    if node.tag == "p" or (node.score and node.words and node.words == best.words):
        density = node.linked / node.chars if node.chars else 1.0
        text = " ".join(t for t, _, _ in runs(node))
        return density < 0.25 and len(text) > PROSE or not node.linked and bool(re.search(r"[.!?。！？](?:\s|$)", text))
    return False


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    prune(root)
    blocks = runs(root)
    if not blocks:
        return ""
    held = score(blocks)
    best = max(held, key=_final)
    # Several articles of one page: what holds them all is the main text.
    if best.tag not in HOLDERS and best.parent and best.parent.tag in {"article", "main"}:
        best = best.parent
    if not best.parent or best.tag in {"#page", "html", "body"}:
        return "\n".join(t for t, _, _ in runs(best))
    least = max(10.0, SIBLING * _final(best))
    out = []
    for x in best.parent.items:
        if not isinstance(x, str) and (x is best or _sibling_stays(x, best, least)):
            out += [t for t, _, _ in runs(x)]
    return "\n".join(out)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches):
    for batch in common.parts(batches, 200):
        texts = [main_text(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page. A map over rows; nothing is shuffled."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)
