"""Main text of web pages by tree scoring.

Every paragraph of the element tree passes points to the LEVELS elements around it: one, plus
one per comma, plus one per hundred characters, discounted by the share of its
characters that are link text; its parent gets all of them, the next one up half, the
following ones a third and less. The element with the most points is the container. It grows to the article or main element around it if it
holds at least half of that one's points, or if what else that one holds scores as well; otherwise
siblings with a good share of its points or with plain paragraph text are kept with it.

Menus, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, by element and by the
words of class, id and role. Headers, related boxes and the like (MAYBE) are left out outside the container; inside, only if LINKED of
their characters are links. A box with a word of the layout that holds most points of the page is the page's wrapper, and its word is ignored.
Lists and boxes that are almost only links are menus where the whole page is the container, and beside a container; inside one they are its lists of sources.
Articles beside a chosen article that have a good share of its points belong to it.

A page is parsed and scored by itself, in one pass over the table without a shuffle, in time proportional to its elements.

Defined results: null, empty or text-free html gives an empty text; broken markup is
repaired as browsers do where it matters (unclosed p, li, b; stray end tags); repeated rows
give a row each; of elements with equal points the first in page order is the container; very long and very deep pages are read whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import string_column

# Fixed values of HTML: elements without content, elements that are blocks, what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table td th body html article section div main aside nav header footer form".split())
# Elements that are never part of an article.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input option iframe object embed svg canvas dialog menu audio video search".split())
# Words of class, id or role that mark such parts.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion
    breadcrumb breadcrumbs pager pagination notice notices cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login comment comments commentlist disqus respond responses contentinfo complementary skip""".split())
# Words of the layout and of readers' parts, which a wrapper of the whole page may bear too.
LAYOUT = frozenset("nav navbar navigation menu footer sidebar aside toolbar review reviews feedback discussion reply replies".split())
# Words that mark such parts outside the container; inside it, links decide.
MAYBE = frozenset("header masthead banner side alert share sharing social related recommended recommendations search widget widgets".split())
#: A box of MAYBE inside the container goes if at least this share of its characters is link text.
LINKED = 0.5
#: A list or box is a menu if at least this share is.
MENU = 0.8
#: Elements around a paragraph that get points.
LEVELS = 10
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "mark", "points", "below", "chars", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, mark: int = 0):
        self.tag, self.parent, self.dropped, self.mark = tag, parent, dropped, mark
        self.children: list[Node | str] = []
        self.points = self.below = 0.0
        self.chars = self.linked = self.links = 0


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """3: left out by its words or because it is hidden; 2: left out unless it holds most of the page; 1: left out outside the container."""
    mark = int(tag == "header")
    if tag in ("body", "html", "article", "main"):
        names = ("class", "id") if tag == "article" else ()
    else:
        names = ("class", "id", "role")
    for name, value in attrs:
        if name in names and value:
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            mark = max(mark, 3 if not MARKS.isdisjoint(words) else 2 if not LAYOUT.isdisjoint(words) else 1 if not MAYBE.isdisjoint(words) else 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
            return 3
    return 0 if tag == "article" and mark == 2 else mark  # an article may be a review


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("html", None, False)
        self.count: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._close(("p",), stop_at=SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], stop_at=frozenset(("ul", "ol", "dl", "table", "menu", "select")))
        node = Node(tag, self.open, self.open.dropped or tag in DROPPED, _mark(tag, attrs))
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tags: tuple[str, ...], stop_at: frozenset = frozenset()) -> None:
        if not any(self.count[tag] for tag in tags):
            return
        node, passed = self.open, []
        while node.parent is not None and node.tag not in stop_at:
            passed.append(node.tag)
            if node.tag in tags:
                self.open = node.parent
                self.count.subtract(passed)
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            self.open = self.root
            self.count.clear()
        elif tag not in VOID:
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        if not self.open.dropped:
            self.open.children.append(data)


def _in_order(root: Node) -> list[Node]:
    """All elements, parents first."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def _measure(nodes: list[Node]) -> None:
    """Characters, link characters and links below every element."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in node.children)
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        else:
            node.linked = sum(c.linked for c in node.children if isinstance(c, Node))
            node.links = sum(c.links for c in node.children if isinstance(c, Node))


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(nodes: list[Node]) -> None:
    """Paragraphs, and other blocks with text of their own, pass points up; ``below`` has all points under an element."""
    for node in nodes:
        if node.dropped or not node.chars or node.tag not in BLOCKS:
            continue
        own = [c for c in node.children if isinstance(c, str) or c.tag not in BLOCKS]
        text = "".join(_flat(c) for c in own).strip()
        if not text:
            continue
        points = (1 + text.count(",") + len(text) / 100) * (1 - _density(node))
        node.below += points
        above = node.parent
        for level in range(1, LEVELS + 1):
            if above is None:
                break
            above.points += points / (level if level < 3 else 3 * (level - 1))
            above = above.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.below += node.below


def _drop_marked(nodes: list[Node]) -> None:
    """Drop what is marked, and what lies in it, but for wrappers of most of the page."""
    most = nodes[0].below / 2
    for node in nodes:
        node.dropped = node.dropped or node.mark == 3 or (node.mark == 2 and node.below <= most) or (node.parent is not None and node.parent.dropped)


def _flat(part: Node | str) -> str:
    if isinstance(part, str):
        return part
    out, waiting = [], [part]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.dropped:
            waiting.extend(reversed(node.children))
    return "".join(out)


def _is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links >= 2 and _density(node) >= MENU


def _blocks(tops: list[Node], menus: bool) -> list[str]:
    """Texts of the blocks below ``tops``, in page order; with ``menus``, what looks like one is left out."""
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    waiting: list[Node | str | None] = list(reversed(tops))
    while waiting:
        part = waiting.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            current.append(part)
        elif part.tag == "br":
            current.append(" ")
        elif not part.dropped and not (menus and _is_menu(part)):
            if part.tag in BLOCKS:
                end()
                waiting.append(None)
            waiting.extend(reversed(part.children))
    end()
    return blocks


def main_text(html: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    nodes = _in_order(builder.root)
    _measure(nodes)
    _score(nodes)
    _drop_marked(nodes)
    _again(nodes)
    # what MAYBE marks is no candidate, but may lie in the container
    outside = {id(n) for n in nodes if n.mark == 1 and not n.below > nodes[0].below / 2}
    live: list[Node] = []
    for n in nodes:
        if n.parent is not None and id(n.parent) in outside:
            outside.add(id(n))
        if not n.dropped and n.chars and id(n) not in outside:
            live.append(n)
    if not live:
        return ""
    best = max(live, key=lambda n: n.points * (1 - _density(n)))
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None and (best.below >= around.below / 2 or around.points >= SIBLING_SHARE * best.points):
        return _text(_articles(around))
    if best.parent is None or best.tag in ("body", "html"):
        return _text([best], menus=True)
    least = max(1.0, SIBLING_SHARE * best.points)
    tops: list[Node] = []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.dropped:
            continue
        plain = sibling.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and _density(sibling) < 0.25
        between = sibling.tag in ("section", "div") and sibling.mark == 0 and sibling.below >= 1 and _density(sibling) < 0.25
        if sibling is best or plain or between or sibling.mark == 0 and sibling.points >= least and not _is_menu(sibling):
            tops.append(sibling)
    return _text(tops)


def _again(nodes: list[Node]) -> None:
    """Measure and score once more, without what has been dropped."""
    for node in nodes:
        node.points = node.below = 0.0
        node.chars = node.linked = node.links = 0
    _measure(nodes)
    _score(nodes)


def _articles(chosen: Node) -> list[Node]:
    """The container with the articles beside it that score as it does: a text in several articles."""
    if chosen.tag != "article" or chosen.parent is None:
        return [chosen]
    beside = [c for c in chosen.parent.children if isinstance(c, Node) and c.tag == "article" and not c.dropped and c.mark == 0 and not _is_menu(c)]
    return [c for c in beside if c is chosen or c.points >= SIBLING_SHARE * chosen.points]


def _text(tops: list[Node], menus: bool = False) -> str:
    for top in tops:
        inside = _in_order(top)
        for node in inside[1:]:
            node.dropped = node.dropped or node.parent.dropped or (node.mark == 1 and _density(node) >= LINKED)
    return "\n\n".join(_blocks(tops, menus))


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in string_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
