"""HTML extraction by tree scoring.

A page is read into a tree of block elements. Every paragraph passes points for its length
and its commas to its ancestors: in full to the parent and to ``article`` and ``main``
elements, half to the grandparent and less above. A container's points are discounted by the
share of its text inside links. The best container and those of its siblings that score well or
read like text are the article. Navigation, headers, footers, sidebars, forms, notices,
adverts and reader comments are left out by element, role and class before anything is scored;
what holds an ``article`` or ``main`` is never left out for its class.

Character references are decoded, white space inside a block becomes one blank, blocks are
trimmed and joined in page order by line breaks. Nulls and odd input: a null or empty page
has an empty text, as has a page without an article; unclosed elements end with their parent,
and a page that ends inside a tag is read as far as it goes. Equal rows get equal texts; of two
containers that score alike the first is taken. Pages are independent and parsed whole, however
long; no column but the three named is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the text.
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input label "
    "map menu nav noframes noscript object option script search select style svg template textarea title video".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Words in a class or id that name page furniture.
FURNITURE = frozenset(
    "ad ads adbox adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promoted related reply replies respond share sharebar "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A start tag on the left ends an open element on the right.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: First parts of a class that say what an element has or is filed under, not what it is.
QUALIFIERS = frozenset("category format has hide in is no not show status tag type with without".split())
#: First parts of a class that, with "header", name the head of the article itself.
OWN_HEADERS = frozenset("article content entry page post story".split())
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MIN_PARAGRAPH, SIBLING_SHARE = 25, 0.2


class _Node:
    __slots__ = ("tag", "parent", "order", "points", "chars", "linked", "named", "holds")

    def __init__(self, tag: str, parent: _Node | None, order: int, named: bool = False):
        self.tag, self.parent, self.order = tag, parent, order
        self.points, self.chars, self.linked = 0.0, 0, 0
        #: Whether its class names furniture, and whether an article or main lies in it.
        self.named, self.holds = named, False


def _names_furniture(name: str) -> bool:
    """Whether a class or id, by its first or last part, names page furniture."""
    parts = _PARTS.findall(name)
    if not parts or len(parts) > 1 and parts[0] in QUALIFIERS:
        return False
    if parts[-1] == "header" and len(parts) > 1 and parts[0] in OWN_HEADERS:
        return False
    return parts[0] in FURNITURE or parts[-1] in FURNITURE


class _Reader(HTMLParser):
    """Blocks of text with the element that holds each; ``blocks`` is in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = _Node("", None, 0)
        self.nodes = [self.node]
        self.blocks: list[tuple[_Node, str, int]] = []
        self.skipped: list[str] = []
        self.links = 0
        self.text: list[str] = []
        self.link_chars = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.node, text, min(self.link_chars, len(text))))
        self.text.clear()
        self.link_chars = 0

    def _dropped(self, tag: str, told: dict[str, str]) -> bool:
        """Whether an element goes whatever it holds."""
        if tag in DROPPED:
            return True
        if tag in ("html", "body", "main"):
            return False
        return (
            tag == "header" and not self._within(("article", "main")) or told.get("role", "").lower() in ROLES
            or "hidden" in told or told.get("aria-hidden") == "true" or bool(_HIDDEN.search(told.get("style", "")))
        )

    def _within(self, tags: tuple[str, ...]) -> bool:
        node: _Node | None = self.node
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _leave(self, tags: set[str], until: set[str]) -> None:
        """Close the nearest open element among ``tags`` not beyond one of ``until``."""
        node: _Node | None = self.node
        while node is not None and node.tag not in tags:
            if node.tag in until:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped and tag in ("article", "main") and self.skipped[0] in ("header", "menu", "nav"):
            self.skipped.clear()  # left open: no menu holds an article
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in BLOCKS:
            self._flush()
            self._leave({"p"}, BLOCKS - {"p"})
            if tag in CLOSES:
                self._leave(CLOSES[tag], {"ul", "ol", "dl", "table"})
        told = {name: value or "" for name, value in attrs}
        named = any(map(_names_furniture, f"{told.get('class', '')} {told.get('id', '')}".lower().split()))
        holder = tag in BLOCKS and tag not in VOID
        if self._dropped(tag, told) or named and not holder:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1
        elif holder:
            self.node = _Node(tag, self.node, len(self.nodes), named and tag not in ("html", "body", "main", "article"))
            self.nodes.append(self.node)
            if tag in ("article", "main"):
                above = self.node.parent
                while above is not None and not above.holds:
                    above.holds, above = True, above.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in DROPPED:  # HTML ignores the slash of other elements
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:  # what was left open in it ends with it
                    pass
                return
            if tag not in ("body", "html") and not (tag in BLOCKS and self._within((tag,))):
                return
            self.skipped.clear()  # left open: it ends with its parent
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS and tag not in ("html", "body"):
            self._flush()
            self._leave({tag}, {"td", "th", "table", "article", "main"} - {tag})

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)
            if self.links:
                self.link_chars += len(data.strip())

    def close(self) -> None:
        super().close()
        self._flush()
        out: list[bool] = []
        for node in self.nodes:  # parents come first
            out.append(node.named and not node.holds or node.parent is not None and out[node.parent.order])
        self.blocks = [block for block in self.blocks if not out[block[0].order]]


def _score(reader: _Reader) -> None:
    for node, text, linked in reader.blocks:
        holder: _Node | None = node
        while holder is not None:
            holder.chars += len(text)
            holder.linked += linked
            holder = holder.parent
        if len(text) < MIN_PARAGRAPH:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        # Text that stands in a container itself counts for the container.
        holder, level = (node.parent if node.tag in ("p", "pre", "li", "td", "blockquote") else node), 0
        while holder is not None:
            whole = level == 0 or holder.tag in ("article", "main")
            holder.points += points / (1 if whole else 2 if level == 1 else 3 * level)
            holder, level = holder.parent, level + 1


def _net(node: _Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def _chosen(reader: _Reader) -> set[int] | None:
    """Orders of the elements whose blocks are the article; None if nothing scores."""
    best = max(reader.nodes, key=lambda n: (_net(n), -n.order))
    if _net(best) <= 0:
        return None
    taken = {best.order}
    for node in reader.nodes:
        if node.parent is best.parent and node.parent is not None and node.chars:
            density = node.linked / node.chars
            texty = node.tag == "p" and (node.chars > 80 and density < 0.25 or density == 0)
            if texty or _net(node) >= max(10.0, SIBLING_SHARE * _net(best)):
                taken.add(node.order)
    # A heading or lead right beside the chosen elements belongs to them.
    if best.parent is not None:
        taken |= {n.order for n in reader.nodes if n.parent is best.parent and n.tag in ("h1", "h2", "h3", "h4") and n.chars}
    return taken


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    _score(reader)
    taken = _chosen(reader)
    if taken is None:
        # Nothing long enough to score: an article or main element, else all that is not a link.
        taken = {n.order for n in reader.nodes if n.tag in ("article", "main")}
        if not taken:
            return "\n".join(text for _, text, linked in reader.blocks if linked < len(text))
    inside = [False] * len(reader.nodes)
    for node in reader.nodes:  # parents come first
        inside[node.order] = node.order in taken or (node.parent is not None and inside[node.parent.order])
    return "\n".join(text for node, text, _ in reader.blocks if inside[node.order])


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(extract)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; no shuffle."""
    read = F.pandas_udf(_extracted, "string")(F.coalesce(html, F.lit("")))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), read.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
