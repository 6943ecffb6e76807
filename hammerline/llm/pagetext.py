"""Main-text extraction from web pages: flat blocks, judged by a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import released

#: Elements that begin and end a block (fixed values).
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements whose content is never text of the page, and elements without content (fixed values).
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "canvas", "iframe", "object", "audio", "video", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements around the article, and names of classes, ids and roles that mark such parts (fixed values).
AROUND = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Parts of a name that say where or what kind of box it is, but nothing of its content (fixed values).
PLAIN_NAMES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "content", "group", "inner", "item", "items", "left", "link", "links", "list", "main",
    "outer", "page", "panel", "posts", "right", "section", "site", "slot", "text", "top", "unit", "wrap", "wrapper",
}


def names_an_aside(names: str) -> bool:
    """Whether one of the names, taken apart at hyphens and underscores, is made of ASIDE_NAMES, and beside them
    PLAIN_NAMES and numbers, alone: cookie-notice and ad_slot_2 are, social-history and header-image aren't."""
    for name in names.lower().split():
        parts = [p for p in re.split("[-_]+", name) if p]
        if any(p in ASIDE_NAMES for p in parts) and all(p in ASIDE_NAMES or p in PLAIN_NAMES or p.isdigit() for p in parts):
            return True
    return False


#: Elements that may stand in a page's head (fixed values).
IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: Elements that can't stay open when a new block of their kind begins (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    aside: bool = False
    inside: bool = False
    heading: bool = False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Flattener(HTMLParser):
    """Turns a page into its flat sequence of text blocks. Tags may be unclosed or misplaced: a closing
    tag ends the innermost open element of its name, and is ignored if there is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.blocks: list[Block] = []
        self.now = Block()
        self.count: dict[str, int] = {}
        self.asides = 0
        self.articles = self.mains = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What begins with <![ has no meaning in a page and is passed over to its end, whatever it holds."""
        return self.parse_bogus_comment(i, 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count.get("head") and tag not in IN_HEAD:  # a head that was never closed
            self._pop(next(k for k, (name, _) in enumerate(self.open) if name == "head"))
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCK else set())
        if any(self.count.get(c) for c in closes):  # else there is nothing to look for
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in closes:
                    self._pop(k)
                    break
                if name in BLOCK:
                    break
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self.now.parts.append(" ")
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        header = tag == "header" and not self._in("article", "main")
        aside = tag in AROUND or header or bool(named and tag not in ("html", "body", "article", "main") and names_an_aside(named))
        if tag in ("article", "main") and not self._in("article", "main") and not self.asides and not aside:
            self.articles += tag == "article"
            self.mains += tag == "main"
        self.open.append((tag, aside))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.asides += aside

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self._pop(k)
                    break
        if tag in BLOCK:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.open and any(self.count.get(t) for t in SILENT):
            return
        self.now.parts.append(data)
        if self.count.get("a"):
            self.now.linked += len(data.split())
        if not data.isspace():
            self.now.aside |= self.asides > 0
            self.now.inside |= self._in("article", "main")
            self.now.heading |= self._in("h1", "h2", "h3", "h4", "h5", "h6")

    def _in(self, *tags: str) -> bool:
        return any(self.count.get(t) for t in tags)

    def _pop(self, k: int) -> None:
        for tag, aside in self.open[k:]:
            self.count[tag] -= 1
            self.asides -= aside
            if tag in BLOCK:
                self._flush()
        del self.open[k:]

    def _flush(self) -> None:
        if self.now.parts:
            if any(p and not p.isspace() for p in self.now.parts):
                self.blocks.append(self.now)
            self.now = Block()


def flat_blocks(html: str | None) -> list[Block]:
    parser, html = Flattener(), html or ""
    rest = html.find("<", html.rfind(">") + 1)  # a tag that never ends: the parser would try it from each "<" on
    parser.feed(html if rest < 0 else html[:rest])
    parser.close()
    parser._flush()
    if parser.articles > 1 and not parser.mains:  # a list of teasers or posts: which of them is meant is not said
        for block in parser.blocks:
            block.inside = False
    return parser.blocks


#: Columns of the labelled table.
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "inside", "page_has_article"]
#: A small labelled table of blocks (fixed values): word count and share of linked words of the block and
#: of its neighbours, whether it lies in a part around the article, whether in one marked as the article,
#: whether the page marks an article at all; last, 1 for main text. Where a page marks none, the neighbours
#: decide: few words between links are a menu, between text a line of it.
LABELLED = [
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (8, 0.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0), (30, 0.0, 8, 1.0, 60, 0.0, 1, 0, 1, 0),
    (12, 0.0, 9, 0.0, 30, 0.0, 0, 1, 1, 1), (90, 0.0, 10, 0.0, 70, 0.0, 0, 1, 1, 1), (1, 0.0, 80, 0.0, 2, 0.0, 0, 1, 1, 1), (2, 0.0, 1, 0.0, 40, 0.0, 0, 1, 1, 1),
    (35, 0.1, 40, 0.0, 9, 0.0, 0, 1, 1, 1), (5, 1.0, 60, 0.0, 60, 0.0, 0, 1, 1, 1), (60, 0.0, 1, 1.0, 80, 0.0, 0, 1, 1, 1), (7, 0.0, 55, 0.0, 9, 0.0, 1, 0, 1, 0),
    (9, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 0), (40, 0.0, 30, 0.0, 25, 0.0, 1, 1, 1, 0), (6, 0.0, 40, 0.0, 3, 1.0, 1, 1, 1, 0), (3, 1.0, 6, 0.0, 3, 1.0, 1, 1, 1, 0),
    (10, 0.0, 9, 0.0, 10, 0.0, 0, 1, 1, 1), (10, 0.0, 1, 1.0, 10, 0.0, 0, 1, 1, 1), (4, 0.0, 6, 1.0, 1, 0.0, 0, 1, 1, 1), (70, 0.0, 60, 0.0, 8, 0.2, 0, 1, 1, 1),
    (1, 0.0, 2, 0.0, 9, 0.5, 0, 1, 1, 1), (3, 0.0, 40, 0.0, 3, 1.0, 0, 1, 1, 1), (25, 0.4, 3, 1.0, 5, 1.0, 0, 1, 1, 1), (2, 1.0, 30, 0.0, 4, 1.0, 0, 1, 1, 1),
    (150, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (6, 0.5, 8, 0.8, 6, 1.0, 0, 1, 1, 1), (45, 0.0, 6, 0.6, 4, 0.9, 0, 1, 1, 1),
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 1, 0), (90, 0.0, 10, 0.0, 70, 0.0, 0, 0, 1, 0), (12, 0.0, 9, 0.0, 30, 0.0, 0, 0, 1, 0), (1, 0.0, 40, 0.0, 2, 0.0, 0, 0, 1, 0),
    (35, 0.1, 40, 0.0, 9, 0.0, 0, 0, 1, 0), (20, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0), (8, 0.0, 60, 0.0, 12, 0.0, 0, 0, 1, 0), (2, 0.0, 1, 0.0, 40, 0.0, 0, 0, 1, 0),
    (6, 0.0, 3, 1.0, 50, 0.0, 0, 0, 1, 0), (25, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1, 0), (10, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 1, 0),
    (60, 0.0, 1, 1.0, 70, 0.0, 0, 0, 0, 1), (80, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1), (15, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (6, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 1),
    (25, 0.1, 8, 0.0, 40, 0.0, 0, 0, 0, 1), (9, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0, 1), (1, 0.0, 30, 0.0, 20, 0.0, 0, 0, 0, 1), (12, 0.0, 14, 0.0, 13, 0.0, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (8, 0.9, 3, 1.0, 4, 0.8, 0, 0, 0, 0), (20, 0.8, 9, 0.7, 15, 0.9, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0), (6, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 0), (50, 0.0, 20, 0.0, 30, 0.0, 1, 0, 0, 0),
    (70, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (45, 0.0, 50, 0.0, 5, 0.2, 0, 0, 0, 1), (30, 0.0, 20, 0.0, 3, 1.0, 0, 0, 0, 1), (12, 0.0, 40, 0.0, 1, 0.0, 0, 0, 0, 1),
    (34, 0.1, 2, 1.0, 3, 0.9, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (10, 0.2, 1, 1.0, 9, 0.0, 0, 0, 0, 1), (200, 0.1, 3, 1.0, 2, 0.9, 0, 0, 0, 1),
    (2, 0.9, 2, 1.0, 30, 0.0, 0, 0, 0, 0), (3, 0.9, 40, 0.0, 40, 0.0, 0, 0, 0, 0), (12, 0.8, 20, 0.0, 50, 0.0, 0, 0, 0, 0), (30, 0.7, 60, 0.0, 12, 0.0, 0, 0, 0, 0),
    (3, 1.0, 1, 1.0, 50, 0.0, 1, 0, 0, 0), (9, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0),
    (3, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (4, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1), (5, 0.0, 50, 0.0, 35, 0.0, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1), (4, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (6, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1), (3, 0.0, 4, 1.0, 30, 0.0, 0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (2, 0.0, 4, 1.0, 2, 0.9, 0, 0, 0, 0), (5, 0.0, 3, 0.8, 4, 1.0, 0, 0, 0, 0), (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (15, 0.0, 4, 1.0, 4, 1.0, 0, 0, 0, 0), (22, 0.0, 5, 1.0, 6, 1.0, 0, 0, 0, 0), (12, 0.0, 3, 1.0, 5, 1.0, 0, 0, 0, 0), (18, 0.0, 6, 1.0, 2, 1.0, 0, 0, 0, 0),
    (3, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0), (2, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (4, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0), (1, 0.0, 30, 0.0, 5, 1.0, 0, 0, 0, 0),
    (26, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 1), (16, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 1), (20, 0.0, 25, 0.0, 4, 0.9, 0, 0, 0, 1), (12, 0.0, 35, 0.0, 2, 1.0, 0, 0, 0, 1),
    (40, 0.0, 30, 0.0, 1, 1.0, 1, 0, 0, 0), (60, 0.0, 50, 0.0, 2, 1.0, 1, 0, 0, 0), (30, 0.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0), (16, 0.0, 40, 0.0, 3, 1.0, 1, 0, 0, 0),
    (25, 0.0, 60, 0.0, 2, 1.0, 1, 0, 0, 0), (90, 0.0, 3, 1.0, 4, 1.0, 1, 0, 0, 0), (4, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0, 0), (70, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0),
]


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 9) -> tuple | float:
    """A binary decision tree by Gini impurity: (feature, threshold, tree below or equal, tree above), or
    the share of main text in a leaf. Ties go to the first feature and the lowest threshold."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return float(share)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            parts = (labels[low], labels[~low])
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return float(share)
    _, f, t = best
    low = rows[:, f] <= t
    return f, t, grow_tree(rows[low], labels[low], depth - 1), grow_tree(rows[~low], labels[~low], depth - 1)


def trained_tree() -> tuple | float:
    table = np.array(LABELLED, dtype=float)
    return grow_tree(table[:, :-1], table[:, -1])


def is_main(tree: tuple | float, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree >= 0.5


def main_text(html: str | None, tree: tuple | float) -> str:
    """Main blocks of a page in order, with an empty line between them."""
    blocks = flat_blocks(html)
    texts = [b.text() for b in blocks]
    words = [len(t.split()) for t in texts]
    shares = [min(1.0, b.linked / n) if n else 0.0 for b, n in zip(blocks, words)]
    article = any(b.inside for b in blocks)
    around = lambda values, k: values[k] if 0 <= k < len(values) else 0
    kept = []
    for k, b in enumerate(blocks):
        row = [words[k], shares[k], around(words, k - 1), around(shares, k - 1), around(words, k + 1), around(shares, k + 1), b.aside, b.inside, article]
        if is_main(tree, row):
            kept.append(texts[k])
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id_col, url_col, text (empty if none). Null and empty pages have an empty text;
    ids and urls may repeat or be null. Pages are judged one by one, so nothing is shuffled. Malformed pages
    are read as far as they go: unclosed, misplaced and unknown markup ends nothing. A very long page takes
    memory in proportion. Columns but these three don't matter, whatever they are called."""
    tree = trained_tree()
    rows = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    schema = rows.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in list(schema)[:2])
    return rows.mapInArrow(released(run), f"{kinds}, text string")
