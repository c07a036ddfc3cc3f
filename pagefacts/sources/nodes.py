"""Node extraction: raw markup to a table of nodes and a table of text nodes.

Markup tokens are the one thing Spark has no expression for, so a page is tokenised in an Arrow batch
(`mapInPandas`); every later fact is derived with joins, windows and column expressions.
A node is the interval from its own number to that of the last node below it; no node carries a path, so a page of nested tags
that nobody closes takes as much memory as a flat one.
The tree profile is TOKEN_TREE_1: void elements, raw-text elements and implied end tags, without the
browser's repair of misnested formatting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

DOM_PROFILE = "TOKEN_TREE_1"
NODE_SCHEMA = (
    "page_id bigint, node_ix int, parent_ix int, depth int, tag string, attrs map<string,string>, "
    "class_tokens array<string>, subtree_end int, child_count int, dom_profile string"
)
TEXT_SCHEMA = "page_id bigint, text_ix int, parent_ix int, depth int, data string"
_ROWS_PER_BATCH = 20_000
_CLASS_SPACE = re.compile("[\t\n\f\r ]+")

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
# A start tag on the left closes an open element of the right, inside the nearest scope.
IMPLIED_END = {
    **{tag: frozenset({"p"}) for tag in (
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul").split()},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "option": frozenset({"option"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
SCOPE_TAGS = frozenset("html body ul ol dl table select div section article main nav aside header footer td th".split())


class _Tree(HTMLParser):
    """Nodes as [parent, depth, tag, attributes, end of subtree, children]; the open elements by number, and their places by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.texts: list[tuple] = []
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}

    def _last(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element with one of the tags, -1 if there is none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def _close_from(self, position: int) -> None:
        for node in reversed(self.open[position:]):
            self.nodes[node][4] = len(self.nodes) - 1
            self.places[self.nodes[node][2]].pop()
        del self.open[position:]

    def _close_implied(self, tag: str) -> None:
        closing = IMPLIED_END.get(tag)
        if not closing:
            return
        barrier = self._last(SCOPE_TAGS - closing)
        while (position := self._last(closing)) > barrier:
            name = self.nodes[self.open[position]][2]
            self._close_from(position)
            if name != "p":
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._close_implied(tag)
        parent = self.open[-1] if self.open else None
        if parent is not None:
            self.nodes[parent][5] += 1
        named: dict[str, str] = {}
        for key, value in attrs:
            named.setdefault(key, value or "")
        self.nodes.append([parent, len(self.open), tag, named, len(self.nodes), 0])
        if tag not in VOID_TAGS:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self._close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.open:
            self.texts.append((self.open[-1], len(self.open), data))

    def close(self) -> None:
        super().close()
        self._close_from(0)


def _tree_of(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def _node_rows(page_id: int, html: str | None) -> Iterator[tuple]:
    for index, (parent, depth, tag, attrs, end, children) in enumerate(_tree_of(html).nodes):
        tokens = list(dict.fromkeys(token for token in _CLASS_SPACE.split(attrs.get("class") or "") if token))
        yield page_id, index, parent, depth, tag, attrs, tokens, end, children, DOM_PROFILE


def _text_rows(page_id: int, html: str | None) -> Iterator[tuple]:
    for index, (parent, depth, data) in enumerate(_tree_of(html).texts):
        yield page_id, index, parent, depth, data


def _batched(rows_of, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                for row in rows_of(page_id, html):
                    held.append(row)
                    if len(held) >= _ROWS_PER_BATCH:
                        yield _frame(held, names)
                        held = []
        if held:
            yield _frame(held, names)

    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["parent_ix"] = frame["parent_ix"].astype("Int32")
    return frame


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("map<string,string>", "map").split(", ")]


def extract_nodes(pages: DataFrame) -> DataFrame:
    """Pre-order element table."""
    return pages.select("page_id", "html").mapInPandas(_batched(_node_rows, _names(NODE_SCHEMA)), NODE_SCHEMA)


def extract_text_nodes(pages: DataFrame) -> DataFrame:
    """Text nodes in document order; `depth` counts the elements above."""
    return pages.select("page_id", "html").mapInPandas(_batched(_text_rows, _names(TEXT_SCHEMA)), TEXT_SCHEMA)


@udtf(returnType="node_ix int, parent_ix int, depth int, tag string, attrs map<string,string>, class_tokens array<string>, "
                 "subtree_end int, child_count int")
class PageNodes:
    """The same extraction for SQL: `SELECT … FROM pages, LATERAL page_nodes(html)`."""

    def eval(self, html: str):
        for row in _node_rows(0, html):
            yield row[1:-1]


def register_page_nodes(spark: SparkSession) -> None:
    spark.udtf.register("page_nodes", PageNodes)
