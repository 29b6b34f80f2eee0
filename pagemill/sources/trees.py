"""Markup to element trees: one row a page with its nodes as an array, in document order.

Only tokenizing runs in Python, in Arrow batches; blocks, inline runs, styles and
contents are made from the nodes by DataFrame functions. A node knows its number
(from 1, the place in the array), its parent, the last number below it and the
numbers of all elements around it, outermost first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The named entities of XML.
NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}
ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z_:][\w:.-]*));")
#: Elements without an end tag, those whose text is no content, and those that end an open paragraph.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that make their parent a container of blocks.
BLOCKISH = {"img", "blockquote", "ol", "ul", "p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "body", "div", "main", "section"}
NODE = "n int, parent int, last int, path array<int>, tag string, text string, holds_blocks boolean, attrs map<string,string>"
#: Bytes of markup whose trees a task holds at once, besides the page that goes beyond them.
BATCH_BYTES = 2 << 20


def decode_entities(text: str) -> str:
    """XML entities in one pass; unknown names and invalid code points stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return NAMED.get(m[3], m[0])
        code = int(m[1]) if m[1] else int(m[2], 16)
        fine = code in (9, 10, 13) or 0x20 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF
        return chr(code) if fine else m[0]

    return ENTITY.sub(one, text)


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Tree(HTMLParser):
    """Columns of one page's nodes. Missing end tags are added where a paragraph, an item
    or the page ends; an end tag without a start is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parent, self.last, self.paths, self.tags, self.texts, self.holds, self.attrs = [], [], [], [], [], [], []
        self.open: list[int] = []
        self.joins = False

    def _add(self, tag: str, text: str | list[str] | None, attrs: dict[str, str]) -> int:
        n = len(self.tags) + 1
        if tag in BLOCKISH and self.open:
            self.holds[self.open[-1] - 1] = True
        for column, value in ((self.parent, self.open[-1] if self.open else 0), (self.last, n), (self.paths, list(self.open)), (self.tags, tag), (self.texts, text), (self.holds, False), (self.attrs, attrs)):
            column.append(value)
        self.joins = False
        return n

    def _close(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.last[n - 1] = len(self.tags)
        del self.open[depth:]
        self.joins = False

    def _depth(self, names: set[str], stops: set[str]) -> int | None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.tags[self.open[k] - 1]
            if tag in names:
                return k
            if tag in stops:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and (k := self._depth({"p"}, {"div", "li", "td", "section", "article", "body", "blockquote"})) is not None:
            self._close(k)
        if tag == "li" and (k := self._depth({"li"}, {"ol", "ul"})) is not None:
            self._close(k)
        n = self._add(tag, None, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if (k := self._depth({tag}, set())) is not None:
            self._close(k)

    def handle_data(self, data):
        if self.joins:
            self.texts[-1].append(data)
        elif not self.open or self.tags[self.open[-1] - 1] not in SILENT:
            self._add("#text", [data], {})
            self.joins = True
        elif self.tags[self.open[-1] - 1] == "style":
            self._add("#style", data, {})

    def handle_entityref(self, name):
        self.handle_data(decode_entities(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(decode_entities(f"&#{name};"))


def tree_of(markup: str) -> _Tree:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    tree._close(0)
    tree.texts = ["".join(t) if isinstance(t, list) else t for t in tree.texts]  # entities part a text into many pieces
    return tree


def _nodes(trees: list[_Tree]) -> pa.ListArray:
    """The trees' nodes as one Arrow array of lists of structs."""
    flat = lambda name: [x for t in trees for x in getattr(t, name)]
    ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    paths, attrs = flat("paths"), flat("attrs")
    columns = [
        pa.array([n for t in trees for n in range(1, len(t.tags) + 1)], pa.int32()), pa.array(flat("parent"), pa.int32()), pa.array(flat("last"), pa.int32()),
        pa.ListArray.from_arrays(ends(paths), pa.array([a for p in paths for a in p], pa.int32())), pa.array(flat("tags"), pa.string()), pa.array(flat("texts"), pa.string()), pa.array(flat("holds"), pa.bool_()),
        pa.MapArray.from_arrays(ends(attrs), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string())),
    ]
    return pa.ListArray.from_arrays(ends([t.tags for t in trees]), pa.StructArray.from_arrays(columns, [c.split()[0] for c in NODE.replace("map<string,string>", "map").split(", ")]))


def trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The pages' nodes, a few pages at a time however many a batch has."""
    for markup in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(markup), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(markup)]):
            yield _nodes([tree_of(m.as_py() or "") for m in markup[lo:hi]])


def element_trees(pages: DataFrame, markup_col: str, out: str = "nodes") -> DataFrame:
    """The pages without their markup column, with its nodes. A null page has none."""
    nodes = F.arrow_udf(trees, f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")(F.col(markup_col)).alias(out)
    return pages.select(*[c for c in pages.columns if c != markup_col], nodes)
