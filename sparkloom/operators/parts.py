"""Tables and links of pages, made while a page is read: what functions.pages gives over node arrays, without the nodes.

Which texts are the cells of which table follows from the order of a page's tags, so it is found once
for all pages that share it (operators.nodes); of each page only its texts are joined.

Defined results: as functions.pages.tables and functions.pages.links, in time linear in a page's nodes,
whatever tables hold; rows are kept as they are, without the page, with one column more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.operators.nodes import Pages, Shape, attributes

TABLE = "array<struct<caption:string,id:string,headers:array<string>,rows:array<array<string>>>>"
LINK = "array<struct<href:string,text:string,context:string>>"
#: Nodes that tables need; what is trimmed of texts; longest context of a link; links that stay on a page.
OF_TABLES = frozenset("table thead tbody tr td th caption".split())
WHITE = " \t\n\x0b\f\r\xa0"
CONTEXT = 200
STAYS = re.compile("#|javascript:")


def _offsets(sizes: Sequence[int]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)]))


class Layout:
    """Places of texts and elements in a tree: text before a node, elements before a node, inside of nodes."""

    def __init__(self, shape: Shape) -> None:
        self.tags, self.parent, self.last = shape.tag.to_pylist(), shape.of["parent"].tolist(), shape.of["last"].tolist()
        self.texts = np.concatenate([[0], np.cumsum(shape.text)]).tolist()

    def element(self, i: int) -> int:
        """The number of a node among the elements."""
        return i - self.texts[i]

    def inside(self, i: int) -> tuple[int, int]:
        """The texts inside a node."""
        return self.texts[i], self.texts[self.last[i] + 1]


class TableLayout(Layout):
    """The tables of a tree: for each the number of its element and the texts of its caption; sizes; texts of headers and cells."""

    def __init__(self, shape: Shape) -> None:
        super().__init__(shape)
        tags, up = self.tags, self.parent
        part = lambda i: tags[up[i]] if up[i] >= 0 else None
        # a row or caption belongs to the innermost table around it
        open_, rows, captions, cells = [], {}, {}, {}
        for i, tag in enumerate(tags):
            while open_ and self.last[open_[-1]] < i:
                open_.pop()
            if tag == "table":
                open_.append(i)
                rows[i] = []
            elif tag == "tr" and open_:
                rows[open_[-1]].append(i)
            elif tag == "caption" and open_:
                captions.setdefault(open_[-1], i)
            elif tag == "td" or tag == "th":
                cells.setdefault(up[i], []).append(i)
        self.heads: list[tuple[int, tuple[int, int] | None]] = []
        self.n_headers, self.n_rows, self.n_cells, headers, held = [], [], [], [], []
        for t, own in rows.items():
            head = next((r for r in own if part(r) == "thead"), None)
            top = [c for c in cells.get(own[0], ()) if tags[c] == "th"] if own else []
            names = top if head is None else cells.get(head, [])
            bodies = [r for r in own if part(r) == "tbody"] or (own[1:] if names else own)
            found = [cells[r] for r in bodies if r in cells]
            if names or found:
                self.heads.append((self.element(t), self.inside(captions[t]) if t in captions else None))
                self.n_headers.append(len(names))
                self.n_rows.append(len(found))
                self.n_cells += map(len, found)
                headers += map(self.inside, names)
                held += [self.inside(c) for r in found for c in r]
        self.headers, self.cells = headers, held


class Tables(Pages):
    """The tables of pages, one page behind the other."""

    def __init__(self) -> None:
        super().__init__(OF_TABLES)
        self.layouts: list[TableLayout] = []
        self.captions: list[str | None] = []
        self.ids: list[str | None] = []
        self.headers: list[str] = []
        self.cells: list[str] = []

    def add(self, shape: Shape, texts: Sequence[str], held: Sequence) -> None:
        layout = shape.__dict__.get("tables")
        if layout is None:
            layout = shape.tables = TableLayout(shape)
        self.layouts.append(layout)
        for at, caption in layout.heads:
            self.captions.append(None if caption is None else "".join(texts[caption[0] : caption[1]]).strip(WHITE))
            self.ids.append(ident(held[at]))
        self.headers += ["".join(texts[a:b]).strip(WHITE) for a, b in layout.headers]
        self.cells += ["".join(texts[a:b]).strip(WHITE) for a, b in layout.cells]
        self.size += shape.all

    def arrow(self) -> pa.Array:
        sizes = lambda name: [n for x in self.layouts for n in getattr(x, name)]
        row = pa.ListArray.from_arrays(_offsets(sizes("n_cells")), pa.array(self.cells, pa.string()))
        columns = {
            "caption": pa.array(self.captions, pa.string()),
            "id": pa.array(self.ids, pa.string()),
            "headers": pa.ListArray.from_arrays(_offsets(sizes("n_headers")), pa.array(self.headers, pa.string())),
            "rows": pa.ListArray.from_arrays(_offsets(sizes("n_rows")), row),
        }
        return pa.ListArray.from_arrays(_offsets([len(x.heads) for x in self.layouts]), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def of_element(held: str | tuple) -> tuple:
    """Id, classes and attributes of an element, from its markup or as they were read."""
    return held if isinstance(held, tuple) else attributes(held, False)


@lru_cache(65536)
def ident(held: str | tuple) -> str | None:
    return of_element(held)[0]


@lru_cache(65536)
def href(held: str | tuple) -> str | None:
    """The link of an anchor that leads off the page, or nothing."""
    found = dict(of_element(held)[2]).get("href")
    return None if not found or STAYS.match(found) else found


class LinkLayout(Layout):
    """The anchors of a tree: the number of each among the elements, the texts inside it and inside its parent."""

    def __init__(self, shape: Shape) -> None:
        super().__init__(shape)
        self.anchors = [(self.element(i), self.inside(i), self.inside(self.parent[i]) if self.parent[i] >= 0 else None) for i, tag in enumerate(self.tags) if tag == "a"]


class Links(Pages):
    """The links of pages, one page behind the other."""

    def __init__(self) -> None:
        super().__init__()
        self.counts: list[int] = []
        self.found: tuple[list, list, list] = ([], [], [])

    def add(self, shape: Shape, texts: Sequence[str], held: Sequence) -> None:
        layout = shape.__dict__.get("links")
        if layout is None:
            layout = shape.links = LinkLayout(shape)
        hrefs, inner, contexts = self.found
        before, around, context = len(hrefs), False, None
        for at, (a, b), up in layout.anchors:
            to = href(held[at])
            if to is None:
                continue
            hrefs.append(to)
            inner.append("".join(texts[a:b]).strip(WHITE))
            # anchors side by side share what is around them
            if up != around:
                around, context = up, None if up is None else "".join(texts[up[0] : up[1]]).strip(WHITE)[:CONTEXT]
            contexts.append(context)
        self.counts.append(len(hrefs) - before)
        self.size += shape.all

    def arrow(self) -> pa.Array:
        return pa.ListArray.from_arrays(_offsets(self.counts), pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in self.found], ["href", "text", "context"]))


def with_parts(pages: DataFrame, reader: type[Tables] | type[Links], out: str, html: str = "html", most_chars: int = 2_000_000, most_nodes: int = 50_000) -> DataFrame:
    """The rows without their page, with its tables or links in one more column; batches go out when their pages hold so many characters or nodes."""
    kept = [c for c in pages.columns if c not in (out, html)]
    schema = pages.select(*kept).schema.add(out, T._parse_datatype_string(TABLE if reader is Tables else LINK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            start, read, size = 0, reader(), 0
            for i, page in enumerate(column):
                text = page.as_py() or ""
                read.page(text)
                size += len(text)
                if size > most_chars or read.size > most_nodes or i == len(column) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), read.arrow()], schema.names)
                    start, read, size = i + 1, reader(), 0

    return pages.mapInArrow(run, schema)


def with_tables(pages: DataFrame, html: str = "html", out: str = "tables") -> DataFrame:
    """The rows without their page, with its tables as functions.pages.tables gives them."""
    return with_parts(pages, Tables, out, html)


def with_links(pages: DataFrame, html: str = "html", out: str = "links") -> DataFrame:
    """The rows without their page, with its links as functions.pages.links gives them."""
    return with_parts(pages, Links, out, html)
