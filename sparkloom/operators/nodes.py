"""Pages as node tables: a linear tokenizer that gives every element and text of a page with its place in the tree.

A page becomes an array of nodes in page order. A node's number is its place in the array; `last` is
the number of the last node inside it, so one node lies in another where its number lies between that
one's number and `last`: selectors and extraction (functions.selectors) need no walk of the tree and
stay expressions of the engine over that array.

Comments, declarations and processing instructions give no nodes; the last two end at the latest where
the next tag starts. The contents of scripts, styles and
their like are one text, whatever stands in them. Void elements hold nothing; an end tag closes what
was left open inside its element, and is passed over where no such element is open; paragraphs, list
items, table parts and options end where the next of their kind starts. Named, decimal and hexadecimal
character references are decoded in texts and values. A tag that never ends drops the rest of the page.

Where places in the markup are not asked for, a page is cut at its tags at once, and its tree is taken from
a page before it that has the same tags in the same order, if there is one, as pages of one template do.

Defined results: null and empty pages have no nodes; repeated attributes keep the first value; pages
are read whole, in time and memory linear in their length; rows are kept as they are, with one column
more, which replaces one of its name.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Collection, Iterator, Sequence
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: start and stop are the places of an element's markup in the page, open and close those of what is inside it.
NODE = "struct<node:int,parent:int,last:int,depth:int,nth:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string,pre:boolean,lists:int,start:int,open:int,close:int,stop:int>"
#: Fields that selectors, metadata, links and tables need; Markdown and lengths of markup need all.
SELECTED = "node parent last tag id classes attrs text"
#: Fields that attributes and the text inside elements need; tables; metadata and links of a head.
NAMED_TEXTS, TABLES, NAMED = "node last tag attrs text", "node parent last tag id text", "tag attrs"
#: Elements without contents; elements whose contents are text; those of them where references are decoded.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DECODED = frozenset(("textarea", "title"))
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: What a start tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
PARAGRAPH_SCOPE = {"table", "td", "th", "caption", "button", "object"}
#: End tags that do not reach out of a table's cell.
CELLS = {"td", "th", "caption"}
OF_TABLES = {"table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "body"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^<>]*>?", re.S)
ENDING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: What stands between texts, with the same reach as in Tree.page: an element of text with its end; a tag; what gives no nodes.
#: Groups: name, attributes and contents of an element of text; name with its slash and attributes of a tag.
#: The first two letters are looked at before the names of elements of text are tried.
_WITHIN = r"""([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>"""
BETWEEN = re.compile(
    rf"""<(?=[insxtINSXT][cefimotCEFIMOT])(?i:({"|".join(sorted(RAW))}))(?=[\s/>]){_WITHIN}([\s\S]*?)(?:(?i:</\1)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<(/?[a-zA-Z][^\s/>]*){_WITHIN}"""
    r"""|<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<[!?][^<>]*>?|</(?=[\x00-\x7f])(?![a-zA-Z])[^<>]*>?|</\Z|</?[a-zA-Z][\s\S]*"""
)


#: Attributes of a tag that is longer are not remembered.
REMEMBERED = 200


def attributes(raw: str, xml: bool) -> tuple[str | None, tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Id, classes and attributes of a start tag; of equal names the first counts."""
    attrs: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value = a or b or c
        attrs.setdefault(name if xml else name.lower(), references.unescape(value) if "&" in value else value)
    return attrs.get("id"), tuple(attrs.get("class", "").split()), tuple(attrs.items())


remembered = lru_cache(4096)(attributes)


#: What is known of a node where it starts, in this order; held is (id, classes, attributes), or nothing for texts.
KEPT = ("tag", "parent", "depth", "nth", "held", "text", "pre", "lists", "start", "open")


class Tree:
    """The nodes of pages, one page behind the other, as they are read."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.last: list[int] = []
        self.close: list[int] = []
        self.stop: list[int] = []
        self.ends: list[int] = []
        self.begin()

    def begin(self) -> None:
        """What is open in the page that is read next."""
        self.base = len(self.nodes)
        self.stack: list[int] = []
        self.opened: dict[str, int] = {}
        self.children: list[dict[str, int]] = [{}]
        self.pre, self.lists = False, 0

    def add(self, tag: str, held: tuple | None, text: str | None, start: int, open_: int, stop: int) -> None:
        siblings, stack, nodes = self.children[-1], self.stack, self.nodes
        siblings[tag] = nth = siblings.get(tag, 0) + 1
        self.last.append(len(nodes) - self.base)
        self.close.append(stop)
        self.stop.append(stop)
        nodes.append((tag, stack[-1] if stack else -1, len(stack), nth, held, text, self.pre, self.lists, start, open_))

    def count(self, tag: str, n: int) -> None:
        self.opened[tag] = self.opened.get(tag, 0) + n
        if tag == "pre":
            self.pre = self.opened["pre"] > 0
        elif tag == "ul" or tag == "ol":
            self.lists += n

    def push(self, tag: str) -> None:
        """Opens the node that came last."""
        self.stack.append(len(self.nodes) - self.base - 1)
        self.count(tag, 1)
        self.children.append({})

    def pop(self, close: int, stop: int) -> None:
        at = self.base + self.stack.pop()
        self.count(self.nodes[at][0], -1)
        self.children.pop()
        self.last[at], self.close[at], self.stop[at] = len(self.nodes) - self.base - 1, close, stop

    def end(self, names: Collection[str], within: Collection[str], close: int, stop: int, all_of_them: bool = False) -> None:
        """Closes the nearest open element of the names (or all of them) that is not beyond the others, and all inside it."""
        for name in names:
            if self.opened.get(name):
                break
        else:
            return
        reach = None
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.nodes[self.base + self.stack[k]][0]
            if tag in names:
                reach = k
                if not all_of_them:
                    break
            elif tag in within:
                break
        if reach is not None:
            while len(self.stack) > reach + 1:
                self.pop(close, close)
            self.pop(close, stop)

    def add_text(self, text: str, start: int, stop: int, decode: bool = True) -> None:
        if text:
            self.add("#text", None, references.unescape(text) if decode and "&" in text else text, start, start, stop)

    def start_tag(self, tag: str, raw: str, start: int, stop: int, xml: bool = False) -> None:
        if not xml:
            if tag in BLOCKS and self.opened.get("p"):
                self.end(("p",), PARAGRAPH_SCOPE, start, start)
            if tag in ENDS:
                names, within = ENDS[tag]
                self.end(names, within, start, start, all_of_them=True)
        self.add(tag, NONE if not raw else remembered(raw, xml) if len(raw) < REMEMBERED else attributes(raw, xml), None, start, stop, stop)

    def page(self, page: str, xml: bool = False) -> None:
        """Reads a page; in XML, elements hold what their tags say and names keep their case."""
        self.begin()
        at, size, match = 0, len(page), TAG.match
        while at < size:
            found = match(page, at)
            if found is None and page[at] != "<":
                stop = page.find("<", at)
                stop = size if stop < 0 else stop
                self.add_text(page[at:stop], at, stop)
                at = stop
                continue
            if xml and page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                stop = size if stop < 0 else stop
                self.add_text(page[at + 9 : stop], at, stop, decode=False)
                at = min(size, stop + 3)
                continue
            if found is None:
                following = page[at + 1 : at + 2]
                if following in ("!", "?") or (following == "/" and not page[at + 2 : at + 3].isalpha()):
                    at = OTHER.match(page, at).end()
                elif following.isascii() and following.isalpha() or following == "/":
                    break
                else:
                    stop = page.find("<", at + 1)
                    stop = size if stop < 0 else stop
                    self.add_text(page[at:stop], at, stop)
                    at = stop
                continue
            ending, tag, raw = found.groups()
            start, at = at, found.end()
            if not xml:
                tag = tag.lower()
            if ending:
                if self.stack and self.nodes[self.base + self.stack[-1]][0] == tag:
                    self.pop(start, at)
                    continue
                self.end((tag,), () if xml or tag in OF_TABLES else CELLS, start, at)
                continue
            self.start_tag(tag, raw, start, at, xml)
            if xml:
                if not raw.endswith("/"):
                    self.push(tag)
                continue
            if tag in VOID or (raw.endswith("/") and tag not in RAW and self.opened.get("svg")):
                continue
            self.push(tag)
            if tag in RAW:
                ending = ENDING[tag].search(page, at)
                stop = ending.start() if ending else size
                self.add_text(page[at:stop], at, stop, tag in DECODED)
                after = page.find(">", stop)
                at = size if not ending or after < 0 else after + 1
                self.pop(stop, at)
        while self.stack:
            self.pop(size, size)
        self.ends.append(len(self.nodes))

    def scripts(self) -> list[dict]:
        """(id, type, text) of the scripts of the page that was read last."""
        found = [i for i in range(self.base, len(self.nodes)) if self.nodes[i][0] == "script"]
        at = {name: i for i, name in enumerate(KEPT)}
        inside = lambda i: self.nodes[i + 1 : self.base + self.last[i] + 1]
        return [{"id": self.nodes[i][at["held"]][0], "type": dict(self.nodes[i][at["held"]][2]).get("type"), "text": "".join(n[at["text"]] or "" for n in inside(i))} for i in found]

    def arrow(self, kind: pa.DataType) -> pa.Array:
        """The pages as arrays of the nodes' fields that a type names."""
        offsets = np.array([0, *self.ends], np.int32)
        columns = dict(zip(KEPT, zip(*self.nodes) if self.nodes else [()] * len(KEPT))) | {"last": self.last, "close": self.close, "stop": self.stop}
        held = columns["held"]
        texts = np.fromiter((h is None for h in held), bool, len(held))
        made = []
        for field in kind.value_type:
            if field.name == "node":
                values = pa.array(np.arange(len(held), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)))
            elif field.name == "id":
                values = pa.array([h and h[0] for h in held], pa.string())
            elif field.name == "classes":
                values = pa.ListArray.from_arrays(_offsets(held, 1, texts), pa.array([c for h in held if h for c in h[1]], pa.string()))
            elif field.name == "attrs":
                pairs = [x for h in held if h for x in h[2]]
                values = pa.MapArray.from_arrays(_offsets(held, 2, texts), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
            elif pa.types.is_integer(field.type):
                values = pa.array(np.array(columns[field.name], np.int32))
            else:
                values = pa.array(columns[field.name], field.type)
            made.append(values)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, fields=list(kind.value_type)))


NONE = (None, (), ())


def _offsets(held: Sequence[tuple | None], part: int, missing: np.ndarray) -> pa.Array:
    """Where each node's parts start in the list of all; null where there are none to have."""
    sizes = np.fromiter((len(h[part]) if h else 0 for h in held), np.int32, len(held))
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    return pa.array(ends, mask=np.append(missing, False))


def page_nodes(page: str, xml: bool = False) -> list[dict]:
    """The nodes of a page, in page order; in XML, elements hold what their tags say and names keep their case."""
    tree = Tree()
    tree.page(page, xml)
    rows = [dict(zip(KEPT, node)) for node in tree.nodes]
    for i, row in enumerate(rows):
        held = row.pop("held")
        row |= {"node": i, "last": tree.last[i], "close": tree.close[i], "stop": tree.stop[i], "id": held and held[0], "classes": held and list(held[1]), "attrs": held and dict(held[2])}
    return rows


#: Fields of places in the markup; those that follow from the order of tags alone.
PLACES = frozenset("start open close stop".split())
SHAPED = {"parent": np.int32, "last": np.int32, "depth": np.int32, "nth": np.int32, "pre": bool, "lists": np.int32}
#: Most nodes of trees, and most orders of tags met once, that a process remembers.
MOST_SHAPED, MOST_MET = 300_000, 100_000


class Shape:
    """The tree of a page without its texts and attributes.

    Of the nodes only elements of some tags, and texts inside them, are held, if tags are given; numbers are those
    of what is held, and a parent that is not held is -1.
    """

    def __init__(self, tree: Tree, only: frozenset[str] | None) -> None:
        columns = dict(zip(KEPT, zip(*tree.nodes) if tree.nodes else [()] * len(KEPT))) | {"last": tree.last}
        tags = columns["tag"]
        self.of = {name: np.array(columns[name], kind) for name, kind in SHAPED.items()}
        self.text = np.fromiter((h is None for h in columns["held"]), bool, len(tags))
        self.all = len(tags)
        self.kept = np.arange(self.all)
        if only is not None:
            wanted = np.fromiter((t in only for t in tags), bool, self.all) & ~self.text
            reach = np.maximum.accumulate(np.where(wanted, self.of["last"], -1)) if self.all else self.kept
            self.kept = np.flatnonzero(wanted | (self.text & (reach >= self.kept)))
            number = np.full(self.all + 1, -1, np.int32)
            number[self.kept] = np.arange(len(self.kept))
            upto = np.searchsorted(self.kept, self.of["last"], side="right") - 1
            self.of |= {"parent": number[self.of["parent"]], "last": upto.astype(np.int32)}
            self.of = {name: values[self.kept] for name, values in self.of.items()}
            self.text = self.text[self.kept]
        self.tag = pa.array([tags[i] for i in self.kept], pa.string())

    def places(self, parts: list[str | None]) -> bool:
        """Finds where the cut page has the texts and attributes of the nodes; whether it has all."""
        at, verbatim = [], set()
        for i in range(0, len(parts), 6):
            if parts[i]:
                at.append(i)
            if i + 1 < len(parts):
                raw, content, tag = parts[i + 1], parts[i + 3], parts[i + 4]
                if raw is not None:
                    at.append(i + 2)
                    if content:
                        if raw.lower() not in DECODED:
                            verbatim.add(i + 3)
                        at.append(i + 3)
                elif tag is not None and tag[0] != "/":
                    at.append(i + 5)
        if len(at) != self.all:
            return False
        held = [at[i] for i in self.kept]
        texts = [i for i, t in zip(held, self.text) if t]
        self.texts, self.raws = _getter(texts), _getter([i for i, t in zip(held, self.text) if not t])
        self.verbatim = [k for k, i in enumerate(texts) if i in verbatim]
        return True


def _getter(at: list[int]) -> Callable[[list], Sequence]:
    return itemgetter(*at) if len(at) > 1 else lambda parts: [parts[i] for i in at]


class Numbers(dict):
    """A number for each key, in the order they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


unescaped = lru_cache(4096)(references.unescape)
#: Trees by the tags held and the order of a page's tags; None where attributes have a say in the tree. Those met once.
_shapes: dict[tuple, Shape | None] = {}
_met: set[int] = set()
_shaped = 0


class Pages:
    """The nodes of pages without their places, one page behind the other, trees taken from pages of the same tags."""

    def __init__(self, only: frozenset[str] | None = None) -> None:
        self.only = only
        self.shapes: list[Shape] = []
        self.texts: list[str] = []
        self.held = Numbers()
        self.numbers: list[int] = []
        self.size = 0

    def page(self, page: str) -> None:
        parts = BETWEEN.split(page)
        shape = key = None
        if "<" not in "".join(parts[::6]):
            key = (self.only, *parts[4::6], *parts[1::6], bytes(map(bool, parts[::6])), bytes(map(bool, parts[3::6])))
            shape = _shapes.get(key)
        if shape is None:
            self.read(page, parts, key)
            return
        texts = [unescaped(t) if "&" in t else t for t in shape.texts(parts)]
        if shape.verbatim:
            plain = shape.texts(parts)
            for k in shape.verbatim:
                texts[k] = plain[k]
        self.add(shape, texts, shape.raws(parts))

    def add(self, shape: Shape, texts: Sequence[str], held: Sequence) -> None:
        self.shapes.append(shape)
        self.texts += texts
        self.numbers += map(self.held.__getitem__, held)
        self.size += len(shape.kept)

    def read(self, page: str, parts: list[str | None], key: tuple | None) -> None:
        """Reads a page by itself; keeps its tree when the order of its tags is met the second time."""
        global _shaped
        tree = Tree()
        tree.page(page)
        shape = Shape(tree, self.only)
        if key is not None and key not in _shapes:
            if hash(key) not in _met:
                if len(_met) >= MOST_MET:
                    _met.clear()
                _met.add(hash(key))
            elif shape.all <= MOST_SHAPED // 10:
                if _shaped > MOST_SHAPED:
                    _shapes.clear()
                    _shaped = 0
                # in svg a slash at the end of a tag closes it
                svg = any(t is not None and t.lower() == "svg" for t in parts[4::6])
                _shapes[key] = shape if not svg and shape.places(parts) else None
                _shaped += len(parts)
        nodes = [tree.nodes[i] for i in shape.kept]
        held, text = KEPT.index("held"), KEPT.index("text")
        self.add(shape, [n[text] for n in nodes if n[held] is None], [n[held] for n in nodes if n[held] is not None])

    def arrow(self, kind: pa.DataType) -> pa.Array:
        """The pages as arrays of the nodes' fields that a type names."""
        sizes = np.fromiter((len(x.kept) for x in self.shapes), np.int32, len(self.shapes))
        offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        joined = lambda found, dtype: np.concatenate([np.zeros(0, dtype), *found])
        text = joined((x.text for x in self.shapes), bool)
        held = [h if isinstance(h, tuple) else attributes(h, False) for h in self.held]
        numbers = np.zeros(self.size, np.int32)
        numbers[~text] = self.numbers
        numbers = pa.array(numbers, mask=text)
        made = []
        for field in kind.value_type:
            if field.name == "node":
                values = pa.array(np.arange(self.size, dtype=np.int32) - np.repeat(offsets[:-1], sizes))
            elif field.name == "tag":
                values = pa.concat_arrays([pa.array([], pa.string()), *(x.tag for x in self.shapes)])
            elif field.name == "text":
                values = pa.array(self.texts, pa.string()).take(pa.array(np.cumsum(text) - 1, mask=~text))
            elif field.name == "id":
                values = pa.array([h[0] for h in held], pa.string()).take(numbers)
            elif field.name == "classes":
                values = pa.array([h[1] for h in held], field.type).take(numbers)
            elif field.name == "attrs":
                values = pa.array([h[2] for h in held], field.type).take(numbers)
            else:
                values = pa.array(joined((x.of[field.name] for x in self.shapes), SHAPED[field.name]))
            made.append(values)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, fields=list(kind.value_type)))


def with_nodes(pages: DataFrame, html: str = "html", out: str = "nodes", most_chars: int = 2_000_000, xml: bool = False, most_nodes: int = 50_000, keep: bool = True, fields: str | None = None, only: str | None = None, of_scripts: tuple[str, str, pa.DataType, Callable[[list[dict]], list]] | None = None) -> DataFrame:
    """The rows with the nodes of their page in one more column; without the page, if it is not kept.

    Batches go out when their pages hold so many characters or nodes. Of a node only the fields named go
    out, or all of them; of nodes all, or elements of some tags (only) and the texts inside them, numbered by themselves,
    -1 for a parent that stays behind: with fields that are no places, and for pages that are not XML. of_scripts (a name, its types for Spark and Arrow, a function of (id, type, text) rows)
    is one more column, made of a page's scripts while its nodes are at hand.
    """
    kept = [c for c in pages.columns if c != out and (keep or c != html)]
    kind = T._parse_datatype_string(NODE)
    kind = T.StructType([f for f in kind.fields if fields is None or f.name in fields.split()])
    schema = pages.select(*kept).schema.add(out, T.ArrayType(kind))
    if of_scripts is not None:
        schema = schema.add(of_scripts[0], T._parse_datatype_string(of_scripts[1]))
    arrow = pa.list_(pa.struct([(f.name, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}[f.dataType.simpleString()]) for f in kind.fields]))

    by_shape = not xml and of_scripts is None and PLACES.isdisjoint(kind.names)
    if only is not None and not by_shape:
        raise ValueError("of some tags alone there are no places, scripts or XML")
    tags = None if only is None else frozenset(only.split())
    begun = (lambda: Pages(tags)) if by_shape else Tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            start, tree, size, made = 0, begun(), 0, []
            for i, page in enumerate(column):
                text = page.as_py() or ""
                if by_shape:
                    tree.page(text)
                else:
                    tree.page(text, xml)
                size += len(text)
                if of_scripts is not None:
                    made.append(of_scripts[3](tree.scripts()))
                if size > most_chars or (tree.size if by_shape else len(tree.nodes)) > most_nodes or i == len(column) - 1:
                    part = batch.slice(start, i + 1 - start)
                    more = [] if of_scripts is None else [pa.array(made, of_scripts[2])]
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), tree.arrow(arrow), *more], schema.names)
                    start, tree, size, made = i + 1, begun(), 0, []

    return pages.mapInArrow(run, schema)
