"""Selectors and extraction over the node arrays of operators.nodes, as column functions.

A selector is a list of alternatives, each a row of compound selectors joined by a blank (inside) or
`>` (child): `main article, .content > p, [role="main"], a[href^="http"]`. Compounds hold a tag, `#id`,
`.class` and attribute tests (there, =, ~=, ^=, $=, *=).

Defined results: pages without nodes match nothing; a selector's matches are in page order, each once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<node:int,parent:int,last:int,depth:int,nth:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string,pre:boolean,lists:int,start:int,open:int,close:int,stop:int>>"
_COMPOUND = re.compile(r"""(?:\*|([a-zA-Z][\w-]*))?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)$""")
_PART = re.compile(r"""#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]]+))\s*)?\]""")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A use of a value that is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _test(compound: str) -> Callable[[Column], Column]:
    found = _COMPOUND.match(compound)
    if not found or not compound:
        raise ValueError(f"not a selector: {compound!r}")

    def test(n: Column) -> Column:
        out = F.lower(n["tag"]) == found[1].lower() if found[1] else n["tag"] != "#text"
        for ident, name, attr, how, a, b, c in _PART.findall(found[2]):
            if ident:
                out = out & (n["id"] == ident)
            elif name:
                out = out & F.array_contains(n["classes"], name)
            else:
                value, wanted = F.try_element_at(n["attrs"], F.lit(attr.lower())), F.lit(a or b or c)
                out = out & {
                    "": lambda: value.isNotNull(),
                    "=": lambda: value == wanted,
                    "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted),
                    "^=": lambda: F.startswith(value, wanted),
                    "$=": lambda: F.endswith(value, wanted),
                    "*=": lambda: F.contains(value, wanted),
                }[how]()
        return F.coalesce(out, F.lit(False))

    return test


def inside(n: Column, x: Column) -> Column:
    return (n["node"] > x["node"]) & (n["node"] <= x["last"])


def select(nodes: Column, selector: str) -> Column:
    """The nodes that a selector matches, in page order."""

    def steps(nodes: Column, parts: list[str]) -> Column:
        test = _test(parts[-1])
        if len(parts) == 1:
            return F.filter(nodes, test)
        child = parts[-2] == ">"
        near = (lambda n, x: n["parent"] == x["node"]) if child else inside
        return let(steps(nodes, parts[: -2 if child else -1]), lambda above: F.filter(nodes, lambda n: test(n) & F.exists(above, lambda x: near(n, x))))

    alternatives = [re.sub(r"\s*>\s*", " > ", a).split() for a in re.split(r",(?![^\[]*\])", selector)]
    if all(len(a) == 1 for a in alternatives):
        tests = [_test(a[0]) for a in alternatives]
        return F.filter(nodes, lambda n: _any([t(n) for t in tests]))
    if len(alternatives) == 1:
        return steps(nodes, alternatives[0])
    return _union(nodes, [steps(nodes, a) for a in alternatives])


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _union(nodes: Column, found: list[Column]) -> Column:
    numbers = F.flatten(F.array(*[F.transform(x, lambda n: n["node"]) for x in found]))
    return let(numbers, lambda some: F.filter(nodes, lambda n: F.array_contains(some, n["node"])))


def marked(nodes: Column) -> Column:
    """The nodes that tell one page's parts from another: all but texts and paragraphs without attributes, for selectors that ask for neither."""
    return F.filter(nodes, lambda n: (n["tag"] != "#text") & ((n["tag"] != "p") | (F.size(n["attrs"]) > 0)))


def first(nodes: Column, selector: str) -> Column:
    """The first match, or null."""
    return F.get(select(nodes, selector), F.lit(0))


def without(nodes: Column, removed: Column) -> Column:
    """The nodes but those of an array and what is inside them."""
    return let(removed, lambda gone: F.when(F.size(gone) > 0, F.filter(nodes, lambda n: ~F.exists(gone, lambda x: (n["node"] == x["node"]) | inside(n, x)))).otherwise(nodes))


def within(nodes: Column, x: Column) -> Column:
    """The nodes inside one of them."""
    return F.filter(nodes, lambda n: inside(n, x))


def raw_text(nodes: Column, x: Column, whole: bool = False) -> Column:
    """All text inside a node as it stands; of all nodes of a page (whole), only those inside it are touched."""
    if whole:
        # elements have no text, and what is null is not joined
        held = F.when(x["last"] > x["node"], F.sequence(x["node"] + 1, x["last"])).when(x["last"].isNotNull(), F.array().cast("array<int>"))
        return F.array_join(F.transform(held, lambda i: F.get(nodes, i)["text"]), "")
    held = F.filter(nodes, lambda n: inside(n, x))
    return F.array_join(F.transform(F.filter(held, lambda n: n["tag"] == "#text"), lambda n: n["text"]), "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\xa0"))


def text_of(nodes: Column, x: Column, whole: bool = False) -> Column:
    """The text inside a node, trimmed; null where the node is."""
    return let(x, lambda x: F.when(x.isNotNull(), trimmed(raw_text(nodes, x, whole))))


def attr(x: Column, name: str) -> Column:
    return F.try_element_at(x["attrs"], F.lit(name))


def meta(nodes: Column, *selectors: str) -> Column:
    """The content of the first of some meta elements that has one."""
    return F.coalesce(*[filled(F.trim(attr(first(nodes, s), "content"))) for s in selectors])


def filled(text: Column) -> Column:
    """A text that is made once, or null where it is empty."""
    return let(text, lambda t: F.when(t != "", t))


# ---- pages: noise, titles, main content

#: What is taken out of a page first; titles and containers of the content by trust: (name, selector, confidence).
NOISE = "script, style, noscript, iframe, svg, nav, footer, aside, .ads, .advertisement, #cookie-banner"
TITLES = (("og_title", 'meta[property="og:title"]', 0.95), ("title_tag", "title", 0.85), ("h1", "h1", 0.70))
CONTAINERS = (("main", "main", 0.85), ("article", "article", 0.85), ("role_main", '[role="main"]', 0.80), ("content_class", ".content, #content, .main", 0.70))
FALLBACK = ("body_fallback", "body", 0.30)
#: Least markup of a container that is content; shares of title and content in the whole confidence.
LEAST_MARKUP, TITLE_SHARE = 100, 0.3


def cleaned(nodes: Column) -> Column:
    return without(nodes, select(nodes, NOISE))


def body(nodes: Column) -> Column:
    """The body, or a node over the whole page where none is marked."""
    size = F.size(nodes)
    whole = F.from_json(F.lit('{"node": -1}'), NODES[6:-1]).withField("last", F.coalesce(F.get(nodes, size - 1)["node"], F.lit(-1))).withField("close", F.coalesce(F.get(nodes, size - 1)["stop"], F.lit(0))).withField("open", F.lit(0))
    return F.coalesce(first(nodes, "body"), whole)


def extent(x: Column) -> Column:
    """The numbers of a node and of the last node inside it, or null."""
    return let(x, lambda x: F.when(x.isNotNull(), F.struct(x["node"].alias("node"), x["last"].alias("last"))))


def body_extent(nodes: Column, few: Column | None = None) -> Column:
    """The extent of the body, or of the whole page where none is marked; needs no places in the markup."""
    last = F.coalesce(F.get(nodes, F.size(nodes) - 1)["node"], F.lit(-1))
    return F.coalesce(extent(first(nodes if few is None else few, "body")), F.struct(F.lit(-1).alias("node"), last.alias("last")))


def markup_length(nodes: Column, x: Column, removed: Column) -> Column:
    """Characters of markup inside a node without those of removed nodes in it."""
    outer = F.filter(removed, lambda r: inside(r, x) & ~F.exists(removed, lambda o: inside(r, o)))
    return x["close"] - x["open"] - F.aggregate(outer, F.lit(0), lambda s, r: s + r["stop"] - r["start"])


def extraction(nodes: Column) -> Column:
    """(title, title_source, text, markdown, source, selector, confidence, title_confidence, overall, attempts) of a page.

    Noise is taken out first; the title is that of the first source that has one, the content that of
    the first container with more than 100 characters of markup, else of the body. attempts lists all
    sources of title and content that were tried, in order.
    """

    def over(clean: Column, gone: Column) -> Column:
        titles = [(s, q, c, trimmed(attr(first(clean, q), "content") if s == "og_title" else raw_text(clean, first(clean, q)))) for s, q, c in TITLES]
        boxes = [(s, q, c, first(clean, q)) for s, q, c in CONTAINERS]
        has = lambda t: F.coalesce(t, F.lit("")) != ""
        tried = F.array(*[F.struct(F.lit("title").alias("part"), F.lit(s).alias("source"), F.lit(q).alias("selector"), has(t).alias("usable"), F.coalesce(F.length(t), F.lit(0)).alias("length"), F.lit(c).alias("confidence")) for s, q, c, t in titles])
        placed = F.array(*[F.struct(F.lit("content").alias("part"), F.lit(s).alias("source"), F.lit(q).alias("selector"), F.lit(True).alias("usable"), F.coalesce(markup_length(clean, x, gone), F.lit(0)).alias("length"), F.lit(c).alias("confidence")) for s, q, c, x in boxes])
        placed = F.transform(placed, lambda a: a.withField("usable", a["length"] > LEAST_MARKUP))
        name, box, conf = FALLBACK
        fallback = F.struct(F.lit("content").alias("part"), F.lit(name).alias("source"), F.lit(box).alias("selector"), F.lit(True).alias("usable"), markup_length(clean, body(clean), gone).alias("length"), F.lit(conf).alias("confidence"))
        nothing = F.struct(F.lit("title").alias("part"), F.lit("unknown").alias("source"), F.lit("none").alias("selector"), F.lit(True).alias("usable"), F.lit(0).alias("length"), F.lit(0.0).alias("confidence"))

        def chosen(t: Column, p: Column) -> Column:
            pick = lambda a, rest: F.coalesce(F.get(F.filter(a, lambda x: x["usable"]), F.lit(0)), rest)
            title, content = pick(t, nothing), pick(p, fallback)
            of = lambda pairs, by, rest: F.coalesce(*[F.when(by == s, v) for s, v in pairs], rest)

            def filled(box: Column) -> Column:
                return F.struct(
                    of([(s, x) for s, _, _, x in titles], title["source"], F.lit("")).alias("title"),
                    title["source"].alias("title_source"),
                    squeezed(raw_text(clean, box)).alias("text"),
                    markdown(clean, box).alias("markdown"),
                    content["source"].alias("source"),
                    content["selector"].alias("selector"),
                    title["confidence"].alias("title_confidence"),
                    content["confidence"].alias("confidence"),
                    F.round(TITLE_SHARE * title["confidence"] + (1 - TITLE_SHARE) * content["confidence"], 6).alias("overall"),
                    F.concat(
                        t,
                        F.when(title["source"] == "unknown", F.array(nothing)).otherwise(F.slice(t, 1, 0)),
                        p,
                        F.when(content["source"] == name, F.array(fallback)).otherwise(F.slice(p, 1, 0)),
                    ).alias("attempts"),
                )

            return let(of([(s, x) for s, _, _, x in boxes], content["source"], body(clean)), filled)

        return let(tried, lambda t: let(placed, lambda p: chosen(t, p)))

    return let(select(nodes, NOISE), lambda gone: let(F.filter(nodes, lambda n: ~F.exists(gone, lambda x: (n["node"] == x["node"]) | inside(n, x))), lambda clean: over(clean, gone)))


def rows_of(nodes: Column, selectors: dict[str, str]) -> Column:
    """Array of structs, from all nodes of a page: the nth match of each selector side by side, as many as the first one has; a match's text, else its href, else its src."""

    def value(x: Column) -> Column:
        return F.coalesce(F.nullif(text_of(nodes, x, True), F.lit("")), attr(x, "href"), attr(x, "src"))

    matches = F.array(*[F.transform(select(nodes, s), value) for s in selectors.values()])
    return let(matches, lambda m: F.transform(m[0], lambda _, i: F.struct(*[F.get(m[k], i).alias(name) for k, name in enumerate(selectors)])))


# ---- markdown

_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_BLOCK = ("p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "blockquote", "figure", "dl", "table", "caption", "form")


def markdown(nodes: Column, x: Column) -> Column:
    """What is inside a node as Markdown: headings with #, lists, links, images, emphasis, code, quotes and tables with a line under the head."""
    tag = lambda n: n["tag"]
    level = lambda n: F.substring(tag(n), 2, 1).cast("int")
    heading = lambda n: tag(n).rlike("^h[1-6]$")
    wrap = lambda n: F.coalesce(*[F.when(tag(n) == t, F.lit(w)) for t, w in _WRAP.items()])

    def opening(n: Column, parents: Column) -> Column:
        up = F.get(F.filter(parents, lambda p: p["node"] == n["parent"]), F.lit(0))
        number = F.coalesce(F.try_element_at(up["attrs"], F.lit("start")).try_cast("int"), F.lit(1)) + n["nth"] - 1
        bullet = F.when(tag(up) == "ol", F.concat(number.cast("string"), F.lit(".  "))).otherwise(F.lit("*   "))
        words = F.when(n["pre"], n["text"]).otherwise(F.regexp_replace(n["text"], r"[ \t\r\n]+", " "))
        return (
            F.when(tag(n) == "#text", words)
            .when(tag(n) == "p", F.lit("\n\n"))
            .when(heading(n), F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level(n)), F.lit(" ")))
            .when(tag(n) == "li", F.concat(F.lit("\n"), F.repeat(F.lit("    "), F.greatest(n["lists"] - 1, F.lit(0))), bullet))
            .when(tag(n) == "br", F.lit("  \n"))
            .when(tag(n) == "hr", F.lit("\n\n* * *\n\n"))
            .when(tag(n) == "pre", F.lit("\n\n```\n"))
            .when((tag(n) == "a") & attr(n, "href").isNotNull(), F.lit("["))
            .when((tag(n) == "img") & attr(n, "src").isNotNull(), F.concat(F.lit("!["), F.coalesce(attr(n, "alt"), F.lit("")), F.lit("]("), attr(n, "src"), F.lit(")")))
            .when(tag(n).isin("td", "th"), F.lit(" "))
            .when(tag(n) == "tr", F.lit("\n|"))
            .when((tag(n) == "code") & n["pre"], F.lit(""))
            .when(wrap(n).isNotNull(), wrap(n))
            .when(tag(n) == "blockquote", F.lit("\n\n> "))
            .when(tag(n).isin("ul", "ol"), F.when(n["lists"] == 0, F.lit("\n\n")).otherwise(F.lit("")))
            .when(tag(n).isin(*_BLOCK), F.lit("\n\n"))
            .otherwise(F.lit(""))
        )

    def closing(n: Column, cells: Column) -> Column:
        heads = F.size(F.filter(cells, lambda c: (c["parent"] == n["node"]) & (c["tag"] == "th")))
        return (
            F.when((tag(n) == "p") | heading(n), F.lit("\n\n"))
            .when(tag(n) == "pre", F.lit("\n```\n\n"))
            .when((tag(n) == "a") & attr(n, "href").isNotNull(), F.concat(F.lit("]("), attr(n, "href"), F.lit(")")))
            .when(tag(n).isin("td", "th"), F.lit(" |"))
            .when((tag(n) == "tr") & (n["nth"] == 1) & (heads > 0), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), heads)))
            .when((tag(n) == "code") & n["pre"], F.lit(""))
            .when(wrap(n).isNotNull(), wrap(n))
            .when(tag(n).isin("ul", "ol"), F.when(n["lists"] == 0, F.lit("\n\n")).otherwise(F.lit("")))
            .when(tag(n).isin(*_BLOCK), F.lit("\n\n"))
            .otherwise(F.lit(""))
        )

    def over(sub: Column) -> Column:
        elements = F.filter(sub, lambda n: n["tag"] != "#text")
        cells = F.filter(sub, lambda n: n["tag"].isin("td", "th"))
        parents = F.filter(sub, lambda n: n["tag"].isin("ul", "ol"))
        # what opens stands at a node, what closes behind the last node inside it, the innermost first
        event = lambda at, kind, order, s: F.struct(at.alias("at"), F.lit(kind).alias("kind"), order.alias("order"), s.alias("s"))
        opens = let(parents, lambda p: F.transform(sub, lambda n: event(n["node"], 0, F.lit(0), opening(n, p))))
        closes = let(cells, lambda c: F.transform(elements, lambda n: event(n["last"], 1, -n["node"], closing(n, c))))
        return F.array_join(F.transform(F.array_sort(F.concat(opens, closes)), lambda e: e["s"]), "")

    text = let(within(nodes, x), over)
    text = F.regexp_replace(text, r"[ \t]*\n(?:[ \t]*\n)+\s*?(?=\S|\z)", "\n\n")
    return trimmed(text)
