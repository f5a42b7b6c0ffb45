"""Articles, tables and links of pages, over the node arrays of operators.nodes, as these give them.

Defined results: pages without nodes are no articles and have no tables or links; what is not found is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import selectors as q

#: Types of schema.org that are articles; where author, dates, tags, category and content are looked for, in order.
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
AUTHOR_METAS = ('meta[name="author"]', 'meta[property="article:author"]', 'meta[name="byl"]')
AUTHORS = (".author-name", ".author", ".byline", '[rel="author"]', '[itemprop="author"]', ".post-author", ".entry-author")
DATE_METAS = ('meta[property="article:published_time"]', 'meta[name="publish-date"]', 'meta[name="date"]', 'meta[property="og:published_time"]', 'meta[itemprop="datePublished"]')
CHANGE_METAS = ('meta[property="article:modified_time"]', 'meta[name="last-modified"]', 'meta[property="og:updated_time"]', 'meta[itemprop="dateModified"]')
TAGS = '.tags a, .tag, [rel="tag"], .post-tags a'
CONTENTS = ("article", '[itemprop="articleBody"]', ".post-content", ".article-content", ".entry-content", ".article-body", "main article", ".content article")
CONTENT_NOISE = "nav, aside, .related-posts, .advertisement, .comments, .sidebar, .social-share"
PAGE_NOISE = 'script, style, noscript, iframe, svg, nav, footer, aside, header, [class*="cookie"], [class*="banner"], [class*="popup"], [class*="modal"], [class*="sidebar"], [class*="advertisement"], [class*="social"]'
PAGE_CONTENT = 'main, article, [role="main"], .content, #content, .post, .article'
#: Indicators that make an article; least text of its content; words read a minute; least text of a valid page.
LEAST_INDICATORS, LEAST_CONTENT, PACE, LEAST_VALID = 3, 200, 200, 100


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s ]+"), lambda w: w != ""))


def body_words(nodes: Column, few: Column | None = None) -> Column:
    return q.let(q.body_extent(nodes, few), lambda b: words(q.raw_text(nodes, b, True)))


def has_schema_type(nodes: Column, *types: str, few: Column | None = None) -> Column:
    """Whether a page's JSON-LD names one of the types, in a node or one of its graph."""
    bodies = F.transform(q.select(nodes if few is None else few, 'script[type="application/ld+json"]'), lambda s: q.raw_text(nodes, s, True))
    wanted = F.array(*map(F.lit, types))

    def one(v: Column) -> Column:
        kind = F.get_json_object(v, "$['@type']")
        listed = F.coalesce(F.from_json(kind, "array<string>"), F.array(kind))
        return F.coalesce(F.arrays_overlap(listed, wanted), F.lit(False))

    graph = lambda v: F.coalesce(F.from_json(F.get_json_object(v, "$['@graph']"), "array<string>"), F.slice(F.array(v), 1, 0))
    return F.exists(bodies, lambda v: one(v) | F.exists(graph(v), one))


def instant(text: Column) -> Column:
    """A time written as in ISO 8601, in UTC, or null."""
    return F.try_to_timestamp(q.filled(F.trim(text)))


def first_date(nodes: Column, metas: tuple[str, ...]) -> Column:
    """The content of the first of some metas that is there, as a time."""
    return instant(q.meta(nodes, *metas))


def published(nodes: Column) -> Column:
    tagged = F.coalesce(q.attr(q.first(nodes, "time[datetime]"), "datetime"), q.attr(q.first(nodes, '[itemprop="datePublished"]'), "content"))
    return F.coalesce(first_date(nodes, DATE_METAS), instant(tagged))


def modified(nodes: Column) -> Column:
    return first_date(nodes, CHANGE_METAS)


def author(nodes: Column, few: Column | None = None) -> Column:
    """From metadata, else the first selector whose first match has 1 to 99 characters, without words like `by` before the name."""
    if few is None:
        return q.let(q.marked(nodes), lambda few: author(nodes, few))
    found = [q.text_of(nodes, q.first(few, s), True) for s in AUTHORS]
    named = F.coalesce(*[q.let(t, lambda t: F.when((F.length(t) > 0) & (F.length(t) < 100), t)) for t in found])
    return F.coalesce(q.meta(few, *AUTHOR_METAS), F.trim(F.regexp_replace(named, r"(?i)^(?:by|written by|author:|posted by)\s*", "")))


def tags(nodes: Column, few: Column | None = None) -> Column:
    """Distinct tags, as they first come: keywords, article tags, then tags of fewer than 50 characters on the page."""
    if few is None:
        return q.let(q.marked(nodes), lambda few: tags(nodes, few))
    keywords = F.split(F.coalesce(q.attr(q.first(few, 'meta[name="keywords"]'), "content"), F.lit("")), ",")
    listed = F.transform(q.select(few, 'meta[property="article:tag"]'), lambda m: q.attr(m, "content"))
    shown = F.filter(F.transform(q.select(few, TAGS), lambda x: q.text_of(nodes, x, True)), lambda t: F.length(t) < 50)
    found = F.concat(F.transform(F.concat(keywords, listed), lambda t: F.trim(t)), shown)
    return F.array_distinct(F.filter(found, lambda t: F.coalesce(t, F.lit("")) != ""))


def category(nodes: Column, few: Column | None = None) -> Column:
    few = nodes if few is None else few
    text = lambda s: q.filled(q.text_of(nodes, q.first(few, s), True))
    return F.coalesce(q.meta(few, 'meta[property="article:section"]'), text(".category"), text(".post-category"))


def article_structure(nodes: Column, n: Column | None = None, few: Column | None = None) -> Column:
    """Of a number of words, or those of the body: more than 500 words, more than 5 paragraphs, 2 headings or more, fewer than half a link a hundred words."""
    count = lambda s, nodes=nodes if few is None else few: F.size(q.select(nodes, s))
    return q.let(body_words(nodes) if n is None else n, lambda n: (n > 500) & (count("p", nodes) > 5) & (count("h1, h2, h3, h4, h5, h6") >= 2) & (count("a") < 0.5 * n / 100))


def main_content(nodes: Column, few: Column | None = None) -> Column:
    """Markdown of the first place for content with more than 200 characters, cleaned; else of the largest block."""
    if few is None:
        return q.let(q.marked(nodes), lambda few: main_content(nodes, few))

    def cleaned(x: Column) -> Column:
        return q.let(q.without(nodes, q.select(q.within(few, x), CONTENT_NOISE)), lambda clean: q.markdown(clean, x))

    def good(places: Column) -> Column:
        # places that several selectors find are looked at once, and the Markdown of a place is made once
        distinct = F.filter(places, lambda x, i: x.isNotNull() & ~F.exists(F.slice(places, F.lit(1), i), lambda y: F.coalesce(y["node"] == x["node"], F.lit(False))))
        full = F.filter(distinct, lambda x: F.length(q.text_of(nodes, x, True)) > LEAST_CONTENT)
        # once a place is good those behind it are not made
        return F.aggregate(full, F.lit(None).cast("string"), lambda held, x: F.coalesce(held, q.let(cleaned(x), lambda t: F.when(F.length(t) > LEAST_CONTENT, t))))

    sized = F.transform(q.select(few, "div, section, main"), lambda x: F.struct(F.length(q.text_of(nodes, x, True)).alias("n"), (-x["node"]).alias("at")))
    largest = q.let(F.array_max(sized), lambda best: F.when(best["n"] > 0, q.markdown(nodes, F.get(nodes, -best["at"]))))
    return F.coalesce(q.let(F.array(*[q.first(few, s) for s in CONTENTS]), good), largest, F.lit(""))


#: What can be asked of an article beside whether it is one.
ARTICLE = ("author", "published", "modified", "tags", "category", "content", "words", "minutes")


def article(nodes: Column, *parts: str) -> Column:
    """(is_article, indicators, author, published, modified, tags, category, content, words, minutes); all but the first two null where it is none. Of the others only those named are made, or all."""

    def over(few: Column) -> Column:
        by = lambda: F.size(q.select(few, '.author, .byline, [rel="author"]')) + F.size(q.select(few, 'meta[name="author"]'))
        first_of_all = F.struct(published(few).alias("published"), body_words(nodes, few).alias("words"))
        signs = lambda known: [
            F.size(q.select(few, "article")) > 0,
            has_schema_type(nodes, *ARTICLE_TYPES, few=few),
            F.coalesce(q.attr(q.first(few, 'meta[property="og:type"]'), "content") == "article", F.lit(False)),
            by() > 0,
            known["published"].isNotNull(),
            article_structure(nodes, known["words"], few),
        ]
        indicators = lambda known: F.aggregate(F.array(*signs(known)), F.lit(0), lambda n, s: n + s.cast("int"))

        def told(known: Column, n: Column) -> Column:
            made = {
                "author": lambda: author(nodes, few),
                "published": lambda: known["published"],
                "modified": lambda: modified(few),
                "tags": lambda: tags(nodes, few),
                "category": lambda: category(nodes, few),
                "content": lambda: main_content(nodes, few),
                "words": lambda: known["words"],
                "minutes": lambda: F.ceil(known["words"] / PACE),
            }
            return F.struct((n >= LEAST_INDICATORS).alias("is_article"), n.alias("indicators"), *[F.when(n >= LEAST_INDICATORS, made[name]()).alias(name) for name in parts or ARTICLE])

        return q.let(first_of_all, lambda known: q.let(indicators(known), lambda n: told(known, n)))

    return q.let(q.marked(nodes), over)


def static_page(nodes: Column) -> Column:
    """(title, text, markdown, is_article) of a page: an article's content, else the first container of the page without noise, else its body."""

    def over(a: Column, clean: Column, few: Column) -> Column:
        first = lambda s: q.filled(q.text_of(clean, q.first(few, s)))
        title = F.coalesce(first("title"), first("h1"), q.meta(few, 'meta[property="og:title"]'), F.lit(""))
        told = a["is_article"] & (F.coalesce(a["content"], F.lit("")) != "")
        box = F.coalesce(q.extent(q.first(few, PAGE_CONTENT)), q.body_extent(clean, few))
        text = q.let(box, lambda x: F.struct(q.squeezed(q.raw_text(clean, x)).alias("text"), q.markdown(clean, x).alias("markdown")))
        whole = F.when(told, F.struct(q.squeezed(a["content"]).alias("text"), a["content"].alias("markdown"))).otherwise(text)
        return q.let(whole, lambda t: F.struct(title.alias("title"), t["text"].alias("text"), t["markdown"].alias("markdown"), a["is_article"].alias("is_article")))

    clean = q.without(nodes, q.select(nodes, PAGE_NOISE))
    return q.let(article(nodes, "content"), lambda a: q.let(clean, lambda c: q.let(q.marked(c), lambda few: over(a, c, few))))


def structured_page(nodes: Column) -> Column:
    """(title, text) of a page's JSON-LD, else of its Open Graph data; nulls where it has neither."""

    def over(few: Column, script: Column) -> Column:
        value = lambda *paths: F.coalesce(*[q.filled(F.trim(F.get_json_object(script, p))) for p in paths])
        title = F.coalesce(value("$.headline", "$.name"), q.meta(few, 'meta[property="og:title"]'))
        text = F.coalesce(value("$.articleBody", "$.description"), q.meta(few, 'meta[property="og:description"]'))
        return F.struct(title.alias("title"), text.alias("text"))

    return q.let(q.marked(nodes), lambda few: q.let(q.text_of(nodes, q.first(few, 'script[type="application/ld+json"]'), True), lambda script: over(few, script)))


def by_strategy(strategies: dict[str, Column], least: int = LEAST_VALID) -> Column:
    """(strategy, title, text, tried, failed) of the first strategy whose text has so many characters.

    A strategy is a column of (title, text); tried lists the names up to the one that holds, failed
    those before it with the length that they came to.
    """
    # each strategy is worked out once, whatever is taken of it
    result = lambda name, r: q.let(r, lambda r: F.struct(F.lit(name).alias("strategy"), r["title"].alias("title"), r["text"].alias("text"), F.coalesce(F.length(r["text"]), F.lit(0)).alias("length")))
    results = F.array(*[result(name, r) for name, r in strategies.items()])

    def told(found: Column) -> Column:
        places = F.transform(found, lambda r, i: F.when(r["length"] >= least, i))
        at = F.array_min(F.filter(places, lambda i: i.isNotNull()))
        best = F.get(found, at)
        before = F.slice(found, F.lit(1), F.coalesce(at, F.size(found)))
        tried = F.slice(found, F.lit(1), F.coalesce(at + 1, F.size(found)))
        return F.struct(best["strategy"].alias("strategy"), best["title"].alias("title"), best["text"].alias("text"), F.transform(tried, lambda r: r["strategy"]).alias("tried"), F.transform(before, lambda r: F.concat_ws(":", r["strategy"], r["length"].cast("string"))).alias("failed"))

    return q.let(results, told)


# ---- tables and links


def tables(nodes: Column) -> Column:
    """Array of (caption, id, headers, rows) of all tables that have cells; a nested table is one of its own, and its rows are not those of the outer one.

    Headers are the cells of the first row of a head, else the header cells of the first row; rows are
    those of the bodies that are marked, else all but a row of headers.
    """

    def over(all_tables: Column, rows: Column, captions: Column) -> Column:
        def table(t: Column) -> Column:
            nested = F.filter(all_tables, lambda x: q.inside(x, t))
            own = lambda xs, nested: F.filter(xs, lambda x: q.inside(x, t) & ~F.exists(nested, lambda o: q.inside(x, o)))
            texts = lambda xs: F.transform(xs, lambda c: q.text_of(nodes, c, True))

            def filled(r: Column) -> Column:
                part = lambda x: F.get(nodes, x["parent"])["tag"]
                # a row's cells are among the nodes inside it, so other rows' cells are not touched
                held = lambda x: F.when(x["last"] > x["node"], F.sequence(x["node"] + 1, x["last"])).otherwise(F.array().cast("array<int>"))
                of = lambda x: F.filter(F.transform(held(x), lambda i: F.get(nodes, i)), lambda c: (c["parent"] == x["node"]) & F.lower(c["tag"]).isin("td", "th"))
                head = F.get(F.filter(r, lambda x: part(x) == "thead"), F.lit(0))
                top = F.get(r, F.lit(0))
                heading = lambda x: F.filter(of(x), lambda c: c["tag"] == "th")
                # the rows of a head are looked for once, not for each cell
                headers = q.let(head, lambda x: F.when(x.isNotNull(), texts(of(x))).otherwise(q.let(top, lambda y: texts(heading(y)))))
                bodies = F.filter(r, lambda x: part(x) == "tbody")

                def told(headers: Column) -> Column:
                    plain = F.filter(r, lambda x: ~((x["node"] == top["node"]) & (F.size(headers) > 0)))
                    return F.struct(
                        q.text_of(nodes, F.get(own(captions, nested), F.lit(0)), True).alias("caption"),
                        t["id"].alias("id"),
                        headers.alias("headers"),
                        F.filter(F.transform(q.let(bodies, lambda b: F.when(F.size(b) > 0, b).otherwise(plain)), lambda x: texts(of(x))), lambda x: F.size(x) > 0).alias("rows"),
                    )

                return q.let(F.coalesce(headers, F.array().cast("array<string>")), told)

            return q.let(nested, lambda nested: q.let(own(rows, nested), filled))

        return F.filter(F.transform(all_tables, table), lambda t: (F.size(t["rows"]) > 0) | (F.size(t["headers"]) > 0))

    return q.let(q.select(nodes, "table"), lambda t: q.let(q.select(nodes, "tr"), lambda r: q.let(q.select(nodes, "caption"), lambda k: over(t, r, k))))


def records(table: Column) -> Column:
    """A table's rows as maps from header to cell; headers without text are `column_` and their place from 0, cells that lack are empty, of equal headers the last counts; none without headers."""
    key = lambda h, i: F.when(h == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(h)

    def told(t: Column) -> Column:
        keys = F.transform(t["headers"], key)
        # of equal keys only the last is kept
        return q.let(keys, lambda k: F.transform(t["rows"], lambda r: F.map_from_entries(F.filter(F.transform(k, lambda h, i: F.struct(h.alias("key"), F.when(F.array_position(F.reverse(k), h) == F.size(k) - i, F.coalesce(F.get(r, i), F.lit(""))).alias("value"))), lambda e: e["value"].isNotNull()))))

    return q.let(table, lambda t: F.when(F.size(t["headers"]) > 0, told(t)).otherwise(F.slice(told(t), 1, 0)))


def table_with(found: Column, ident: str | None = None, caption: str | None = None, header: str | None = None) -> Column:
    """The first table with the id, or words in its caption, or words in its headers, whatever their case; or null."""
    near = lambda x, words: F.coalesce(F.contains(F.lower(x), F.lit(words.lower())), F.lit(False))

    def good(t: Column) -> Column:
        out = F.lit(False)
        if ident is not None:
            out = out | F.coalesce(t["id"] == ident, F.lit(False))
        if caption is not None:
            out = out | near(t["caption"], caption)
        if header is not None:
            out = out | near(F.array_join(t["headers"], " "), header)
        return out

    return F.get(F.filter(found, good), F.lit(0))


def links(nodes: Column) -> Column:
    """Array of (href, text, context) of anchors that lead off the page; context is the first 200 characters of the text around them."""

    def one(a: Column) -> Column:
        around = F.get(nodes, F.when(a["parent"] >= 0, a["parent"]))
        context = q.let(around, lambda x: F.substring(q.text_of(nodes, x, True), 1, 200))
        return F.struct(q.attr(a, "href").alias("href"), q.text_of(nodes, a, True).alias("text"), context.alias("context"))

    real = F.filter(q.select(nodes, "a[href]"), lambda a: (q.attr(a, "href") != "") & ~q.attr(a, "href").rlike("^(?:#|javascript:)"))
    return F.transform(real, one)
