"""Column functions over markup and hypermedia: metadata, structured data, links, sitemaps and robots files.

All are built from regular expressions and JSON functions of the engine; malformed input gives empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import selectors as q
from sparkloom.functions.url import resolved

NAMED = "struct<name:string,content:string>"
LINK = "struct<rel:string,href:string,title:string>"
HINT = "struct<path:string,type:string,score:double>"
#: Elements of Dublin Core; types of articles and organisations.
DUBLIN_CORE = "title creator subject description publisher contributor date type format identifier source language relation coverage rights".split()
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle")
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness", "Store", "Restaurant")
#: Relations of links to documentation and to parts of an interface.
DOCUMENTATION_RELATIONS = ("describedby", "service-doc", "documentation", "help")
API_RELATIONS = ("api", "service", "self", "collection", "item", "search", "create-form", "edit-form")
#: Paths of robots files and URLs of sitemaps that hint at an interface (pattern, type, score); the first that matches holds.
ROBOTS_HINTS = (
    (r"^/api/?$", "api-path", 0.7),
    (r"^/api/", "api-path", 0.6),
    (r"^/v\d+/?$", "api-path", 0.6),
    (r"^/v\d+/", "api-path", 0.5),
    (r"^/rest/?$", "api-path", 0.6),
    (r"^/rest/", "api-path", 0.5),
    (r"/graphql/?$", "graphql", 0.8),
    (r"/gql/?$", "graphql", 0.7),
    (r"/(?:swagger|openapi)\.(?:json|yaml)$", "spec-file", 0.9),
    (r"/api-docs$", "spec-file", 0.7),
    (r"/api\.json$", "spec-file", 0.6),
    (r"^/docs/?$", "documentation", 0.5),
    (r"^/documentation/?$", "documentation", 0.5),
    (r"^/api-docs/?$", "documentation", 0.7),
    (r"/developers?/?$", "developer-portal", 0.6),
    (r"^/dev/?$", "developer-portal", 0.5),
)
SITEMAP_HINTS = (
    (r"/api[-_]?docs?/|/docs/api|/documentation/api", "documentation", 0.7),
    (r"/api/docs", "documentation", 0.6),
    (r"/reference/", "documentation", 0.5),
    (r"/api-reference", "documentation", 0.7),
    (r"/developers?/", "developer-portal", 0.6),
    (r"/dev-portal", "developer-portal", 0.7),
    (r"/dev/", "developer-portal", 0.4),
    (r"/swagger|/openapi|/asyncapi", "spec-file", 0.8),
)


# ---- pages, as the node arrays of operators.nodes


def metas(nodes: Column) -> Column:
    """Array of (name, content) of meta elements; the name is the property, else the name, else the http-equiv; empty values do not count."""
    value = lambda t, n: F.nullif(q.attr(t, n), F.lit(""))
    name = lambda t: F.coalesce(value(t, "property"), value(t, "name"), value(t, "http-equiv"))
    pairs = F.transform(q.select(nodes, "meta"), lambda t: F.struct(name(t).alias("name"), value(t, "content").alias("content")))
    return F.filter(pairs, lambda x: x["name"].isNotNull() & x["content"].isNotNull())


def value_of(pairs: Column, *names: str) -> Column:
    """The last content under the first of the names that has one."""
    last = lambda n: F.try_element_at(F.filter(pairs, lambda x: x["name"] == n), F.lit(-1))["content"]
    return F.coalesce(*map(last, names))


def prefixed(pairs: Column, prefix: str) -> Column:
    """The pairs whose name starts with a prefix, without it."""
    found = F.filter(pairs, lambda x: F.startswith(F.lower(x["name"]), F.lit(prefix)))
    return F.transform(found, lambda x: F.struct(F.substr(x["name"], F.lit(len(prefix) + 1)).alias("name"), x["content"].alias("content")))


def camel(name: Column) -> Column:
    """site_name as siteName, image:width as imageWidth."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.split(name, "[:_]"), lambda w, i: F.when(i == 0, w).otherwise(capital(w))), "")


def open_graph(nodes: Column) -> Column:
    """(name, content) pairs of Open Graph without images, names in camel case, and the images under image."""
    found = prefixed(metas(nodes), "og:")
    return F.transform(found, lambda x: F.struct(F.when(x["name"].isin("image", "image:url"), "image").otherwise(camel(x["name"])).alias("name"), x["content"].alias("content")))


def twitter_card(nodes: Column) -> Column:
    return prefixed(metas(nodes), "twitter:")


def dublin_core(nodes: Column) -> Column:
    """(name, content) pairs of Dublin Core, under dc. or dcterms."""
    found = F.filter(metas(nodes), lambda x: x["name"].rlike("^(?i)(?:dc|dcterms)\\."))
    named = F.transform(found, lambda x: F.struct(F.lower(F.element_at(F.split(x["name"], r"\."), -1)).alias("name"), x["content"].alias("content")))
    return F.filter(named, lambda x: x["name"].isin(*DUBLIN_CORE))


def items(nodes: Column, kind: str, prop: str) -> Column:
    """Array of (type, name, content): properties of microdata or RDFa with the type of the nearest element around them that has one.

    A property that is an item of its own has no content; others have their content, href, src or text.
    """

    def pairs(owners: Column) -> Column:
        def pair(x: Column) -> Column:
            owner = F.try_element_at(F.filter(owners, lambda o: q.inside(x, o)), F.lit(-1))
            value = F.coalesce(q.attr(x, "content"), q.attr(x, "href"), q.attr(x, "src"), F.nullif(q.squeezed(q.raw_text(nodes, x, True)), F.lit("")))
            own = F.element_at(F.split(q.attr(owner, kind), "/"), -1)
            return F.struct(own.alias("type"), q.attr(x, prop).alias("name"), value.alias("content"))

        plain = F.filter(q.select(nodes, f"[{prop}]"), lambda x: q.attr(x, kind).isNull())
        return F.transform(plain, pair)

    found = q.let(q.select(nodes, f"[{kind}]"), pairs)
    return F.filter(found, lambda x: x["type"].isNotNull() & x["name"].isNotNull() & x["content"].isNotNull())


def microdata(nodes: Column) -> Column:
    return items(nodes, "itemtype", "itemprop")


def rdfa(nodes: Column) -> Column:
    return items(nodes, "typeof", "property")


def title(nodes: Column) -> Column:
    """Open Graph title, else title element, else first heading."""
    inner = lambda t: F.nullif(q.squeezed(q.raw_text(nodes, q.first(nodes, t))), F.lit(""))
    return F.coalesce(value_of(metas(nodes), "og:title"), inner("title"), inner("h1"))


def link_elements(nodes: Column, base: Column) -> Column:
    """Array of (rel, href, title) of link elements, one a relation."""
    each = lambda t: F.transform(F.split(F.lower(q.attr(t, "rel")), r"\s+"), lambda r: F.struct(r.alias("rel"), resolved(base, q.attr(t, "href")).alias("href"), q.attr(t, "title").alias("title")))
    return kept(F.flatten(F.transform(q.select(nodes, "link[rel]"), each)))


def anchors(nodes: Column, base: Column) -> Column:
    """Array of (href, text) of anchors that lead somewhere."""
    real = F.filter(q.select(nodes, "a[href]"), lambda x: ~q.attr(x, "href").rlike("^(?i)(?:#|javascript:|mailto:|tel:|$)"))
    return F.transform(real, lambda x: F.struct(resolved(base, q.attr(x, "href")).alias("href"), q.squeezed(q.raw_text(nodes, x, True)).alias("text")))


def link_header(header: Column, base: Column) -> Column:
    """Array of (rel, href, title) of a Link header, one a relation."""
    parts = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"<[^>]*>(?:\s*;\s*[a-zA-Z*-]+\s*=\s*(?:\"[^\"]*\"|[^\s,;\"]+))*"), F.lit(0))

    def each(p: Column) -> Column:
        param = lambda n: F.nullif(F.regexp_extract(p, rf"(?i);\s*{n}\s*=\s*\"?([^\";,]*)", 1), F.lit(""))
        rels = F.split(F.lower(F.coalesce(param("rel"), F.lit("related"))), r"\s+")
        return F.transform(rels, lambda r: F.struct(r.alias("rel"), resolved(base, F.regexp_extract(p, "^<([^>]*)>", 1)).alias("href"), param("title").alias("title")))

    return kept(F.flatten(F.transform(parts, each)))


def unescaped(text: Column) -> Column:
    """The named character references of XML decoded."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


# ---- JSON


def as_list(json: Column) -> Column:
    """The elements of a JSON array as texts, or the one value that it is."""
    return F.when(json.isNull(), F.array().cast("array<string>")).when(json.rlike(r"^\s*\["), F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(json))


def field(json: Column, *paths: str) -> Column:
    """The first of some JSON paths that is there, as text."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def entries(json: Column) -> Column:
    """The members of a JSON object as (key, value) texts."""
    return F.coalesce(F.map_entries(F.from_json(json, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def json_ld(page: Column) -> Column:
    """The nodes of a page's JSON-LD as JSON texts, graphs and lists taken apart."""
    bodies = F.transform(q.select(page, 'script[type="application/ld+json"]'), lambda x: q.raw_text(page, x, True))
    nodes = F.flatten(F.transform(bodies, as_list))
    graph = lambda n: F.get_json_object(n, "$['@graph']")
    apart = lambda n, g: F.when(g.isNotNull(), as_list(g)).when(n.rlike(r"^\s*\{") & F.get_json_object(n, "$").isNotNull(), F.array(n)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(nodes, lambda n: q.let(graph(n), lambda g: apart(n, g))))


def first_of_type(nodes: Column, types: Sequence[str]) -> Column:
    wanted = F.array(*map(F.lit, types))
    return F.try_element_at(F.filter(nodes, lambda n: F.arrays_overlap(as_list(F.get_json_object(n, "$['@type']")), wanted)), F.lit(1))


def product(page: Column) -> Column:
    """(name, brand, sku, price, currency, availability, rating) of a page's product: from JSON-LD, else microdata, else metadata."""
    known = F.struct(first_of_type(json_ld(page), ["Product"]).alias("node"), metas(page).alias("pairs"), microdata(page).alias("data"))

    def told(known: Column) -> Column:
        node, pairs, data = known["node"], known["pairs"], known["data"]
        offer = F.try_element_at(as_list(F.get_json_object(node, "$.offers")), F.lit(1))
        item = lambda n: F.try_element_at(F.filter(data, lambda x: x["name"] == n), F.lit(1))["content"]
        by_item = F.exists(data, lambda x: x["type"] == "Product")
        by_meta = F.coalesce(value_of(pairs, "og:type") == "product", F.lit(False)) | value_of(pairs, "product:price:amount").isNotNull()
        brand = F.get_json_object(node, "$.brand")

        def pick(from_node: Column, from_item: Column, from_meta: Column) -> Column:
            return F.when(node.isNotNull(), from_node).when(by_item, from_item).when(by_meta, from_meta)

        none = F.lit(None).cast("string")
        return F.struct(
            pick(field(node, "$.name"), item("name"), value_of(pairs, "og:title", "product:name")).alias("name"),
            pick(F.coalesce(F.get_json_object(node, "$.brand.name"), brand), item("brand"), value_of(pairs, "product:brand")).alias("brand"),
            pick(field(node, "$.sku"), item("sku"), none).alias("sku"),
            pick(field(offer, "$.price"), item("price"), value_of(pairs, "product:price:amount")).try_cast("double").alias("price"),
            pick(F.coalesce(field(offer, "$.priceCurrency"), F.when(offer.isNotNull(), "USD")), item("priceCurrency"), value_of(pairs, "product:price:currency")).alias("currency"),
            pick(field(offer, "$.availability"), item("availability"), value_of(pairs, "product:availability")).alias("availability"),
            pick(field(node, "$.aggregateRating.ratingValue"), none, none).try_cast("double").alias("rating"),
        )

    # each of the three is read once a page, whatever is taken of it
    return q.let(known, told)


def article(page: Column) -> Column:
    """(headline, author, published, section, keywords) of a page's article: from JSON-LD, else microdata, else metadata."""
    node, pairs, data = first_of_type(json_ld(page), ARTICLES), metas(page), microdata(page)
    one = lambda n: F.try_element_at(F.filter(data, lambda x: x["name"] == n), F.lit(1))["content"]
    item = lambda *names: F.coalesce(*map(one, names))
    by_item = F.exists(data, lambda x: x["type"].isin(*ARTICLES))
    by_meta = F.coalesce(value_of(pairs, "og:type") == "article", F.lit(False))
    pick = lambda a, b, c: F.when(node.isNotNull(), a).when(by_item, b).when(by_meta, c)
    names = F.array_join(F.transform(as_list(F.get_json_object(node, "$.author")), lambda a: F.when(a.rlike(r"^\s*\{"), F.get_json_object(a, "$.name")).otherwise(a)), ", ")
    words = F.get_json_object(node, "$.keywords")
    listed = F.when(words.rlike(r"^\s*\["), as_list(words)).otherwise(F.transform(F.split(words, ","), lambda w: F.trim(w)))
    none = F.lit(None).cast("string")
    return F.struct(
        pick(field(node, "$.headline", "$.name"), item("headline", "name"), value_of(pairs, "og:title")).alias("headline"),
        pick(F.nullif(names, F.lit("")), item("author"), value_of(pairs, "article:author")).alias("author"),
        pick(field(node, "$.datePublished"), item("datePublished"), value_of(pairs, "article:published_time")).alias("published"),
        pick(field(node, "$.articleSection"), none, value_of(pairs, "article:section")).alias("section"),
        F.array_join(pick(listed, F.array().cast("array<string>"), F.array(value_of(pairs, "article:tag"))), ", ").alias("keywords"),
    )


def organisation(page: Column) -> Column:
    """(name, url, logo, phone) of a page's organisation from JSON-LD."""
    told = lambda node: F.struct(field(node, "$.name").alias("name"), field(node, "$.url").alias("url"), field(node, "$.logo.url", "$.logo").alias("logo"), field(node, "$.telephone").alias("phone"))
    return q.let(first_of_type(json_ld(page), ORGANISATIONS), told)


def has_structured_data(page: Column) -> Column:
    """Whether a page has JSON-LD, microdata, RDFa, or metadata of Open Graph, Twitter or Dublin Core."""
    marked = F.size(q.select(page, 'script[type="application/ld+json"], [itemscope], [typeof]')) > 0
    return marked | F.exists(metas(page), lambda x: x["name"].rlike(r"^(?i)(?:og:|twitter:|dc\.|dcterms\.)"))


def has_product(page: Column) -> Column:
    return product(page)["name"].isNotNull() | first_of_type(json_ld(page), ["Product"]).isNotNull() | F.exists(microdata(page), lambda x: x["type"] == "Product")


def has_article(page: Column) -> Column:
    by_meta = F.coalesce(value_of(metas(page), "og:type") == "article", F.lit(False))
    return by_meta | first_of_type(json_ld(page), ARTICLES).isNotNull() | F.exists(microdata(page), lambda x: x["type"].isin(*ARTICLES))


# ---- hypermedia


def kept(links: Column) -> Column:
    """The links that have a relation and lead somewhere."""
    return F.filter(links, lambda x: (F.length(x["rel"]) > 0) & x["href"].isNotNull())


def link(rel: Column, href: Column, base: Column, title_: Column | None = None) -> Column:
    return F.struct(rel.alias("rel"), resolved(base, href).alias("href"), (F.lit(None).cast("string") if title_ is None else title_).alias("title"))


def hypermedia_format(doc: Column) -> Column:
    """hal, json-api, siren, collection+json, hydra or null."""
    at = lambda *p: field(doc, *p)
    first = F.try_element_at(as_list(at("$.data")), F.lit(1))
    return (
        F.when(at("$._links").rlike(r"^\s*\{"), "hal")
        .when(field(first, "$.type").isNotNull() & field(first, "$.id").isNotNull(), "json-api")
        .when(at("$.class", "$.entities", "$.actions").isNotNull() & at("$.links").rlike(r"^\s*\["), "siren")
        .when(at("$.collection.items", "$.collection.links").isNotNull(), "collection+json")
        .when(F.contains(at("$['@context']"), F.lit("hydra")), "hydra")
    )


def hal_links(doc: Column, base: Column) -> Column:
    each = lambda e: F.transform(as_list(e["value"]), lambda i: link(e["key"], field(i, "$.href"), base, field(i, "$.title")))
    return kept(F.flatten(F.transform(entries(field(doc, "$._links")), each)))


def json_api_links(doc: Column, base: Column) -> Column:
    of = lambda links: F.transform(entries(links), lambda e: link(e["key"], F.when(e["value"].rlike(r"^\s*\{"), field(e["value"], "$.href")).otherwise(e["value"]), base))
    resources = F.flatten(F.transform(as_list(field(doc, "$.data")), lambda r: of(field(r, "$.links"))))
    return kept(F.concat(of(field(doc, "$.links")), resources))


def siren_links(doc: Column, base: Column) -> Column:
    of = lambda json: F.flatten(F.transform(as_list(json), lambda x: F.transform(as_list(field(x, "$.rel")), lambda r: link(r, field(x, "$.href"), base, field(x, "$.title")))))
    return kept(F.concat(of(field(doc, "$.links")), of(field(doc, "$.entities"))))


def collection_links(doc: Column, base: Column) -> Column:
    of = lambda json: F.transform(as_list(json), lambda x: link(field(x, "$.rel"), field(x, "$.href"), base, field(x, "$.prompt")))
    items_ = F.transform(as_list(field(doc, "$.collection.items")), lambda x: F.concat(F.array(link(F.lit("item"), field(x, "$.href"), base)), of(field(x, "$.links"))))
    return kept(F.concat(F.array(link(F.lit("self"), field(doc, "$.collection.href"), base)), of(field(doc, "$.collection.links")), F.flatten(items_)))


def hydra_links(doc: Column, base: Column) -> Column:
    own = field(doc, "$['@id']")
    view = [link(F.lit(rel), field(doc, f"$['hydra:view']['{key}']"), base) for rel, key in (("self", "@id"), ("first", "hydra:first"), ("last", "hydra:last"), ("next", "hydra:next"), ("prev", "hydra:previous"))]
    operations = F.transform(as_list(field(doc, "$['hydra:operation']")), lambda o: link(F.concat(F.lit("operation:"), F.lower(field(o, "$['hydra:method']"))), own, base, field(o, "$['hydra:title']")))
    members = F.transform(as_list(field(doc, "$['hydra:member']")), lambda m: link(F.lit("item"), field(m, "$['@id']"), base))
    return kept(F.concat(F.array(link(F.lit("self"), own, base), *view), operations, members))


def api_links(links: Column) -> Column:
    return F.filter(links, lambda x: F.lower(x["rel"]).isin(*API_RELATIONS) | F.lower(x["rel"]).rlike("api|service|endpoint"))


def documentation_links(links: Column) -> Column:
    return F.filter(links, lambda x: x["rel"].isin(*DOCUMENTATION_RELATIONS))


def pagination_links(links: Column) -> Column:
    """(next, prev, first, last): the last link of each of these relations."""

    def told(links: Column) -> Column:
        of = lambda *rels: F.try_element_at(F.filter(links, lambda x: F.lower(x["rel"]).isin(*rels)), F.lit(-1))["href"]
        return F.struct(of("next").alias("next"), of("prev", "previous").alias("prev"), of("first").alias("first"), of("last").alias("last"))

    return q.let(links, told)


# ---- sitemaps and robots files


def sitemap_parts(xml: Column, *names: str) -> Column:
    """Array of the given parts, as text, of the entries of a sitemap that have a URL; empty where an entry has none."""
    blocks = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    part = lambda b, n: F.trim(F.regexp_extract(b, rf"(?i)<{n}>([^<]+)</{n}>", 1))
    return F.filter(F.transform(blocks, lambda b: F.struct(*(part(b, n).alias(n) for n in names))), lambda x: x["loc"] != "")


def sitemap(xml: Column) -> Column:
    """Array of (loc, lastmod, changefreq, priority) of a sitemap."""
    told = lambda x, n: F.nullif(x[n], F.lit(""))
    rows = sitemap_parts(xml, "loc", "lastmod", "changefreq", "priority")
    return F.transform(rows, lambda x: F.struct(unescaped(x["loc"]).alias("loc"), told(x, "lastmod").alias("lastmod"), F.lower(told(x, "changefreq")).alias("changefreq"), told(x, "priority").try_cast("double").alias("priority")))


def sitemap_index(xml: Column) -> Column:
    """URLs of the sitemaps that an index lists."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?i)<sitemap>\s*<loc>([^<]+)</loc>"), F.lit(1)), lambda x: unescaped(F.trim(x)))


def robots_rules(text: Column) -> Column:
    """Array of (rule, path) of the allow and disallow lines of groups for all agents."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", "")))
    groups = F.split(F.array_join(lines, "\n"), r"(?i)(?=(?:^|(?<=\n))user-agent:)")
    wanted = F.filter(groups, lambda g: g.rlike(r"(?i)^user-agent:\s*\*\s*(?:\n|$)") | ~g.rlike("(?i)^user-agent:"))
    found = F.flatten(F.transform(wanted, lambda g: F.regexp_extract_all(g, F.lit(r"(?im)^(?:dis)?allow:\s*\S+"), F.lit(0))))
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, "^[A-Za-z]+", 0)).alias("rule"), F.regexp_extract(x, r":\s*(\S+)", 1).alias("path")))


def first_hint(path: Column, table: Sequence[tuple[str, str, float]], factor: Column) -> Column:
    """(path, type, score) by the first pattern that matches, or null."""
    out = F.lit(None).cast(HINT)
    for pattern, kind, score in reversed(table):
        out = F.when(path.rlike("(?i)" + pattern), F.struct(path.alias("path"), F.lit(kind).alias("type"), F.round(F.least(F.lit(1.0), F.lit(score) * factor), 6).alias("score"))).otherwise(out)
    return out


def robots_hints(text: Column) -> Column:
    """Hints at interfaces in a robots file: each path once, disallowed ones first and at nine tenths."""
    rules = robots_rules(text)
    ordered = F.concat(F.filter(rules, lambda x: x["rule"] == "disallow"), F.filter(rules, lambda x: x["rule"] == "allow"))
    paths = F.array_distinct(F.transform(ordered, lambda x: x["path"]))
    banned = F.transform(F.filter(rules, lambda x: x["rule"] == "disallow"), lambda x: x["path"])
    return F.array_compact(F.transform(paths, lambda p: first_hint(p, ROBOTS_HINTS, F.when(F.array_contains(banned, p), 0.9).otherwise(1.0))))


def sitemap_hints(xml: Column) -> Column:
    """Hints at interfaces in a sitemap: each URL once, rarely changing ones a tenth higher."""
    slow = lambda x: F.when(F.lower(x["changefreq"]).isin("monthly", "yearly", "never"), 1.1).otherwise(1.0)
    # in order of their URLs, so that the first entry of each is the one with another URL before it; then as they were
    keyed = F.array_sort(F.transform(sitemap_parts(xml, "loc", "changefreq"), lambda x, i: F.struct(unescaped(x["loc"]).alias("loc"), i.alias("i"), slow(x).alias("slow"))))
    fresh = q.let(keyed, lambda k: F.filter(k, lambda x, j: (j == 0) | (F.get(k, j - 1)["loc"] != x["loc"])))
    ordered = F.array_sort(F.transform(fresh, lambda x: F.struct(x["i"], x["loc"], x["slow"])))
    return F.array_compact(F.transform(ordered, lambda x: first_hint(x["loc"], SITEMAP_HINTS, x["slow"])))


def hints_from(hints: Column, least: float) -> Column:
    return F.filter(hints, lambda h: h["score"] >= least)


def hints_of(hints: Column, types: Sequence[str]) -> Column:
    return F.filter(hints, lambda h: h["type"].isin(*types))


def hints_in_order(hints: Column) -> Column:
    """Hints by falling score; those of equal score as they were."""
    keyed = F.transform(hints, lambda h, i: F.struct((-h["score"]).alias("a"), i.alias("b"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda k: k["h"])
