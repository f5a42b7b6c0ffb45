"""Queries of metadata, structured data, links, hypermedia, sitemaps and robots files.

The pages and documents are made from rows of the tables, so what must be found in them is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import markup as m
from sparkloom.operators.nodes import NAMED, NAMED_TEXTS, SELECTED, with_nodes
from sparkloom.plans.registry import query
from sparkloom.tables import load, spread


def text(template: str, **columns):
    """A text with columns in place of names in braces; doubled braces stand for themselves."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else columns[p].cast("string") for i, p in enumerate(pieces)])


HEAD = """<!doctype html><html><head><title>{name} &amp; more</title><META property="og:title" content="{name} &lt;{key}&gt;"><meta property='og:type' content='{kind}'/>
<meta property="og:image" content="/i/{key}.png"><meta property="og:image:width" content="640"><meta property="og:site_name" content="{brand}"><meta name="twitter:card" content=summary>
<meta name="DC.creator" content="{brand}"><meta name="dcterms.date" content="2024"><meta name="dc.colour" content="red"><meta http-equiv="refresh" content="30"><meta name="empty" content="">
<meta property="product:price:amount" content="{price}"><meta property="product:price:currency" content="EUR"><link rel="Canonical next" href="/p/{key}?page=2" title="on"><link rel=help href="help.html"></head><body><h1>no</h1>
<a href="/p/{key}">The <b>{name}</b></a><a href='#top'>top</a><a href="mailto:a@b.c">mail</a><a class=x href=http://other.org/>o</a>"""
NODE = """<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["Thing", "Product"], "name": "{name}", "sku": "s{key}", "brand": {"name": "{brand}"}, "offers": [{"price": "{price}", "priceCurrency": "USD", "availability": "InStock"}], "aggregateRating": {"ratingValue": "{size}"}}]}</script>
<script type='application/ld+json'>{"@type": "NewsArticle", "headline": "{name}", "author": [{"name": "{brand}"}, "x"], "datePublished": "2024-01-02", "articleSection": "s", "keywords": "a, b"}</script>
<script type="application/ld+json">{"@type": "Store", "name": "{brand}", "url": "http://s.org", "logo": {"url": "l.png"}, "telephone": "1"}</script><script type="application/ld+json">{broken</script>"""
ITEM = """<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">{name}</span><span itemprop="brand">{brand}</span><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="{price}"><meta itemprop="priceCurrency" content="GBP"></div></div>
<div vocab="http://schema.org/" typeof="Person"><span property="name">{brand}</span></div>"""


#: What a reader of tags alone would take for metadata, links and data.
TRICKS = """<!-- <meta property="og:title" content="no"><a href="/no">no</a><div itemscope itemtype="x/Product"><b itemprop="name">no</b></div> --><script>var a = '<meta name="twitter:card" content="no"><link rel=help href=no><a href=/no>no</a>'</script>"""


def shop(s, d, fields=SELECTED, only=None):
    """(id, url, nodes): a page a part; every third has JSON-LD, every third microdata and RDFa, every third metadata alone."""
    k = F.col("p_partkey")
    columns = dict(name=F.col("p_name"), key=k, brand=F.col("p_brand"), price=F.col("p_retailprice"), size=F.col("p_size"), kind=F.when(k % 2 == 0, "product").otherwise("article"))
    more = F.when(k % 3 == 0, text(NODE.replace("{broken", "[broken"), **columns)).when(k % 3 == 1, text(ITEM, **columns)).otherwise("")
    html = F.concat(F.lit(TRICKS), text(HEAD, **columns), more, F.lit("</body></html>"))
    parts = spread(load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice", "p_size"), "p_partkey")
    return with_nodes(parts.select(k.alias("id"), text("http://shop.org/list/{key}", **columns).alias("url"), html.alias("html")), keep=False, fields=fields, only=only)


def pairs(name: str, sql: str, found, fields=NAMED_TEXTS, only=None):
    """A query of (id, name, content) rows of the elements of some tags, or of all."""

    @query(name, sql)
    def _(s, d):
        return shop(s, d, fields, only).select("id", F.explode(found(F.col("nodes"))).alias("x")).select("id", "x.*")


def rows(*values: str, where: str = "true") -> str:
    """SQL for some rows a part."""
    return " UNION ALL ".join(f"SELECT p_partkey AS id, {v} FROM part WHERE {where}" for v in values)


named = lambda *items: tuple(f"'{n}' AS name, {v} AS content" for n, v in items)
TITLE = "p_name || ' <' || p_partkey || '>'"
KIND = "CASE WHEN p_partkey % 2 = 0 THEN 'product' ELSE 'article' END"
IMAGE = "'/i/' || p_partkey || '.png'"
PRICE = "CAST(p_retailprice AS VARCHAR)"

pairs("h12_open_graph", rows(*named(("title", TITLE), ("type", KIND), ("image", IMAGE), ("imageWidth", "'640'"), ("siteName", "p_brand"))), m.open_graph, NAMED, "meta")
pairs("h13_twitter_card", rows(*named(("card", "'summary'"))), m.twitter_card, NAMED, "meta")
pairs("h14_dublin_core", rows(*named(("creator", "p_brand"), ("date", "'2024'"))), m.dublin_core, NAMED, "meta")
pairs("h16_all_meta", rows(*named(("og:title", TITLE), ("og:type", KIND), ("og:image", IMAGE), ("og:image:width", "'640'"), ("og:site_name", "p_brand"), ("twitter:card", "'summary'"), ("DC.creator", "p_brand"), ("dcterms.date", "'2024'"), ("dc.colour", "'red'"), ("refresh", "'30'"), ("product:price:amount", PRICE), ("product:price:currency", "'EUR'"))), m.metas, NAMED, "meta")
pairs("h11_microdata", rows("'Product' AS type, 'name' AS name, p_name AS content", "'Product' AS type, 'brand' AS name, p_brand AS content", "'Offer' AS type, 'price' AS name, CAST(p_retailprice AS VARCHAR) AS content", "'Offer' AS type, 'priceCurrency' AS name, 'GBP' AS content", where="p_partkey % 3 = 1"), m.microdata)
pairs("h15_rdfa", rows("'Person' AS type, 'name' AS name, p_brand AS content", where="p_partkey % 3 = 1"), m.rdfa)
pairs("h40_html_links", rows("'canonical' AS rel, 'http://shop.org/p/' || p_partkey || '?page=2' AS href, 'on' AS title", "'next' AS rel, 'http://shop.org/p/' || p_partkey || '?page=2' AS href, 'on' AS title", "'help' AS rel, 'http://shop.org/list/help.html' AS href, NULL AS title"), lambda h: m.link_elements(h, F.col("url")), NAMED, "link")
pairs("h8_anchors", rows("'http://shop.org/p/' || p_partkey AS href, 'The ' || p_name AS text", "'http://other.org/' AS href, 'o' AS text"), lambda h: m.anchors(h, F.col("url")), NAMED_TEXTS, "a")
pairs("f29_documentation_links", rows("'help' AS rel, 'http://shop.org/list/help.html' AS href, NULL AS title"), lambda h: m.documentation_links(m.link_elements(h, F.col("url"))), NAMED, "link")


@query("h10_json_ld", "SELECT p_partkey AS id, unnest(['WebSite', '[\"Thing\",\"Product\"]', 'NewsArticle', 'Store']) AS type FROM part WHERE p_partkey % 3 = 0")
def _(s, d):
    return shop(s, d, NAMED_TEXTS, "script").select("id", F.explode(m.json_ld(F.col("nodes"))).alias("n")).select("id", F.get_json_object("n", "$['@type']").alias("type"))


@query("h9_structured_data", "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 0 END AS INTEGER) AS nodes, CAST(CASE WHEN p_partkey % 3 = 1 THEN 4 ELSE 0 END AS INTEGER) AS items, CAST(12 AS INTEGER) AS metas, p_name || ' <' || p_partkey || '>' AS title FROM part")
def _(s, d):
    page = F.col("nodes")
    return shop(s, d).select("id", F.size(m.json_ld(page)), F.size(m.microdata(page)), F.size(m.metas(page)), m.title(page)).toDF("id", "nodes", "items", "metas", "title")


@query("h17_product", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN {TITLE} ELSE p_name END AS name, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey END AS sku, p_retailprice AS price,
  ['USD', 'GBP', 'EUR'][p_partkey % 3 + 1] AS currency, CASE WHEN p_partkey % 3 = 0 THEN 'InStock' END AS availability, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS rating FROM part""")
def _(s, d):
    return shop(s, d, NAMED_TEXTS).select("id", m.product(F.col("nodes")).alias("x")).select("id", "x.*")


@query("h18_article", f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 1 THEN {TITLE} END AS headline, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ', x' END AS author, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-02' END AS published,
  CASE WHEN p_partkey % 3 = 0 THEN 's' END AS section, CASE WHEN p_partkey % 3 = 0 THEN 'a, b' WHEN p_partkey % 2 = 1 THEN '' END AS keywords FROM part""")
def _(s, d):
    return shop(s, d, NAMED_TEXTS).select("id", m.article(F.col("nodes")).alias("x")).select("id", "x.*")


@query("h19_organisation", "SELECT p_partkey AS id, p_brand AS name, 'http://s.org' AS url, 'l.png' AS logo, '1' AS phone FROM part WHERE p_partkey % 3 = 0")
def _(s, d):
    found = m.organisation(F.col("nodes"))
    # taken as rows, so that it is not made once to choose by and once to give
    return shop(s, d, NAMED_TEXTS, "script").select("id", F.inline(F.filter(F.array(found), lambda x: x["name"].isNotNull())))


@query("h20_has_structured_data", "SELECT page_id, regexp_matches(html, 'application/ld\\+json|itemscope|property=\"og:|name=\"twitter:|name=\"dc\\.|typeof=') AS has FROM pages UNION ALL SELECT -1 - p_partkey, true FROM part")
def _(s, d):
    made = shop(s, d, NAMED).select((-1 - F.col("id")).alias("page_id"), "nodes")
    given = with_nodes(load(s, d, "pages").select("page_id", "html"), keep=False, fields=NAMED)
    return given.unionAll(made).select("page_id", m.has_structured_data(F.col("nodes")).alias("has"))


@query("h21_has_product", "SELECT p_partkey AS id, true AS has FROM part UNION ALL SELECT -1 - page_id, false FROM pages")
def _(s, d):
    given = with_nodes(load(s, d, "pages").select((-1 - F.col("page_id")).alias("id"), "html"), keep=False, fields=NAMED_TEXTS)
    return shop(s, d, NAMED_TEXTS).select("id", "nodes").unionAll(given).select("id", m.has_product(F.col("nodes")).alias("has"))


@query("h22_has_article", "SELECT p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 2 = 1 AS has FROM part")
def _(s, d):
    return shop(s, d, NAMED_TEXTS).select("id", m.has_article(F.col("nodes")).alias("has"))


# ---- hypermedia documents, one a customer

HAL = '{"_links": {"self": {"href": "/c/{key}"}, "api:orders": [{"href": "/c/{key}/orders", "title": "{name}"}, {"href": "http://x.org/o"}], "bad": {"title": "no"}}}'
JSON_API = '{"links": {"self": "/c/{key}", "next": {"href": "/c?page=2"}}, "data": [{"type": "c", "id": "{key}", "links": {"related": "/r/{key}"}}, {"type": "c", "id": "2"}]}'
SIREN = '{"class": ["c"], "links": [{"rel": ["self", "item"], "href": "/c/{key}", "title": "{name}"}], "entities": [{"rel": ["order"], "href": "/o/{key}"}, {"rel": ["none"]}]}'
COLLECTION = '{"collection": {"href": "/c", "links": [{"rel": "feed", "href": "/f", "prompt": "{name}"}], "items": [{"href": "/c/{key}", "links": [{"rel": "photo", "href": "/p/{key}"}]}]}}'
HYDRA = '{"@context": "http://www.w3.org/ns/hydra/context.jsonld", "@id": "/c/{key}", "hydra:view": {"@id": "/v", "hydra:first": "/v?1", "hydra:next": "/v?2", "hydra:previous": "/v?0"}, "hydra:operation": [{"hydra:method": "POST", "hydra:title": "{name}"}], "hydra:member": [{"@id": "/m/{key}"}]}'
FORMATS = {"hal": HAL, "json-api": JSON_API, "siren": SIREN, "collection+json": COLLECTION, "hydra": HYDRA}


def documents(s, d, template):
    return spread(load(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_custkey").alias("id"), text(template, key=F.col("c_custkey"), name=F.col("c_name")).alias("doc"))


def linked(name: str, template: str, found, *links: tuple[str, str, str]):
    """A query of the links of each customer's document, with SQL of (relation, path, title) rows."""
    sql = " UNION ALL ".join(f"SELECT c_custkey AS id, '{rel}' AS rel, {href if '://' in href else chr(39) + 'http://api.org' + chr(39) + ' || ' + href} AS href, {title} AS title FROM customer" for rel, href, title in links)

    @query(name, sql)
    def _(s, d):
        return documents(s, d, template).select("id", F.explode(found(F.col("doc"), F.lit("http://api.org/c/"))).alias("x")).select("id", "x.*")


KEY = "c_custkey"
linked("h42_hal_links", HAL, m.hal_links, ("self", f"'/c/' || {KEY}", "NULL"), ("api:orders", f"'/c/' || {KEY} || '/orders'", "c_name"), ("api:orders", "'http://x.org/o'", "NULL"))
linked("h43_json_api_links", JSON_API, m.json_api_links, ("self", f"'/c/' || {KEY}", "NULL"), ("next", "'/c?page=2'", "NULL"), ("related", f"'/r/' || {KEY}", "NULL"))
linked("h44_siren_links", SIREN, m.siren_links, ("self", f"'/c/' || {KEY}", "c_name"), ("item", f"'/c/' || {KEY}", "c_name"), ("order", f"'/o/' || {KEY}", "NULL"))
linked("h45_collection_links", COLLECTION, m.collection_links, ("self", "'/c'", "NULL"), ("feed", "'/f'", "c_name"), ("item", f"'/c/' || {KEY}", "NULL"), ("photo", f"'/p/' || {KEY}", "NULL"))
linked("h46_hydra_links", HYDRA, m.hydra_links, ("self", f"'/c/' || {KEY}", "NULL"), ("self", "'/v'", "NULL"), ("first", "'/v?1'", "NULL"), ("next", "'/v?2'", "NULL"), ("prev", "'/v?0'", "NULL"), ("operation:post", f"'/c/' || {KEY}", "c_name"), ("item", f"'/m/' || {KEY}", "NULL"))
linked("f28_api_links", HAL, lambda doc, base: m.api_links(m.hal_links(doc, base)), ("self", f"'/c/' || {KEY}", "NULL"), ("api:orders", f"'/c/' || {KEY} || '/orders'", "c_name"), ("api:orders", "'http://x.org/o'", "NULL"))


@query("h41_hypermedia_format", "SELECT c_custkey AS id, ['hal', 'json-api', 'siren', 'collection+json', 'hydra', NULL][c_custkey % 6 + 1] AS format FROM customer")
def _(s, d):
    docs = F.array(*[text(t, key=F.col("c_custkey"), name=F.col("c_name")) for t in (*FORMATS.values(), '{"data": [], "links": "{key}"}')])
    chosen = F.element_at(docs, (F.col("c_custkey") % 6 + 1).cast("int"))
    return spread(load(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_custkey").alias("id"), m.hypermedia_format(chosen).alias("format"))


@query("h47_pagination_links", "SELECT c_custkey AS id, 'http://api.org/v?2' AS next, 'http://api.org/v?0' AS prev, 'http://api.org/v?1' AS first, CAST(NULL AS VARCHAR) AS last FROM customer")
def _(s, d):
    return documents(s, d, HYDRA).select("id", m.pagination_links(m.hydra_links(F.col("doc"), F.lit("http://api.org/c/"))).alias("x")).select("id", "x.*")


@query("h39_link_header", "SELECT c_custkey AS id, 'next' AS rel, 'http://api.org/c?page=2' AS href, c_name AS title FROM customer UNION ALL SELECT c_custkey, 'last', 'http://api.org/c/' || c_custkey, NULL FROM customer UNION ALL SELECT c_custkey, 'item', 'http://api.org/c/' || c_custkey, NULL FROM customer")
def _(s, d):
    header = '</c?page=2>; rel="next"; title="{name}", <{key}>; rel="last item"'
    return documents(s, d, header).select("id", F.explode(m.link_header(F.col("doc"), F.lit("http://api.org/c/"))).alias("x")).select("id", "x.*")


# ---- sitemaps and robots files: one a nation, of its customers and suppliers

SITE_SQL = "site AS (SELECT s_nationkey AS id, s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '/docs/api/' WHEN 1 THEN '/openapi/' WHEN 2 THEN '/dev/' ELSE '/shop/' END AS folder FROM supplier)"


def site(s, d):
    k = F.col("s_suppkey")
    folder = F.element_at(F.array(*map(F.lit, ("/docs/api/", "/openapi/", "/dev/", "/shop/"))), (k % 4 + 1).cast("int"))
    entry = F.concat(F.lit("<url>\n<loc> http://s.org"), folder, k.cast("string"), F.lit("?a=1&amp;b=2</loc><lastmod>2024-01-01</lastmod>"), F.when(k % 2 == 0, "<changefreq>Monthly</changefreq>").otherwise("<changefreq>daily</changefreq>"), F.lit("<priority>0.5</priority></url>"))
    # a nation's suppliers make one file, which is the input of the functions shown here
    return spread(load(s, d, "supplier"), "s_nationkey").groupBy(F.col("s_nationkey").alias("id")).agg(F.concat(F.lit("<?xml?><urlset>"), F.array_join(F.collect_list(entry), "\n"), F.lit("<url><lastmod>1</lastmod></url></urlset>")).alias("xml"))


@query("h48_sitemap", f"WITH {SITE_SQL} SELECT id, 'http://s.org' || folder || k || '?a=1&b=2' AS loc, '2024-01-01' AS lastmod, CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'daily' END AS changefreq, 0.5::DOUBLE AS priority FROM site")
def _(s, d):
    return site(s, d).select("id", F.explode(m.sitemap(F.col("xml"))).alias("x")).select("id", "x.*")


HINT_SQL = "SELECT id, 'http://s.org' || folder || k || '?a=1&b=2' AS path, CASE k % 4 WHEN 0 THEN 'documentation' WHEN 1 THEN 'spec-file' ELSE 'developer-portal' END AS type, round(CASE k % 4 WHEN 0 THEN 0.7 * 1.1 WHEN 1 THEN 0.8 ELSE 0.4 * 1.1 END, 6)::DOUBLE AS score FROM site WHERE k % 4 < 3"


@query("h50_sitemap_hints", f"WITH {SITE_SQL} {HINT_SQL}")
def _(s, d):
    return site(s, d).select("id", F.explode(m.sitemap_hints(F.col("xml"))).alias("x")).select("id", "x.*")


@query("f30_hints_by_score", f"WITH {SITE_SQL}, h AS ({HINT_SQL}) SELECT * FROM h WHERE score >= 0.77")
def _(s, d):
    return site(s, d).select("id", F.explode(m.hints_from(m.sitemap_hints(F.col("xml")), 0.77)).alias("x")).select("id", "x.*")


@query("f31_hints_by_type", f"WITH {SITE_SQL}, h AS ({HINT_SQL}) SELECT * FROM h WHERE type IN ('spec-file', 'graphql')")
def _(s, d):
    return site(s, d).select("id", F.explode(m.hints_of(m.sitemap_hints(F.col("xml")), ["spec-file", "graphql"])).alias("x")).select("id", "x.*")


@query("t12_hints_in_order", f"WITH {SITE_SQL}, h AS ({HINT_SQL}) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC) AS INTEGER) AS place, score FROM h")
def _(s, d):
    return site(s, d).select("id", F.posexplode(m.hints_in_order(m.sitemap_hints(F.col("xml")))).alias("place", "x")).select("id", (F.col("place") + 1).alias("place"), "x.score")


ROBOTS = "User-agent: bot\nDisallow: /graphql\n\nUser-agent: *\nDisallow: /api/{key} # no\nAllow: /docs\nallow: /v{key}/\nDisallow: /shop\nAllow: /api/{key}\nSitemap: http://s.org/s.xml"


@query("h49_robots_hints", "SELECT c_custkey AS id, '/api/' || c_custkey AS path, 'api-path' AS type, 0.54::DOUBLE AS score FROM customer UNION ALL SELECT c_custkey, '/docs', 'documentation', 0.5 FROM customer UNION ALL SELECT c_custkey, '/v' || c_custkey || '/', 'api-path', 0.6 FROM customer")
def _(s, d):
    return documents(s, d, ROBOTS).select("id", F.explode(m.robots_hints(F.col("doc"))).alias("x")).select("id", "x.*")
