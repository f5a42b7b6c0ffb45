"""Queries of the state that frameworks leave in pages: one made page a document, of eight templates, with its text in scripts as JSON, as literals or as markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import apis
from sparkloom.functions import frameworks as f
from sparkloom.plans.registry import query
from sparkloom.tables import load, spread

#: Templates: @k is the key, @s the text as a string literal, @t the text as markup.
TEMPLATES = (
    '<script id="__NEXT_DATA__" type="application/json">{"page":"/p","props":{"pageProps":{"extra":"an extra text that is long @k","title":"N @k","content":@s,"url":"https://a.org/that/is/long/enough"}}}</script>',
    "<script>/* __NUXT__={data:1} */ window.__NUXT__=(function(a,b){return {layout:\"d\",data:[{n:b,body:a,ok:!0}]}}(@s,void 0));</script>",
    "<script>window.pagePath = '/x'; window.___GATSBY = {path: '/x', data: {'message': @s,},}; // {end}\n</script>",
    '<script>window.__remixContext = {"state":{"loaderData":{"r":{"text":@s,"n":[1,2]}}},"actionData":null};</script>',
    '<app-root ng-version="17"></app-root><script id="ng-state" type="application/json">{"k":{"headline":"A @k","post":@s}}</script>',
    '<div class="wide VPDoc"><h1>V @k</h1>\n<p>@t</p></div>',
    "<script>window.__VUEPRESS_SSR_CONTEXT__ = {frontmatter: {title: 'U @k', d: new Date('2024')}, description: @s}</script>",
    '<!-- <script id="__NEXT_DATA__" type="application/json">{"props":{}}</script> --><script>var t = "window.__NUXT__={data:[]}"</script><p>@t</p><script>state = {"text": @s}</script>',
)
NAMES = [x[0] for x in f.FRAMEWORKS]

MADE = """WITH d AS (SELECT doc_id AS id, doc_id % 8 AS k, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL), t AS (
  SELECT id, k, t, CASE WHEN length(t) > 20 AND NOT starts_with(t, 'http') THEN t || chr(10) ELSE '' END AS x FROM d
), s AS (
  SELECT id, k, ['nextjs', 'nuxt', 'gatsby', 'remix', 'angular', 'vitepress', 'vuepress', NULL][k + 1] AS framework, ['N ' || id, '', '', '', 'A ' || id, 'V ' || id, 'U ' || id, ''][k + 1] AS title,
    CASE k WHEN 0 THEN x || 'an extra text that is long ' || id || chr(10) WHEN 5 THEN rtrim('V ' || id || chr(10) || t, ' ' || chr(10) || chr(9) || chr(13)) ELSE x END AS text FROM t
), found AS (
  SELECT id, framework, title, text FROM s WHERE framework IS NOT NULL AND (framework IN ('nuxt', 'remix') OR length(text) > 50)
) """


def made(s, d):
    """(id, nodes, states) of the pages."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    literal = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    markup = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("@k"), k.cast("string")), F.lit("@t"), markup), F.lit("@s"), literal)
    page = F.coalesce(*[F.when(k % len(TEMPLATES) == i, fill(t)) for i, t in enumerate(TEMPLATES)])
    given = spread(load(s, d, "documents").where("doc_id is not null").select("doc_id", "text"), "doc_id")
    return f.prepared(given.select(k.alias("id"), page.alias("html")), keep=False)


@query("h30_framework_pages", f"{MADE} SELECT s.id, found.framework, found.title, md5(found.text) AS text_md5 FROM s LEFT JOIN found ON found.id = s.id")
def _(s, d):
    found = made(s, d).select("id", f.any_of(F.col("nodes"), F.col("states")).alias("x"))
    return found.select("id", "x.framework", "x.title", F.md5("x.text").alias("text_md5"))


def one(number: int, name: str):
    @query(f"h{number}_{name}", f"{MADE} SELECT id, title, length(text) AS n_chars, md5(text) AS text_md5 FROM found WHERE framework = '{name}'")
    def _(s, d):
        found = made(s, d).select("id", f.of(F.col("nodes"), F.col("states"), name).alias("x")).where("x is not null")
        return found.select("id", "x.title", F.length("x.text").cast("long").alias("n_chars"), F.md5("x.text").alias("text_md5"))


for place, name in enumerate(NAMES):
    one(31 + place, name)


@query(
    "x4_texts_of_states",
    """WITH d AS (SELECT doc_id AS id, doc_id % 8 AS k, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL AND doc_id % 8 <> 5)
  SELECT id, ['__NEXT_DATA__', '__NUXT__', '___GATSBY', '__remixContext', 'ng-state', '', '__VUEPRESS_SSR_CONTEXT__', 'state'][k + 1] AS name, ['N ' || id, '', '', '', 'A ' || id, '', 'U ' || id, ''][k + 1] AS title,
    CASE WHEN length(t) > 20 AND NOT starts_with(t, 'http') THEN length(t) + 1 ELSE 0 END + CASE WHEN k = 0 THEN 28 + length(CAST(id AS VARCHAR)) ELSE 0 END AS n_chars FROM d""",
)
def _(s, d):
    found = made(s, d).select("id", F.explode("states").alias("x"))
    return found.select("id", "x.name", "x.title", F.length("x.text").cast("long").alias("n_chars"))


# ---- addresses of interfaces

SCRIPTS = (
    """<div data-api-url="/api/d@k" data-config="no"></div><script>// fetch('/api/no')
const base = 'https://x.org/v2'; fetch(`${base}/things/@k`); /* axios.get("/api/no") */ axios.post("/rest/@k", {a: 'fetch("/api/no")'}); fetch('/static/api/x'); fetch('relative/api/x');</script>""",
    """<script>var cfg = {apiUrl: '/data/@k', logo: "/logo.png"}, root = "/api"; x.open('GET', root + '/items/@k'); y("/graphql"); z('package.json'); z('/files/@k.json')</script><!-- <script>fetch('/api/no')</script> -->""",
    """<p>fetch('/api/no')</p><script>fetch("/api/a"); fetch('/api/a'); load('feed'); w("//cdn.org/api/x.js"); v('http://o.org/v1/@k?q')</script>""",
)
FOUND = {
    0: (("attribute", "'https://s.org/api/d' || c_custkey"), ("fetch", "'https://x.org/v2/things/' || c_custkey"), ("axios", "'https://s.org/rest/' || c_custkey")),
    1: (("config", "'https://s.org/data/' || c_custkey"), ("request", "'https://s.org/api/items/' || c_custkey"), ("graphql", "'https://s.org/graphql'"), ("rest", "'https://s.org/api'"), ("json", "'https://s.org/files/' || c_custkey || '.json'")),
    2: (("fetch", "'https://s.org/api/a'"), ("rest", "'http://o.org/v1/' || c_custkey || '?q'")),
}
FOUND_SQL = " UNION ALL ".join(f"SELECT c_custkey AS id, '{by}' AS shown_by, {url} AS url FROM customer WHERE c_custkey % 3 = {kind}" for kind, rows in FOUND.items() for by, url in rows)


@query("h38_script_apis", FOUND_SQL)
def _(s, d):
    k = F.col("c_custkey")
    page = F.coalesce(*[F.when(k % len(SCRIPTS) == i, F.replace(F.lit(t), F.lit("@k"), k.cast("string"))) for i, t in enumerate(SCRIPTS)])
    return apis.script_apis(load(s, d, "customer").select(k.alias("id"), F.lit("https://s.org/p?x").alias("url"), page.alias("html")))


@query(
    "l11_predicted_addresses",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages
    UNION ALL SELECT -1 - c_custkey, 'https://s.org', '/2024/0' || (c_custkey % 9 + 1) || '/post-' || c_custkey FROM customer)
  SELECT page_id, unnest(list_filter([site || '/api' || path, site || '/api/v1' || path, site || path || '.json', site || '/_next/data/development' || path || '.json', CASE WHEN page_id < 0 THEN site || '/wp-json/wp/v2/posts?slug=post-' || (-1 - page_id) END, site || '/graphql?query={page(path:"' || path || '"){title,content}}'], lambda x: x IS NOT NULL)) AS address FROM u""",
)
def _(s, d):
    k = F.col("c_custkey")
    posts = load(s, d, "customer").select((-1 - k).alias("page_id"), F.concat(F.lit("https://s.org/2024/0"), (k % 9 + 1).cast("string"), F.lit("/post-"), k.cast("string"), F.lit("?x#y")).alias("url"))
    return load(s, d, "pages").select("page_id", "url").unionAll(posts).select("page_id", F.explode(apis.predicted(F.col("url"))).alias("address"))


ADDRESSES = ("/api/x", "/v2/x", "//cdn.org/api/", "/static/api/", "http://a.org/REST/1", "relative/api/x", "/img/a.PNG", "/a/search?q", "/fonts/api/x", "/plain", "/datasets", "mailto:a@b.c", "/x.json", "/Images/api/", "/feed", "#/api/", "http://a.org/app.js", "/_next/static/api/")
IS_ONE = (1, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 0, 0, 0)


@query("l13_api_addresses", f"SELECT c_custkey AS id, ({list(IS_ONE)}[c_custkey % {len(IS_ONE)} + 1])::BOOLEAN AS is_api FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    return load(s, d, "customer").select(k.alias("id"), apis.looks_like_api(F.element_at(F.array(*map(F.lit, ADDRESSES)), (k % len(ADDRESSES) + 1).cast("int"))).alias("is_api"))
