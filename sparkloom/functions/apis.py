"""Addresses of interfaces in scripts and pages, and addresses that a page's own suggests.

Defined results: null texts are no address; addresses of a page are listed once each, in the order of
what shows them, then of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import frameworks
from sparkloom.functions import selectors as q
from sparkloom.operators.nodes import with_nodes
from sparkloom.operators.states import with_literals

#: What an address of an interface is not; what shows that it is one.
NOT_THESE = (r"^//", r"(?i)\.(?:css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot)$", r"^/static/", r"^/assets/", r"(?i)^/images?/", r"(?i)^/fonts?/", r"^/_next/static", r"^/favicon")
THESE = (r"(?i)/api/", r"/v\d+/", r"(?i)/rest/", r"(?i)/graphql", r"(?i)/data/", r"(?i)/json", r"(?i)\.json$", r"(?i)/feed", r"(?i)/query", r"(?i)/search", r"(?i)/get", r"(?i)/fetch", r"(?i)/load", r"/api", r"\.json", r"/data")
#: Fixed values: (name, what stands before a text, what the text must be, whether it must look like an address besides), in order.
SHOWN = (
    ("fetch", r"fetch\($", r"^\S+$", True),
    ("axios", r"axios(?:\.(?:get|post|put|delete|patch))?\($", r"^\S+$", True),
    ("config", r"(?:api[Uu]rl|endpoint|baseURL|apiEndpoint|apiBase|dataUrl|fetchUrl|requestUrl)[=:]$", r"^\S+$", True),
    ("request", r'\.open\("",$', r"^\S+$", True),
    ("graphql", r"", r"(?i)/graphql", False),
    ("rest", r"", r"(?i)^(?:https?://\S+)?/(?:api|v\d+|rest|data|json|feed)\S*$", True),
    ("route", r"", r"^/api/\S+$", False),
    ("json", r"", r"^(?!.*(?:package\.json|tsconfig|node_modules))\S+\.json$", True),
)


def looks_like_api(text: Column) -> Column:
    """Whether a text is a path, or an http address, of an interface rather than of a page's own files."""
    out = text.rlike("^(?:/|http)")
    for pattern in NOT_THESE:
        out = out & ~text.rlike(pattern)
    shown = F.lit(False)
    for pattern in THESE:
        shown = shown | text.rlike(pattern)
    return F.coalesce(out & shown, F.lit(False))


def absolute(text: Column, origin: Column) -> Column:
    return F.when(text.rlike("^https?://"), text).when(F.startswith(text, F.lit("//")), F.concat(F.lit("https:"), text)).when(F.startswith(text, F.lit("/")), F.concat(origin, text)).otherwise(F.concat(origin, F.lit("/"), text))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)


def predicted(url: Column) -> Column:
    """Array of addresses where a page's data may be, by its own."""
    site = origin(url)
    found = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(found == "", "/").otherwise(found)
    slug = F.element_at(F.split(path, "/"), -1)
    listed = F.array(
        F.concat(site, F.lit("/api"), path),
        F.concat(site, F.lit("/api/v1"), path),
        F.concat(site, path, F.lit(".json")),
        F.concat(site, F.lit("/_next/data/development"), path, F.lit(".json")),
        F.when(path.rlike(r"/\d{4}/\d{2}/[\w-]+"), F.concat(site, F.lit("/wp-json/wp/v2/posts?slug="), slug)),
        F.concat(site, F.lit('/graphql?query={page(path:"'), path, F.lit('"){title,content}}')),
    )
    return F.filter(listed, lambda x: x.isNotNull())


def script_apis(pages: DataFrame, key: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, shown_by, url) of addresses in the scripts of pages, and in data attributes; each once a page, by the first thing that shows it."""
    rows = with_nodes(pages.select(key, F.col(url).alias("__url"), F.col(html).alias("__html")), "__html", "__nodes").drop("__html")
    named = F.flatten(F.transform(F.col("__nodes"), lambda n: F.transform(F.map_entries(F.map_filter(F.coalesce(n["attrs"], F.create_map().cast("map<string,string>")), lambda k, v: k.rlike("^data-(?:api|endpoint|url|config)"))), lambda e: e["value"])))
    rows = with_literals(rows.withColumn("__scripts", frameworks.scripts(F.col("__nodes"))).withColumn("__named", named).drop("__nodes"), "__scripts", "__texts").drop("__scripts")
    site = origin(F.col("__url"))
    attributes = F.transform(F.filter("__named", looks_like_api), lambda v: F.struct(F.lit("attribute").alias("shown_by"), absolute(v, site).alias("url")))

    def shown(name: str, before: str, text: str, looks: bool) -> Column:
        good = lambda x: x["before"].rlike(before) & x["text"].rlike(text) & (looks_like_api(x["text"]) if looks else F.lit(True))
        return F.transform(F.filter("__texts", good), lambda x: F.struct(F.lit(name).alias("shown_by"), absolute(x["text"], site).alias("url")))

    every = F.concat(attributes, *[shown(*s) for s in SHOWN])
    web = F.filter(every, lambda x: x["url"].rlike("^https?://"))
    once = q.let(web, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["url"]), x["url"]) == i + 1))
    return rows.select(key, F.explode(once).alias("x")).select(key, "x.*")
