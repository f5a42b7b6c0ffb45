"""State that frameworks of web pages leave in them, over node arrays and the states of operators.states.

Defined results: a page of which no framework gives enough text has null; frameworks are tried in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import selectors as q
from sparkloom.operators.nodes import SELECTED, with_nodes
from sparkloom.operators.states import STATE_KIND, STATES, clean_states

FOUND = "struct<framework:string,title:string,text:string>"
#: Fixed values: (framework, names of its states, least text, what shows that it is there, containers of its text, or nothing).
FRAMEWORKS = (
    ("nextjs", ("__NEXT_DATA__",), 50, None, ()),
    ("nuxt", ("__NUXT__",), -1, None, ()),
    ("gatsby", ("gatsby-script-loader", "___GATSBY"), 50, None, ()),
    ("remix", ("__remixContext",), -1, None, ()),
    ("angular", ("serverApp-state", "transfer-state", "ng-state", "__INITIAL_STATE__", "__STATE__", "__APP_STATE__", "initialState", "appState", "state"), 50, None, ()),
    ("vitepress", ("__VP_ROUTE_DATA__", "__VP_HASH_MAP__", "__VP_PAGE_DATA__"), 50, '[class*="vp-doc"], [class*="VPDoc"], [class*="VPContent"], [id^="__VP_"]', ('[class*="vp-doc"], [class*="VPDoc"]', '[class*="VPContent"]')),
    ("vuepress", ("__VUEPRESS_SSR_CONTEXT__", "VUEPRESS_DATA__", "__VUEPRESS_DATA__"), 50, '[class*="theme-default-content"], [id*="VUEPRESS"], meta[content^="VuePress"]', ('[class*="theme-default-content"]', '[class*="content"]', '[class*="page"]')),
)
#: States that hold an Angular page's data only where the page shows that it is one.
ANGULAR = '[ng-version], [ngh], app-root, script[src*="polyfills"], script[src*="zone"], script[src*="runtime"]'
OF_ANGULAR = ("__INITIAL_STATE__", "__STATE__", "__APP_STATE__", "initialState", "appState", "state")


def scripts(nodes: Column) -> Column:
    """Array of (id, type, text) of a page's scripts."""
    return F.transform(q.select(nodes, "script"), lambda s: F.struct(s["id"].alias("id"), q.attr(s, "type").alias("type"), q.raw_text(nodes, s, True).alias("text")))


def candidates(nodes: Column, states: Column, name: str) -> Column:
    """Array of (framework, title, text) that one framework gives, in order, enough or not."""
    _, names, least, shown, boxes = next(f for f in FRAMEWORKS if f[0] == name)
    order = F.array(*map(F.lit, names))
    mine = F.filter(states, lambda s: F.array_contains(order, s["name"]))
    if name == "angular":
        there = F.size(q.select(nodes, ANGULAR)) > 0
        mine = F.filter(mine, lambda s: ~s["name"].isin(*OF_ANGULAR) | there)
    if shown is not None:
        # what a framework keeps shows that it is there as well
        there = (F.size(q.select(nodes, shown)) > 0) | F.exists(states, lambda s: F.array_contains(order, s["name"]))
        mine = F.filter(mine, lambda s: there)
    found = F.transform(mine, lambda s: F.struct(F.lit(name).alias("framework"), s["title"].alias("title"), s["text"].alias("text")))
    if not boxes:
        return found
    heading = F.coalesce(q.text_of(nodes, q.first(nodes, "h1"), True), F.lit(""))
    held = F.array(*[F.struct(F.lit(name).alias("framework"), heading.alias("title"), F.coalesce(q.text_of(nodes, q.first(nodes, b), True), F.lit("")).alias("text")) for b in boxes])
    return F.concat(found, F.filter(held, lambda x: there))


def of(nodes: Column, states: Column, name: str) -> Column:
    """What one framework gives: the first of its candidates with enough text, or null."""
    least = next(f[2] for f in FRAMEWORKS if f[0] == name)
    return F.get(F.filter(candidates(nodes, states, name), lambda x: F.length(x["text"]) > least), F.lit(0))


def any_of(nodes: Column, states: Column) -> Column:
    """What the first framework that gives enough text gives, or null."""
    return F.coalesce(*[of(nodes, states, f[0]) for f in FRAMEWORKS])


def prepared(pages: DataFrame, html: str = "html", keep: bool = True) -> DataFrame:
    """The rows with nodes (of the fields that selectors need) and states of their pages, both made while a page is read; without the page, if it is not kept."""
    return with_nodes(pages, html, "nodes", keep=keep, fields=SELECTED, of_scripts=("states", STATES, STATE_KIND, clean_states))
