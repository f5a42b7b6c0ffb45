"""What keeps queries in time and memory on larger tables: how rows are dealt, what is read, and growth within a row."""

import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import selectors as q
from sparkloom.operators import joins, nodes, parts
from sparkloom.plans import frameworks, markup, pages, registry

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("made", [markup.shop, lambda s, d: markup.documents(s, d, "{key}"), pages.made, pages.orders, frameworks.made])
def test_made_texts_are_dealt_over_the_cluster(spark, made):
    # a small file of rows is one task, whatever the pages made of them come to
    assert made(spark, DATA).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_nodes_with_some_fields(spark):
    given = spark.createDataFrame([(1, "<ul><li>a<li><b>b</b></ul>"), (2, None), (3, "<p>" * 300)], "id int, html string")
    found = nodes.with_nodes(given, keep=False, fields=nodes.SELECTED, most_nodes=100)
    assert found.columns == ["id", "nodes"] and found.select(F.explode("nodes").alias("n")).select("n.*").columns == nodes.SELECTED.split()
    n = F.col("nodes")
    got = found.select("id", F.size(n).alias("size"), F.transform(q.select(n, "ul, li, b, p"), lambda x: q.raw_text(n, x, True)).alias("texts")).orderBy("id").collect()
    assert [r.size for r in got] == [6, 0, 300] and got[0].texts == ["ab", "a", "b", "b"] and got[2].texts == [""] * 300


def test_hints_of_a_large_sitemap(spark):
    # each URL once, the first counts: its entries are not compared with all others
    entry = lambda i, freq: f"<url><loc>http://s.org/dev/{i}</loc><changefreq>{freq}</changefreq></url>"
    xml = "".join(entry(i % 6000, "daily" if i < 6000 else "never") for i in range(9000))
    df = spark.createDataFrame([(xml,)], "xml string").select(F.explode(markup.m.sitemap_hints(F.col("xml"))).alias("h")).select("h.*")
    assert [(r.path, r.score) for r in df.collect()] == [(f"http://s.org/dev/{i}", 0.4) for i in range(6000)]


def test_hints_read_two_parts_of_an_entry_once(spark):
    # each part stood in the expression twice, and two of the four are not needed
    odd = "<url><loc> http://s.org/dev/&amp;1 </loc><changefreq> NEVER </changefreq></url><url><loc> </loc></url><url><lastmod>1</lastmod></url><url><loc>http://s.org/dev/2</loc></url>"
    df = spark.createDataFrame([(odd,), (None,)], "xml string").select(markup.m.sitemap_hints(F.col("xml")).alias("h"), markup.m.sitemap(F.col("xml")).alias("s"))
    hints, rows = df.select("h"), df.collect()
    assert hints._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    assert [(x.path, x.score) for x in rows[0].h] == [("http://s.org/dev/&1", 0.44), ("http://s.org/dev/2", 0.4)] and rows[1].h == rows[1].s == []
    assert [tuple(x) for x in rows[0].s] == [("http://s.org/dev/&1", None, "never", None), ("http://s.org/dev/2", None, None, None)]


def test_counts_above_equal_pairs(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, rng.uniform(-3, 3), float(rng.randint(-2, 2))])
    rows = [(i, rng.choice([1, 2, None]), value()) for i in range(120)]
    others = [(rng.choice([1, 2, 3, None]), value()) for i in range(150)]
    a, b = spark.createDataFrame(rows, "id int, k int, v double"), spark.createDataFrame(others, "k int, v double")
    want = a.alias("a").join(b.alias("b"), F.expr("a.k = b.k and b.v > a.v")).groupBy("a.id").agg(F.count("*").alias("n"))
    assert sorted(joins.counted_above(a, b, "k", "v").select("id", "n").collect()) == sorted(want.collect())


@needs_tables
def test_an_order_that_stands_twice_is_one_entry(spark, tmp_path):
    for name in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        rows.unionAll(rows.limit(40) if name == "orders" else rows.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = registry.QUERIES["a46_engine_stats"](spark, str(tmp_path)).select("domain", "entries", "patterns", "failures", "validators").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.SQL["a46_engine_stats"]).fetchall())


def test_titles_with_references(spark, tmp_path):
    titles = ["a &quot;b", "x&amp;&amp", "\n ü &lt;t&gt;\t &amp;lt; ", "&eacute;&#33;"]
    spark.createDataFrame([(i, f"<html>ü<title>{t}</title><h1>h</h1>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES["h1_titles"](spark, str(tmp_path)).select("page_id", "title", "source").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.SQL["h1_titles"]).fetchall())


def test_states_are_made_with_the_nodes(spark):
    # one pass of Python, so nodes do not go back to it in batches of thousands of pages
    given = spark.createDataFrame([(1, "<script id=ng-state type='application/json'>{\"title\":\"t\"}</script><script>window.__NUXT__={data:1}</script><p>x")], "id int, html string")
    found = frameworks.f.prepared(given, keep=False)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    row = found.first()
    assert found.columns == ["id", "nodes", "states"] and [s["name"] for s in row.states] == ["ng-state", "__NUXT__"]


ODD_PAGES = (
    "<!-- <p> --><p>a &amp; b<p class='x y'>c<br/>d</p><b id=q>e</b><!doctype x><?php ?>f</1>g</é>h",
    "<script>if (a < b) '<td>&amp;'</script x>t<TITLE>a&lt;b</Title>u<style>p</styl></style ><textarea>&amp;<b></textarea>",
    "<svg><path/><g>s</g></svg><path/>x<script src=a>never <b>ends &amp;",
    "<table><tr><td>1<td>2<table><thead><tr><th>h<th></thead><tr><td>in</table><tr><th>3</table>x</td>",
    "<table id=t><caption>c <i>d</i><tfoot><tr><td>f<tbody><form><tr><th>a<th>a</form><tr><td> 1\xa0<b>2</b><script>s</script></table><tr>",
    "<table><div><tr><td><p>a<div>b</table><table></table><table><tr></table><TABLE><THEAD><TR><TH>k</THEAD><TBODY><TR><TD>v",
    "a < b <i>c</i", "<a b='>'>x</a <b>", "</", "<", "", "<!--", "<!-->x", "<p>" * 3, "<title>a</title",
)


def test_trees_of_pages_with_the_same_tags():
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.rsplit(":", 1) for f in "node:int parent:int last:int depth:int nth:int tag:string id:string classes:array<string> attrs:map<string,string> text:string pre:boolean lists:int".split()]
    kind = pa.list_(pa.struct([(name, kinds[k]) for name, k in fields]))
    rng = random.Random(7)
    bits = [b for page in ODD_PAGES for b in re.split("(?=<)", page)]
    given = [*ODD_PAGES, *("".join(rng.choices(bits, k=rng.randrange(9))) for _ in range(300))]
    given = [page.replace("a", a) for a in ("a", "aa", "b", "&gt;") for page in given]
    plain, shaped = nodes.Tree(), nodes.Pages()
    for page in given:
        plain.page(page)
        shaped.page(page)
    assert shaped.arrow(kind).to_pylist() == plain.arrow(kind).to_pylist()


def test_a_template_is_read_twice_at_most(monkeypatch):
    read = []
    monkeypatch.setattr(nodes.Tree, "page", lambda self, page, xml=False, plain=nodes.Tree.page: (read.append(page), plain(self, page, xml))[1])
    found = nodes.Pages()
    for i in range(50):
        found.page(f"<ul data-once><li>{i}<li><a href=/{i}>x</a></ul>")
    assert len(read) == 2 and found.texts[-2:] == ["49", "x"] and found.size == 50 * 6


def test_tables_of_the_nodes_of_tables_alone(spark):
    given = spark.createDataFrame(list(enumerate(ODD_PAGES)), "id int, html string")
    found = lambda **how: nodes.with_nodes(given, keep=False, **how).select("id", pages.p.tables(F.col("nodes")).alias("t")).orderBy("id").collect()
    some, whole = found(**pages.OF_TABLES), found()
    assert some == whole and [len(r.t) for r in some[3:6]] == [2, 1, 2]
    held = nodes.with_nodes(given, keep=False, **pages.OF_TABLES).select("id", F.transform("nodes", lambda n: n["tag"]).alias("x"), F.transform("nodes", lambda n: n["parent"]).alias("up"), F.transform("nodes", lambda n: n["last"]).alias("last"))
    assert held.where("id = 0").first().x == []
    odd = held.where("id = 4").first()
    # the form is left out, so its row has no parent; the italics are left out, their text is not
    assert odd.x[:4] == ["table", "caption", "#text", "#text"] and odd.up[3] == -1 and odd.last[1] == 3 and -1 in [u for u, t in zip(odd.up, odd.x) if t == "tr"]


def test_nodes_of_some_tags_have_no_places(spark):
    with pytest.raises(ValueError, match="places"):
        nodes.with_nodes(spark.createDataFrame([("",)], "html string"), only="a")


@needs_tables
def test_json_of_a_page_is_read_once(spark):
    plan = registry.QUERIES["h19_organisation"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("application/ld+json, ") + plan.count("= application/ld+json") == 1


@needs_tables
@pytest.mark.parametrize("name, tag", [("h16_all_meta", "meta"), ("h40_html_links", "link"), ("f29_documentation_links", "link"), ("h8_anchors", "a"), ("h19_organisation", "script"), ("h20_has_structured_data", None), ("h22_has_article", None)])
def test_what_is_read_of_a_page(spark, monkeypatch, name, tag):
    asked = []
    monkeypatch.setattr(markup, "with_nodes", lambda rows, plain=markup.with_nodes, **how: (asked.append(how), plain(rows, **how))[1])
    registry.QUERIES[name](spark, DATA)
    assert asked and all(h.get("only") == tag and set(h["fields"].split()) <= set("node last tag attrs text".split()) for h in asked)


def test_a_node_that_is_looked_for_is_looked_for_once(spark):
    # a match stood in the expression of its text up to 18 times, and an author's in full for each
    given = nodes.with_nodes(spark.createDataFrame([("<p class=byline>By A<p class=post-category>k",)], "html string"))
    n = F.col("nodes")
    found = given.select(pages.p.author(n).alias("by"), pages.p.category(n).alias("k"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in (", author-name)", ", byline)", ", post-category)")] == [1, 1, 1]
    assert tuple(found.first()) == ("A", "k")


def test_alternatives_among_some_nodes_of_a_page(spark):
    # matches were taken by their number from the nodes left, which have other places there
    given = nodes.with_nodes(spark.createDataFrame([("<nav>n</nav><div><b>1</b></div><main><i>2</i></main><b>3",)], "html string"))
    left = q.without(F.col("nodes"), q.select(F.col("nodes"), "nav"))
    row = given.select(F.transform(q.select(left, "div b, main > i"), lambda x: x["tag"]).alias("t"), F.size(q.marked(F.col("nodes"))).alias("n")).first()
    assert row.t == ["b", "i"] and row.n == 6


@needs_tables
@pytest.mark.parametrize("name, missing", [("h29_strategies", ("keywords", "author-name")), ("h27_main_content", ("byline",)), ("h23_articles", ("related-posts", "keywords", "author-name")), ("h28_static_pages", ("keywords", "author-name"))])
def test_what_is_made_of_an_article(spark, monkeypatch, name, missing):
    asked = []
    monkeypatch.setattr(pages, "with_nodes", lambda rows, plain=pages.with_nodes, **how: (asked.append(how), plain(rows, **how))[1])
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    made = plan[: plan.index("MapInArrow")]
    assert asked and nodes.PLACES.isdisjoint(asked[0]["fields"].split())
    assert not [x for x in missing if x in made]


def test_the_first_good_place_is_the_content(spark):
    long = "w " * 150
    given = [
        f"<article><div class=post-content>{long}</div><nav>{long}</nav>a</article>",
        f"<div class=post-content>{long}b</div><article>short</article>",
        f"<article><nav>{long}</nav>c</article><div class=entry-content>{long}d</div>",
        f"<div>e</div><section>{long}f</section>",
    ]
    made = nodes.with_nodes(spark.createDataFrame(list(enumerate(given)), "id int, html string"), fields=pages.CONTENT)
    got = [r.x for r in made.select("id", pages.p.main_content(F.col("nodes")).alias("x")).orderBy("id").collect()]
    assert [x[-1] for x in got] == list("abdf") and len(got[0]) < 310


def odd_pages(n: int) -> list[str]:
    """Pages of odd pieces, each three times with other texts, so that trees are taken from pages before."""
    rng = random.Random(9)
    more = ["<a href='#x'>q</a>", "<a href=/p>~ <b>y</b></a>", "<A HREF='javascript:0'>", "<a href>", "<a href='/k&amp;l'>\xa0w ", "</a>", "<caption>~", "<tr>", "<tr><td>~", "<td>~ ", "<th>h", "</table>", "<table id=u>", "<table>", "<thead>", "<tbody>", "<form><tr>", "<div>"]
    bits = [b for page in ODD_PAGES for b in re.split("(?=<)", page)]
    made = ["".join(rng.choices(more, k=rng.randrange(25)) + rng.choices(bits, k=rng.randrange(3))) for _ in range(n)]
    given = [*ODD_PAGES, *made, "~".join(["<p>" + "v" * 90 + "<a href=/r>s</a>"] * 3)]
    return [page.replace("~", t) for page in given for t in ("t", "&lt;", "")]


@pytest.mark.parametrize("reader, plain", [("with_tables", pages.p.tables), ("with_links", pages.p.links)])
def test_parts_made_with_the_page_equal_those_of_its_nodes(spark, reader, plain):
    given = spark.createDataFrame([*enumerate(odd_pages(250)), (-1, None)], "id int, html string").coalesce(1)
    got = {r.id: r.x for r in getattr(parts, reader)(given, out="x").collect()}
    want = {r.id: r.x for r in nodes.with_nodes(given, keep=False).select("id", plain(F.col("nodes")).alias("x")).collect()}
    assert got == want and sum(map(len, want.values())) > 100


def test_rows_of_nested_tables_are_not_met_again(spark):
    # a table was compared with all rows of the page, so a page of nested tables took their product, and more
    page = "<table id=o>" + "<tr><td>x<table><tr><th>h<td>y</table></td>" * 3000
    (row,) = parts.with_tables(spark.createDataFrame([(page,)], "html string")).collect()
    assert [t.id for t in row.tables[:2]] == ["o", None] and len(row.tables) == 3001 and len(row.tables[0].rows) == 3000
    assert row.tables[3000].headers == ["h"] and row.tables[3000].rows == []


@needs_tables
@pytest.mark.parametrize("name", ["h5_order_tables", "h6_order_records", "h7_found_table", "h8_links_in_context"])
def test_no_nodes_where_parts_are_read(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "nodes#" not in plan
