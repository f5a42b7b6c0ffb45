"""Operators that SQL cannot express, on fixtures and against plain Python."""

import datetime as dt
import difflib
import os
import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as x
from sparkloom.functions import url as l
from sparkloom.functions import markup, pages
from sparkloom.functions import selectors as q
from sparkloom.operators import change, diff, graph, nodes
from sparkloom.plans import documents, registry
from sparkloom.sources import stores
from sparkloom.streaming import state

PAGE = """<html lang="en"><head><title>Plain</title><meta property="og:title" content="Better"><link rel="next" href="/p/2">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "name": "A"}, {"@type": ["Product"], "offers": {"price": 3}}]}</script></head>
<body><a href="x.html">X <b>y</b></a><table id="t"><caption>Cap</caption><tr><th>A<th>B</tr><tr><td>1<td>2 &amp; 3</tr><tr><td>4</td><td>5</td></tr></table>
<table><tr><td>only</table><span itemprop="price" content="9"></span><h1>Head</body>"""


def test_page_structure(spark):
    df = nodes.with_nodes(spark.createDataFrame([(1, "http://a.org/p/1", PAGE, "kept"), (2, None, None, None), (3, "", "", "")], "page_id long, url string, html string, nodes string"))
    n = F.col("nodes")
    found = df.select("page_id", markup.title(n).alias("title"), q.attr(q.first(n, "html"), "lang").alias("lang"), pages.tables(n).alias("tables"), markup.anchors(n, F.col("url")).alias("anchors"), markup.json_ld(n).alias("json_ld"), markup.link_elements(n, F.col("url")).alias("links"), q.extraction(n).alias("e"), pages.links(n).alias("out"))
    got = {r.page_id: r for r in found.collect()}
    one = got[1]
    assert (one.title, one.lang) == ("Better", "en")
    assert one.tables[0].headers == ["A", "B"] and one.tables[0].rows == [["1", "2 & 3"], ["4", "5"]] and one.tables[0].caption == "Cap" and one.tables[1].rows == [["only"]]
    assert [(a.href, a.text) for a in one.anchors] == [("http://a.org/p/x.html", "X y")] and [x.context for x in one.out] == ["X yCapAB12 & 345\nonlyHead"]
    assert len(one.json_ld) == 2 and [(x.rel, x.href) for x in one.links] == [("next", "http://a.org/p/2")]
    for i in (2, 3):
        assert got[i].title is None and got[i].tables == got[i].anchors == got[i].json_ld == [] and (got[i].e.text, got[i].e.title_source) == ("", "unknown")


class Plain(HTMLParser):
    """Text and start tags of a page by the standard library, to hold the tokenizer against."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.texts = [], []

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)

    def handle_data(self, data):
        self.texts.append(data)


def test_nodes_against_the_standard_library():
    for path in ("/root/testdata/sf0.001/pages.parquet",):
        if not os.path.exists(path):
            pytest.skip("no test tables")
        for page in pq.read_table(path).to_pylist():
            plain, found = Plain(), nodes.page_nodes(page["html"] or "")
            plain.feed(page["html"] or "")
            plain.close()
            assert [n["tag"] for n in found if n["tag"] != "#text"] == plain.tags
            assert "".join(n["text"] for n in found if n["tag"] == "#text") == "".join(plain.texts)


def brute_tree(found):
    """Parent, last and depth again from parents alone."""
    last = {n["node"]: n["node"] for n in found}
    for n in reversed(found):
        if n["parent"] >= 0:
            last[n["parent"]] = max(last[n["parent"]], last[n["node"]])
    return [last[n["node"]] for n in found]


def test_no_page_stops_a_job():
    rng = random.Random(3)
    pieces = ["<", ">", "<![foo[", "<!-- ", "-->", "<a href='http://[x'>", "<table>", "<tr>", "<td>", "</table>", "<ul><li>", "</ul>", '<script type="application/ld+json">', "[[", '{"a":' * 2000, "</script>", "<p itemprop=x>", "</p>", "</div>", "<div>", "&#x;", "&#0;", "&eacute", "<link rel=next href='//['>", "text", "\x00", '<a "', "</", "<br/>", "</br>", "<textarea>&lt;<b>"]
    for _ in range(600):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        found = nodes.page_nodes(page)
        assert [n["node"] for n in found] == list(range(len(found))) and [n["last"] for n in found] == brute_tree(found)
        for n in found:
            above = found[n["parent"]] if n["parent"] >= 0 else None
            assert n["start"] <= n["open"] <= n["close"] <= n["stop"] <= len(page) and (above is None or (above["depth"] == n["depth"] - 1 and above["open"] <= n["start"] and n["stop"] <= above["stop"]))


def test_selectors(spark):
    page = """<body><main id=m class="a b"><p class=x>1<p>2<div><p data-k="v w">3</div></main><p lang=en-GB>4<section><!-- <p> --><article><h2>t</h2></article></section>"""
    df = nodes.with_nodes(spark.createDataFrame([(page,)], "html string"))
    texts = lambda s: F.transform(q.select(F.col("nodes"), s), lambda x: q.text_of(F.col("nodes"), x))
    want = {"p": "1234", "main p": "123", "main > p": "12", "#m > .x": "1", "p[data-k]": "3", '[data-k~="w"]': "3", 'p[lang^="en"], .x': "14", "[lang$=GB]": "4", '[data-k*="v"]': "3", "div p, main > p": "123", "body main div > p": "3", "main.a.b > div": "3", "main.a.c": "", "section h2": "t", "*[class]": "1231"}
    got = df.select(*[F.array_join(texts(s), "").alias(str(i)) for i, s in enumerate(want)]).first()
    assert ["".join(sorted(x)) if s == "*[class]" else x for s, x in zip(want, got)] == ["".join(sorted(x)) if s == "*[class]" else x for s, x in want.items()]
    with pytest.raises(ValueError):
        q.select(F.col("nodes"), "p:first")


def test_diffs(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))), "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, None, "a")]
    got = {r.doc_id: r for r in diff.diffs(spark.createDataFrame(rows, "doc_id long, old string, new string"), "doc_id").collect()}
    for i, a, b in rows[:-1]:
        ops = diff.operations(a.split("\n"), b.split("\n"))
        assert [s for k, s in ops if k != "+"] == a.split("\n") and [s for k, s in ops if k != "-"] == b.split("\n")
        table = [[0] * (len(b.split("\n")) + 1) for _ in range(len(a.split("\n")) + 1)]
        for p, s in enumerate(a.split("\n"), 1):
            for q, t in enumerate(b.split("\n"), 1):
                table[p][q] = table[p - 1][q - 1] + 1 if s == t else max(table[p - 1][q], table[p][q - 1])
        assert got[i].kept == table[-1][-1]
    old, new = [str(i) for i in range(30)], [str(i) for i in range(30) if i not in (3, 20)] + ["z"]
    want = "\n".join(list(difflib.unified_diff(old, new, lineterm=""))[2:])
    assert diff.unified(diff.operations(old, new)) == want


def test_every_document_is_held_against_the_one_before(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x\ny", "x\nz", "", None])) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    last, want = {}, {}
    for i, source, text in sorted(rows):
        want[i] = last.get(source)
        last[source] = text
    got = change.against_previous(df, ["source"], ["doc_id"], df.text).collect()
    assert {r.doc_id: r.before for r in got} == want and len(got) == len(rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    pairs = {r.doc_id: (r.old, r.new) for r in documents.pairs(spark, str(tmp_path)).collect()}
    texts = {i: text for i, _, text in rows}
    assert pairs == {i: (old, texts[i]) for i, old in want.items() if old is not None}
    assert {r.doc_id for r in registry.QUERIES["d1_line_diffs"](spark, str(tmp_path)).collect()} == set(pairs)


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "d"), ("x", "y"), (None, "q")]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "x"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Fee: €1.234,50 in 3 weeks", "a: 1\nb: 2\na: 3", "max-age=60, no-store")], "t string, kv string, cc string")
    df.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    r = df.select(x.money(df.t).alias("m"), x.duration_days(df.t).alias("d"), x.key_values(df.kv).alias("kv"), x.cache_directives(df.cc).alias("cc"), x.hash31(df.t).alias("h"), x.language_code(df.t).alias("lc")).first()
    assert (r.m, r.d, r.kv, r.cc) == (1234.5, 21, {"a": "3", "b": "2"}, {"max-age": "60", "no-store": ""})


@pytest.mark.parametrize(("url", "safe"), [("http://127.0.0.1/", False), ("https://10.1.2.3/x", False), ("http://172.20.0.1/", False), ("http://169.254.169.254/", False), ("http://8.8.8.8/", True), ("ftp://a.org/", False), ("https://a.org", True), ("http://localhost:80/", False)])
def test_safe_urls(spark, url, safe):
    assert spark.createDataFrame([(url,)], "u string").select(l.is_safe(l.F.col("u"))).first()[0] is safe


def test_stores(spark, tmp_path):
    assert stores.read_json(spark, str(tmp_path / "none.json"), stores.KEY_VALUE).count() == 0
    stores.upsert(str(tmp_path / "kv"), spark.createDataFrame([("n", "k", "1", 1), ("n", "k", "2", 5), ("m", "k", "3", 2)], stores.KEY_VALUE))
    now = stores.latest_values(spark.read.parquet(str(tmp_path / "kv")), ["namespace", "key"], ["updated_at"])
    assert {(r.namespace, r.value) for r in now.collect()} == {("n", "2"), ("m", "3")}
    line = stores.exposition(spark.createDataFrame([("a\"b", 3)], "tool string, n long"), "calls", ["tool"], "n").first()[0]
    assert line == 'calls{tool="a\\"b"} 3'


def run_stream(spark, tmp_path, rows, schema, build):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    name = f"out{abs(hash(str(tmp_path)))}"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def test_back_off_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=i), ok) for i, ok in enumerate([True, False, False, False, True, False])]
    out = run_stream(spark, tmp_path, rows, "k string, ts timestamp, success boolean", lambda s: state.back_off(s, "k", 60, 200))
    assert out.sort_values("ts").wait_s.tolist() == [0, 60, 120, 200, 0, 60]


def test_limit_and_window_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=s)) for s in (0, 10, 20, 61, 62)]
    out = run_stream(spark, tmp_path, rows, "k string, ts timestamp", lambda s: state.sliding_limit(s, "k", 2)).sort_values("ts")
    assert out.admitted.tolist() == [True, True, False, True, False] and out.delay_s.tolist()[2] == 40
    (tmp_path / "w").mkdir()
    out = run_stream(spark, tmp_path / "w", rows, "k string, ts timestamp", lambda s: state.anchored_windows(s, "k", 2, 60)).sort_values("ts")
    assert out.n.tolist() == [1, 2, 3, 1, 2]


def test_consensus_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=i), p) for i, p in enumerate([True, False, True, True, False, False, True])]
    out = run_stream(spark, tmp_path, rows, "k string, ts timestamp, positive boolean", lambda s: state.consensus(s, "k")).sort_values("ts")
    assert out.adjustment.tolist() == [0, 0, 0, 1, 0, -1, 0]


def test_markup_of_odd_pages(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import markup as m

    pages = [
        ('<div itemscope itemtype="http://schema.org/BlogPosting"><h1 itemprop="headline">A</h1><a itemprop="author" href="/b">B</a></div>', ("A", "/b")),
        ('<script type="application/ld+json">{"@graph": null}</script><script type="application/ld+json">' + '{"a":' * 3000 + "</script>", (None, None)),
        ('<script type="application/ld+json">[{"@type": "Article", "name": "n", "author": "x"}]</script>', ("n", "x")),
        ("<![foo[ <meta property=og:type content=article><meta property='og:title' content='t'> <a href='http://[abc'>", ("t", None)),
        ("", (None, None)),
        (None, (None, None)),
    ]
    rows = nodes.with_nodes(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "id int, html string"))
    got = rows.select("id", m.article(F.col("nodes")).alias("a"), m.anchors(F.col("nodes"), F.lit("http://x/")).alias("l"), m.product(F.col("nodes")).alias("p"), m.organisation(F.col("nodes")).alias("o")).orderBy("id").collect()
    assert [(r.a.headline, r.a.author) for r in got] == [w for _, w in pages]


def plain_operations(old, new):
    """Differences by the whole table."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append((" ", old[i]))
            i, j = i + 1, j + 1
        elif j < len(new) and (i == len(old) or best[i][j + 1] >= best[i + 1][j]):
            out.append(("+", new[j]))
            j += 1
        else:
            out.append(("-", old[i]))
            i += 1
    return out


def test_differences_equal_the_whole_table():
    rng = random.Random(2)
    for _ in range(300):
        old, new = (["x"] * 0 + [rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert diff.operations(old, new) == plain_operations(old, new)
    assert len(diff.operations([str(i) for i in range(6000)], [str(2 * i) for i in range(6000)])) == 9000


def test_lines_side_by_side(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "", "d  e"]) for _ in range(rng.randrange(0, 12))), "\n".join(rng.choice(["a b", "a x", "", "d e"]) for _ in range(rng.randrange(0, 12)))) for i in range(40)] + [(100, None, "a"), (101, "a", None), (102, None, None)]
    got = {}
    for r in diff.lines_side_by_side(spark.createDataFrame(rows, "id long, old string, new string"), "id").collect():
        got.setdefault(r.id, []).append(r)
    for i, old, new in rows:
        lines = sorted(got[i], key=lambda r: r.place)
        assert [r.place for r in lines] == list(range(1, len(lines) + 1))
        for side, text in (("old", old), ("new", new)):
            assert [(r[f"{side}_line"], r[side]) for r in lines if r[side] is not None] == list(enumerate((text or "").split("\n"), 1))
        for r in lines:
            assert (r.type == "equal") == (r.old == r.new) or r.type == "modify"
            assert (r.type == "modify") == (r.old_words is not None)
            if r.old_words is not None:
                assert "".join(w.text for w in r.old_words) == r.old and "".join(w.text for w in r.new_words) == r.new
                assert [w.text for w in r.old_words if not w.changed] == [w.text for w in r.new_words if not w.changed]
    assert diff.inline("a  b  c", "a  b  c")[0] == [{"text": t, "changed": False} for t in ("a", "  ", "b", "  ", "c")]


def test_sections_and_slots_of_odd_texts(spark):
    from sparkloom.functions import sections, slots

    rows = [(0, None, None), (1, "", "a b c"), (2, "a b c", None), (3, "same\n\n\nsame", "same"), (4, "one two three", "one two three four\n\none two three five"), (5, "x" * 300 + " end", "x" * 300 + " other")]
    df = spark.createDataFrame(rows, "id int, old string, new string")
    got = {r.id: [(x.type, x.old, x.new) for x in r.x] for r in df.select("id", sections.section_changes(F.col("old"), F.col("new")).alias("x")).collect()}
    assert got[0] == got[3] == [] and got[1] == [("added", None, "a b c")] and got[2] == [("removed", "a b c", None)]
    assert got[4] == [("modified", "one two three", "one two three four"), ("modified", "one two three", "one two three five")]
    assert got[5] == [("added", None, "x" * 200), ("removed", "x" * 200, None)]
    dates = [(None, None), ("", ""), ("31.12.51", "1951-12-31"), ("1/2/49", "2049-02-01"), ("Sept 3, 2024", "2024-09-03"), ("3 agosto 2024", "2024-08-03"), ("5. marz 2020", "2020-03-05"), ("5 de juin 2020", "2020-06-05"), ("5 nomonth 2020", "5 nomonth 2020")]
    assert [(r.d, r.x) for r in spark.createDataFrame([(d,) for d, _ in dates], "d string").select("d", slots.iso_date(F.col("d")).alias("x")).collect()] == dates
    texts = [None, "", "1:3\n" + "9:30 " * 60, "Call 9:30\nCall 9:30\nnothing here"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(slots.time_slots(F.col("t")).alias("x")).collect()
    assert [[(s.date, s.time, s.raw) for s in r.x] for r in found] == [[], [], [], [(None, "9:30", "Call 9:30")]]
