"""Literals in scripts against JSON, and odd scripts and pages."""

import json
import random

from pyspark.sql import functions as F

from sparkloom.functions import frameworks
from sparkloom.operators import states
from tests.test_specs import any_value


def literal(draw, value):
    """A value as scripts write it."""
    space = draw.choice(["", " ", "\n", "/* } */", "// ]\n"])
    if isinstance(value, dict):
        inner = ",".join(space + (k if k.isidentifier() and draw.random() < 0.5 else json.dumps(k)) + ":" + literal(draw, v) for k, v in value.items())
        return "{" + inner + (draw.choice(["", ","]) if value else "") + space + "}"
    if isinstance(value, list):
        return "[" + ",".join(space + literal(draw, v) for v in value) + "]"
    if isinstance(value, str) and draw.random() < 0.5:
        quote = draw.choice("'`")
        return quote + value.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("\n", "\\n") + quote
    return {True: draw.choice(["true", "!0"]), False: draw.choice(["false", "!1"]), None: draw.choice(["null", "void 0", "undefined"])}[value] if value is None or isinstance(value, bool) else json.dumps(value)


def test_literals_round_trip():
    draw = random.Random(4)
    for _ in range(400):
        value = {"top": any_value(draw), "list": [any_value(draw)]}
        text = literal(draw, value)
        assert states.assigned(f"'a={{b:1}}'; // c={{}}\nwindow.x_1 = {text}; f(2)") == [("x_1", value)], text
        assert states.assigned(f"var p=(function(q,r){{return {{v:q,w:r}}}}({text},1))") == [("p", {"v": value, "w": 1})]
        assert states.assigned(f"y=JSON.parse({json.dumps(json.dumps(value))})") == [("y", value)]


def test_odd_scripts():
    draw = random.Random(6)
    pieces = ["a={", "}", "[", "]", "'", '"', "`", "/*", "*/", "//", "\n", "\\", "x", ":", ",", "(function(a){return ", ")", "1", "-", "=", "=>", "JSON.parse(", "\\u{110000}", "\\ud800"]
    for _ in range(800):
        script = "".join(draw.choice(pieces) for _ in range(draw.randrange(0, 30)))
        for s in states.states([{"id": None, "type": None, "text": script}, {"id": "i", "type": "application/json", "text": script}]):
            json.loads(s["json"])
    assert states.states([{"id": None, "type": None, "text": None}]) == []
    deep = "a=" + "{b:" * 5000 + "1" + "}" * 5000
    assert states.assigned(deep) == []
    tree = {"x": {"heading": "H"}, "n": "too short", "u": "http://a.org/long/enough/to/count", "text": "a text that is long enough", "z": ["another text of some length", 5]}
    assert states.title(tree) == "H" and "".join(states.texts(tree)) == "a text that is long enough\nanother text of some length\n"


def test_pages_of_frameworks(spark):
    long = "words and words " * 9
    pages = [None, "", "<p>x", f'<script id=__NEXT_DATA__ type="application/json">{{"props":{{"pageProps":{{"name":"n","x":"{long}"}}}}}}</script>', f"<script>window.__NEXT_DATA__={{props:{{pageProps:{{x:'{long}'}}}}}}</script>", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"x":"short"}}}</script><script>__NUXT__={}</script>', f"<script>state={{text:'{long}'}}</script>", f"<app-root></app-root><script>state={{text:'{long}'}}</script>", f"<div class='theme-default-content'><h1>T</h1>{long}</div>", f"<div class=content>{long}</div>", f'<script id="__VP_ROUTE_DATA__" type="application/json">{{"title":"v","summary":"{long}"}}</script>']
    df = frameworks.prepared(spark.createDataFrame(list(enumerate(pages)), "id int, html string"))
    got = {r.id: (r.x.framework, r.x.title) if r.x else None for r in df.select("id", frameworks.any_of(F.col("nodes"), F.col("states")).alias("x")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: ("nextjs", "n"), 4: ("nextjs", ""), 5: ("nuxt", ""), 6: None, 7: ("angular", ""), 8: ("vuepress", "T"), 9: None, 10: ("vitepress", "v")}


def test_texts_in_scripts():
    got = states.literals("""// fetch('/no')
    const b = 'http://a'; fetch(`${b}/x/${c}`); go(b + "/y"); s = /* 'no' */ "it\\'s"; o = {k: ''}; t = 'open""")
    assert [x["text"] for x in got] == ["http://a", "http://a/x/${c}", "http://a/y", "it's", ""]
    assert [x["before"][-3:] for x in got] == ["tb=", "ch(", "go(", ";s=", "{k:"]
    assert states.literals(None) == [] == states.literals("")
