"""Descriptions of interfaces: references against a plain walk, YAML by round trips, and odd texts."""

import json
import random

from pyspark.sql import functions as F

from sparkloom.functions import specs
from sparkloom.operators import nodes, trees


def yaml_of(value, indent=0):
    """A document in block style, with lists in flow style where they hold scalars alone."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v and not (isinstance(v, list) and all(not isinstance(x, (dict, list)) for x in v)):
                out.append(f"{pad}{json.dumps(k)}: # note\n{yaml_of(v, indent + 1)}")
            else:
                out.append(f"{pad}{json.dumps(k)}: {json.dumps(v)}")
        return "\n".join(out)
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}- {yaml_of(v, indent + 1).lstrip()}" if isinstance(v, (dict, list)) and v else f"{pad}- {json.dumps(v)}" for v in value)
    return pad + json.dumps(value)


def any_value(draw, depth=0):
    kind = draw.randrange(9 if depth < 4 else 6)
    if kind < 6:
        return draw.choice([None, True, False, 0, -3, 2.5, "", "a b", "x: y", "# no", "it's", 'q"q', "é\n", "- d", "[z", "{", "true", "12"])
    if kind < 8:
        return {draw.choice(["a", "b c", "x:y", "/p/{q}", "1", "é", ""]) + str(i): any_value(draw, depth + 1) for i in range(draw.randrange(0, 4))}
    return [any_value(draw, depth + 1) for _ in range(draw.randrange(0, 4))]


def test_yaml_round_trips():
    draw = random.Random(5)
    for _ in range(500):
        value = {"top": any_value(draw), "more": any_value(draw)}
        text = yaml_of(value)
        assert trees.parsed(text) == value, text


def test_odd_texts_give_nothing():
    for text in (None, "", "  ", "\t- a", "a: 1\n  b: 2", "a: [1, 2", "a: {b", "a: 'x", "- a\nb: c", "[" * 5000, '{"a":' * 5000, "a:\n" + "\n".join("  " * i + "- " for i in range(1, 400))):
        assert trees.as_json(text) is None
        assert trees.raml_endpoints(text) == [] and trees.raml_endpoints("#%RAML 1.0\n" + (text or "")) == []
        assert specs.resolve(text)["document"] is None
    assert trees.parsed("a: |+\n  x\n\n  y\nb: >-\n  p\n  q\n\n  r\nc: d # e") == {"a": "x\n\ny\n", "b": "p q\nr", "c": "d"}


def plain_walk(doc, value, open_=(), depth=0):
    """Resolution as the rule says it, without bookkeeping."""
    if isinstance(value, list):
        return [plain_walk(doc, v, open_, depth) for v in value]
    if not isinstance(value, dict):
        return value
    ref = value.get("$ref")
    if not isinstance(ref, str):
        return {k: plain_walk(doc, v, open_, depth) for k, v in value.items()}
    if depth > specs.MOST_DEEP:
        found = {"$ref": ref, "_maxDepthExceeded": True}
    elif ref in open_:
        found = {"$ref": ref, "_circular": True}
    elif ref[2:] not in doc:
        found = {"$ref": ref, "_notFound": True}
    else:
        found = plain_walk(doc, doc[ref[2:]], (*open_, ref), depth + 1)
    rest = {k: v for k, v in value.items() if k != "$ref"}
    return {**found, **rest} if isinstance(found, dict) else found


def test_references_of_random_graphs():
    draw = random.Random(8)
    for _ in range(200):
        size = draw.randrange(1, 6)
        doc = {f"n{i}": {"v": i, **{f"to{j}": {"$ref": f"#/n{draw.randrange(size + 1)}", **({"own": j} if draw.random() < 0.3 else {})} for j in range(draw.randrange(0, 3))}} for i in range(size)}
        got = specs.resolve(json.dumps(doc))
        assert json.loads(got["document"]) == plain_walk(doc, doc)
    deep = {f"n{i}": {"next": {"$ref": f"#/n{i + 1}"}} for i in range(30)} | {"n30": 1}
    assert json.loads(specs.resolve(json.dumps(deep))["document"]) == plain_walk(deep, deep)


def test_descriptions_of_odd_shapes(spark):
    docs = [None, "", "[]", "7", '{"openapi":"3.0.0"}', '{"openapi":"3.0.0","paths":[]}', '{"openapi":"3.1.0","paths":{"/a":7,"/b":{"get":"x","put":{"parameters":{"no":1},"responses":[],"tags":"t"}}}}', '{"asyncapi":"2.0.0","channels":7}', '{"asyncapi":"9.0.0"}', "<application><resources><resource><method/></resource></resources></application>", "<application wadl", "## A [GET]", "# A [/x]\n## B [GET]"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    assert [(r.id, r.path, r.method, r.parameters, r.tags) for r in specs.openapi_endpoints(df).collect()] == [(6, "/b", "PUT", [], [])]
    assert specs.asyncapi_operations(df).collect() == []
    assert [(r.id, r.path, r.method) for r in specs.wadl_endpoints(df).collect()] == [(9, "/", None)]
    assert [(r.id, r.x.path, r.x.summary) for r in df.select("id", F.explode(specs.blueprint_endpoints(F.col("doc"))).alias("x")).collect()] == [(12, "/x", "B")]
    assert specs.openapi_endpoints(df.limit(0)).collect() == [] and specs.wadl_endpoints(df.limit(0)).collect() == []


def test_xml_nodes():
    found = nodes.page_nodes('<a><P/>t<![CDATA[<x>&amp;]]><li>1<li>2</li></li></a>', xml=True)
    assert [(n["tag"], n["parent"]) for n in found] == [("a", -1), ("P", 0), ("#text", 0), ("#text", 0), ("li", 0), ("#text", 4), ("li", 4), ("#text", 6)]
    assert found[3]["text"] == "<x>&amp;"
