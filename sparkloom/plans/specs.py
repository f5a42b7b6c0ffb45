"""Queries of descriptions of interfaces: references, OpenAPI, AsyncAPI, RAML, API Blueprint and WADL.

Each customer has a description of each kind, in several shapes by its key, with what must be found in
them known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import graphql as g
from sparkloom.functions import specs as a
from sparkloom.operators import trees
from sparkloom.plans.registry import query
from sparkloom.tables import load, spread


def made(s, d, *templates: str, only=None):
    """(id, doc): a text a customer, of the template of its key; @k is the key, @n the name."""
    k = F.col("c_custkey")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("@k"), k.cast("string")), F.lit("@n"), F.col("c_name"))
    return spread(load(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select(k.alias("id"), F.coalesce(*[F.when(k % len(templates) == i, fill(t)) for i, t in enumerate(templates)]).alias("doc"))


def told(kinds: int, *rows: tuple[int, str]) -> str:
    """SQL for rows of customers by the template of their key."""
    return " UNION ALL ".join(f"SELECT c_custkey AS id, {values} FROM customer WHERE c_custkey % {kinds} = {kind}" for kind, values in rows)


# ---- references

REFS = (
    '{"a":{"$ref":"#/defs/x~1y"},"defs":{"x/y":{"n":@k,"t":{"$ref":"#/defs/z~0"}},"z~":[1,{"$ref":"#/defs/leaf","more":"@n"}],"leaf":{"v":true}}}',
    '{"a":{"$ref":"#/b"},"b":{"to":{"$ref":"#/c"},"n":@k},"c":{"back":{"$ref":"#/b"}}}',
    '{"a":{"$ref":"#/none/@k"},"b":{"$ref":"other.json#/x","kept":1},"c":{"$ref":"#/list/1"},"list":["u",{"w":"@n"}]}',
    '{"no":"refs","$ref":7,"list":[@k,null,"é"]}',
    '[{"$ref":"#/0"}]',
)
RESOLVED_SQL = (
    (0, """'{"a":{"n":' || c_custkey || ',"t":[1,{"v":true,"more":"' || c_name || '"}]},"defs":{"x/y":{"n":' || c_custkey || ',"t":[1,{"v":true,"more":"' || c_name || '"}]},"z~":[1,{"v":true,"more":"' || c_name || '"}],"leaf":{"v":true}}}' AS document, CAST(6 AS INTEGER) AS resolved, '' AS circular, '' AS errors"""),
    (1, """'{"a":{"to":{"back":{"$ref":"#/b","_circular":true}},"n":' || c_custkey || '},"b":{"to":{"back":{"to":{"$ref":"#/c","_circular":true},"n":' || c_custkey || '}},"n":' || c_custkey || '},"c":{"back":{"to":{"back":{"$ref":"#/b","_circular":true}},"n":' || c_custkey || '}}}' AS document, CAST(6 AS INTEGER) AS resolved, '#/b,#/c,#/b' AS circular, '' AS errors"""),
    (2, """'{"a":{"$ref":"#/none/' || c_custkey || '","_notFound":true},"b":{"$ref":"other.json#/x","_unresolved":true,"kept":1},"c":{"w":"' || c_name || '"},"list":["u",{"w":"' || c_name || '"}]}' AS document, CAST(1 AS INTEGER) AS resolved, '' AS circular, 'not found: #/none/' || c_custkey || ',remote: other.json#/x' AS errors"""),
    (3, """'{"no":"refs","$ref":7,"list":[' || c_custkey || ',null,"é"]}' AS document, CAST(0 AS INTEGER) AS resolved, '' AS circular, '' AS errors"""),
    (4, "NULL AS document, CAST(0 AS INTEGER) AS resolved, '' AS circular, '' AS errors"),
)


@query("m38_resolved_references", told(5, *RESOLVED_SQL))
def _(s, d):
    found = a.with_references(made(s, d, *REFS)).select("id", "refs.*")
    return found.select("id", "document", F.size("resolved").alias("resolved"), F.array_join("circular", ",").alias("circular"), F.array_join("errors", ",").alias("errors"))


# ---- OpenAPI

SWAGGER = """{"swagger":"2.0","info":{"title":"S @k"},"host":"h@k.org","basePath":"/v1","schemes":["http","https"],"securityDefinitions":{"k":{"type":"apiKey","name":"X-K","in":"header"},"b":{"type":"basic"},"o":{"type":"other"}},
"paths":{"/a/{id}":{"parameters":[{"name":"id","in":"path","required":true,"type":"string"}],"get":{"operationId":"getA@k","summary":"A \\"of\\" @n","parameters":[{"name":"q","in":"query","type":"integer"},{"in":"query"},7],"responses":{"200":{"description":"ok"},"404":{"description":"no"}},"tags":["t","@n"]},"delete":{"deprecated":true,"responses":{"204":{}}},"trace":{},"put":null},"/none":null}}"""
OPEN = """{"openapi":"3.0.2","info":{"title":"O @k","x-ratelimit-limit":@k},"x-ratelimit-window":60,"servers":[{"url":"/api"}],"paths":{"/b":{"$ref":"#/components/pathItems/b"},"/c":{"post":{"requestBody":{"required":true,"content":{"text/xml":{},"multipart/form-data":{}}},"responses":{"201":{"$ref":"#/components/responses/made"}}}}},
"components":{"pathItems":{"b":{"get":{"operationId":"getB","parameters":[{"$ref":"#/components/parameters/p~1q"}],"responses":{}}}},"parameters":{"p/q":{"name":"p@k","in":"query","schema":{"type":"number"}}},"responses":{"made":{"description":"made @k"}},"securitySchemes":{"h":{"type":"http","scheme":"bearer"},"oi":{"type":"openIdConnect"}},"headers":{"X-RateLimit-Limit":{},"X-RateLimit-Remaining":{}}}}"""
YAML = """# of @n
openapi: 3.1.0
info: {title: "Y @k", version: 1}
servers:
- url: y.org/@k
paths:
  /d/{x}:
    parameters:
    - {name: x, in: path, required: true, schema: {type: integer}}
    get:
      summary: |-
        Two
        lines
      tags: [one, 'two: 2']
      responses:
        "200":
          description: fine # so
    patch:
      deprecated: true
      requestBody:
        content:
          application/x-www-form-urlencoded: {}
          application/json:
            schema:
              $ref: '#/components/schemas/s'
components:
  schemas:
    s: {type: object}
"""
OTHER = '{"swagger":"1.2","paths":{"/x":{"get":{}}}}'
NOTHING = "paths: [unfinished"
OPENAPI = (SWAGGER, OPEN, YAML, OTHER, NOTHING)


def described(s, d):
    return trees.with_json(made(s, d, *OPENAPI), "doc", "doc")


@query(
    "h53_openapi_endpoints",
    told(
        5,
        *[
            (kind, f"CAST({place} AS BIGINT) AS place, '{version}' AS version, '{path}' AS path, '{method}' AS method, {operation} AS operation_id, {summary} AS summary, {deprecated} AS deprecated, {tags} AS tags, {parameters} AS parameters, {body} AS body_type, {required} AS body_required, {responses} AS responses")
            for kind, place, version, path, method, operation, summary, deprecated, tags, parameters, body, required, responses in (
                (0, 0, "2.0", "/a/{id}", "GET", "'getA' || c_custkey", "'A \"of\" ' || c_name", "false", "'t,' || c_name", "'id:path:true:string|q:query:false:integer'", "NULL", "NULL", "'200:ok|404:no'"),
                (0, 1, "2.0", "/a/{id}", "DELETE", "NULL", "NULL", "true", "''", "'id:path:true:string'", "NULL", "NULL", "'204:'"),
                (1, 0, "3.0", "/b", "GET", "'getB'", "NULL", "false", "''", "'p' || c_custkey || ':query:false:number'", "NULL", "NULL", "''"),
                (1, 5, "3.0", "/c", "POST", "NULL", "NULL", "false", "''", "''", "'multipart/form-data'", "true", "'201:made ' || c_custkey"),
                (2, 0, "3.1", "/d/{x}", "GET", "NULL", "'Two' || chr(10) || 'lines'", "false", "'one,two: 2'", "'x:path:true:integer'", "NULL", "NULL", "'200:fine'"),
                (2, 1, "3.1", "/d/{x}", "PATCH", "NULL", "NULL", "true", "''", "'x:path:true:integer'", "'application/json'", "false", "''"),
            )
        ],
    ),
)
def _(s, d):
    found = a.openapi_endpoints(described(s, d))
    parts = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["place"], p["required"].cast("string"), p["type"])), "|")
    codes = F.array_join(F.transform("responses", lambda r: F.concat(r["code"], F.lit(":"), F.coalesce(r["description"], F.lit("")))), "|")
    return found.withColumns({"parameters": parts, "responses": codes, "tags": F.array_join("tags", ",")})


@query(
    "h53_openapi_heads",
    told(
        5,
        (0, "'2.0' AS version, 'http://h' || c_custkey || '.org/v1' AS base, 'k:apiKey:X-K:header|b:http:basic' AS security, NULL::DOUBLE AS most, NULL::DOUBLE AS within, NULL AS header"),
        (1, "'3.0' AS version, 'https://s.org/api' AS base, 'h:http:bearer|oi:openIdConnect' AS security, c_custkey::DOUBLE AS most, 60::DOUBLE AS within, 'X-RateLimit-Limit' AS header"),
        (2, "'3.1' AS version, 'https://y.org/' || c_custkey AS base, '' AS security, NULL::DOUBLE AS most, NULL::DOUBLE AS within, NULL AS header"),
    ),
)
def _(s, d):
    doc = F.col("doc")
    schemes = F.array_join(F.transform(a.security_schemes(doc), lambda x: F.concat_ws(":", x["key"], x["type"], x["scheme"], x["name"], x["place"])), "|")
    limit = a.rate_limit(doc)
    found = described(s, d).select("id", a.openapi_version(doc).alias("version"), a.base_url(doc, F.lit("https://s.org/x/openapi.json")).alias("base"), schemes.alias("security"), limit["limit"].alias("most"), limit["window"].alias("within"), limit["limit_header"].alias("header"))
    return found.where("version is not null")


# ---- AsyncAPI

ASYNC = (
    '{"asyncapi":"2.4.1","servers":{"p":{"url":"ws://a@k","protocol":"wss"},"q":{}},"channels":{"c/{u}":{"parameters":{"u":{},"v":{}},"publish":{"operationId":"send@k","message":{"name":"m","contentType":"application/json"}},"subscribe":{"summary":"@n","message":{"oneOf":[{"name":"x"},{"name":"y"}]}}},"idle":{}}}',
    '{"asyncapi":"3.0.0","channels":{"one":{"address":"a/@k"},"two":{}},"operations":{"o1":{"action":"send","channel":{"$ref":"#/channels/one"},"messages":[{"$ref":"#/components/messages/made"}]},"o2":{"action":"receive","channel":"two","summary":"@n","messages":[{"name":"n","contentType":"t"},{"name":"z"}]},"o3":{"action":"receive","channel":"two"},"o4":{"action":"none","channel":"two"}}}',
    '{"asyncapi":"1.2.0","channels":{"c":{"publish":{}}}}',
    "asyncapi: 2.0.0\nchannels:\n  y/@k:\n    subscribe:\n      operationId: s\n",
)


@query(
    "h54_asyncapi_operations",
    told(
        4,
        *[
            (kind, f"'{version}' AS version, {channel} AS channel, {what} AS kind, {operation} AS operation_id, {summary} AS summary, {message} AS message, {content} AS content_type, '{parameters}' AS parameters")
            for kind, version, channel, what, operation, summary, message, content, parameters in (
                (0, "2.4", "'c/{u}'", "'publish'", "'send' || c_custkey", "NULL", "'m'", "'application/json'", "u,v"),
                (0, "2.4", "'c/{u}'", "'subscribe'", "NULL", "c_name", "'oneOf'", "NULL", "u,v"),
                (0, "2.4", "'idle'", "NULL", "NULL", "NULL", "NULL", "NULL", ""),
                (1, "3.0", "'a/' || c_custkey", "'publish'", "'o1'", "NULL", "'made'", "NULL", ""),
                (1, "3.0", "'two'", "'subscribe'", "'o3'", "NULL", "NULL", "NULL", ""),
                (3, "2.0", "'y/' || c_custkey", "'subscribe'", "'s'", "NULL", "NULL", "NULL", ""),
            )
        ],
    ),
)
def _(s, d):
    found = a.asyncapi_operations(trees.with_json(made(s, d, *ASYNC), "doc", "doc"))
    return found.withColumn("parameters", F.array_join("parameters", ","))


@query("h54_asyncapi_servers", told(4, (0, "'p' AS name, 'ws://a' || c_custkey AS url, 'wss' AS protocol"), (0, "'q' AS name, '' AS url, 'ws' AS protocol")))
def _(s, d):
    return made(s, d, *ASYNC).select("id", F.explode(a.servers(F.col("doc"))).alias("x")).select("id", "x.*")


# ---- RAML, API Blueprint, WADL

RAML = (
    """#%RAML 1.0
title: R @k
/users:
  get:
    displayName: List of @n
    queryParameters:
      page?: integer
      size: {required: false}
      sort:
    headers: {X-A: string}
    responses:
      200:
      404:
  /{id}:
    uriParameters: {id: string}
    get:
    put:
      body:
        application/json:
          type: object
    /posts/{post}:
      delete:
/k@k:
  post:
    description: |
      made
""",
    "title: no RAML @k\n/x:\n  get:\n",
)


@query(
    "h57_raml_endpoints",
    told(
        2,
        *[
            (0, f"{path} AS path, '{method}' AS method, {summary} AS summary, '{parameters}' AS parameters, {body} AS body_type, '{codes}' AS codes")
            for path, method, summary, parameters, body, codes in (
                ("'/users'", "GET", "'List of ' || c_name", "page:query:false|size:query:false|sort:query:true|X-A:header:true", "NULL", "200,404"),
                ("'/users/{id}'", "GET", "NULL", "id:path:true", "NULL", ""),
                ("'/users/{id}'", "PUT", "NULL", "id:path:true", "'application/json'", ""),
                ("'/users/{id}/posts/{post}'", "DELETE", "NULL", "id:path:true|post:path:true", "NULL", ""),
                ("'/k' || c_custkey", "POST", "'made'", "", "NULL", ""),
            )
        ],
    ),
)
def _(s, d):
    found = trees.with_raml(made(s, d, *RAML), "doc").select("id", F.explode("endpoints").alias("x")).select("id", "x.*")
    parts = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["place"], p["required"].cast("string"))), "|")
    return found.withColumns({"parameters": parts, "codes": F.array_join("codes", ",")})


BLUEPRINT = """FORMAT: 1A
HOST: http://b.org

# B @k

## Group Things

## Things [/things{?page}]

### List of @n [GET]
+ Parameters
    + page: 1 (number)
    + size (optional)

+ Response 200

### Make [post]

## One [/things/{id}]
### Read [GET /k@k/{id}]
+ Parameters
    + id (required)
    + deep
### Gone [DELETE]
"""


@query(
    "h58_blueprint_endpoints",
    told(
        1,
        *[
            (0, f"'{method}' AS method, {path} AS path, {summary} AS summary, '{inside}' AS path_params, '{asked}' AS query_params")
            for method, path, summary, inside, asked in (
                ("GET", "'/things{?page}'", "'List of ' || c_name", "?page", "page,size"),
                ("POST", "'/things{?page}'", "'Make'", "?page", ""),
                ("GET", "'/k' || c_custkey || '/{id}'", "'Read'", "id", "deep"),
                ("DELETE", "'/things/{id}'", "'Gone'", "id", ""),
            )
        ],
    ),
)
def _(s, d):
    found = made(s, d, BLUEPRINT).select("id", F.explode(a.blueprint_endpoints(F.col("doc"))).alias("x")).select("id", "x.*")
    return found.withColumns({c: F.array_join(c, ",") for c in ("path_params", "query_params")})


WADL = """<?xml version="1.0"?><!-- <resource path="no"><method name="GET"/></resource> --><application xmlns="http://wadl.dev.java.net/2009/02"><doc title="W @k"/><resources base="http://w.org/">
<resource path="/a/"><param name="v" style="query"/><method name="get" id="listA"><request><param name="q" style="query"/><param name="h" style="header"/></request><response><representation mediaType="text/xml"/></response></method>
<resource path="{id}"><param name="id" style="template"/><method name="PUT"><request><representation mediaType="application/json"/></request></method><resource path="k@k"><method name="DELETE" id="x &amp; y"/></resource></resource></resource></resources></application>"""


@query(
    "h59_wadl_endpoints",
    told(
        1,
        *[
            (0, f"CAST({place} AS BIGINT) AS place, '{method}' AS method, {path} AS path, {summary} AS summary, '{inside}' AS path_params, '{asked}' AS query_params, {body} AS body_type, {response} AS response_type")
            for place, method, path, summary, inside, asked, body, response in (
                (0, "GET", "'/a'", "'listA'", "", "v,q", "NULL", "'text/xml'"),
                (1, "PUT", "'/a/{id}'", "NULL", "id", "v", "'application/json'", "NULL"),
                (2, "DELETE", "'/a/{id}/k' || c_custkey", "'x & y'", "id", "v", "NULL", "NULL"),
            )
        ],
    ),
)
def _(s, d):
    found = a.wadl_endpoints(made(s, d, WADL))
    return found.withColumns({c: F.array_join(c, ",") for c in ("path_params", "query_params")})


# ---- GraphQL

_T = lambda kind, name: f'{{"kind":"{kind}","name":"{name}"}}'
_W = lambda kind, inner: f'{{"kind":"{kind}","name":null,"ofType":{inner}}}'
INT, TEXT, IDENT = _T("SCALAR", "Int"), _T("SCALAR", "String"), _T("SCALAR", "ID")
THING = """{"kind":"OBJECT","name":"Thing@k","fields":[{"name":"__typename","args":[],"type":%s},{"name":"id","args":[],"type":%s},{"name":"label","args":null,"type":%s},{"name":"owner","args":[%%s],"type":%s},{"name":"odd","type":%s}]}""" % (TEXT, _W("NON_NULL", IDENT), TEXT, _W("NON_NULL", _T("OBJECT", "Owner")), _T("ENUM", "Odd"))
OWNER = """{"kind":"OBJECT","name":"Owner","fields":[{"name":"title","type":%s},{"name":"things","type":%s},{"name":"name","type":%s},{"name":"age","type":%s},{"name":"id","type":%s}]}""" % (_T("OBJECT", "Title"), _W("LIST", _T("OBJECT", "Thing@k")), TEXT, INT, IDENT)
QUERY = """{"kind":"OBJECT","name":"Q","fields":[{"name":"thing","args":[{"name":"ids","type":%s},{"name":"deep","type":%s}],"type":%s},{"name":"count","args":[],"type":%s},{"name":"odd","args":[],"type":%s}]}""" % (_W("NON_NULL", _W("LIST", _W("NON_NULL", IDENT))), INT, _W("NON_NULL", _W("LIST", _T("OBJECT", "Thing@k"))), INT, _T("ENUM", "Odd"))
CHANGE = """{"kind":"OBJECT","name":"M","fields":[{"name":"make","args":[{"name":"name","type":%s}],"type":%s}]}""" % (_W("NON_NULL", TEXT), _T("OBJECT", "Owner"))
PAGED = """,{"kind":"OBJECT","name":"ThingConnection","fields":[{"name":"pageInfo","type":%s}]}""" % TEXT
OTHERS = ',{"kind":"ENUM","name":"Odd","fields":null},{"kind":"OBJECT","name":"__Type","fields":[]},{"kind":"SCALAR","name":"Int"}'


def _schema(argument: str, more: str = "", change: bool = True) -> str:
    types = ",".join([QUERY, THING % argument, OWNER] + [CHANGE] * change)
    return '{"data":{"__schema":{"queryType":{"name":"Q"},"mutationType":' + ('{"name":"M"}' if change else "null") + ',"types":[' + types + more + OTHERS + "]}}}"


GRAPHS = (_schema('{"name":"After","type":%s}' % TEXT, PAGED), _schema('{"name":"first","type":%s},{"name":"page","type":%s}' % (INT, INT)), _schema('{"name":"pageSize","type":%s}' % INT, change=False), _schema('{"name":"skip","type":%s}' % INT), _schema(""), '{"data":{}}')


@query("h55_graphql_schemas", told(6, *[(k, f"CAST({n} AS INTEGER) AS entities, {style} AS paging, {change} AS mutations") for k, n, style, change in ((0, 5, "'relay'", "'M'"), (1, 4, "'cursor'", "'M'"), (2, 3, "'page'", "NULL"), (3, 4, "'offset'", "'M'"), (4, 4, "NULL", "'M'"))]))
def _(s, d):
    found = made(s, d, *GRAPHS).select("id", g.schema(F.col("doc")).alias("x")).where("x is not null")
    return found.select("id", F.size(g.entity_types(F.col("x"))).alias("entities"), g.paging(F.col("x")).alias("paging"), F.col("x.mutationType.name").alias("mutations"))


OF_THING = "query ThingQuery($ids: [ID!]!) {\n  thing(ids: $ids) {\n    id label owner { title name age }\n  }\n}"
OF_ODD = "query OddQuery {\n  odd {\n    id\n  }\n}"
OF_MAKE = "mutation MakeMutation($name: String!) {\n  make(name: $name) {\n    things { __typename id label } name age id\n  }\n}"


@query(
    "h56_graphql_queries",
    told(
        6,
        *[
            (k, f"'{kind}' AS kind, CAST({place} AS BIGINT) AS place, '{name}' AS name, {returns} AS returns, '{must}' AS required, '{may}' AS optional, '{text}' AS query")
            for k in range(5)
            for kind, place, name, returns, must, may, text in (("query", 0, "thing", "'Thing' || c_custkey", "ids", "deep", OF_THING), ("query", 2, "odd", "'Odd'", "", "", OF_ODD), ("mutation", 0, "make", "'Owner'", "name", "", OF_MAKE))
            if k != 2 or kind == "query"
        ],
    ),
)
def _(s, d):
    found = g.operations(made(s, d, *GRAPHS))
    return found.withColumns({c: F.array_join(c, ",") for c in ("required", "optional")})
