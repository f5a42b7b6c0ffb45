"""Descriptions of interfaces as rows: OpenAPI 2 and 3, AsyncAPI 2 and 3, and references inside JSON documents.

A description is a JSON text; `operators.trees` makes one of YAML. Its parts are taken apart by JSON
functions and explode, so one description is spread over rows as soon as its paths are known.

Defined results: texts that are no description of the kind give no rows; missing members are null;
parts of the wrong kind are passed over; members keep their order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import selectors as q
from sparkloom.operators.nodes import with_nodes

#: Methods of an interface, in order; kinds of request bodies by preference; deepest reference that is followed.
METHODS = ("get", "post", "put", "delete", "patch")
BODIES = ("application/json", "application/x-www-form-urlencoded", "multipart/form-data")
MOST_DEEP = 10
RESOLVED = "struct<document:string,resolved:array<string>,circular:array<string>,errors:array<string>>"


class References:
    """One document whose local references are put in place of their pointers."""

    def __init__(self, document: dict, most_deep: int) -> None:
        self.document, self.most_deep = document, most_deep
        self.resolved: list[str] = []
        self.circular: list[str] = []
        self.errors: list[str] = []
        self.open: set[str] = set()

    def target(self, pointer: str):
        """What a pointer names, or KeyError; ~1 is a slash and ~0 a tilde."""
        value = self.document
        for part in pointer[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(value, list) and part.isdigit() and int(part) < len(value):
                value = value[int(part)]
            elif isinstance(value, dict):
                value = value[part]
            else:
                raise KeyError(part)
        return value

    def follow(self, pointer: str, depth: int):
        marked = {"$ref": pointer}
        if not pointer.startswith("#/"):
            self.errors.append(f"remote: {pointer}")
            return marked | {"_unresolved": True}
        if depth > self.most_deep:
            self.errors.append(f"too deep: {pointer}")
            return marked | {"_maxDepthExceeded": True}
        if pointer in self.open:
            self.circular.append(pointer)
            return marked | {"_circular": True}
        try:
            value = self.target(pointer)
        except KeyError:
            self.errors.append(f"not found: {pointer}")
            return marked | {"_notFound": True}
        self.resolved.append(pointer)
        self.open.add(pointer)
        value = self.walk(value, depth + 1)
        self.open.discard(pointer)
        return value

    def walk(self, value, depth: int = 0):
        if isinstance(value, list):
            return [self.walk(x, depth) for x in value]
        if not isinstance(value, dict):
            return value
        if not isinstance(value.get("$ref"), str):
            return {k: self.walk(x, depth) for k, x in value.items()}
        found = self.follow(value["$ref"], depth)
        beside = {k: x for k, x in value.items() if k != "$ref"}
        return found | beside if isinstance(found, dict) else found


def resolve(text: str | None, most_deep: int = MOST_DEEP) -> dict:
    """A JSON text with its local references in place, and the pointers that were followed, are circular or failed."""
    try:
        document = json.loads(text or "")
        refs = References(document, most_deep)
        out = json.dumps(refs.walk(document), ensure_ascii=False, separators=(",", ":")) if isinstance(document, dict) else None
    except (ValueError, RecursionError) as error:
        return {"document": None, "resolved": [], "circular": [], "errors": [type(error).__name__]}
    return {"document": out, "resolved": refs.resolved, "circular": refs.circular, "errors": refs.errors}


def with_references(rows: DataFrame, doc: str = "doc", out: str = "refs", most_deep: int = MOST_DEEP) -> DataFrame:
    """The rows with one more column: (document, resolved, circular, errors) of a column of JSON texts."""
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*kept).schema.add(out, T._parse_datatype_string(RESOLVED))
    kind = pa.struct([("document", pa.string()), *((n, pa.list_(pa.string())) for n in ("resolved", "circular", "errors"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([resolve(t.as_py(), most_deep) for t in batch.column(batch.schema.get_field_index(doc))], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), found], [*kept, out])

    return rows.mapInArrow(run, schema)


# ---- JSON texts


def entries(text: Column) -> Column:
    """The members of a JSON object as (key, value) JSON texts, in order; none for other texts."""
    return F.coalesce(F.map_entries(F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def elements(text: Column) -> Column:
    return F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>"), F.array().cast("array<string>"))


def at(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def member(found: Column, *names: str) -> Column:
    """The value of the first of some names in an array of (key, value)."""
    one = lambda n: F.get(F.filter(found, lambda e: e["key"] == n), F.lit(0))["value"]
    return F.coalesce(*map(one, names))


# ---- OpenAPI


def openapi_version(doc: Column) -> Column:
    """2.0, 3.0 or 3.1, or null."""
    three = at(doc, "$.openapi")
    return F.when(at(doc, "$.swagger") == "2.0", "2.0").when(three.rlike(r"^3\.1"), "3.1").when(three.rlike(r"^3\.0"), "3.0")


def base_url(doc: Column, spec_url: Column) -> Column:
    """Where the interface is: from host, path and schemes, or from the first server, made absolute by the URL of the description."""
    origin = F.regexp_extract(spec_url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)
    host = F.coalesce(at(doc, "$.host"), F.regexp_replace(origin, r"^.*://", ""))
    two = F.concat(F.coalesce(at(doc, "$.schemes[0]"), F.lit("https")), F.lit("://"), host, F.coalesce(at(doc, "$.basePath"), F.lit("")))
    server = F.coalesce(at(doc, "$.servers[0].url"), F.lit(""))
    three = F.when(server == "", origin).when(F.startswith(server, F.lit("/")), F.concat(origin, server)).when(~F.startswith(server, F.lit("http")), F.concat(F.lit("https://"), server)).otherwise(server)
    return F.when(at(doc, "$.swagger") == "2.0", two).otherwise(three)


def security_schemes(doc: Column) -> Column:
    """Array of (key, type, scheme, name, place) of the security schemes that are known."""
    found = F.concat(entries(at(doc, "$.securityDefinitions")), entries(at(doc, "$.components.securitySchemes")))

    def one(e: Column) -> Column:
        kind = at(e["value"], "$.type")
        basic = kind == "basic"
        key = kind == "apiKey"
        return F.struct(e["key"].alias("key"), F.when(basic, "http").otherwise(kind).alias("type"), F.when(basic, "basic").otherwise(F.when(kind == "http", at(e["value"], "$.scheme"))).alias("scheme"), F.when(key, at(e["value"], "$.name")).alias("name"), F.when(key, at(e["value"], "$.in")).alias("place"))

    return F.filter(F.transform(found, one), lambda x: x["type"].isin("apiKey", "http", "oauth2", "openIdConnect"))


def rate_limit(doc: Column) -> Column:
    """(limit, window, limit_header, remaining_header, reset_header) from extensions of the description or its info, and from names of its headers."""
    named = F.transform(entries(at(doc, "$.components.headers")), lambda e: e["key"])
    low = lambda k: F.lower(k)
    about = F.filter(named, lambda k: low(k).rlike("rate-?limit"))
    last = lambda test: F.try_element_at(F.filter(about, test), F.lit(-1))
    number = lambda *paths: F.coalesce(*[F.when(at(doc, p).rlike(r"^-?[\d.]+$"), at(doc, p).try_cast("double")) for p in paths])
    rest, back = (lambda k: low(k).rlike("remaining")), (lambda k: low(k).rlike("reset"))
    return F.struct(
        number("$.info['x-ratelimit-limit']", "$.info['x-rate-limit']", "$['x-ratelimit-limit']", "$['x-rate-limit']").alias("limit"),
        number("$.info['x-ratelimit-window']", "$.info['x-rate-limit-window']", "$['x-ratelimit-window']", "$['x-rate-limit-window']").alias("window"),
        F.coalesce(last(lambda k: ~rest(k) & ~back(k)), at(doc, "$['x-ratelimit-headers'].limit")).alias("limit_header"),
        F.coalesce(last(lambda k: rest(k)), at(doc, "$['x-ratelimit-headers'].remaining")).alias("remaining_header"),
        F.coalesce(last(lambda k: back(k) & ~rest(k)), at(doc, "$['x-ratelimit-headers'].reset")).alias("reset_header"),
    )


def openapi_endpoints(specs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, place, version, path, method, operation_id, summary, deprecated, tags, parameters, body_type, body_required, responses) of every operation.

    References are put in place first. Parameters are those of the path, then those of the operation,
    as (name, place, required, type); responses are (code, description).
    """
    whole = with_references(specs.select(key, F.col(doc).alias("__doc")), "__doc", "__refs").select(key, F.col("__refs.document").alias("__doc"))
    paths = whole.withColumn("version", openapi_version(F.col("__doc"))).where("version is not null").select(key, "version", F.posexplode(entries(at(F.col("__doc"), "$.paths"))).alias("__path", "__item"))
    item = entries(F.col("__item.value"))
    operations = F.filter(F.transform(F.array(*map(F.lit, METHODS)), lambda m: F.struct(m.alias("method"), F.get(F.filter(item, lambda e: e["key"] == m), F.lit(0))["value"].alias("op"))), lambda o: o["op"].rlike(r"^\s*\{"))
    rows = paths.select(key, "version", "__path", F.col("__item.key").alias("path"), member(item, "parameters").alias("__shared"), F.posexplode(operations).alias("__n", "__o"))
    op = F.col("__o.op")

    def parameter(p: Column) -> Column:
        kind = F.when(F.col("version") == "2.0", at(p, "$.type")).otherwise(at(p, "$.schema.type"))
        return F.struct(at(p, "$.name").alias("name"), at(p, "$.in").alias("place"), F.coalesce(at(p, "$.required") == "true", F.lit(False)).alias("required"), kind.alias("type"))

    listed = F.concat(elements(F.col("__shared")), elements(at(op, "$.parameters")))
    content = entries(at(op, "$.requestBody.content"))
    kinds = F.transform(content, lambda e: e["key"])
    body = F.coalesce(*[F.when(F.array_contains(kinds, b), F.lit(b)) for b in BODIES], F.get(kinds, F.lit(0)))
    three = F.col("version") != "2.0"
    return rows.select(
        key,
        (F.col("__path") * len(METHODS) + F.col("__n")).cast("long").alias("place"),
        "version",
        "path",
        F.upper("__o.method").alias("method"),
        at(op, "$.operationId").alias("operation_id"),
        at(op, "$.summary").alias("summary"),
        F.coalesce(at(op, "$.deprecated") == "true", F.lit(False)).alias("deprecated"),
        elements(at(op, "$.tags")).alias("tags"),
        F.filter(F.transform(listed, parameter), lambda p: (p["name"] != "") & (p["place"] != "")).alias("parameters"),
        F.when(three, body).alias("body_type"),
        F.when(three & body.isNotNull(), F.coalesce(at(op, "$.requestBody.required") == "true", F.lit(False))).alias("body_required"),
        F.transform(entries(at(op, "$.responses")), lambda e: F.struct(e["key"].alias("code"), at(e["value"], "$.description").alias("description"))).alias("responses"),
    )


# ---- AsyncAPI


def asyncapi_version(doc: Column) -> Column:
    """2.0 to 2.6 or 3.0, or null."""
    v = at(doc, "$.asyncapi")
    return F.when(v.rlike(r"^3\."), "3.0").when(v.rlike(r"^2\.[0-6]"), F.substring(v, 1, 3))


def servers(doc: Column) -> Column:
    """Array of (name, url, protocol) of a description's servers."""
    return F.transform(entries(at(doc, "$.servers")), lambda e: F.struct(e["key"].alias("name"), F.coalesce(at(e["value"], "$.url"), F.lit("")).alias("url"), F.coalesce(at(e["value"], "$.protocol"), F.lit("ws")).alias("protocol")))


def asyncapi_operations(specs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, version, channel, kind, operation_id, summary, message, content_type, parameters) of every operation of every channel.

    In version 2 operations stand in their channels; in version 3 they name their channel, and `send`
    is what clients publish. Of operations of one kind and channel the last counts. A message of
    several kinds is named oneOf; in version 3 the first message counts. Channels without operations
    have one row of a null kind.
    """
    d = F.col("__doc")
    known = specs.select(key, F.col(doc).alias("__doc")).withColumn("version", asyncapi_version(d)).where("version is not null")
    rows = known.select(key, "version", entries(at(d, "$.operations")).alias("__ops"), F.explode(entries(at(d, "$.channels"))).alias("__c"))
    c = F.col("__c.value")
    two = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("name"), at(c, f"$.{k}").alias("op")) for k in ("publish", "subscribe")]), lambda o: o["op"].rlike(r"^\s*\{"))
    channel = lambda op: F.coalesce(F.regexp_replace(at(op, "$.channel['$ref']"), "^#/channels/", ""), at(op, "$.channel"))
    action = lambda op: F.when(at(op, "$.action") == "send", "publish").when(at(op, "$.action") == "receive", "subscribe")
    mine = F.filter(F.transform(F.col("__ops"), lambda e: F.struct(action(e["value"]).alias("kind"), e["key"].alias("name"), e["value"].alias("op"), channel(e["value"]).alias("of"))), lambda o: o["of"] == F.col("__c.key"))
    last = lambda k: F.try_element_at(F.filter(mine, lambda o: o["kind"] == k), F.lit(-1))
    three = F.filter(F.transform(F.array(last("publish"), last("subscribe")), lambda o: F.struct(o["kind"].alias("kind"), o["name"].alias("name"), o["op"].alias("op"))), lambda o: o["op"].isNotNull())
    is_three = F.col("version") == "3.0"
    rows = rows.select(key, "version", F.when(is_three, F.coalesce(at(c, "$.address"), F.col("__c.key"))).otherwise(F.col("__c.key")).alias("channel"), F.transform(entries(at(c, "$.parameters")), lambda e: e["key"]).alias("parameters"), F.explode_outer(F.when(is_three, three).otherwise(two)).alias("__o"))
    op = F.col("__o.op")
    message = F.when(is_three, at(op, "$.messages[0]")).otherwise(at(op, "$.message"))
    several = at(message, "$.oneOf").isNotNull()
    named = F.coalesce(F.regexp_extract(at(message, "$['$ref']"), "([^/]*)$", 1), at(message, "$.name"))
    return rows.select(key, "version", "channel", F.col("__o.kind").alias("kind"), F.coalesce(F.col("__o.name"), at(op, "$.operationId")).alias("operation_id"), at(op, "$.summary").alias("summary"), F.when(several, "oneOf").otherwise(named).alias("message"), F.when(~F.coalesce(several, F.lit(False)), at(message, "$.contentType")).alias("content_type"), "parameters")


# ---- API Blueprint


def blueprint_endpoints(doc: Column) -> Column:
    """Array of (method, path, summary, path_params, query_params) of an API Blueprint.

    An action is a heading with a method in brackets, and takes the path of its own, else of the last
    heading before it whose brackets hold a path. Parameters are the list under `+ Parameters`, without
    those of the path.
    """
    blocks = F.filter(F.split(F.coalesce(doc, F.lit("")), r"(?m)^(?=#{1,4}\s)"), lambda b: b.rlike(r"^#{1,4}\s"))
    heading = lambda b: F.regexp_extract(b, r"^#{1,4}[ \t]+(.*)", 1)
    inner = lambda b: F.trim(F.regexp_extract(heading(b), r"\[([^\]]+)\]\s*$", 1))
    action = r"^(?i)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)(?:\s+(.+))?$"

    def over(found: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            before = F.filter(F.slice(found, F.lit(1), i + 1), lambda r: F.startswith(inner(r), F.lit("/")))
            shared = inner(F.try_element_at(before, F.lit(-1)))
            own = F.trim(F.regexp_extract(inner(b), action, 2))
            path = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.coalesce(shared, own))
            listed = F.regexp_extract(b, r"(?im)^\s*\+\s*Parameters\s*\n((?:[ \t]+\+[ \t]+.*\n?)+)", 1)
            return q.let(F.regexp_extract_all(path, F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda named: F.struct(F.upper(F.regexp_extract(inner(b), action, 1)).alias("method"), path.alias("path"), F.trim(F.regexp_replace(heading(b), r"\s*\[[^\]]+\]\s*$", "")).alias("summary"), named.alias("path_params"), F.filter(F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]+\+[ \t]+(\w+)"), F.lit(1)), lambda p: ~F.array_contains(named, p)).alias("query_params")))

        rows = F.transform(found, lambda b, i: F.when(inner(b).rlike(action), one(b, i)))
        return F.filter(rows, lambda r: r.isNotNull() & (r["path"] != ""))

    return q.let(blocks, over)


# ---- WADL


def wadl_endpoints(specs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, place, method, path, summary, path_params, query_params, body_type, response_type) of the methods of nested resources, paths and parameters of the resources around them inherited."""
    nodes = F.col("__nodes")
    rows = with_nodes(specs.select(key, F.col(doc).alias("__doc")).where(F.contains("__doc", F.lit("<application"))), "__doc", "__nodes", xml=True).select(key, "__nodes")
    rows = rows.withColumn("__resources", q.select(nodes, "resources resource")).withColumn("__params", q.select(nodes, "param")).withColumn("__media", q.select(nodes, "representation"))
    rows = rows.select(key, "__nodes", "__resources", "__params", "__media", F.posexplode(q.select(nodes, "resource > method")).alias("place", "__m"))
    m = F.col("__m")
    around = F.filter("__resources", lambda r: q.inside(m, r))
    slashed = lambda r: F.concat(F.lit("/"), F.regexp_replace(F.coalesce(q.attr(r, "path"), F.lit("")), "^/+|/+$", ""))
    path = F.regexp_replace(F.array_join(F.transform(around, slashed), ""), "/+", "/")
    holder = lambda x: F.get(nodes, x["parent"])
    # a parameter belongs to a resource around the method, or to the method's request
    mine = F.filter("__params", lambda p: q.inside(p, m) & (F.lower(holder(p)["tag"]) == "request") | (F.exists(around, lambda r: p["parent"] == r["node"])))
    names = lambda style: F.transform(F.filter(mine, lambda p: q.attr(p, "style") == style), lambda p: q.attr(p, "name"))
    media = lambda tag: q.attr(F.get(F.filter("__media", lambda x: q.inside(x, m) & (F.lower(holder(x)["tag"]) == tag)), F.lit(0)), "mediaType")
    return rows.select(key, F.col("place").cast("long").alias("place"), F.upper(q.attr(m, "name")).alias("method"), path.alias("path"), q.attr(m, "id").alias("summary"), names("template").alias("path_params"), names("query").alias("query_params"), media("request").alias("body_type"), media("response").alias("response_type"))
