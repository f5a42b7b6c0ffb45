"""Introspected GraphQL schemas: named types, paging style, and a query for every operation.

A schema is the JSON of an introspection. It is read into typed columns once; references to types may
be wrapped DEEP times, as introspection queries ask for.

Defined results: texts that are no introspection give nulls and no rows; fields that return built-in
types, or whose names start with two underscores, are no operations of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import selectors as q

DEEP = 8
#: Built-in types; names of fields and arguments that tell of paging; fields that are asked of nested types, at most so many.
BUILT_IN = ("__Schema", "__Type", "__TypeKind", "__Field", "__InputValue", "__EnumValue", "__Directive", "__DirectiveLocation", "String", "Int", "Float", "Boolean", "ID")
RELAY, CURSOR, PAGE, OFFSET = ("edges", "pageinfo", "cursor", "node"), ("after", "before", "first", "last"), ("page", "perpage", "pagesize"), ("offset", "limit", "skip", "take")
NESTED, MOST_NESTED = ("id", "name", "title"), 3


def _reference(deep: int) -> str:
    return "struct<kind:string,name:string" + (f",ofType:{_reference(deep - 1)}" if deep else "") + ">"


ARGUMENT = f"struct<name:string,type:{_reference(DEEP)}>"
FIELD = f"struct<name:string,args:array<{ARGUMENT}>,type:{_reference(DEEP)}>"
NAMED = "struct<name:string>"
SCHEMA = f"struct<queryType:{NAMED},mutationType:{NAMED},subscriptionType:{NAMED},types:array<struct<kind:string,name:string,fields:array<{FIELD}>>>>"


def schema(doc: Column) -> Column:
    """The schema of an introspection, with or without `data` around it."""
    return F.from_json(F.coalesce(F.get_json_object(doc, "$.data.__schema"), F.get_json_object(doc, "$.__schema")), SCHEMA)


def named(reference: Column, deep: int = DEEP) -> Column:
    """The name of the type that a reference wraps."""
    found, at = [reference["name"]], reference
    for _ in range(deep):
        at = at["ofType"]
        found.append(at["name"])
    return F.coalesce(*found, F.lit("Unknown"))


def written(reference: Column, deep: int = DEEP) -> Column:
    """A reference as queries write it: [T!]!"""
    name = F.coalesce(reference["name"], F.lit("String"))
    if not deep:
        return name
    inner = written(reference["ofType"], deep - 1)
    return F.when(reference["kind"] == "NON_NULL", F.concat(inner, F.lit("!"))).when(reference["kind"] == "LIST", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(name)


def entity_types(found: Column) -> Column:
    """Names of the object types that are not built in."""
    mine = F.filter(found["types"], lambda t: (t["kind"] == "OBJECT") & ~t["name"].isin(*BUILT_IN) & ~F.startswith(t["name"], F.lit("__")))
    return F.transform(mine, lambda t: t["name"])


def paging(found: Column) -> Column:
    """relay, cursor, page or offset: the most telling style that an object type shows, or null."""
    objects = F.filter(found["types"], lambda t: (t["kind"] == "OBJECT") & t["fields"].isNotNull())
    fields = lambda t: F.transform(t["fields"], lambda f: F.lower(f["name"]))
    relay = F.exists(objects, lambda t: F.endswith(t["name"], F.lit("Connection")) & F.exists(fields(t), lambda n: n.isin(*RELAY)))
    asked = F.flatten(F.flatten(F.transform(objects, lambda t: F.transform(t["fields"], lambda f: F.transform(F.coalesce(f["args"], F.array().cast(f"array<{ARGUMENT}>")), lambda a: F.lower(a["name"]))))))
    has = lambda names: F.exists(asked, lambda n: n.isin(*names))
    return F.when(relay, "relay").when(has(CURSOR), "cursor").when(has(PAGE), "page").when(has(OFFSET), "offset")


def selection(types: Column, type_: Column) -> Column:
    """Fields that a query asks of a type: its built-in ones, and of others the first few that are built in or name them."""
    own = F.filter(type_["fields"], lambda f: ~F.startswith(f["name"], F.lit("__")))

    def one(f: Column) -> Column:
        def nested(t: Column) -> Column:
            told = F.filter(t["fields"], lambda x: x["name"].isin(*NESTED) | named(x["type"]).isin(*BUILT_IN))
            names = F.slice(F.transform(told, lambda x: x["name"]), 1, MOST_NESTED)
            return F.when(F.size(names) > 0, F.concat(f["name"], F.lit(" { "), F.array_join(names, " "), F.lit(" }")))

        other = q.let(F.get(F.filter(types, lambda t: t["name"] == named(f["type"])), F.lit(0)), nested)
        return F.when(named(f["type"]).isin(*BUILT_IN), f["name"]).otherwise(other)

    return F.filter(F.transform(own, one), lambda s: s.isNotNull())


def operations(specs: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """(key, kind, place, name, returns, required, optional, query) of every operation of the query and mutation types."""
    rows = specs.select(key, schema(F.col(doc)).alias("__s"))
    root = lambda kind: F.get(F.filter("__s.types", lambda t: t["name"] == F.col(f"__s.{kind}Type.name")), F.lit(0))["fields"]
    none = F.array().cast(f"array<{FIELD}>")
    told = lambda kind: F.transform(F.coalesce(root(kind), none), lambda f, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), f.alias("f")))
    both = F.concat(told("query"), told("mutation"))
    rows = rows.where("__s is not null").select(key, F.col("__s.types").alias("__types"), F.explode(both).alias("__o")).where(~named(F.col("__o.f.type")).isin(*BUILT_IN))
    f = F.col("__o.f")
    args = F.coalesce(f["args"], F.array().cast(f"array<{ARGUMENT}>"))
    must = F.filter(args, lambda a: a["type"]["kind"] == "NON_NULL")
    may = F.filter(args, lambda a: F.coalesce(a["type"]["kind"] != "NON_NULL", F.lit(True)))
    names = lambda xs: F.transform(xs, lambda a: a["name"])
    rows = rows.select(key, F.col("__o.kind").alias("kind"), F.col("__o.place").cast("long").alias("place"), f["name"].alias("name"), named(f["type"]).alias("returns"), must.alias("__must"), names(may).alias("optional"), "__types")
    asked = q.let(F.get(F.filter("__types", lambda t: t["name"] == F.col("returns")), F.lit(0)), lambda t: selection(F.col("__types"), t))
    listed = lambda parts: F.when(F.size("__must") > 0, F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))).otherwise("")
    defined = listed(F.transform("__must", lambda a: F.concat(F.lit("$"), a["name"], F.lit(": "), written(a["type"]))))
    used = listed(F.transform("__must", lambda a: F.concat(a["name"], F.lit(": $"), a["name"])))
    fields = F.coalesce(F.nullif(F.array_join(asked, " "), F.lit("")), F.lit("id"))
    capital = F.concat(F.upper(F.substring("name", 1, 1)), F.substr("name", F.lit(2)), F.initcap("kind"))
    query = F.concat("kind", F.lit(" "), capital, defined, F.lit(" {\n  "), "name", used, F.lit(" {\n    "), fields, F.lit("\n  }\n}"))
    return rows.select(key, "kind", "place", "name", "returns", names(F.col("__must")).alias("required"), "optional", query.alias("query"))
