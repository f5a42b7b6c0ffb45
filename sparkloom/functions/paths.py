"""Paths into JSON texts, and what URLs tell of paging, searching and variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.markup import as_list
from sparkloom.functions.url import path, query_string

#: Query parameters of paging, in the order in which they are looked for, and of searches.
PAGING = ("page", "p", "offset", "start", "cursor", "after")
SEARCHING = ("q", "query", "search", "term", "keyword")


def json_path(dotted: str) -> str:
    """a.b[0].c as a JSON path."""
    import re

    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in re.split(r"[.\[\]]", dotted) if p)


def get(json: Column, dotted: str, default: str | None = None) -> Column:
    """The text at a path, or a default; of an array its first element."""
    found = F.get_json_object(json, json_path(dotted))
    return F.coalesce(F.when(found.rlike(r"^\s*\["), F.try_element_at(as_list(found), F.lit(1))).otherwise(found), F.lit(default).cast("string"))


def first_of(json: Column, paths: Sequence[str]) -> Column:
    """The text at the first of some paths that is there."""
    return F.coalesce(*[F.get_json_object(json, json_path(p)) for p in paths])


def every(json: Column, array: str, field: str) -> Column:
    """A field of every element of the array at a path; elements without it are left out."""
    return F.array_compact(F.transform(as_list(F.get_json_object(json, json_path(array))), lambda x: F.get_json_object(x, json_path(field))))


def last(json: Column, array: str) -> Column:
    """The last element of the array at a path."""
    return F.try_element_at(as_list(F.get_json_object(json, json_path(array))), F.lit(-1))


def has(json: Column, dotted: str) -> Column:
    return F.get_json_object(json, json_path(dotted)).isNotNull()


def fields(json: Column, paths: Mapping[str, Sequence[str]]) -> list[Column]:
    """A column a field, each with the first of its paths that is there."""
    return [first_of(json, p).alias(name) for name, p in paths.items()]


def with_value(json: Column, key: str, value: Column) -> Column:
    """A JSON object with one of its members set to a JSON value, members in order of their names."""
    members = F.from_json(json, "map<string,variant>")
    merged = F.map_concat(F.map_filter(members, lambda k, _: k != key), F.create_map(F.lit(key), F.try_parse_json(value)))
    ordered = F.array_sort(F.map_keys(merged))
    return F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(F.element_at(merged, k)))), ","), F.lit("}"))


def count_refs(json: Column) -> Column:
    """Members named $ref at any depth."""
    return F.regexp_count(F.coalesce(json, F.lit("")), F.lit(r'"\$ref"\s*:'))


def parameter(url: Column, name: str) -> Column:
    """A query parameter's value, or null."""
    return F.nullif(F.regexp_extract(query_string(url), rf"(?:^|&){name}=([^&]*)", 1), F.lit(""))


def paging_parameter(url: Column) -> Column:
    """The first known paging parameter of a URL, else `path` where the path ends in page/N, else null."""
    out = F.when(path(url).rlike(r"/page/[0-9]+/?$"), "path")
    for name in reversed(PAGING):
        out = F.when(parameter(url, name).isNotNull(), name).otherwise(out)
    return out


def paging_between(first: Column, second: Column) -> Column:
    """(kind, name, start, step) of what changes between two URLs of a list: a query parameter, a path segment, or a next button."""
    number = lambda u, n: parameter(u, n).try_cast("long")
    none = F.lit(None)
    row = lambda kind, name, start, step: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), start.cast("long").alias("start"), step.cast("long").alias("step"))
    a, b = F.filter(F.split(path(first), "/"), lambda x: x != ""), F.filter(F.split(path(second), "/"), lambda x: x != "")
    steps = F.zip_with(a, b, lambda x, y: F.struct(x.try_cast("long").alias("x"), y.try_cast("long").alias("y")))
    moved = F.try_element_at(F.filter(steps, lambda s: s["x"].isNotNull() & s["y"].isNotNull() & (s["x"] != s["y"])), F.lit(1))
    out = F.when(moved.isNotNull(), row("path_segment", none, moved["x"], moved["y"] - moved["x"])).otherwise(row("next_button", none, none, none))
    for name in reversed(PAGING):
        x, y = number(first, name), number(second, name)
        out = F.when(x.isNotNull() & y.isNotNull() & (x != y), row("query_param", F.lit(name), x, F.when(y > x, y - x).otherwise(1))).otherwise(out)
    return out


def candidate_score(url: Column, names: Sequence[str], points: int, array: Column) -> Column:
    """Added points of a request that may list results: by its parameters, a path of an interface, and an array in its answer."""
    named = F.lit(False)
    for n in names:
        named = named | parameter(url, n).isNotNull()
    return F.when(named, points).otherwise(0) + F.when(path(url).rlike(r"(?i)/api/|/v\d+/"), 2).otherwise(0) + F.when(array, 3).otherwise(0)


def url_pattern(url: Column, segments: Mapping[str, Column]) -> Column:
    """A regular expression for a URL, with named groups in place of some segments of its path."""
    escaped = lambda x: F.regexp_replace(x, r"([.*+?^$(){}|\[\]\\])", r"\\$1")
    out = path(url)
    for name, segment in segments.items():
        out = F.replace(out, segment, F.lit(f"(?<{name}>[^/]+)"))
    origin = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    return F.concat(F.lit("^"), escaped(origin), out, F.lit("$"))
