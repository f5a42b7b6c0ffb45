"""Indented documents as JSON: block YAML, and RAML as what it says of an interface.

The reader takes mappings, sequences, quoted and plain scalars, literal and folded blocks, comments
and flow collections on one line, by the rules of JSON's types; anchors, tags (but RAML's first line
and `!include`, kept as text) and several documents are not read. Memory is linear in the text.

Defined results: null and empty texts, tabs as indentation and lines that fit nowhere give null; of
equal keys the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#"'\[{][^#]*?|[^\s#"'\[{]))\s*:(?=\s|$)""")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$")
_FLOW = re.compile(r"""\s*(?:([\[\]{},:])|"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|((?:[^\[\]{},:#]|:(?!\s|$)|#(?<!\s#))+))""")
MOST_DEEP = 200


class Indented(ValueError):
    pass


def scalar(text: str):
    """A scalar: null, a truth value, a number or a text."""
    text = text.strip()
    if text[:1] in ('"', "'"):
        end = re.match(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'', text)
        if end is None:
            raise Indented(text)
        return json.loads(f'"{end[1]}"', strict=False) if end[1] is not None else end[2].replace("''", "'")
    text = re.sub(r"(?:^|\s)#.*", "", text).strip()
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return json.loads(text) if _NUMBER.match(text) else text


def flow(text: str):
    """A collection on one line, as [a, {b: c}]."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = _FLOW.match(text, at)
        if found is None or found.end() == at:
            if text[at:].lstrip().startswith("#"):
                break
            raise Indented(text)
        mark, double, single, plain = found.groups()
        tokens.append(("mark", mark) if mark else ("value", json.loads(f'"{double}"', strict=False) if double is not None else single.replace("''", "'") if single is not None else scalar(plain)))
        at = found.end()
    tokens.reverse()

    def read(depth: int = 0):
        if not tokens or depth > MOST_DEEP:
            raise Indented(text)
        kind, value = tokens.pop()
        if kind == "value":
            return value
        out: list | dict = [] if value == "[" else {}
        end = {"[": "]", "{": "}"}.get(value)
        while end and tokens and tokens[-1] != ("mark", end):
            item = read(depth + 1)
            if isinstance(out, list):
                out.append(item)
            else:
                has = tokens and tokens[-1] == ("mark", ":")
                if has:
                    tokens.pop()
                out[str(item)] = read(depth + 1) if has and tokens[-1:] not in ([("mark", ",")], [("mark", end)]) else None
            if tokens and tokens[-1] == ("mark", ","):
                tokens.pop()
        if not end or not tokens:
            raise Indented(text)
        tokens.pop()
        return out

    out = read()
    if tokens:
        raise Indented(text)
    return out


class Lines:
    """The lines of a document that count, as (indent, text), with raw lines for blocks of text."""

    def __init__(self, text: str) -> None:
        self.raw = text.split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.raw):
            line = self.raw[self.at].rstrip("\r")
            body = line.lstrip(" ")
            if body.strip() and not body.startswith("#") and body.strip() not in ("---", "...") and not body.startswith("%"):
                if body.startswith("\t"):
                    raise Indented(line)
                return len(line) - len(body), body.rstrip()
            self.at += 1
        return None

    def block(self, indent: int, style: str) -> str:
        """Lines deeper than an indent as one text: as they are (|) or folded (>)."""
        held: list[str] = []
        while self.at < len(self.raw):
            line = self.raw[self.at].rstrip("\r")
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            held.append(line)
            self.at += 1
        while held and not held[-1].strip():
            held.pop()
        depth = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
        lines = [x[depth:] for x in held]
        text = "\n".join(lines) if style[0] == "|" else re.sub(r"\n(\n*)", lambda m: m[1] or " ", "\n".join(lines))
        return text if "-" in style or not held else text + "\n"

    def value(self, text: str, indent: int, depth: int):
        """What stands behind a key or a dash: on its line, or in the lines below it."""
        if re.match(r"[|>][-+0-9]*\s*(?:#.*)?$", text):
            return self.block(indent, text)
        if text[:1] in ("[", "{"):
            return flow(text)
        if text and not text.startswith("#"):
            return scalar(text)
        below = self.peek()
        if below and (below[0] > indent or (below[0] == indent and re.match(r"-(?:\s|$)", below[1]))):
            return self.tree(below[0], depth + 1) if below[0] > indent else self.sequence(indent, depth + 1)
        return None

    def tree(self, indent: int, depth: int = 0):
        if depth > MOST_DEEP:
            raise Indented("too deep")
        line = self.peek()
        if line is None:
            return None
        if re.match(r"-(?:\s|$)", line[1]):
            return self.sequence(indent, depth)
        if _KEY.match(line[1]) is None:
            self.at += 1
            return flow(line[1]) if line[1][:1] in ("[", "{") else scalar(line[1])
        out = {}
        while (line := self.peek()) and line[0] == indent and (key := _KEY.match(line[1])):
            self.at += 1
            name = json.loads(f'"{key[1]}"', strict=False) if key[1] is not None else key[2].replace("''", "'") if key[2] is not None else key[3].strip()
            out[name] = self.value(line[1][key.end() :].strip(), indent, depth)
        if line and line[0] >= indent and not re.match(r"-(?:\s|$)", line[1]):
            raise Indented(line[1])
        return out

    def sequence(self, indent: int, depth: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and re.match(r"-(?:\s|$)", line[1]):
            rest = line[1][1:].lstrip()
            inner = indent + len(line[1]) - len(rest)
            if rest and (_KEY.match(rest) or re.match(r"-(?:\s|$)", rest)):
                # the dash is read as indentation of what follows it
                self.raw[self.at] = " " * inner + rest
                out.append(self.tree(inner, depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest, indent, depth))
        return out


def parsed(text: str | None):
    """The value of an indented document, or None."""
    try:
        lines = Lines(text or "")
        first = lines.peek()
        if first is None:
            return None
        out = lines.tree(first[0])
        return None if lines.peek() else out
    except (Indented, ValueError, RecursionError):
        return None


def as_json(text: str | None) -> str | None:
    """A JSON text of a JSON or an indented document, or None where it holds no mapping."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        value = parsed(text)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None


#: Methods of a RAML resource.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
ENDPOINT = pa.struct([("path", pa.string()), ("method", pa.string()), ("summary", pa.string()), ("parameters", pa.list_(pa.struct([("name", pa.string()), ("place", pa.string()), ("required", pa.bool_())]))), ("body_type", pa.string()), ("codes", pa.list_(pa.string()))])


def raml_endpoints(text: str | None) -> list[dict]:
    """Endpoints of a RAML document: nested resources with their paths and path parameters inherited."""
    if not (text or "").lstrip().startswith("#%RAML"):
        return []
    root = parsed(text)
    if not isinstance(root, dict):
        return []
    out: list[dict] = []

    def given(part: dict, name: str, place: str) -> list[dict]:
        found = part.get(name)
        required = lambda k, v: not k.endswith("?") and (v.get("required", True) if isinstance(v, dict) else True) is not False
        return [{"name": k.rstrip("?"), "place": place, "required": bool(required(k, v))} for k, v in found.items()] if isinstance(found, dict) else []

    def resource(path: str, part, inherited: list[dict], depth: int = 0) -> None:
        if not isinstance(part, dict) or depth > MOST_DEEP:
            part = {}
        own = given(part, "uriParameters", "path")
        said = {p["name"] for p in own}
        named = [{"name": n, "place": "path", "required": True} for n in re.findall(r"\{([^{}]+)\}", path) if n not in said | {p["name"] for p in inherited}]
        shared = inherited + own + named
        for method in METHODS:
            if method in part:
                op = part[method] if isinstance(part[method], dict) else {}
                body = op.get("body")
                kind = next((k for k in body if "/" in k), None) if isinstance(body, dict) else None
                codes = list(op["responses"]) if isinstance(op.get("responses"), dict) else []
                summary = op.get("displayName") or op.get("description")
                out.append({"path": path, "method": method.upper(), "summary": str(summary).strip() if summary is not None else None, "parameters": shared + given(op, "queryParameters", "query") + given(op, "headers", "header"), "body_type": kind, "codes": [str(c) for c in codes]})
        for key, value in part.items():
            if key.startswith("/"):
                resource(path + key, value, shared, depth + 1)

    for key, value in root.items():
        if key.startswith("/"):
            resource(key, value, [])
    return out


def _added(rows: DataFrame, text: str, out: str, kind: str, arrow: pa.DataType, make) -> DataFrame:
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*kept).schema.add(out, T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([make(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return rows.mapInArrow(run, schema)


def with_json(rows: DataFrame, text: str = "text", out: str = "doc") -> DataFrame:
    """The rows with the JSON text of a column of JSON or YAML documents in one more column."""
    return _added(rows, text, out, "string", pa.string(), as_json)


def with_raml(rows: DataFrame, text: str = "text", out: str = "endpoints") -> DataFrame:
    """The rows with the endpoints of a column of RAML documents in one more column."""
    return _added(rows, text, out, "array<struct<path:string,method:string,summary:string,parameters:array<struct<name:string,place:string,required:boolean>>,body_type:string,codes:array<string>>>", pa.list_(ENDPOINT), raml_endpoints)
