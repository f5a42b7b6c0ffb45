"""What scripts of a page hold as data: object literals that are assigned to names, JSON scripts, and their texts.

A reader of literals takes objects, arrays, strings of all three kinds, numbers, truth values, what
minifiers write for them, JSON.parse of a text, and functions that return a literal, whose parameters
are given where they are called; other names and calls are null. Strings and comments hide what is in
them. Each script is read once from the left; a literal that does not end gives nothing.

Defined results: null and empty scripts hold nothing; scripts are read whole; literals deeper than
MOST_DEEP give nothing; of equal members the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STATES = "array<struct<name:string,json:string,title:string,text:string>>"
MOST_DEEP = 200
#: Members with text, which come first; members that name a document; least length of a text.
TEXTS = ("content", "text", "body", "description", "summary", "article", "post", "message", "comment")
TITLES = ("title", "name", "headline", "heading", "pageTitle", "documentTitle")
LEAST_TEXT = 20
#: Where the data of a page stands in what a framework keeps: name, and paths of which the first that is there is taken.
PLACES = {"__NEXT_DATA__": ("props.pageProps",), "__NUXT__": ("data",), "__remixContext": ("state.loaderData", "loaderData")}

SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\]|\\.)*)`', re.S)
NUMBER = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
NAME = re.compile(r"(?:[^\W\d]|\$)[\w$]*(?:\s*\.\s*(?:[^\W\d]|\$)[\w$]*)*")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b", "0": "\0", "\n": "", "\r\n": ""}
ASSIGNED = re.compile(r"(?:(?:window|self|globalThis)\s*\.\s*|(?:var|let|const)\s+)?((?:[^\W\d]|\$)[\w$]*(?:\.(?:[^\W\d]|\$)[\w$]*)*)\s*=(?![=>])")
FUNCTION = re.compile(r"\(?\s*(?:function\s*[\w$]*\s*\(([^()]*)\)|\(([^()]*)\)\s*=>)\s*\{")


class Unreadable(ValueError):
    pass


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        return (chr(int(digits, 16)) if int(digits, 16) < 0x110000 else "\ufffd") if digits else PLAIN.get(m[4], m[4])

    out = ESCAPE.sub(one, text) if "\\" in text else text
    # halves of a pair of code units become one code point; lone ones have no UTF-8
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search(r"[\ud800-\udfff]", out) else out


class Reader:
    def __init__(self, text: str) -> None:
        self.text = text

    def skip(self, i: int) -> int:
        found = SKIP.match(self.text, i)
        return found.end() if found else i

    def balanced(self, i: int) -> int:
        """The place behind the bracket that closes the one at a place."""
        depth = 0
        while i < len(self.text):
            c = self.text[i]
            if c in "\"'`":
                found = STRING.match(self.text, i)
                i = found.end() if found else len(self.text)
                continue
            if c == "/" and self.text[i + 1 : i + 2] in ("/", "*"):
                i = self.skip(i)
                continue
            depth += (c in "([{") - (c in ")]}")
            i += 1
            if not depth:
                return i
        raise Unreadable("open")

    def value(self, i: int, given: dict, depth: int = 0):
        """(value, place behind it) of the literal at a place."""
        text = self.text
        i = self.skip(i)
        c = text[i : i + 1]
        if depth > MOST_DEEP or not c:
            raise Unreadable(c)
        if c == "{":
            return self.members(i + 1, given, depth)
        if c == "[":
            out, i = [], self.skip(i + 1)
            while text[i : i + 1] != "]":
                if text[i : i + 1] == ",":
                    out.append(None)
                else:
                    item, i = self.value(i, given, depth + 1)
                    out.append(item)
                    i = self.skip(i)
                if text[i : i + 1] == ",":
                    i = self.skip(i + 1)
                elif text[i : i + 1] != "]":
                    raise Unreadable(text[i : i + 9])
            return out, i + 1
        if c in "\"'`":
            found = STRING.match(text, i)
            if found is None:
                raise Unreadable(c)
            return unescaped(next(x for x in found.groups() if x is not None)), found.end()
        if found := NUMBER.match(text, i):
            digits = found[0].lstrip("+")
            number = int(digits, 16) if "x" in digits.lower() else float(digits)
            return int(number) if number == number and abs(number) < 1e15 and number == int(number) else number, found.end()
        if c == "!":
            inner, i = self.value(i + 1, given, depth + 1)
            return not inner, i
        if c == "(":
            found = FUNCTION.match(text, i)
            if found is None:
                inner, i = self.value(i + 1, given, depth + 1)
                i = self.skip(i)
                if text[i : i + 1] != ")":
                    raise Unreadable("(")
                return inner, i + 1
            return self.called(i, found, depth)
        found = NAME.match(text, i)
        if found is None:
            raise Unreadable(c)
        return self.named(found, given, depth)

    def members(self, i: int, given: dict, depth: int):
        text, out = self.text, {}
        i = self.skip(i)
        while text[i : i + 1] != "}":
            if text[i : i + 1] in ('"', "'"):
                key, i = self.value(i, given, depth + 1)
            elif found := NAME.match(text, i) or NUMBER.match(text, i):
                key, i = found[0], found.end()
            else:
                raise Unreadable(text[i : i + 9])
            i = self.skip(i)
            if text[i : i + 1] == ":":
                out[str(key)], i = self.value(i + 1, given, depth + 1)
            else:
                out[str(key)] = given.get(key)
            i = self.skip(i)
            if text[i : i + 1] == ",":
                i = self.skip(i + 1)
            elif text[i : i + 1] != "}":
                raise Unreadable(text[i : i + 9])
        return out, i + 1

    def called(self, i: int, found: re.Match, depth: int):
        """A function that returns a literal, with the values that it is called with."""
        text = self.text
        start, stop = found.end() - 1, self.balanced(found.end() - 1)
        call = self.skip(stop)
        if text[call : call + 1] == ")" and text[i] == "(":
            call = self.skip(call + 1)
        if text[call : call + 1] != "(":
            raise Unreadable("function")
        after = self.balanced(call)
        values, _ = Reader("[" + text[call + 1 : after - 1] + "]").value(0, {}, depth + 1)
        names = [n.strip() for n in (found[1] if found[1] is not None else found[2]).split(",") if n.strip()]
        given = dict(zip(names, values))
        back = re.search(r"\breturn\b", text[start:stop])
        if back is None:
            raise Unreadable("return")
        inner, _ = self.value(start + back.end(), given, depth + 1)
        after = self.skip(after)
        return inner, after + (text[after : after + 1] == ")" and text[i] == "(")

    def named(self, found: re.Match, given: dict, depth: int):
        text, name, i = self.text, re.sub(r"\s", "", found[0]), found.end()
        if name in ("true", "false"):
            return name == "true", i
        if name in ("new", "void", "typeof", "await"):
            inner, i = self.value(i, given, depth + 1)
            return (inner if name == "new" else None), i
        after = self.skip(i)
        if text[after : after + 1] == "(":
            stop = self.balanced(after)
            if name in ("JSON.parse", "Date"):
                inner, _ = self.value(after + 1, given, depth + 1) if text[self.skip(after + 1)] != ")" else (None, 0)
                return (json.loads(inner) if name == "JSON.parse" and isinstance(inner, str) else inner), stop
            return None, stop
        return given.get(name), i


def assigned(script: str) -> list[tuple[str, object]]:
    """(name, value) of the literals that a script assigns, in order, outside strings and comments."""
    reader, out, i, size = Reader(script), [], 0, len(script)
    while i < size:
        c = script[i]
        if c in "\"'`":
            found = STRING.match(script, i)
            i = found.end() if found else i + 1
        elif c == "/" and script[i + 1 : i + 2] in ("/", "*"):
            i = reader.skip(i)
        elif c.isalpha() or c in "_$":
            found = ASSIGNED.match(script, i)
            if found is None:
                i = NAME.match(script, i).end()
                continue
            try:
                value, i = reader.value(found.end(), {})
                if isinstance(value, (dict, list)):
                    out.append((found[1], value))
            except (ValueError, IndexError, RecursionError):
                i = found.end()
        else:
            i += 1
    return out


def texts(value, depth: int = 0) -> Iterator[str]:
    """Texts of a tree that are long and no addresses: those of members that hold contents first, then the others, in order."""
    if isinstance(value, str):
        if len(value) > LEAST_TEXT and not value.startswith("http"):
            yield value + "\n"
    elif depth > MOST_DEEP:
        return
    elif isinstance(value, list):
        for x in value:
            yield from texts(x, depth + 1)
    elif isinstance(value, dict):
        for key in TEXTS:
            if key in value:
                yield from texts(value[key], depth + 1)
        for key, x in value.items():
            if key not in TEXTS:
                yield from texts(x, depth + 1)


def title(value, depth: int = 0) -> str:
    """The first title of a tree: of its own members, else of the first member that has one."""
    if depth > MOST_DEEP or not isinstance(value, (dict, list)):
        return ""
    if isinstance(value, dict):
        for key in TITLES:
            if isinstance(value.get(key), str) and value[key]:
                return value[key]
    for x in value.values() if isinstance(value, dict) else value:
        if found := title(x, depth + 1):
            return found
    return ""


def part(name: str, value):
    """The data of a page in what is kept under a name."""
    for path in PLACES.get(name, ()):
        at = value
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            return at
    return {} if name in PLACES else value


def states(scripts: list[dict]) -> list[dict]:
    """(name, json, title, text) of a page's scripts of (id, type, text): JSON scripts by their id, literals by the name that they are assigned to."""
    out = []
    for script in scripts:
        text, kind = script["text"] or "", (script["type"] or "").lower()
        if "json" in kind:
            try:
                found = [(script["id"] or "", json.loads(text))]
            except (ValueError, RecursionError):
                found = []
        else:
            found = assigned(text)
        for name, value in found:
            try:
                data = part(name, value)
                out.append({"name": name, "json": json.dumps(value, ensure_ascii=False, separators=(",", ":")), "title": title(data), "text": "".join(texts(data))})
            except RecursionError:
                continue
    return out


STATE_KIND = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "json", "title", "text")]))


def clean_states(scripts: list[dict]) -> list[dict]:
    """The states of a page's scripts, as UTF-8 can hold them."""
    return [{k: v.encode("utf-8", "replace").decode() for k, v in state.items()} for state in states(scripts)]


def with_states(pages: DataFrame, scripts: str = "scripts", out: str = "states") -> DataFrame:
    """The rows with the states of a column of arrays of (id, type, text) in one more column."""
    kept = [c for c in pages.columns if c != out]
    schema = pages.select(*kept).schema.add(out, T._parse_datatype_string(STATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(scripts))
            made = pa.array([clean_states(x.as_py() or []) for x in found], STATE_KIND)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return pages.mapInArrow(run, schema)


# ---- texts in scripts, and what stands before them

LITERALS = "array<struct<before:string,text:string>>"
HELD_BACK = 6
PART = re.compile(r"\$\{\s*([A-Za-z_$][\w$.]*)\s*\}")


def literals(script: str | None) -> list[dict]:
    """The texts of a script, in order, each with what stands before it: up to six names, marks and texts (as "").

    Comments are passed over. Names that are assigned a text carry it to the template literals behind
    them that hold the name, and, where one is put before a text by +, to that text.
    """
    script = script or ""
    out: list[dict] = []
    before: list[str] = []
    known: dict[str, str] = {}
    i, size = 0, len(script)
    while i < size:
        if found := SKIP.match(script, i):
            i = found.end()
            continue
        if script[i] in "\"'`":
            found = STRING.match(script, i)
            if found is None:
                i += 1
                continue
            text = unescaped(next(x for x in found.groups() if x is not None))
            if script[i] == "`":
                text = PART.sub(lambda m: known.get(m[1], m[0]), text)
            if len(before) > 1 and before[-1] == "+" and before[-2] in known:
                text = known[before[-2]] + text
                before = before[:-2]
            out.append({"before": "".join(before), "text": text})
            if len(before) > 1 and before[-1] == "=":
                known[before[-2]] = text
            token, i = '""', found.end()
        elif found := NAME.match(script, i):
            token, i = re.sub(r"\s", "", found[0]), found.end()
        else:
            token, i = script[i], i + 1
        before = [*before[1 - HELD_BACK :], token]
    return out


def with_literals(pages: DataFrame, scripts: str = "scripts", out: str = "literals") -> DataFrame:
    """The rows with the texts of a column of arrays of (id, type, text) in one more column, as (before, text)."""
    kept = [c for c in pages.columns if c != out]
    schema = pages.select(*kept).schema.add(out, T._parse_datatype_string(LITERALS))
    kind = pa.list_(pa.struct([("before", pa.string()), ("text", pa.string())]))
    plain = lambda s: s.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(scripts))
            rows = [[{k: plain(v) for k, v in x.items()} for s in (script.as_py() or []) for x in literals(s["text"])] for script in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(rows, kind)], [*kept, out])

    return pages.mapInArrow(run, schema)
