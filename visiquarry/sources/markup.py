"""Markup in source files: tags with their attributes and places, and an index of the words in class and id attributes.

Source text is no document: tags stand in templates, scripts and JSX expressions, inside each other's attributes, and need not be
closed. So every ``<name`` is read on its own by a small state machine: between attributes, in a quoted value, or in braces,
whose depth is counted over nested braces, quotes, template literals and their ``${}``. It ends at the first ``>`` outside of all
of these. Each text is passed over once, in Arrow batches; what comes out are columns, and all rules are conditions on them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keys import KEYS

TAGS = "array<struct<name:string,line:int,closed:boolean,hidden:boolean,attributes:array<struct<name:string,value:string>>>>"
POSTINGS = "array<struct<part:string,lead:string,offset:int,line:int>>"

_OPEN = re.compile(r"<([A-Za-z][A-Za-z0-9]*)")
_COMMENT = re.compile(r"<!--[\s\S]*?-->")
_NAME = re.compile(r"[^\s=<>\"'`{}/]+")
_SPACE = re.compile(r"\s*")
_BARE = re.compile(r"[^\s\"'>]+")
#: what changes the state inside braces
_TURN = re.compile(r"[{}\"'`\\]")
_LITERAL = re.compile(r"\\.|`|\$\{", re.S)
_NAMED = re.compile(r"(?:class(?:Name)?|id)=[\"']([^\"']*)[\"']")
_PART = re.compile(r"\w+", re.A)


def braces_end(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``; -1 if none does."""
    depth, i = 0, at
    while (turn := _TURN.search(text, i)) is not None:
        c, i = turn[0], turn.end()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i
        elif c == "\\":
            i += 1
        elif c == "`":
            i = _literal_end(text, i)
        else:  # a quote of code ends on its line; an apostrophe of text between tags does not start one
            line = text.find("\n", i)
            close = text.find(c, i, len(text) if line < 0 else line)
            i = close + 1 if close >= 0 else i
        if i < 0:
            return -1
    return -1


def _literal_end(text: str, i: int) -> int:
    """The place after the backtick that ends a template literal; -1 if none does."""
    while (turn := _LITERAL.search(text, i)) is not None:
        if turn[0] == "`":
            return turn.end()
        i = braces_end(text, turn.end() - 1) if turn[0] == "${" else turn.end()
        if i < 0:
            return -1
    return -1


def read_tag(text: str, i: int, end: int) -> tuple[list[tuple[str, str]], bool]:
    """Attributes (name in lower case, value without quotes; braces stay) from behind a tag's name, and whether the tag is closed."""
    found: list[tuple[str, str]] = []
    while i < end:
        c = text[i]
        if c == ">":
            return found, True
        if c == "<":
            if text.startswith("<?", i) and (stop := text.find("?>", i, end)) >= 0:
                i = stop + 2
                continue
            return found, False
        if c in "\"'":
            i = text.find(c, i + 1, end) + 1
        elif c == "{":
            i = braces_end(text, i)
        elif (name := _NAME.match(text, i, end)) is not None:
            i = _SPACE.match(text, name.end(), end).end()
            value = ""
            if i < end and text[i] == "=":
                start = i = _SPACE.match(text, i + 1, end).end()
                c = text[i] if i < end else ""
                if c and c in "\"'":
                    i = text.find(c, i + 1, end) + 1
                    value = text[start + 1 : i - 1]
                elif c == "{":
                    i = braces_end(text, i)
                    value = text[start:i] if i > 0 else ""
                elif (bare := _BARE.match(text, i, end)) is not None:
                    value, i = bare[0], bare.end()
            found.append((name[0].lower(), value))
        else:
            i += 1
        if i <= 0 or i > end:
            return found, False
    return found, False


def read_tags(text: str | None) -> list[dict]:
    """Every tag in order; hidden: inside a comment."""
    text = text or ""
    comments = [m.span() for m in _COMMENT.finditer(text)]
    lines = _Lines(text)
    out, k = [], 0
    for m in _OPEN.finditer(text):
        while k < len(comments) and comments[k][1] <= m.start():
            k += 1
        hidden = k < len(comments) and comments[k][0] < m.start()
        attributes, closed = read_tag(text, m.end(), comments[k][1] if hidden else len(text))
        out.append({"name": m[1], "line": lines.at(m.start()), "closed": closed, "hidden": hidden, "attributes": [{"name": n, "value": v} for n, v in attributes]})
    return out


def read_postings(text: str | None) -> list[dict]:
    """Every part of the words in class and id attributes, in order: the hyphens between it and the part before (null: none such), its
    offset, and the line where the attribute starts. ``ad-banner`` has two parts; no combination of parts is told."""
    text = text or ""
    lines, out = _Lines(text), []
    for m in _NAMED.finditer(text):
        line, end = lines.at(m.start()), -1
        for part in _PART.finditer(text, m.start(1), m.end(1)):
            between = text[end : part.start()] if end >= 0 else None
            out.append({"part": part[0], "lead": between if between is not None and between.strip("-") == "" else None, "offset": part.start(), "line": line})
            end = part.end()
    return out


class _Lines:
    def __init__(self, text: str) -> None:
        self.starts = [m.end() for m in re.finditer("\n", text)]

    def at(self, index: int) -> int:
        """1 and the newlines before a character."""
        return 1 + bisect_right(self.starts, index)


def _mapped(files: DataFrame, column: str, kind: str, read) -> DataFrame:
    """``files`` with one more column, read from content."""
    numbers = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    fields = [tuple(f.split(":", 1)) for f in kind.removeprefix("array<struct<").removesuffix(">>").split(",attributes")[0].split(",")]
    made = pa.list_(pa.struct([(n, numbers[t]) for n, t in fields] + ([("attributes", pair)] if "attributes" in kind else [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                own = pa.array([read(t) for t in batch.column("content").to_pylist()], made)
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, {column} {kind}")


def with_tags(files: DataFrame) -> DataFrame:
    """files (content and any other columns) with ``tags``."""
    return _mapped(files, "tags", TAGS, read_tags)


def postings(files: DataFrame) -> DataFrame:
    """client, run_id, rel_path, part, lead, offset, line: the positional index of class and id attributes."""
    rows = _mapped(files.select(*KEYS, "rel_path", "content"), "found", POSTINGS, read_postings)
    return rows.select(*KEYS, "rel_path", F.explode("found").alias("p")).select(*KEYS, "rel_path", "p.*")
