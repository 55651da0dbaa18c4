"""A tolerant reader of JSON as models write it: one pass, a stack of open marks, and what may come next."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = "\"'“”"
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*(?s:.*?)\*/)*")
#: A key that follows, perhaps behind a comma; a mark that ends a container, with something plausible behind it; a next value.
_KEY = re.compile(r"\s*,?\s*(?:[\"'“]([^\"'“”\n]{1,80})[\"'”]\s*:|[A-Za-z_]\w{0,79}\s*:)")
_END = re.compile(r"\s*,?\s*[}\]]\s*(?:[,}\]]|$|[\"'“{\[]|```)")
_NEXT = re.compile(r"\s*,\s*(?:[\"'“{\[\-0-9]|true|false|null)|\s*[\"“{\[]")
_PART = re.compile(r"\s*,\s*[\"'“][^\"'“”\n]{0,80}[\"'”]?\s*\Z")  # a key that the end of the text cuts off
_DONE = re.compile(r"[\s,]*\Z")
_BARE = re.compile(r"[^,}\]\n]*")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: Places at which the wanted object may be looked for, as prose may hold braces, too.
STARTS = 16
_WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None}


class _Cut(Exception):
    """The text ended inside a value."""


def _text(s: str, at: int, in_object: bool, is_key: bool) -> tuple[str, int]:
    """The string that opens at ``at`` and the place behind it. A quote closes it only where what follows may follow."""
    single = s[at] == "'"
    out, i = [], at + 1
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            e = s[i + 1]
            if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", s[i + 2 : i + 6]):
                out.append(chr(int(s[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(e, e))
            i += 2
            continue
        if (c == "'") if single else (c in "\"“”"):
            rest = i + 1
            if is_key:
                closes = s[rest : rest + 40].lstrip()[:1] in (":", "", *_OPEN)
            elif in_object:
                closes = _KEY.match(s, rest) or _END.match(s, rest) or _DONE.match(s, rest) or _PART.match(s, rest)
            else:
                closes = _NEXT.match(s, rest) or _END.match(s, rest) or _DONE.match(s, rest)
            if closes:
                return "".join(out), rest
        out.append(" " if c in "\r\n\t" else c)
        i += 1
    raise _Cut


def _bare(s: str, at: int) -> tuple[object, int]:
    """A number, a word or an unquoted text."""
    end = _BARE.match(s, at).end()
    said = s[at:end].strip()
    if end == len(s) and not re.fullmatch(r"true|false|null", said):
        raise _Cut
    if said.lower() in _WORDS:
        return _WORDS[said.lower()], end
    try:
        value = json.loads(said)
        return (None if isinstance(value, float) and not abs(value) < float("inf") else value), end
    except ValueError:
        return said, end


def _read(s: str, at: int) -> tuple[object, int]:
    """The container that opens at ``at``, closed where the text ends early, and the place behind it."""
    root: object = {} if s[at] == "{" else []
    stack: list[tuple[object, str | None]] = [(root, None)]  # open containers, each with the key that waits for a value
    i = at + 1

    def put(value: object) -> None:
        held, key = stack[-1]
        if isinstance(held, list):
            held.append(value)
        elif key is not None:
            held[key] = value
            stack[-1] = (held, None)

    try:
        while stack:
            i = _SPACE.match(s, i).end()
            if i >= len(s):
                break
            c, (held, key) = s[i], stack[-1]
            in_object = isinstance(held, dict)
            if c in "}]":
                wanted = dict if c == "}" else list
                if any(isinstance(h, wanted) for h, _ in stack):  # what stands open inside it ends, too; a stray mark is nothing
                    while not isinstance(stack.pop()[0], wanted):
                        pass
                i += 1
            elif c == "," or (c == ":" and in_object):
                i += 1
            elif in_object and key is None:
                if c in _OPEN:
                    name, i = _text(s, i, True, True)
                elif m := re.compile(r"[^\s:,{}\[\]\"]+").match(s, i):
                    name, i = m.group(), m.end()
                else:
                    i += 1
                    continue
                stack[-1] = (held, name)
            elif c in "{[":
                new: object = {} if c == "{" else []
                put(new)
                stack.append((new, None))
                i += 1
            elif c in _OPEN:
                value, i = _text(s, i, in_object, False)
                put(value)
            else:
                value, i = _bare(s, i)
                put(value)
    except _Cut:
        i = len(s)
    return root, i


def mended(s: str | None, wanted: tuple[str, ...] = ()) -> str | None:
    """The first object in a text that has the wanted keys, as proper JSON; null without one.

    Entries that were complete are kept: marks left open are closed, missing commas, colons and quotes of keys are supplied,
    quotes inside a text belong to it, stray marks and prose around the object go. A text that the end cuts off is left out.
    Raw line ends and tabs in texts are spaces.
    """
    at = (s or "").find("{")
    for _ in range(STARTS):
        if at < 0:
            return None
        value, end = _read(s, at)
        if isinstance(value, dict) and all(k in value for k in wanted):
            try:
                return json.dumps(value, ensure_ascii=False)
            except RecursionError:  # nested beyond what any reader takes
                return None
        at = s.find("{", end if end < len(s) else at + 1)
    return None


def _column(wanted: tuple[str, ...]):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([mended(t, wanted) if t is not None else None for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def mended_json(text: Column, *wanted: str) -> Column:
    """``mended`` as a column; null stays null and costs nothing."""
    return _column(wanted)(text)
