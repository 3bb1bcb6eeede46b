"""Where in a JSON text the value of a pointer stands: quotes that are the source's own bytes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def spans(text: str) -> dict[str, tuple[int, int, int]]:
    """For every pointer (start of the member, start and end of the value); of a repeated key the last.  Raises for no JSON.

    Open containers are a stack, so depth is bounded by memory only.
    """
    out: dict[str, tuple[int, int, int]] = {}
    stack: list[list] = []  # [pointer, kind, start, member start, index]
    at = _SPACE.match(text, 0).end()
    pointer, member = "", at
    while True:
        if text[at : at + 1] in ("{", "["):
            stack.append([pointer, text[at], at, member, -1])
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if stack[-1][1] == "{" else "]"):
                at, pointer, member = _next(text, at, stack[-1], out)
                continue
        else:
            m = (_STRING if text[at : at + 1] == '"' else _SCALAR).match(text, at)
            if not m:
                raise ValueError(f"no JSON value at {at}")
            out[pointer] = (member, at, m.end())
            at = m.end()
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError("more than one JSON value")
                return out
            top, mark = stack[-1], text[at : at + 1]
            if mark == ("}" if top[1] == "{" else "]"):
                stack.pop()
                at += 1
                out[top[0]] = (top[3], top[2], at)
                continue
            if mark != ",":
                raise ValueError(f"a comma is missing at {at}")
            at = _SPACE.match(text, at + 1).end()
            at, pointer, member = _next(text, at, top, out)
            break


def _next(text: str, at: int, top: list, out: dict) -> tuple[int, str, int]:
    """The next member of an open container: where its value starts, its pointer, where the member starts."""
    top[4] += 1
    if top[1] == "[":
        return at, f"{top[0]}/{top[4]}", at
    m = _STRING.match(text, at)
    if not m:
        raise ValueError(f"a key is missing at {at}")
    colon = _SPACE.match(text, m.end()).end()
    if text[colon : colon + 1] != ":":
        raise ValueError(f"a colon is missing at {colon}")
    key = json.loads(m.group()).replace("~", "~0").replace("/", "~1")
    pointer = f"{top[0]}/{key}"
    if pointer in out:  # a repeated key: what stood below the earlier one is gone with it
        for old in [p for p in out if p == pointer or p.startswith(pointer + "/")]:
            del out[old]
    return _SPACE.match(text, colon + 1).end(), pointer, at


def quote(text: str | None, pointer: str, most: int = 4000) -> str | None:
    """The member at a pointer as it is written, its value alone where the member is too long, else that value's beginning."""
    if text is None:
        return None
    try:
        member, start, end = spans(text)[pointer]
    except (ValueError, KeyError):
        return None
    return text[member:end] if end - member <= most else text[start:end][:most]


def quoted(pointer: str, most: int = 4000):
    """A column function that quotes a pointer of each text."""

    def each(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: quote(b, pointer, most))

    return pandas_udf(each, StringType())
