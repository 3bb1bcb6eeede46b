"""JSON pointers over JSON texts, by way of VARIANT: numbers keep their value, a miss is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_path(pointer: str) -> str:
    """``/a~1b/0`` as ``$['a/b'][0]``."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"a JSON pointer starts with a slash: {pointer!r}")
    out = "$"
    for step in pointer[1:].split("/"):
        name = step.replace("~1", "/").replace("~0", "~")
        if re.fullmatch(r"0|[1-9][0-9]*", name):
            out += f"[{name}]"
        elif "'" in name:
            out += f'["{name}"]'
        else:
            out += f"['{name}']"
    return out


def at(text: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a pointer as ``kind``; null for no JSON, a miss, or another type."""
    return F.try_variant_get(F.try_parse_json(text), variant_path(pointer), kind)
