"""Digests of JSON values that are equal for equal values, however these are spelled."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

_NUMERIC = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,4})?")
_ABSENT = "n"  # the canonical form of a missing text and of JSON null


class _Number(str):
    """A JSON number's text."""


def _number(text: str) -> str:
    """A number by its value: no spelling of it, in a string or not, gives another text."""
    if text.isdigit() and text[0] != "0":
        return "#" + text
    value = Decimal(text)
    if not value:
        return "#0"
    sign, digits, exponent = value.as_tuple()
    while digits[-1] == 0:
        digits, exponent = digits[:-1], exponent + 1
    if 0 <= exponent <= 40:
        digits, exponent = digits + (0,) * exponent, 0
    return f"#{'-' * sign}{''.join(map(str, digits))}" + (f"e{exponent}" if exponent else "")


def _form(value) -> str:
    if isinstance(value, _Number):
        return _number(value)
    if isinstance(value, str):
        return _number(value) if _NUMERIC.fullmatch(value) else f"s{len(value)}:{value}"
    if value is None:
        return _ABSENT
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, dict):
        return "{" + ",".join(f"{len(k)}:{k}={_form(v)}" for k, v in sorted(value.items())) + "}"
    return "[" + ",".join(sorted(map(_form, value))) + "]"


def canonical(text: str | None) -> str:
    """One text per JSON value: member and element order don't count, numbers count by value.

    A missing text equals JSON null.  A text that is no JSON stands for itself.
    """
    if text is None:
        return _ABSENT
    try:
        return _form(json.loads(text, parse_int=_Number, parse_float=_Number))
    except (ValueError, RecursionError, ArithmeticError):
        return f"x{len(text)}:{text}"


def _digest(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(canonical(text).encode("utf-8", "surrogatepass"))


@arrow_udf(ArrayType(LongType()))
def value_digests(values: pa.Array) -> pa.Array:
    """For an array of JSON texts the 64-bit digests of their canonical forms; null for a null array.

    A batch's equal texts are worked on once.
    """
    values = values.cast(pa.list_(pa.string())) if not pa.types.is_list(values.type) else values
    coded = values.flatten().dictionary_encode(null_encoding="encode")
    known = np.fromiter((_digest(x) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    flat = known[coded.indices.to_numpy(zero_copy_only=False)].view(np.int64) if len(coded) else np.empty(0, np.int64)
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=values.is_null() if values.null_count else None)
