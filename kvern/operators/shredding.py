"""Nested records to related flat tables, by columnar shredding.

A record is taken apart into one column per leaf path.  Each entry of a column has
a repetition level (at which repeated ancestor a new element begins, 0 for a new
record) and a definition level (how many of the optional and repeated ancestors
are there).  The two level sequences hold the whole structure, so a flat table of
any repeated ancestor is put together from them alone: positions are running
counts between restarts, presence is a comparison of levels.

Everything runs inside one pass over the input (``mapInArrow``) without a shuffle;
a record is never split over tasks and a column is worked on as an array.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Leaf:
    """Levels and values of one leaf path; ``steps`` holds (name, repeated) from the root."""

    steps: tuple[tuple[str, bool], ...]
    rep: list[int] = field(default_factory=list)
    dfn: list[int] = field(default_factory=list)
    values: list[str | None] = field(default_factory=list)

    def level_of(self, depth: int) -> int:
        """Definition level at which the first ``depth`` steps are all there."""
        return sum(2 if repeated else 1 for _, repeated in self.steps[:depth])


def parse_path(path: str) -> tuple[tuple[str, bool], ...]:
    """``"groups*.roles*.type.code"``: a star marks a repeated step."""
    return tuple((s.rstrip("*"), s.endswith("*")) for s in path.split("."))


def read_json(body: str | None):
    """The document, with numbers kept as written; ``None`` for a body that is not one whole JSON document."""
    if not body:
        return None
    try:
        return json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


class _Number(str):
    """A JSON number's text."""


def _refuse(name: str):
    raise ValueError(name)


def stripe(leaf: Leaf, record) -> None:
    """Append the entries of one record to a leaf's columns.

    Optional step: level + 1 where it is there.  Repeated step: level + 1 where its
    list has elements, + 1 where the element is not null.  A single object in place
    of a list is a list of one; a value in place of an object has no parts.
    """
    steps, rep, dfn, values = leaf.steps, leaf.rep, leaf.dfn, leaf.values
    # depth, node, definition level, repetition level of the first entry below, repetition levels passed
    stack = [(0, record, 0, 0, 0)]
    while stack:
        depth, node, level, start, passed = stack.pop()
        if depth == len(steps):
            rep.append(start)
            dfn.append(level)
            values.append(node if isinstance(node, str) else str(node).lower() if isinstance(node, bool) else None)
            continue
        name, repeated = steps[depth]
        child = node.get(name) if isinstance(node, dict) else None
        if child is None or repeated and isinstance(child, list) and not child:
            rep.append(start)
            dfn.append(level)
            values.append(None)
        elif not repeated:
            stack.append((depth + 1, child, level + 1, start, passed))
        else:
            elements = child if isinstance(child, list) else [child]
            below = []
            for k, element in enumerate(elements):
                at = start if k == 0 else passed + 1
                if element is None:
                    below.append((len(steps), None, level + 1, at, passed + 1))
                else:
                    below.append((depth + 1, element, level + 2, at, passed + 1))
            stack.extend(reversed(below))


def positions(rep: np.ndarray, levels: int) -> np.ndarray:
    """For each entry its record number and its position at each repeated level, from the repetition levels."""
    out = np.empty((levels + 1, len(rep)), dtype=np.int64)
    for k in range(levels + 1):
        begins = rep <= k
        count = np.cumsum(begins)
        if k:
            restart = rep < k
            base = np.maximum.accumulate(np.where(restart, count, 0))
            out[k] = count - base
        else:
            out[0] = count - 1
    return out


def assemble(leaves: list[Leaf], repeated: int) -> dict[str, np.ndarray]:
    """The table of the ancestor at repeated level ``repeated``, from its leaves' level sequences.

    All leaves pass the same first ``repeated`` repeated steps.  Gives the record
    number, the position at each level and for each leaf its values; null where the
    leaf or a step to it is missing.  Leaves that repeat further are not taken.
    """
    first = leaves[0]
    starred = [i for i, (_, r) in enumerate(first.steps) if r][:repeated]
    depth = starred[-1] + 1 if starred else 0
    rep = np.asarray(first.rep, dtype=np.int64)
    there = np.asarray(first.dfn, dtype=np.int64) >= first.level_of(depth)
    at = positions(rep, repeated)
    table: dict[str, np.ndarray] = {f"level{k}": at[k][there] for k in range(repeated + 1)}
    for leaf in leaves:
        # one entry per ancestor element: leaves of one ancestor have equal level prefixes
        table[".".join(n for n, _ in leaf.steps)] = np.asarray(leaf.values, dtype=object)[there]
    return table


def shred_table(
    df: DataFrame, key: str, source: str, ancestor: str, leaves: dict[str, str], places: list[str], as_json: bool
) -> DataFrame:
    """The flat table of a repeated ancestor: key, a place for each repeated level, and leaves.

    ``ancestor`` is a path with stars ("rollegrupper*.roller*"), ``leaves`` names
    output columns by paths below it, ``places`` names the position columns from the
    outermost level, counting from 0.  ``source`` is a JSON text (``as_json``) or a
    nested column.  Null or unreadable sources, missing or empty lists give no row;
    a null element of a list takes up its position and gives no row; missing or null
    leaves, objects and lists are null; numbers and truth values come as written.  Repeated records are
    each taken by themselves.  Other columns of ``df`` are not read.
    """
    paths = {name: parse_path(f"{ancestor}.{path}") for name, path in leaves.items()}
    depth = sum(r for _, r in parse_path(ancestor))
    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join([f"{p} bigint" for p in places] + [f"{n} string" for n in leaves])

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            records = [read_json(x) if as_json else x for x in raw]
            columns = {name: Leaf(steps) for name, steps in paths.items()}
            for leaf in columns.values():
                for record in records:
                    stripe(leaf, record)
            table = assemble(list(columns.values()), depth)
            arrays = [batch.column(0).take(pa.array(table["level0"]))]
            arrays += [pa.array(table[f"level{k + 1}"]) for k in range(depth)]
            for steps in paths.values():
                arrays.append(pa.array([_text(v) for v in table[".".join(n for n, _ in steps)]], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *places, *leaves])

    return df.select(key, source).mapInArrow(shred, schema)


def _text(value: str | None) -> str | None:
    """Lone surrogates, which JSON can spell but no text can hold, become question marks."""
    return None if value is None else str(value).encode("utf-8", "replace").decode()
