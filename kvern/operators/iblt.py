"""Invertible Bloom lookup tables over arrays of 64-bit keys and digests.

An element is a key with its value's digest.  It goes into one cell of each of
``HASHES`` sub-tables; a cell holds a count and the XOR of keys, digests and check
hashes.  Tables of equal size subtract cell by cell: what both sides have cancels
out, and what is left is peeled from cells that hold a single element.
"""

from __future__ import annotations

import numpy as np

HASHES = 3
#: Multipliers and constants of the 64-bit XXH64 mix, fixed values.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def mix(x: np.ndarray, seed) -> np.ndarray:
    """XXH64 of 8-byte words."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + _P5 + np.uint64(8)
        h = h ^ (_rotate(x * _P2, 31) * _P1)
        h = _rotate(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def check_hash(keys: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return mix(digests, mix(keys, np.uint64(42)))


def cells_of(check: np.ndarray, cells: int) -> np.ndarray:
    """The cell in each sub-table: ``HASHES`` rows."""
    part = cells // HASHES
    return np.stack([(mix(check, np.uint64(k + 1)) % np.uint64(part)).astype(np.int64) + k * part for k in range(HASHES)])


def table(keys: np.ndarray, digests: np.ndarray, cells: int) -> np.ndarray:
    """``(4, cells)``: counts, XOR of keys, of digests, of check hashes."""
    out = np.zeros((4, cells), dtype=np.uint64)
    check = check_hash(keys, digests)
    for at in cells_of(check, cells):
        out[0] += np.bincount(at, minlength=cells).astype(np.uint64)
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else np.empty(0, np.int64)
        if len(at):
            for row, values in ((1, keys), (2, digests), (3, check)):
                out[row][at[order][starts]] ^= np.bitwise_xor.reduceat(values[order], starts)
    return out


def subtract(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([later[:1] - earlier[:1], later[1:] ^ earlier[1:]])


def peel(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Keys, digests and sides (+1 later, -1 earlier) of what differs, and whether all of it was found.

    Round by round all pure cells are taken at once: a count of one on either side
    and a check hash that fits.  The same element in two pure cells counts once.
    """
    left, size = cells.copy(), cells.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    one, minus = np.uint64(1), np.uint64(2**64 - 1)
    with np.errstate(over="ignore"):
        while True:
            single = np.flatnonzero((left[0] == one) | (left[0] == minus))
            pure = single[check_hash(left[1][single], left[2][single]) == left[3][single]]
            if not len(pure):
                break
            _, first = np.unique(left[3][pure], return_index=True)
            pure = pure[first]
            sides, keys, digests, check = (left[k][pure] for k in range(4))
            if len(found) > size:  # more rounds than cells: two elements of one check hash undo each other
                break
            found.append((keys, digests, sides))
            for at in cells_of(check, size):
                np.subtract.at(left[0], at, sides)
                for row, values in ((1, keys), (2, digests), (3, check)):
                    np.bitwise_xor.at(left[row], at, values)
    whole = not left.any()
    if not found:
        empty = np.empty(0, np.uint64)
        return empty, empty, empty.view(np.int64), whole
    keys, digests, sides = (np.concatenate(x) for x in zip(*found, strict=True))
    return keys, digests, sides.view(np.int64), whole
