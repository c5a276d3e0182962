"""Vectorised hashes of lines and of parts of lines, over code points, for tasks of Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from effortlens.llm.wordhash import _BASE, BLOCK, _powers, mix

_INV = pow(_BASE, -1, 2**64)
_SALT = 0x94D049BB133111EB
_SPACE = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint32)
_tables: dict[str, np.ndarray] = {"power": _powers(_BASE, BLOCK + 1), "inverse": _powers(_INV, BLOCK + 1)}


def _table(name: str, n: int) -> np.ndarray:
    if n <= len(_tables[name]):
        return _tables[name]
    return _powers(_BASE if name == "power" else _INV, n)  # one text longer than a block: not kept


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _values(points: np.ndarray, salt: int) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64((salt + 1) * _SALT % 2**64))


@dataclass
class Hasher:
    """Prefix sums of a run of code points; any span of it hashes in constant time."""

    sums: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, salt: int = 0) -> Hasher:
        n = len(points)
        part = _values(points, salt)
        part *= _table("power", n + 1)[:n]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        return cls(sums, _table("inverse", n + 1))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def line_spans(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, start, end) of the lines that are not blank, trimmed of white space.

    ``edges`` are the bounds of the texts in ``points``; lines end at line feeds and are numbered from 0.
    """
    feeds = np.flatnonzero(points == 10)
    start = np.sort(np.concatenate([edges[:-1], feeds + 1]))
    end = np.sort(np.concatenate([edges[1:], feeds]))
    text = np.searchsorted(edges, start, side="right") - 1
    # empty texts share an edge: number their one empty line by order, it is blank in any case
    text = np.minimum(text, len(edges) - 2)
    first = np.searchsorted(text, np.arange(len(edges) - 1))
    number = np.arange(len(start)) - first[text]
    solid = np.flatnonzero(~np.isin(points, _SPACE))
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    full = a < b
    return text[full], number[full], solid[a[full]], solid[b[full] - 1] + 1


def finished(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(h + length.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def part_keys(hasher: Hasher, start: np.ndarray, end: np.ndarray, parts: int) -> np.ndarray:
    """Keys (2 * parts a line) of a line without one of its parts, for partners as long or one longer and one shorter.

    Two lines within one edit agree outside one part, so they share a key: for the shorter length m
    of the two, what lies before part j counted from the left and after it counted from the right.
    """
    out = np.empty((len(start), 2 * parts), dtype=np.uint64)
    for side in (0, 1):
        m = end - start - side
        for j in range(parts):
            left, right = start + j * m // parts, end - (m - (j + 1) * m // parts)
            key = hasher.span(start, left) * np.uint64(0xA0761D6478BD642F) + hasher.span(right, end) * np.uint64(0xE7037ED1A0B428DB)
            out[:, side * parts + j] = mix(key + (m * parts + j).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    return out
