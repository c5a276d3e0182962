"""Vectorised word hashing over Arrow string columns, for operators that run inside Spark tasks.

Words are separated by ASCII white space (0x20, 0x09-0x0D), so they can be found in the UTF-8
bytes. All of a batch is hashed at once: bytes by a polynomial over the word, windows of words by
doubling, so the cost of a window does not depend on its length.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: nothing to give back
    _trim = None

_RNG = np.random.RandomState(20250101)
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + _RNG.randint(0, 2, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C17  # odd and 3 mod 4: far from a root of one
_MUL = np.uint64(0xD6E8FEB86659FD93)
_LEFT = np.uint64(0xA0761D6478BD642F)
#: Bytes hashed at a time; bounds the temporary arrays.
BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 2**64), BLOCK + 1)



def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base; more than a block of them are made for the call."""
    return _POWER[:n] if n <= len(_POWER) else _powers(_BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _INVERSE[:n] if n <= len(_INVERSE) else _powers(pow(_BASE, -1, 2**64), n)


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, in place."""
    x ^= x >> np.uint64(32)
    x *= _MUL
    x ^= x >> np.uint64(29)
    x *= _MUL
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of a run of texts: hash, byte span and text number of each, and the bytes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text (and one more): index of its first word


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + BLOCK, side="right"))
        if j <= i:  # one word longer than a block
            out[i] = _hash_long(data[at : end[i]])
            i += 1
            continue
        part = _BYTE[data[at : end[j - 1]]]
        part *= _POWER[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * _INVERSE[s]
        i = j
    return mix(out)


def _hash_long(word: np.ndarray) -> np.uint64:
    """The same polynomial for a word of more than a block."""
    total, shift = 0, 1
    for k in range(0, len(word), BLOCK):
        part = _BYTE[word[k : k + BLOCK]]
        total = (total + int((part * _POWER[: len(part)]).sum(dtype=np.uint64)) * shift) % 2**64
        shift = shift * int(_POWER[BLOCK]) % 2**64
    return np.uint64(total)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[k]:offsets[k + 1]]."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets.astype(np.int64) - base
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, _hash_spans(data, start, end), first)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` entries, by doubling; n - width + 1 of them."""
    if width > len(h):
        return np.empty(0, dtype=np.uint64)
    power, x = 1, h
    while 2 * power <= width:
        x = mix(x[:-power] * _LEFT + x[power:])
        power *= 2
    if power < width:
        k = width - power
        x = mix(x[:-k] * _LEFT + x[k:])
    return x


def text_runs(texts: pa.Array | pa.ChunkedArray, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about ``most`` bytes of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data, offsets[i : j + 1]
        i = j


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on, and others share their executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """Sorted positions of the leftmost smallest of every ``span`` consecutive values.

    Both copies of a passage pick the same positions, as the choice rests on the values alone; of
    ``span`` consecutive positions one at least is picked.
    """
    n = len(h)
    if not n:
        return np.empty(0, dtype=np.int64)
    if n <= span:
        return np.array([int(np.argmin(h))])
    # sparse-table minimum: positions of the smaller of two overlapping halves
    best = np.arange(n)
    width = 1
    while 2 * width <= span:
        a, b = best[:-width], best[width:]
        best = np.where(h[b] < h[a], b, a)
        width *= 2
    k = span - width
    if k:
        a, b = best[:-k], best[k:]
        best = np.where(h[b] < h[a], b, a)
    return best[np.flatnonzero(np.diff(best, prepend=-1))]
