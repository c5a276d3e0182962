"""Plain reckonings on the driver, for small fixtures."""

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def components(docs):
    """doc_id -> (set size, smallest id reachable), for (doc_id, text) pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    top = {i: i for i, _ in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def repeats_removed(docs, width=50):
    """doc_id -> (n_words, n_removed, sha256 of the words kept), for distinct ids."""
    first = {}
    for i, t in sorted((i, t) for i, t in docs if i is not None):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_statistics(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def vector_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id -> (indexes, error), final books) by comparing every part with every entry, in Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    length = -(-max(1, *(len(v) for _, v in kept)) // parts) * parts
    width = length // parts
    whole = [(i, [math.floor(x * scale) for x in v] + [0] * (length - len(v))) for i, v in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[v[p * width : (p + 1) * width] for _, v in whole] for p in range(parts)]
    books = [part[:entries] for part in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book)) for x in part] for part, book in zip(cut, books, strict=True)]

    for _ in range(rounds):
        for p, found in enumerate(assign()):
            for k in range(len(books[p])):
                own = [x for x, (_, e) in zip(cut[p], found, strict=True) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    return {i: ([last[p][n][1] for p in range(parts)], sum(last[p][n][0] for p in range(parts))) for n, (i, _) in enumerate(whole)}, books
