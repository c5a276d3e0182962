"""A segment tree of token counts over the pre-tokens of one text.

A leaf is a run of whole pre-tokens, the shortest of ``LEAF_CHARS`` characters or more. Pre-tokens
of byte-level vocabularies are runs of letters, of digits or of other signs, with one space in front
if there is one, runs of white space, and a few endings after an apostrophe; so a pre-token ends
wherever, after a letter, digit or sign, another kind of character or white space follows, but for
the apostrophe. A leaf's tokens do not depend on what stands around it. Only a text that is one long
pre-token, such as letters without a break, is one leaf.

The tree is two arrays, characters and tokens, of all levels one after the other: the leaves, then
sums of two by two, up to the root, which comes last. An edit descends by characters to the leaves
it touches; only those are encoded again, widened to a neighbour where the edit has spoilt the cut
between them. If as many leaves come back, only the sums on their paths to the root are renewed.
"""

from __future__ import annotations

import numpy as np
import regex

LEAF_CHARS = 128
# characters that not every library takes for white space are left out
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'\x1C-\x1F\x85\u180E])(?=[ \t-\r\u3000\p{L}\p{N}])")
#: No cut stands within a special token, which the vocabulary finds before it looks at pre-tokens.
SPECIAL = "<|endoftext|>"


def is_cut(text: str, at: int) -> bool:
    """Whether ``text`` may be cut before position ``at``."""
    if not 0 < at < len(text) or _CUT.match(text, at) is None:
        return False
    found = text.find(SPECIAL, max(0, at - len(SPECIAL) + 1), at + len(SPECIAL) - 1)
    return found < 0 or found >= at or found + len(SPECIAL) <= at


def leaf_ends(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ends of the leaves of a text."""
    ends, at = [], leaf_chars
    while at < len(text) and (found := _CUT.search(text, at)):
        at = found.start()
        if at >= len(text):
            break
        if is_cut(text, at):
            ends.append(at)
            at += leaf_chars
        else:
            at += 1
    if text:
        ends.append(len(text))
    return ends


def leaf_texts(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def n_nodes(n_leaves: int) -> int:
    """Length of a tree's arrays."""
    total = n_leaves
    while n_leaves > 1:
        n_leaves = (n_leaves + 1) // 2
        total += n_leaves
    return total


def all_levels(leaves: np.ndarray) -> np.ndarray:
    """Leaves -> the whole array of a tree; no leaves, no tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), 2)))
    return np.concatenate(levels)


def level_sizes(n: int) -> list[int]:
    """Sizes of the levels of a tree whose arrays have ``n`` entries."""
    low, high = 0, n
    while low < high:  # n_nodes grows with the leaves
        middle = (low + high) // 2
        low, high = (middle + 1, high) if n_nodes(middle) < n else (low, middle)
    sizes = [low]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    return sizes


class TokenTree:
    """The tree of one text. ``count`` gives the tokens of a list of strings."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, leaf_chars: int = LEAF_CHARS):
        self.text, self.leaf_chars = text, leaf_chars
        self.chars, self.tokens = np.array(chars, dtype=np.int32), np.array(tokens, dtype=np.int32)
        self.sizes = level_sizes(len(self.chars))
        self.encoded_chars = 0

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1]) if len(self.tokens) else 0

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a character; the last leaf for the end of the text."""
        k, start = 0, 0
        base = len(self.chars) - 1
        for size in reversed(self.sizes[:-1]):
            base -= size
            k *= 2
            left = int(self.chars[base + k])
            if k + 1 < size and position >= start + left:
                start += left
                k += 1
        return k, start

    def _renew(self, first: int, last: int) -> None:
        """Sums above the leaves first..last."""
        base = 0
        for size, above in zip(self.sizes, self.sizes[1:], strict=False):
            first, last = first // 2, last // 2
            for values in (self.chars, self.tokens):
                pairs = values[base + 2 * first : base + min(2 * last + 2, size)]
                values[base + size + first : base + size + last + 1] = np.add.reduceat(pairs, np.arange(0, len(pairs), 2))
            base += size
            assert above > last

    def edit(self, start: int, end: int, inserted: str, count) -> None:
        """Replace the characters start..end by ``inserted``; positions are those of the text now."""
        n_leaves = self.sizes[0]
        self.text = self.text[:start] + inserted + self.text[end:]
        first = last = a = b = 0
        if n_leaves:
            first, a = self.leaf_at(start)
            last, b = (first, a) if end <= start else self.leaf_at(end - 1)
            b += int(self.chars[last])
        b += len(inserted) - (end - start)
        while a > 0 and not is_cut(self.text, a):  # the cut in front is spoilt
            first -= 1
            a -= int(self.chars[first])
        while b < len(self.text) and not is_cut(self.text, b):
            last += 1
            b += int(self.chars[last])
        region = self.text[a:b]
        self.encoded_chars += len(region)
        ends = leaf_ends(region, self.leaf_chars)
        chars = np.diff(ends, prepend=0).astype(np.int32)
        tokens = np.asarray(count(leaf_texts(region, ends)), dtype=np.int32)
        if n_leaves and len(ends) == last + 1 - first:
            self.chars[first : last + 1], self.tokens[first : last + 1] = chars, tokens
            self._renew(first, last)
            return
        rest = min(last + 1, n_leaves)
        self.chars = all_levels(np.concatenate([self.chars[:first], chars, self.chars[rest:n_leaves]]))
        self.tokens = all_levels(np.concatenate([self.tokens[:first], tokens, self.tokens[rest:n_leaves]]))
        self.sizes = level_sizes(len(self.chars))
