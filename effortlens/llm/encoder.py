"""Byte-level BPE over Arrow string columns with the tokenizers library, one distinct piece at a time.

The pre-tokenizer of the vocabulary never joins what stands before a single space to what follows
it, nor a letter to a sign behind it (but for the apostrophe), nor either to a line end behind it.
So a text whose spaces are single may be encoded piece by piece: a word with the space in front of
it, the signs behind it, a line end with what follows. Pieces repeat, and a word is one piece
whatever sign stands behind it, so only distinct new pieces are encoded: those of letters alone,
which are one pre-token, by the library's model, the others by its whole way from text to ids. A
cache, bounded in pieces and bytes, lives as long as the Python worker; when it is full, what has
been used once only goes. Other texts (two white-space characters together of which one is a space)
are encoded whole. Ids are those of encoding each whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from effortlens.llm.wordhash import release_memory, text_runs

#: Bounds of the cache of a worker: pieces (about 200 bytes each) and bytes of their texts.
MAX_CACHED = 400_000
MAX_CACHED_BYTES = 8 << 20
#: Bytes of text handled at a time.
RUN_BYTES = 1 << 20
#: Characters of new pieces handed to the library at a time.
JOINED_CHARS = 1 << 16

_WHITE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WHOLE = rf" [{_WHITE}]|[{_WHITE}] "
#: Pieces that are one pre-token: letters of ASCII and Latin-1, the lower half of the byte-level alphabet.
_LETTERS = re.compile("[ A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF][A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*")
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on; a line end stays.
_PRINTED = np.zeros(256, dtype=bool)
_PRINTED[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
_ALPHABET = np.where(_PRINTED, np.arange(256), 0xFF + np.cumsum(~_PRINTED)).astype("<u2")
_ALPHABET[0x0A] = 0x0A
_LETTER, _SIGN, _SEEN = (np.zeros(256, dtype=bool) for _ in range(3))
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SEEN[0x21:0x7F] = True
# the special token <|endoftext|> is never cut
_SIGN[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True

_encoders: dict[str, Encoder] = {}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Bytes of texts -> where pieces begin, besides the beginnings of texts."""
    cut = data == 0x20
    if len(data) > 1:
        at, before = data[1:], data[:-1]
        letter = _LETTER[before]
        letter[1:] |= (before[:-1] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)  # all but the signs of times and division
        cut[1:] |= (_SIGN[at] & letter) | ((at == 0x0A) & (_SEEN[before] | letter))
    return cut


def encoder_for(path: str) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        release_memory()  # of operators that this worker has run before
        _encoders[path] = Encoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """Free the encoders of this worker, for operators that need none: the worker lives on beside others."""
    _encoders.clear()
    release_memory()


class Encoder:
    def __init__(self, path: str, max_cached: int = MAX_CACHED, max_bytes: int = MAX_CACHED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._max, self._max_bytes = max_cached, max_bytes
        n = self._tokenizer.get_vocab_size()
        self._kind = np.uint16 if n <= 1 << 16 else np.uint32
        self._known: dict[str, int] = {}
        self._pool = np.empty(0, dtype=self._kind)
        self._end = np.zeros(1, dtype=np.int64)  # of each piece in the pool; its start is the end before it
        self._uses = np.zeros(1, dtype=np.int64)
        self._bytes = 0

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per string, all tokens), a few strings at a time: the library's own results are large."""
        lengths, ids, at = [], [np.empty(0, dtype=self._kind)], 0
        while at < len(texts):
            first, chars = at, 0
            while at < len(texts) and chars < JOINED_CHARS:
                chars += len(texts[at])
                at += 1
            lists = [e.ids for e in self._tokenizer.encode_batch_fast(texts[first:at], add_special_tokens=False)]
            lengths += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), dtype=self._kind))
        return np.array(lengths, dtype=np.int64), np.concatenate(ids)

    def _forget(self) -> None:
        """Keep what has been used more than once, if that is less than half of what may be kept."""
        keep = np.flatnonzero(self._uses > 1)
        if len(keep) > self._max // 2 or self._bytes > self._max_bytes:
            keep = keep[np.argsort(-self._uses[keep], kind="stable")][: self._max // 8]
        new = np.zeros(len(self._end), dtype=np.int64)
        new[keep] = np.arange(1, len(keep) + 1)
        pool = self.gather(self._end[keep - 1], self._end[keep] - self._end[keep - 1])
        counts = self._end[keep] - self._end[keep - 1]
        self._known = {p: int(new[slot]) for p, slot in self._known.items() if new[slot]}
        self._pool, self._end = pool, np.concatenate([[0], np.cumsum(counts)])
        self._uses = np.concatenate([[0], np.ones(len(keep), dtype=np.int64)])
        self._bytes = sum(map(len, self._known))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_flat`` for pieces that are one pre-token of letters each: no string is cut, only merged."""
        lengths, ids, at, tokenize = [], [np.empty(0, dtype=self._kind)], 0, self._tokenizer.model.tokenize
        joined = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
        mapped = _ALPHABET[joined].tobytes().decode("utf-16-le").split("\n") if words else []
        while at < len(mapped):
            lists = [[t.id for t in tokenize(word)] for word in mapped[at : at + JOINED_CHARS // 8]]
            at += len(lists)
            lengths += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), dtype=self._kind))
        return np.array(lengths, dtype=np.int64), np.concatenate(ids)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Encode new pieces; their slots."""
        plain = np.fromiter((_LETTERS.fullmatch(p) is not None for p in pieces), dtype=bool, count=len(pieces))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        ordered = [pieces[k] for k in order.tolist()]
        n = int(plain.sum())
        counts, ids = zip(self._letters(ordered[:n]), self._flat(ordered[n:]), strict=True)
        first = len(self._end)
        self._known.update(zip(ordered, range(first, first + len(ordered)), strict=True))
        self._pool = np.concatenate([self._pool, *ids])
        self._end = np.concatenate([self._end, self._end[-1] + np.cumsum(np.concatenate(counts))])
        self._uses = np.concatenate([self._uses, np.zeros(len(ordered), dtype=np.int64)])
        self._bytes += sum(map(len, ordered))
        slots = np.empty(len(ordered), dtype=np.int64)
        slots[order] = np.arange(first, first + len(ordered))
        return slots

    def encode_whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def count_few(self, texts: list[str]) -> list[int]:
        """Tokens of a few short strings, past the cache."""
        return self._flat(texts)[0].tolist()

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts fit for it: (first piece of each text and one more, pool start and token count of each piece)."""
        if len(self._known) > self._max or self._bytes > self._max_bytes:
            self._forget()
        runs = list(text_runs(texts, 1 << 62))
        data, offsets = (runs[0][2][runs[0][3][0] : runs[0][3][-1]], runs[0][3] - runs[0][3][0]) if runs else (np.empty(0, np.uint8), np.zeros(1, np.int64))
        cut = _cuts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, offsets)
        ends = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.LargeStringArray.from_buffers(len(starts), ends, pa.py_buffer(data)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self._known.get, distinct, repeat(0)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(slots == 0)
        if len(new):
            slots[new] = self._learn([distinct[k] for k in new.tolist()])
        slot = slots[np.asarray(coded.indices)]
        self._uses[slots] += np.bincount(np.asarray(coded.indices), minlength=len(slots))
        start = self._end[slot - 1]
        return first, start, self._end[slot] - start

    def fits(self, texts: pa.Array) -> np.ndarray:
        """Which texts may be encoded piece by piece."""
        return ~np.asarray(pc.match_substring_regex(texts, _WHOLE))

    def gather(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The tokens of pieces, one piece after the other."""
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self._pool[np.arange(total) + np.repeat(start - (ends - count), count)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per text, all tokens); null is an empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        fit = self.fits(texts)
        first, start, count = self.pieces(texts.filter(pa.array(fit)))
        tokens = self.gather(start, count)
        sums = np.concatenate([[0], np.cumsum(count)])
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[fit] = sums[first[1:]] - sums[first[:-1]]
        if fit.all():
            return lengths, tokens
        whole, ids = self._flat(texts.filter(pa.array(~fit)).to_pylist())
        lengths[~fit] = whole
        out = np.empty(int(lengths.sum()), dtype=tokens.dtype)
        own = np.repeat(fit, lengths)
        out[own] = tokens
        out[~own] = ids
        return lengths, out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is an empty text."""
        texts = texts.fill_null("").cast(pa.large_string())
        fit = self.fits(texts)
        first, _, count = self.pieces(texts.filter(pa.array(fit)))
        sums = np.concatenate([[0], np.cumsum(count)])
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[fit] = sums[first[1:]] - sums[first[:-1]]
        if not fit.all():
            lengths[~fit] = self.count_few(texts.filter(pa.array(~fit)).to_pylist())
        return lengths
