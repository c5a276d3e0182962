"""Native word splitting shared by the operators that run on Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the contracts: what lies between words.
ITEM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` agrees on pure ASCII, where it is the cheaper of the two."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def split_words(text: Column, pattern: str) -> Column:
    """Words of a text as array<string>; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable holds the value, so neither the optimizer's project collapsing nor an
    enclosing higher-order function can evaluate the expression again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column, width: int) -> Column:
    """1-based starts of all windows of ``width`` words among ``n``; empty if there is none."""
    return F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))


def covered(spans: Column) -> Column:
    """Number of words under spans struct(pos, len) that are sorted by pos."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("next"))

    def step(acc, s):
        end = s["pos"] + s["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["next"], s["pos"]))).alias("n"),
            F.greatest(acc["next"], end).alias("next"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def _joined(left: Column, right: Column, shift: int) -> Column:
    """Hashes of left[i] and right[i + shift]; the last ``shift`` entries stand for no window."""
    tail = F.slice(right, shift + 1, F.greatest(F.size(right) - shift, F.lit(0)))
    return F.zip_with(left, tail, lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column, widths: list[int], body) -> Column:
    """``body(hashes)`` of the 64-bit hashes of all windows of each width, built by doubling.

    ``hashes`` maps a width to an array whose entry i stands for the window that starts at word i
    (0-based); only the first n - width + 1 entries are windows. A window of any width is two
    overlapping windows of the largest power of two that fits, so a width costs one more pass.
    """
    by_width: dict[int, Column] = {}

    def level(power: int, hashes: Column) -> Column:
        by_width[power] = hashes
        if 2 * power <= max(widths):
            return let(_joined(hashes, hashes, power), lambda up: level(2 * power, up))
        return body({w: _of_width(w) for w in widths})

    def _of_width(width: int) -> Column:
        power = 1 << (width.bit_length() - 1)
        return by_width[power] if power == width else _joined(by_width[power], by_width[power], width - power)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: level(1, h))
