"""Quality rules [native]: a decision list learned by sequential covering, emitted as Spark conditions.

Text statistics are SQL expressions, computed inside the row. Labelled rows (a bounded sample) give
candidate thresholds, quantiles of each statistic. A rule is a conjunction of thresholds: it is
grown on two thirds of the sample by information gain on the bad class, pruned on the remaining
third from its last condition backwards, and accepted while it is precise enough there; the rows it
covers are set aside and the next rule is learned. The list becomes one ``when`` chain, whose rule
names tell why a document was rejected.

Only DataFrame and SQL functions touch the corpus; the learner works on the collected sample with
integer bit sets.

Defined cases: a null text has no words and fails the base check; a null label is left out of the
sample; repeated documents or labels count as often as they occur; without labelled rows the list
is empty and the base check alone decides; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.words import SPACE, covered, let, split_words, window_hashes

SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bound of the labelled sample; rows are taken in the order of a hash of their id.
MAX_SAMPLE = 5_000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test: functions of a getter for the base columns and n_lines.
RATIOS = {
    "mean_word_chars": lambda get: get("word_chars") / F.greatest(get("n_words"), F.lit(1)),
    "symbol_share": lambda get: get("n_symbols") / F.greatest(get("word_chars"), F.lit(1)),
    "dup_line_share": lambda get: get("n_dup_lines") / F.greatest(get("n_lines"), F.lit(1)),
    "repeat_share": lambda get: get("n_repeat_words") / F.greatest(get("n_words"), F.lit(1)),
    "words_per_line": lambda get: get("n_words") / F.greatest(get("n_lines"), F.lit(1)),
    "log_words": lambda get: F.log1p(get("n_words")),
}


def _repeat_spans(hashes: Column) -> Column:
    """Sorted struct(pos, len) of the windows whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("pos"))))

    def repeated(s):
        def spot(j):
            here = F.get(s, j)
            twin = (here["h"] == F.get(s, j - 1)["h"]) | (here["h"] == F.get(s, j + 1)["h"])
            return F.when(twin, here["pos"])

        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), spot), lambda p: p.isNotNull())
        return F.transform(F.array_sort(found), lambda p: F.struct(p.alias("pos"), F.lit(REPEAT_WIDTH).alias("len")))

    return let(pairs, repeated)


def repeated_words(words: Column, n: Column) -> Column:
    """Words under 8-word windows that occur twice or more in the text; most texts have none and skip the sort."""

    def of(hashes):
        valid = F.slice(hashes[REPEAT_WIDTH], 1, n - (REPEAT_WIDTH - 1))
        return let(
            valid, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(_repeat_spans(h)))
        )

    return F.when(n <= REPEAT_WIDTH, 0).otherwise(window_hashes(words, [REPEAT_WIDTH], of))


def statistics(text: Column) -> Column:
    """struct of the base columns and n_lines (long) of a text."""

    def of(words: Column, lines: Column) -> Column:
        known = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.array_join(words, "")),
            "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words, F.size(words)),
            "n_lines": F.size(lines),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in known.items()])

    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(split_words(text, SPACE), lambda words: let(lines, lambda x: of(words, x)))


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (by default all that are not named like a statistic), the base columns and n_lines (long)."""
    kept = keep if keep is not None else [c for c in docs.columns if c not in (*BASE, "n_lines")]
    names = [F.col(f"`{c}`") for c in kept]
    return docs.select(*names, statistics(F.col(text_col)).alias("_stats")).select(*names, "_stats.*")


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold`` or ``statistic < threshold``."""

    statistic: str
    at_least: bool
    threshold: float

    def column(self, get=F.col) -> Column:
        value = RATIOS[self.statistic](get)
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects a document."""

    conditions: tuple[Condition, ...]

    def column(self, get=F.col) -> Column:
        return reduce(lambda a, b: a & b, [c.column(get) for c in self.conditions])


def _bits(flags) -> int:
    return int("".join("1" if f else "0" for f in flags) or "0", 2)


def _thresholds(values: list[float], most: int) -> list[float]:
    """Midpoints between neighbouring distinct quantiles."""
    ordered = sorted(values)
    cuts = sorted({ordered[min(len(ordered) - 1, k * len(ordered) // most)] for k in range(most + 1)})
    return [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the bad class when p0, n0 shrink to p, n."""
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(
    rows: list[tuple[dict[str, float], bool]],
    statistics: list[str],
    max_rules: int = 12,
    max_conditions: int = 3,
    max_thresholds: int = 48,
    min_precision: float = 0.9,
    min_support: int = 3,
) -> list[Rule]:
    """Ordered rules for the bad class from (statistics, is_bad); every third row is kept for pruning."""
    if not rows:
        return []
    every = (1 << len(rows)) - 1
    held = _bits(i % 3 == 2 for i in range(len(rows)))
    bad = _bits(b for _, b in rows)
    masks: dict[Condition, int] = {}
    for name in statistics:
        values = [r[name] for r, _ in rows]
        for t in _thresholds(values, max_thresholds):
            above = _bits(v >= t for v in values)
            masks[Condition(name, True, t)] = above
            masks[Condition(name, False, t)] = every & ~above

    def counts(mask: int) -> tuple[int, int]:
        return (mask & bad).bit_count(), (mask & ~bad).bit_count()

    def cover(conditions: tuple[Condition, ...], within: int) -> int:
        for c in conditions:
            within &= masks[c]
        return within

    rules, left = [], every
    while len(rules) < max_rules:
        conditions: tuple[Condition, ...] = ()
        now = left & ~held
        p, n = counts(now)
        if p < min_support:
            break
        while n and len(conditions) < max_conditions:
            best = max(masks, key=lambda c: _gain(*counts(now & masks[c]), p, n))
            if _gain(*counts(now & masks[best]), p, n) <= 0:
                break
            conditions, now = (*conditions, best), now & masks[best]
            p, n = counts(now)

        def worth(some: tuple[Condition, ...], rest: int = left & held) -> float:
            good, wrong = counts(cover(some, rest))
            return (good - wrong) / (good + wrong) if good + wrong else -1.0

        prefixes = [conditions[:k] for k in range(1, len(conditions) + 1)]
        if not prefixes:
            break
        chosen = max(prefixes, key=lambda s: (worth(s), -len(s)))
        good, wrong = counts(cover(chosen, left & held))
        if good < min_support or good < min_precision * (good + wrong):
            break
        rules.append(Rule(chosen))
        left &= ~cover(chosen, every)
    return rules


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> list[tuple[dict[str, float], bool]]:
    """Statistics and badness (label 0) of at most ``max_sample`` labelled rows, in the order of a hash of their id."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad")).orderBy(F.xxhash64("_id"), "_id", "_bad").limit(max_sample)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    stats = text_statistics(found, "_t", ["_id", "_bad"])
    stats = stats.select("_id", "_bad", *[ratio(F.col).cast("double").alias(name) for name, ratio in RATIOS.items()])
    rows = stats.orderBy(F.xxhash64("_id"), "_id", "_bad", *RATIOS).limit(max_sample).collect()
    return [({name: row[name] for name in RATIOS}, row["_bad"]) for row in rows]


def fit_rules(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, **columns: str) -> list[Rule]:
    """The decision list for ``docs``, learned from the labelled ones."""
    return learn_rules(labelled_sample(docs, labels, max_sample, **columns), list(RATIOS))


def base_failed(get=F.col) -> Column:
    return (get("n_words") < MIN_WORDS) | (100 * get("n_repeat_words") > MAX_REPEAT_PERCENT * get("n_words"))


def rejecting_rule(rules: list[Rule], get=F.col) -> Column:
    """Number (from 1) of the first rule that holds, else null."""
    chain = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        chain = F.when(rules[number - 1].column(get), number).otherwise(chain)
    return chain


def assess(docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the base columns, base_failed, rejected_by (int, null if no rule holds), kept.

    By default all columns are kept but those whose names the result has itself.
    """
    own = (*BASE, "base_failed", "rejected_by", "kept")
    kept = keep if keep is not None else [c for c in docs.columns if c not in own]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), statistics(F.col(text_col)).alias("_stats"))
    get = lambda c: F.col("_stats")[c]
    marked = held.select(
        *[F.col(f"_doc.`{c}`").alias(c) for c in kept],
        *[get(c).alias(c) for c in BASE],
        base_failed(get).alias("base_failed"),
        rejecting_rule(rules, get).alias("rejected_by"),
    )
    return marked.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns; one scan, no shuffle.

    The filter tests statistics held by a lambda variable, as it would otherwise compute each anew
    at every mention.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_t"))
    good = let(statistics(F.col("_t")), lambda s: ~base_failed(lambda c: s[c]) & rejecting_rule(rules, lambda c: s[c]).isNull())
    return boxed.where(good).select("_doc.*")
