"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word is cut into two segments whose lengths depend on its own length alone. If another word of
equal length, or one letter longer, is one edit away, the edit lies in one segment and the other is
met unchanged: the first at the start of that word, the second at its end, which is one place later
where the word is longer. So a word is indexed by its two segments and looks up two substrings for
words of its own length and two for words one shorter; what meets is compared on the rest outside
the segment, and pairs that meet twice are made one.

A segment that more than ``CROWDED`` words share is not joined: the rest of its words is cut in two
in the same way, as the edit must lie in the rest, and the words meet on both segments. That goes on
until no segment is crowded or one letter is left (then a group has a word for each letter at most), so
no large group of words is compared in all pairs and none is capped.

The corpus is read once: a task counts the words of its texts and sends sums. All else works on the
vocabulary. A word's form is the commonest of its near words if that is at least ``ratio`` times as
common; forms are followed to the last by doubling of pointers, each round of which joins the
vocabulary once.

Defined cases: a null or empty text has no words; a text is read in pieces that end where a word
ends, so long texts take no more memory; equal rows count twice; a null id counts as ``null`` in the
hash that chooses which words lose a letter; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.storage import small_batches, stored
from effortlens.llm.wordhash import release_memory

#: Fixed by the contract: what a word is, how long and how frequent it is at least.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Fixed by the contract: one in so many words of a document, by hash, loses a letter.
DROP_EVERY = 97
#: Words that share a segment before it is cut again.
CROWDED = 1000
#: Characters of a text read at a time, and different words that a task holds.
PIECE, HELD = 1 << 20, 200_000


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, a piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (open_run := RUN.match(text, end)):
            end = open_run.end()
        yield RUN.findall(text, at, end)
        at = end


def _counted(drop_every: int | None, min_chars: int):
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text -> word, n: sums over texts, a word perhaps several times."""
        counts: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, doc in enumerate(ids):
                raw = texts[k].as_py()
                if not raw:
                    continue
                start = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                # bytes.lower() changes A-Z only
                for runs in _runs(raw.encode().lower().decode()):
                    for word, n in Counter(runs).items():
                        if drop_every and (h := zlib.crc32(word.encode(), start)) % drop_every == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= min_chars:
                            counts[word] += n
                if len(counts) > HELD:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)
        release_memory()

    return rows


def vocabulary(
    docs: DataFrame,
    drop_every: int | None = None,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n of the words of all texts, lower-cased in A-Z; with ``drop_every`` some have lost a letter."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sums = texts.mapInArrow(_counted(drop_every, min_chars), "word string, n long")
    return sums.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _segments(rows: DataFrame, longer: int) -> DataFrame:
    """key, rest, word -> two rows each: the key with one segment of the rest, and what is left of the rest.

    ``longer`` is 1 for words looked up among those one shorter, whose lengths then decide the cut.
    """
    size = F.char_length("rest") - longer
    half = F.floor(size / 2).cast("int")
    tail = size - half

    def piece(mark: str, segment: Column, left: Column) -> Column:
        return F.struct(F.concat("key", F.lit("/"), size.cast("string"), F.lit(mark), segment).alias("key"), left.alias("rest"))

    first = piece("<", F.substr("rest", F.lit(1), half), F.substr("rest", half + 1))
    second = piece(">", F.right("rest", tail), F.left("rest", F.char_length("rest") - tail))
    return rows.select("word", F.explode(F.array(first, second)).alias("s")).select("s.key", "s.rest", "word")


def _met(index: DataFrame, probes: DataFrame, longer: int) -> DataFrame:
    """Pairs that share a key and differ by one edit in the rest."""
    other = probes.select("key", F.col("rest").alias("other_rest"), F.col("word").alias("other"))
    near = F.levenshtein(F.col("rest"), F.col("other_rest"), 1) == 1
    return index.join(other, "key").where(near if longer else near & (F.col("word") < F.col("other"))).select(F.col("word").alias("a"), F.col("other").alias("b"))


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, b: each pair of different words that one inserted, deleted or replaced code point makes equal, once."""
    start = words.select(F.lit("").alias("key"), F.col("word").alias("rest"), "word")
    sides, found = {0: start, 1: start}, []
    while True:
        index, probes = stored(_segments(sides[0], 0), "segments"), stored(_segments(sides[1], 1), "probes")
        many = stored(index.where(F.char_length("rest") > 1).groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
        few = index.join(many, "key", "left_anti")
        found += [_met(few, index, 0), _met(few, probes, 1)]
        if many.isEmpty():
            break
        sides = {0: index.join(many, "key", "left_semi"), 1: probes.join(many, "key", "left_semi")}
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last; every round follows twice as many at once."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """word, n -> word, form, root, n, n_near, form_n."""
    pairs = stored(near_pairs(words.select("word"), crowded), "near")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("b").alias("other"), "m")).alias("best"))
    joined = words.join(best, "word", "left")
    strong = F.col("best.m") >= ratio * F.col("n")
    table = stored(
        joined.select(
            "word",
            F.when(strong, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(table.where("form IS NOT NULL").select("word", "form"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among all words of the texts."""
    with small_batches(docs.sparkSession):
        words = stored(vocabulary(docs, drop_every, id_col=id_col, text_col=text_col), "vocabulary")
    return variants(words)
