"""Benchmark decontamination [native]: a broadcast hash set of the benchmark's word windows.

Every benchmark item is cut into windows of ``width`` consecutive words (an item of fewer words is
one window). The set of their 64-bit hashes is a table of slots, built by an aggregate and handed to
all tasks as the result of a scalar subquery; each document hashes its own windows of the same
lengths, looks each up in its slot, verifies hits on the words themselves and reports what is hit.
Only Spark SQL functions are used, and the scan of the documents needs no shuffle: hit counts and
the verdict are computed inside the row. A benchmark whose windows pass ``max_broadcast_bytes``
(about a million windows) is not sent to all tasks; there hashes are joined by shuffle instead.

Defined cases: a null or wordless text has no words, no hits and is clean; a null or wordless item
has no windows; repeated rows (documents or items) are judged one by one, items of equal text are
all reported; null ids are carried (documents) or ignored in the list of items; an empty table
gives an empty or all-clean result. Only the columns named below are read, so further columns of
any name do no harm. A very long text costs its own hashes, 8 bytes a word and level of doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.storage import checkpointed, stored
from effortlens.llm.words import ITEM_BREAK, ascii_lower, covered, let, positions, split_words, window_hashes

#: Windows of more bytes than this are not sent to all tasks; documents and windows are joined by shuffle instead.
MAX_BROADCAST_BYTES = 128 << 20
#: Bytes that a window takes in the set beside its words.
SLOT_BYTES = 64
WIDTH = 13


def _gram(words: Column, pos: Column, width: int) -> Column:
    return F.concat_ws(" ", F.slice(words, pos, width))


def _gram_hash(gram: Column, width: int) -> Column:
    """The hash that ``window_hashes`` gives a window, from its words."""
    words = F.split(gram, " ")

    def pick(hashes: dict[int, Column]) -> Column:
        return F.coalesce(*[F.when(F.size(words) == w, F.element_at(hashes[w], 1)) for w in range(1, width + 1)])

    return window_hashes(words, list(range(1, width + 1)), pick)


def benchmark_windows(bench: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: gram, len, items (array of the ids that have it)."""
    words = bench.select(F.col(id_col).alias("item"), split_words(ascii_lower(F.col(text_col)), ITEM_BREAK).alias("words"))
    sized = words.select("item", "words", F.size("words").alias("n")).where("n > 0")
    starts = F.when(F.col("n") < width, F.array(F.lit(1))).otherwise(positions(F.col("n"), width))
    grams = sized.select(
        "item",
        F.least(F.col("n"), F.lit(width)).alias("len"),
        F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i, width)))).alias("gram"),
    )
    return grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


_HITS = "array<struct<pos:int,len:int,gram:string>>"


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), ITEM_BREAK)


def _spans(words: Column, starts: Column, width: int) -> Column:
    """array<struct(pos, len, gram)> of the windows at ``starts``."""
    return F.transform(
        starts, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("len"), _gram(words, i, width).alias("gram"))
    )


def _slot(h: Column, n_slots: int) -> Column:
    return F.pmod(h, F.lit(n_slots)).cast("int")


def _hits_of_length(words: Column, hashes: Column, width: int, n_slots: int) -> Column:
    """Hits among the windows of a width; ``_hashes`` and ``_grams`` are the slots of the set."""
    last = F.size(words) - width
    known = lambda h: F.array_contains(F.get("_hashes", _slot(h, n_slots)), h)
    found = F.transform(hashes, lambda h, i: F.when(known(h) & (i <= last), i + 1))
    same = lambda s: F.array_contains(F.get("_grams", _slot(F.element_at(hashes, s["pos"]), n_slots)), s["gram"])
    return F.filter(_spans(words, F.filter(found, lambda i: i.isNotNull()), width), same)


def _in_row(text: Column, lengths: list[int], n_slots: int, body) -> Column:
    """``body(words, hits)`` of a text, both computed once."""
    none = F.array().cast(_HITS)

    def found(words: Column) -> Column:
        if not lengths:
            return none
        hits = lambda hashes: F.array_sort(F.concat(none, *[_hits_of_length(words, hashes[w], w, n_slots) for w in lengths]))
        return window_hashes(words, lengths, hits)

    return let(_words(text), lambda words: let(found(words), lambda hits: body(words, hits)))


def _slots(hashed: DataFrame, n_slots: int) -> DataFrame:
    """One row: hashes and grams, arrays of ``n_slots`` arrays."""
    filled = hashed.groupBy(_slot(F.col("h"), n_slots).alias("slot")).agg(F.collect_list(F.struct("h", "gram")).alias("found"))
    every = hashed.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    table = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("found", F.array().cast("array<struct<h:long,gram:string>>")).alias("found")))).alias("t"))
    return checkpointed(table.select(F.transform("t", lambda x: x["found"]["h"]).alias("hashes"), F.transform("t", lambda x: x["found"]["gram"]).alias("grams")))


def _by_shuffle(docs: DataFrame, hashed: DataFrame, lengths: list[int], text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, _words and _hits, from a join of the hashes of all document windows with the benchmark's."""
    tokens = docs.select(*[F.col(c) for c in keep], _words(F.col(text_col)).alias("_words"), F.monotonically_increasing_id().alias("_row"))
    tokens = stored(tokens, "words")  # read twice, with one number a row
    none = F.array().cast("array<struct<pos:int,len:int,h:long>>")

    def of_width(hashes: Column, width: int) -> Column:
        valid = F.slice(hashes, 1, F.greatest(F.size("_words") - (width - 1), F.lit(0)))
        return F.transform(valid, lambda h, i: F.struct((i + 1).alias("pos"), F.lit(width).alias("len"), h.alias("h")))

    def windows(hashes: dict[int, Column]) -> Column:
        return F.concat(none, *[of_width(hashes[w], w) for w in lengths])

    spans = window_hashes(F.col("_words"), lengths, windows) if lengths else none
    hits = (
        tokens.select("_row", F.explode(spans).alias("s"))
        .select("_row", "s.*")
        .join(hashed.select("h", "len", "gram"), ["h", "len"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "len", "gram"))).alias("_met"))
    )
    joined = tokens.join(hits, "_row", "left")
    same = F.filter("_met", lambda s: _gram(F.col("_words"), s["pos"], s["len"]) == s["gram"])
    return joined.withColumn("_hits", F.coalesce(same, F.array().cast(_HITS))).drop("_row", "_met")


def judged(docs: DataFrame, bench: DataFrame, body, width: int, text_col: str, keep: list[str], max_broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(``keep`` columns and _found = ``body(words, hits)`` per document row, windows).

    Hits are array<struct(pos, len, gram)>, sorted.
    """
    windows = benchmark_windows(bench, width)
    hashed = checkpointed(windows.select("gram", "len", _gram_hash(F.col("gram"), width).alias("h")))
    by_length = hashed.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram")).alias("bytes")).collect()  # a row a length, ``width`` at most
    lengths, n = sorted(r["len"] for r in by_length), sum(r["n"] for r in by_length)
    kept = [F.col(c) for c in keep]
    if sum(r["bytes"] for r in by_length) + SLOT_BYTES * n > max_broadcast_bytes:
        rows = _by_shuffle(docs, hashed, lengths, text_col, keep)
        return rows.select(*kept, body(F.col("_words"), F.col("_hits")).alias("_found")), windows
    n_slots = 1 << max(n, 15).bit_length()
    table = _slots(hashed, n_slots)
    rows = docs.select(*kept, F.col(text_col).alias("_of"), table.select("hashes").scalar().alias("_hashes"), table.select("grams").scalar().alias("_grams"))
    return rows.select(*kept, _in_row(F.col("_of"), lengths, n_slots, body).alias("_found")), windows


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    width: int = WIDTH,
    numerator: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, items (sorted array), contaminated.

    A document is contaminated if it has a hit and ``numerator * n_hit >= n_words``.
    """

    def body(words: Column, hits: Column) -> Column:
        grams = F.array_distinct(F.transform(hits, lambda s: F.struct(s["gram"].alias("gram"), s["len"].alias("len"))))
        return F.struct(F.size(words).cast("long").alias("n_words"), covered(hits).cast("long").alias("n_hit"), grams.alias("grams"))

    rows, windows = judged(docs, bench, body, width, text_col, [id_col], max_broadcast_bytes)
    scored = rows.select(id_col, F.monotonically_increasing_id().alias("_row"), "_found.*")
    owners = windows.select("gram", "len", F.explode("items").alias("item"))
    listed = (
        scored.select(id_col, "_row", "n_words", "n_hit", F.explode_outer("grams").alias("g"))
        .select(id_col, "_row", "n_words", "n_hit", "g.gram", "g.len")
        .join(owners, ["gram", "len"], "left")
        .groupBy("_row", id_col, "n_words", "n_hit")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return listed.select(
        id_col, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * numerator >= F.col("n_words"))).alias("contaminated")
    )


def remove_contaminated(
    docs: DataFrame,
    bench: DataFrame,
    width: int = WIDTH,
    numerator: int = 20,
    text_col: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The documents that are not contaminated, with their own columns; no shuffle within the broadcast bound."""

    def clean(words: Column, hits: Column) -> Column:
        return let(covered(hits), lambda n: (n == 0) | (n * numerator < F.size(words)))

    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_text"))
    rows, _ = judged(boxed, bench, clean, width, "_text", ["_doc"], max_broadcast_bytes)
    return rows.where("_found").select("_doc.*")


def remove_spans(docs: DataFrame, bench: DataFrame, width: int = WIDTH, text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Documents with a column ``clean_text``: the normalised words that no benchmark window covers, joined by a space."""

    def rest(words: Column, hits: Column) -> Column:
        def step(acc, s):
            gap = F.slice(words, acc["next"], F.greatest(F.lit(0), s["pos"] - acc["next"]))
            return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["next"], s["pos"] + s["len"]).alias("next"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
        tail = lambda a: F.concat(a["out"], F.slice(words, a["next"], F.greatest(F.lit(0), F.size(words) - a["next"] + 1)))
        return F.concat_ws(" ", F.aggregate(hits, start, step, tail))

    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_text"))
    rows, _ = judged(boxed, bench, rest, width, "_text", ["_doc"], max_broadcast_bytes)
    return rows.select("_doc.*", F.col("_found").alias("clean_text"))
