"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Sources share the words of the whole input by weight. A source is clamped at ``max_epochs`` times
its size and what it cannot take is shared again among the rest by weight, until no source is
above its cap. All that a round needs is one number, the level (words per unit of weight), so a
round is one aggregate over the table of sources.

A source then takes every document ``whole`` times, and once more the documents that come first in
an order seeded by hash, until the rest of its target is used up; the document in which that point
lies gives its leading words only. The point is found from sums by hash prefix and one small
window, so the documents themselves are neither sorted nor shuffled.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; rows that share a doc_id share their place in the order and divide the cut between
them in proportion to size, rounded down; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effortlens.llm.storage import checkpointed
from effortlens.llm.words import SPACE, split_words

#: With more sources than this the plan is not sent to all tasks.
MAX_BROADCAST_SOURCES = 100_000
#: Rows of a source in one hash bin, about.
BIN_ROWS = 256


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def word_count(text: Column) -> Column:
    return F.size(split_words(text, SPACE)).cast("long")


def water_level(sources: DataFrame, total: int, max_epochs: int) -> float:
    """Words per unit of weight at which clamped and free sources together take ``total``.

    ``sources`` has source_size and weight.
    """
    cap, level = F.col("source_size") * max_epochs, 0.0
    while True:
        clamped = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0)).alias("cap"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            return level
        risen = (total - row["cap"]) / float(row["weight"])
        if risen <= level:
            return level
        level = risen


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Per source: source, source_size, target, whole, cut_key, cut_rest, cut_size.

    ``sized`` has source, size and key. Keys below cut_key are taken once more in full, cut_key
    itself gives cut_rest of its cut_size words.
    """
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    # one row a source, so the order over all of them stays small
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = checkpointed(totals.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int"))))
    summary = sources.agg(F.sum("source_size").alias("total"), F.max("n_rows").alias("most")).first()
    level = water_level(sources, summary["total"] or 0, max_epochs)
    target = F.least((F.col("source_size") * max_epochs).cast("double"), F.lit(level) * F.col("weight"))
    planned = sources.select("source", "source_size", target.alias("target")).withColumns(
        {"whole": F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")}
    )
    planned = planned.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    # a rest that rounds up to the whole source is one repetition more
    full = (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size"))
    planned = planned.withColumns(
        {"whole": F.col("whole") + full.cast("long"), "rest": F.when(full, F.col("rest") - F.col("source_size")).otherwise(F.col("rest"))}
    )

    digits = max(1, math.ceil(math.log((summary["most"] or 1) / BIN_ROWS + 1, 16)))
    in_bin = F.substring("key", 1, digits)
    bins = sized.groupBy("source", in_bin.alias("bin")).agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("bin_size").over(upto) - F.col("bin_size"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    chosen = (
        planned.withColumnRenamed("source", "p_source")
        .join(bins, same("p_source", "source"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bin_size")))
        .select("p_source", F.col("bin").alias("p_bin"), (F.col("rest") - F.col("before")).alias("left"))
    )
    keys = (
        sized.join(_small(chosen), same("source", "p_source") & (in_bin == F.col("p_bin")))
        .groupBy("source", "key", "left")
        .agg(F.sum("size").alias("cut_size"))
        .withColumn("below", F.sum("cut_size").over(Window.partitionBy("source").orderBy("key")) - F.col("cut_size"))
        .where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("cut_size")))
        .select(F.col("source").alias("k_source"), F.col("key").alias("cut_key"), (F.col("left") - F.col("below")).alias("cut_rest"), "cut_size")
    )
    return checkpointed(planned.join(keys, same("source", "k_source"), "left").drop("k_source", "rest"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES else plan


def extra_words(key: Column, size: Column) -> Column:
    """Words of the fractional repetition that a document gives; needs the columns of the plan."""
    share = F.floor(F.try_divide(F.col("cut_rest") * size, F.col("cut_size")))
    return F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), share).otherwise(0).cast("long")


def apportion(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: id, size, source_size, target, taken (words in the mix, repeats counted)."""
    sized = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            order_key(F.col(id_col), seed).alias("key"),
        )
    )
    plan = mixing_plan(sized, weights, max_epochs).withColumnRenamed("source", "p_source")
    taken = F.col("whole") * F.col("size") + extra_words(F.col("key"), F.col("size"))
    joined = sized.join(_small(plan), F.col("source").eqNullSafe(F.col("p_source")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    n_chars_col: str | None = None,
) -> DataFrame:
    """The mixed documents: each row as often as its source takes it, with its own columns.

    Where a copy is cut its text is the leading words joined by a space, and ``n_chars_col``, if
    named, is counted again. Texts are scanned once and never shuffled.
    """
    size = word_count(F.col(text_col))
    sized = checkpointed(
        docs.select(F.col(source_col).alias("source"), size.alias("size"), order_key(F.col(id_col), seed).alias("key"))
    )
    plan = mixing_plan(sized, weights, max_epochs).withColumnRenamed("source", "p_source")
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(source_col).alias("_source"),
        F.col(text_col).alias("_text"),
        order_key(F.col(id_col), seed).alias("_key"),
    ).join(_small(plan), F.col("_source").eqNullSafe(F.col("p_source")))
    at_cut = F.coalesce(F.col("_key") == F.col("cut_key"), F.lit(False))
    words = split_words(F.col("_text"), SPACE)
    cut = F.when(at_cut, F.slice(words, 1, extra_words(F.col("_key"), F.size(words).cast("long")).cast("int")))
    once_more = (F.col("_key") < F.col("cut_key")) | (at_cut & (F.size(cut) > 0))
    copies = F.sequence(F.lit(1), (F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")).cast("int"))
    none = F.array().cast("array<int>")
    n_copies = F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")
    rows = boxed.withColumn("_cut", F.concat_ws(" ", cut)).select(
        "_doc", "_cut", at_cut.alias("_at_cut"), "whole", F.explode(F.when(n_copies > 0, copies).otherwise(none)).alias("_copy")
    )
    shortened = F.col("_at_cut") & (F.col("_copy") > F.col("whole"))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    out[text_col] = F.when(shortened, F.col("_cut")).otherwise(out[text_col])
    if n_chars_col:
        out[n_chars_col] = F.when(shortened, F.char_length("_cut").cast("long")).otherwise(out[n_chars_col])
    return rows.select(*[c.alias(name) for name, c in out.items()])
