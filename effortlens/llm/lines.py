"""Line dedup by a deletion-neighbourhood join.

A line is removed if an earlier line, by (id, line number), is equal to it or within one edit
(insertion, deletion or substitution of a character). Equal lines meet in an aggregate by hash.
For the rest every line emits its deletion variants as hashed keys and lines meet on equal
variants: two lines of one length that agree without their i-th character, or a line and the
variant of a longer one. Each line is paired with the earliest line it meets, the pair's edit
distance is verified on the texts, and the earliest stays.

A line of n characters has n variants, so two filters that lose nothing come first: lines within
one edit agree outside one half, and outside one of ``PARTS`` parts. Lines that share no half, and
parts no other line shares, emit nothing. A group of lines that differ in one place costs one row a
line, never a row a pair.

Defined cases: lines end at line feeds and are compared trimmed of ASCII white space; blank lines
are never removed; lines of fewer than ``min_chars`` characters must be equal; a null text has no
lines; rows with a null id come last in the order and, like rows of equal id, count as one document
each, in the order of a digest of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.linehash import Hasher, code_points, finished, line_spans, part_keys
from effortlens.llm.storage import stored
from effortlens.llm.wordhash import as_long, mix, text_runs

MIN_CHARS = 10
PARTS = 16
RUN_BYTES = 1 << 20
_SUB, _SHORT, _LONG = 0, 1, 2


def _runs(texts: pa.Array):
    """(first row, number of texts, code points, edges of the texts) of runs of texts."""
    for i, j, data, offsets in text_runs(texts, RUN_BYTES):
        raw = data[int(offsets[0]) : int(offsets[-1])]
        points = code_points(raw.tobytes().decode("utf-8", "surrogatepass"))
        leading = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        yield i, j - i, points, leading[offsets.astype(np.int64) - int(offsets[0])]


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text -> id, tie, no, h, g, keys (of the halves; none for short lines) of each line."""
        for batch in batches:
            for i, n, points, edges in _runs(batch.column(1)):
                text, number, start, end = line_spans(points, edges)
                one, two = Hasher.of(points), Hasher.of(points, 1)
                h, g = finished(one.span(start, end), end - start), finished(two.span(start, end), end - start)
                ties = finished(two.span(edges[:-1], edges[1:]), np.diff(edges))
                keys = part_keys(one, start, end, 2)
                long_enough = end - start >= min_chars
                offsets = np.concatenate([[0], np.cumsum(np.where(long_enough, 4, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(keys[long_enough].ravel())))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n).take(pa.array(text)),
                        pa.array(as_long(ties[text])),
                        pa.array(number.astype(np.int32)),
                        pa.array(as_long(h)),
                        pa.array(as_long(g)),
                        lists,
                    ],
                    ["id", "tie", "no", "h", "g", "keys"],
                )

    return rows


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> h, g, line."""
    for batch in batches:
        for _, _, points, edges in _runs(batch.column(0)):
            _, _, start, end = line_spans(points, edges)
            h = finished(Hasher.of(points).span(start, end), end - start)
            g = finished(Hasher.of(points, 1).span(start, end), end - start)
            raw = points.tobytes()
            lines = [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(start, end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(as_long(g)), pa.array(lines, pa.string())], ["h", "g", "line"])


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, line -> key, slot, h: a key for each part and length of partner."""
    for batch in batches:
        for h, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = code_points(line)
            keys = part_keys(Hasher.of(points), np.array([0]), np.array([len(points)]), PARTS)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(keys)), pa.array(np.arange(2 * PARTS, dtype=np.int32)), pa.array(np.full(2 * PARTS, h, dtype=np.int64))],
                ["key", "slot", "h"],
            )


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, g, line, slots -> bucket, role, h, g: the deletion variants inside the parts shared with other lines."""
    for batch in batches:
        for h, g, line, slots in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            points = code_points(line)
            n = len(points)
            sums = Hasher.of(points)
            at = [np.arange(0)]
            at_longer = [np.arange(0)]
            for slot in slots:
                side, j = divmod(slot, PARTS)
                m = n - side
                places = np.arange(j * m // PARTS, n - (m - (j + 1) * m // PARTS))
                (at_longer if side else at).append(places)
            at, at_longer = np.unique(np.concatenate(at)), np.unique(np.concatenate(at_longer))

            def without(i, sums=sums, n=n):
                zero = np.zeros(len(i), dtype=np.int64)
                head, tail = sums.span(zero, i), sums.sums[np.full(len(i), n)] - sums.sums[i + 1]
                return finished(head + tail * sums.inverse[1], np.full(len(i), n - 1))

            full = finished(sums.span(np.array([0]), np.array([n])), np.array([n]))
            buckets = [mix(without(at) + (at + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), full if len(at) else full[:0], np.unique(without(at_longer))]
            roles = np.repeat([_SUB, _SHORT, _LONG], [len(b) for b in buckets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(np.concatenate(buckets))), pa.array(roles), pa.array(np.full(len(roles), h)), pa.array(np.full(len(roles), g))],
                ["bucket", "role", "h", "g"],
            )


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines id, tie, no, h, g, keys; removed firsts h, g): every line, and those first lines that have an earlier near line."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = stored(texts.mapInArrow(_line_rows(min_chars), f"id {kind}, tie long, no int, h long, g long, keys array<long>"), "lines")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "tie", "no")
    firsts = lines.groupBy("h", "g").agg(F.min(place).alias("place"))

    halves = lines.select(F.explode("keys").alias("key"), "h")
    shared = stored(halves.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("key"), "halves")
    near = stored(halves.join(shared, "key", "left_semi").select("h").distinct(), "near")
    known = (
        texts.select("text")
        .mapInArrow(_line_texts, "h long, g long, line string")
        .join(near, "h", "left_semi")
        .dropDuplicates(["h", "g"])
        .join(firsts, ["h", "g"])
    )
    known = stored(known, "known")

    parts = known.select("h", "line").mapInArrow(_part_rows, "key long, slot int, h long")
    again = stored(parts.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("key"), "parts")
    slots = parts.join(again, "key", "left_semi").groupBy("h").agg(F.collect_set("slot").alias("slots"))
    variants = known.join(slots, "h").select("h", "g", "line", "slots").mapInArrow(_variant_rows, "bucket long, role int, h long, g long")
    met = stored(variants.join(known.select("h", "g", "place"), ["h", "g"]), "variants")

    # the earliest line of each kind in a bucket; a shorter line meets longer ones and the reverse
    earliest = met.groupBy("bucket", "role").agg(F.min(F.struct("place", "h", "g")).alias("first"))
    facing = F.when(F.col("role") == _SHORT, _LONG).when(F.col("role") == _LONG, _SHORT).otherwise(_SUB)
    earliest = earliest.select("bucket", facing.alias("role"), "first")
    pairs = (
        met.join(stored(earliest, "earliest"), ["bucket", "role"])
        .where("first.place < place")
        .select("h", "g", F.col("first.h").alias("eh"), F.col("first.g").alias("eg"))
        .distinct()
    )
    with_line = pairs.join(known.select("h", "g", "line"), ["h", "g"])
    other = known.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("line").alias("earlier"))
    verified = with_line.join(other, ["eh", "eg"]).where(F.levenshtein("line", "earlier", 1).between(0, 1))
    return lines, stored(verified.select("h", "g").distinct(), "removed")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that has lines: id, tie (digest of the text), n_lines, removed (sorted numbers of the lines to remove)."""
    lines, gone = line_table(docs, min_chars, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "tie", "no")
    firsts = stored(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times")), "firsts")
    # lines that occur once and have no near line stay; only the others are looked up
    marked = firsts.join(gone.withColumn("near", F.lit(True)), ["h", "g"], "left").where("times > 1 OR near")
    looked = lines.join(stored(marked, "marked"), ["h", "g"], "left")
    out = F.col("near") | (F.col("first") < place)
    rows = looked.select("id", "tie", F.when(out, F.col("no")).alias("no"))
    return rows.groupBy("id", "tie").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_set("no")).alias("removed")).withColumnRenamed("id", id_col)


def _tie_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, tie."""
    for batch in batches:
        for i, n, points, edges in _runs(batch.column(1)):
            ties = finished(Hasher.of(points, 1).span(edges[:-1], edges[1:]), np.diff(edges))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(as_long(ties))], ["id", "tie"])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_lines (not blank), n_removed, removed (sorted line numbers from 0)."""
    kind = docs.schema[id_col].dataType.simpleString()
    ties = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_tie_rows, f"id {kind}, tie long")
    # a row repeated with its text is one place twice over: it keeps or loses the same lines
    found = repeated_lines(docs, min_chars, id_col, text_col).withColumnRenamed(id_col, "f_id").withColumnRenamed("tie", "f_tie")
    copies = ties.groupBy("id", "tie").agg(F.count("*").alias("copies"))
    joined = copies.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")), "left")
    each = joined.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    none = F.array().cast("array<int>")
    removed = F.coalesce("removed", none)
    return each.select(
        F.col("id").alias(id_col),
        (F.coalesce("n_lines", F.lit(0)) / F.col("copies")).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed"),
    )


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, their texts without the repeated lines."""
    found = repeated_lines(docs, min_chars, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("tie").alias("_tie"), "removed")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).alias("_text"))
    tied = boxed.mapInArrow(_append_tie(1), f"_doc {boxed.schema['_doc'].dataType.simpleString()}, _text string, _own long")
    joined = tied.join(found, F.col(f"_doc.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tie")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.filter(F.split("_text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    out[text_col] = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("_text"))
    return joined.select(*[c.alias(name) for name, c in out.items()])


def _append_tie(text_at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ties = [
                finished(Hasher.of(points, 1).span(edges[:-1], edges[1:]), np.diff(edges)) for _, _, points, edges in _runs(batch.column(text_at))
            ]
            tie = as_long(np.concatenate(ties)) if ties else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tie)], [*batch.schema.names, "_own"])

    return rows
