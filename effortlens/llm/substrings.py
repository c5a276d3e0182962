"""Substring dedup by level-wise doubling: only windows repeated at one length go on to twice that length.

Texts equal in all their words are one class, found first from a digest; a copy of an earlier
document is covered as a whole and takes no further part. Level one are windows of ``min_words``/2
words at content-selected positions (minimisers): every window of ``min_words`` words holds one of
them, at the same place in each of its copies, so nothing is lost, and one position in thirteen is
enough. Windows that occur in one text only are dropped. Level two are the windows of ``min_words``
words that hold a surviving one; of those that occur in more than one document, all but the
occurrences in the smallest doc_id are removed. No longer window can add to what these cover, so
the levels end there.

Counts are aggregates by window hash with map-side combining; joins are plain equi-joins, which
adaptive execution splits where a passage is frequent. Python only turns texts into hashes and
spans into digests, a few megabytes at a time.

Defined cases: words are split at ASCII white space; a null or empty text has no words; documents
with fewer than ``min_words`` words lose nothing; repeats inside one document are left; rows that
share a doc_id are neither earlier nor later than each other; rows with a null doc_id lose nothing
and are nobody's original; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm import wordhash
from effortlens.llm.storage import stored

MIN_WORDS = 50
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _ident(digest: str) -> int:
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


def _digest(text: bytes) -> tuple[int, str]:
    words = text.split()  # of bytes: at ASCII white space
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, n_words, digest of the words."""
    for batch in batches:
        found = [_digest(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())],
            ["id", "n_words", "digest"],
        )


def anchor_rows(width: int, span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text -> h, id, ident, pos of the windows at selected positions."""
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in wordhash.text_runs(batch.column(1)):
                words = wordhash.hash_words(data, offsets)
                h, pos, doc, ident = [], [], [], []
                for k in range(j - i):
                    a, b = words.first[k], words.first[k + 1]
                    if b - a < width + span - 1:
                        continue
                    own = wordhash.window_hashes(words.hash[a:b], width)
                    at = wordhash.minimisers(own, span)
                    h.append(own[at])
                    pos.append(at)
                    doc.append(np.full(len(at), i + k))
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    ident.append(np.full(len(at), _ident(_digest(text)[1]), dtype=np.int64))
                if not h:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wordhash.as_long(np.concatenate(h))),
                        ids.take(pa.array(np.concatenate(doc))),
                        pa.array(np.concatenate(ident)),
                        pa.array(np.concatenate(pos).astype(np.int32)),
                    ],
                    ["h", "id", "ident", "pos"],
                )

    return rows


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, ident, z: the words joined by a space, compressed."""
    for batch in batches:
        ident, packed = [], []
        for t in batch.column(1).cast(pa.binary()):
            words = b" ".join((t.as_buffer().to_pybytes() if t.is_valid else b"").split())
            ident.append(_ident(hashlib.sha256(words).hexdigest()))
            packed.append(zlib.compress(words, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ident, pa.int64()), pa.array(packed, pa.binary())], ["id", "ident", "z"]
        )


def _word_hashes(z: bytes) -> np.ndarray:
    text = zlib.decompress(z)
    return wordhash.hash_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash


def _window_rows(width: int, inner: int):
    reach = np.arange(inner - width, 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, ident, z, at -> h, g (two hashes), id, ident, pos of the windows that hold a window at ``at``."""
        for batch in batches:
            for k in range(batch.num_rows):
                h = _word_hashes(batch.column(2)[k].as_buffer().to_pybytes())
                at = np.asarray(batch.column(3)[k].values, dtype=np.int64)
                pos = np.unique(at[:, None] + reach)
                pos = pos[(pos >= 0) & (pos <= len(h) - width)]
                if not len(pos):
                    continue
                one = wordhash.window_hashes(h, width)[pos]
                two = wordhash.window_hashes(wordhash.mix(h ^ np.uint64(0x5851F42D4C957F2D)), width)[pos]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wordhash.as_long(one)),
                        pa.array(wordhash.as_long(two)),
                        pa.repeat(batch.column(0)[k], len(pos)),
                        pa.repeat(batch.column(1)[k], len(pos)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["h", "g", "id", "ident", "pos"],
                )

    return rows


def _kept_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, ident, z, at -> id, ident, n_removed, kept: the words that no window at ``at`` covers."""
        for batch in batches:
            removed, kept = [], []
            for k in range(batch.num_rows):
                words = zlib.decompress(batch.column(2)[k].as_buffer().to_pybytes()).split()
                at = np.asarray(batch.column(3)[k].values, dtype=np.int64)
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + width, -1)
                free = np.cumsum(steps[:-1]) == 0
                removed.append(int((~free).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(free)]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "ident", "n_removed", "kept"],
            )

    return rows


def repeated(rows: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys that occur with two owners or more, with the smallest owner as ``first_owner``."""
    counted = rows.groupBy(*keys).agg(F.min(owner).alias("first_owner"), F.max(owner).alias("_last"))
    return counted.where("first_owner < _last").drop("_last")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_removed, kept (null if nothing was removed, else the words kept), kept_sha256.

    A word is removed if a window of ``min_words`` words that covers it also occurs in a document
    of smaller id.
    """
    inner = (min_words + 1) // 2
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = texts.where(F.col("id").isNotNull())
    table = stored(texts.mapInArrow(describe, f"id {kind}, n_words long, digest string"), "texts")
    firsts = stored(table.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "classes")

    anchors = known.mapInArrow(anchor_rows(inner, min_words - inner + 1), f"h long, id {kind}, ident long, pos int")
    again = stored(repeated(anchors, ["h"], "ident").select("h"), "level-1")
    places = anchors.join(again, "h", "left_semi").groupBy("id", "ident").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    originals = firsts.select(F.col("rep").alias("id"), F.expr("cast(conv(substring(digest, 1, 16), 16, -10) AS long)").alias("ident"))
    candidates = stored(
        known.mapInArrow(packed_texts, f"id {kind}, ident long, z binary")
        .join(places.join(originals, ["id", "ident"], "left_semi"), ["id", "ident"])
        .dropDuplicates(["id", "ident"]),
        "candidates",
    )

    windows = candidates.select("id", "ident", "z", "at").mapInArrow(
        _window_rows(min_words, inner), f"h long, g long, id {kind}, ident long, pos int"
    )
    twice = stored(repeated(windows, ["h", "g"], "id"), "level-2")
    covered = windows.join(twice, ["h", "g"]).where("id > first_owner").groupBy("id", "ident").agg(F.collect_set("pos").alias("spans"))
    partial = (
        candidates.join(covered, ["id", "ident"])
        .select("id", "ident", "z", "spans")
        .mapInArrow(_kept_rows(min_words), f"id {kind}, ident long, n_removed long, kept string")
    )

    whole = table.join(firsts, "digest", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("rep"), F.lit(False)))
    whole = whole.withColumn("ident", F.expr("cast(conv(substring(digest, 1, 16), 16, -10) AS long)"))
    joined = whole.join(partial, ["id", "ident"], "left")
    gone = F.col("copy") & (F.col("n_words") >= min_words)
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.lit(EMPTY_DIGEST)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("digest"))).alias("kept_sha256"),
    )
