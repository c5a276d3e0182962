"""Suffix-array dedup with a sparse array: suffixes at minimiser positions, sorted, neighbours compared, matches extended.

Suffixes are retained at content-selected positions only (minimisers of windows of ``min_words``/2
words), so every passage of ``min_words`` words holds one, at the same place in each copy. They are
range-partitioned and sorted by the hash of their first words; a suffix that equals neither
neighbour is dropped. Those left are extended, left to the suffix before and right to ``min_words``
words, and the extended matches are sorted and compared again: one whose run starts in a smaller
doc_id is removed as a whole. What heads a run is extended window by window in a last sort, so that
partial matches are found as well; there every distinct passage is present once.

A run of equal suffixes may be cut by the edge of a partition, so a passage in a third of all
documents is spread over many tasks; runs are mended across edges from two rows a partition.

A word is removed if a window of ``min_words`` words that covers it also occurs in a document of
smaller id. Defined cases: as in ``substrings``: a null or empty text has no words; shorter texts
lose nothing; repeats inside one document are left; rows that share a doc_id are neither earlier
nor later than each other; rows with a null doc_id lose nothing and are nobody's original; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm import wordhash
from effortlens.llm.storage import stored
from effortlens.llm.substrings import EMPTY_DIGEST, MIN_WORDS, anchor_rows, describe, packed_texts

_SALT = np.uint64(0x5851F42D4C957F2D)
_IDENT = "cast(conv(substring(digest, 1, 16), 16, -10) AS long)"


def _walk(n_keys: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (keys..., id, ...) -> the same, head (first id of the run), twin (equal to the row before or after), run0, edge, part.

        ``edge`` marks the first (1) and last (2) row of a partition, 3 if they are one.
        """
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # last row of the batch before, not yet emitted
        held_state: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            keys = np.stack([np.asarray(whole.column(k)) for k in range(n_keys)])
            ids = np.asarray(whole.column(n_keys))
            n = whole.num_rows
            same = np.zeros(n + 1, dtype=bool)  # same[i]: row i equals row i - 1
            same[1:n] = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
            before_same, head0, run0_first, first = held_state if held_state else (False, ids[0], True, True)
            start = np.maximum.accumulate(np.where(same[:n], 0, np.arange(n)))
            head = np.where(start == 0, head0, ids[start])
            run0 = (start == 0) & run0_first
            same[0] = before_same
            twin = same[:n] | same[1:]
            edge = np.zeros(n, dtype=np.int8)
            edge[0] = 1 if first else 0
            if n > 1:
                yield _marked(whole.slice(0, n - 1), head[:-1], twin[:-1], run0[:-1], edge[:-1], part)
            held = whole.slice(n - 1, 1)
            held_state = (bool(same[n - 1]), head[n - 1], bool(run0[n - 1]), bool(first and n == 1))
        if held is not None:
            before_same, head0, run0_first, first = held_state
            last = np.array([3 if first else 2], dtype=np.int8)
            yield _marked(held, np.array([head0]), np.array([before_same]), np.array([run0_first]), last, part)

    return rows


def _marked(batch: pa.RecordBatch, head, twin, run0, edge, part: int) -> pa.RecordBatch:
    more = [pa.array(head), pa.array(twin), pa.array(run0), pa.array(edge), pa.array(np.full(batch.num_rows, part, dtype=np.int32))]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "head", "twin", "run0", "edge", "part"])


def compare_neighbours(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (keys, id, pos, ...) with head (smallest id of those with equal keys) and twin (another row has equal keys).

    ``rows`` is read twice, once for the bounds of the ranges, and should be a stored table. Ids
    are longs without nulls.
    """
    order = [*keys, "id", "pos"]
    rest = [c for c in rows.columns if c not in (*keys, "id")]
    shaped = rows.select(*keys, "id", *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema)
    ordered = shaped.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = stored(ordered.mapInArrow(_walk(len(keys)), f"{schema}, head long, twin boolean, run0 boolean, edge byte, part int"), name)
    edges: dict[int, dict] = {}
    for row in walked.where("edge > 0").select(*keys, "head", "run0", "edge", "part").collect():  # two rows a partition
        for bit in (1, 2):
            if row["edge"] & bit:
                edges.setdefault(row["part"], {})[bit] = row
    fixes, carried = [], None
    for part in sorted(edges):
        first, last = edges[part].get(1), edges[part].get(2)
        last = last or first
        key = tuple(first[k] for k in keys)
        joined = carried is not None and carried[0] == key
        if joined:
            fixes.append((part, carried[1], True, False))
            fixes.append((carried[2], None, False, True))
        head = carried[1] if joined and last["run0"] else last["head"]
        carried = (tuple(last[k] for k in keys), head, part)
    if not fixes:
        return walked.drop("run0", "edge", "part")
    by_part: dict[int, list] = {}
    for part, head, front, back in fixes:
        was = by_part.setdefault(part, [None, False, False])
        by_part[part] = [head if head is not None else was[0], was[1] or front, was[2] or back]
    table = rows.sparkSession.createDataFrame([(p, *v) for p, v in by_part.items()], "f_part int, f_head long, f_front boolean, f_back boolean")
    fixed = walked.join(F.broadcast(table), F.col("part") == F.col("f_part"), "left")  # a row a partition at most
    at_front = F.coalesce("f_front", F.lit(False)) & F.col("run0")
    at_back = F.coalesce("f_back", F.lit(False)) & (F.col("edge") >= 2)
    return fixed.select(
        *keys, "id", *rest, F.when(at_front, F.col("f_head")).otherwise(F.col("head")).alias("head"), (F.col("twin") | at_front | at_back).alias("twin")
    )


def _word_hashes(z: bytes) -> np.ndarray:
    text = zlib.decompress(z)
    return wordhash.hash_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash


def _span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end of a text, from prefix sums of a polynomial."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * wordhash.powers(len(h)), out=sums[1:])
    return wordhash.mix((sums[end] - sums[start]) * wordhash.inverse_powers(len(h) + 1)[start] + (end - start).astype(np.uint64))


def _both_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    other = wordhash.mix(h ^ _SALT)
    return [pa.array(wordhash.as_long(_span_hashes(x, start, end))) for x in (h, other)]


def _extended_rows(width: int, inner: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, ident, z, at (sorted) -> h, g, id, ident, pos, until: each suffix with all windows that it is the first suffix of, pos <= start <= until."""
        for batch in batches:
            for k in range(batch.num_rows):
                h = _word_hashes(batch.column(2)[k].as_buffer().to_pybytes())
                at = np.asarray(batch.column(3)[k].values, dtype=np.int64)
                before = np.concatenate([[-1], at[:-1]])
                start = np.maximum(np.maximum(before + 1, at - (width - inner)), 0)
                until = np.minimum(at, len(h) - width)
                fits = start <= until
                start, until = start[fits], until[fits]
                if not len(start):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        *_both_hashes(h, start, until + width),
                        pa.repeat(batch.column(0)[k], len(start)),
                        pa.repeat(batch.column(1)[k], len(start)),
                        pa.array(start.astype(np.int32)),
                        pa.array(until.astype(np.int32)),
                    ],
                    ["h", "g", "id", "ident", "pos", "until"],
                )

    return rows


def _window_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, ident, z, spans (pos, until) -> h, g, id, ident, pos of each window of the spans."""
        for batch in batches:
            for k in range(batch.num_rows):
                h = _word_hashes(batch.column(2)[k].as_buffer().to_pybytes())
                spans = batch.column(3)[k].values
                first = np.asarray(spans.field(0), dtype=np.int64)
                count = np.asarray(spans.field(1), dtype=np.int64) - first + 1
                pos = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        *_both_hashes(h, pos, pos + width),
                        pa.repeat(batch.column(0)[k], len(pos)),
                        pa.repeat(batch.column(1)[k], len(pos)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["h", "g", "id", "ident", "pos"],
                )

    return rows


def _kept_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, ident, z, spans -> id, ident, n_removed, kept."""
        for batch in batches:
            removed, kept = [], []
            for k in range(batch.num_rows):
                words = zlib.decompress(batch.column(2)[k].as_buffer().to_pybytes()).split()
                spans = batch.column(3)[k].values
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, np.asarray(spans.field(0), dtype=np.int64), 1)
                np.add.at(steps, np.asarray(spans.field(1), dtype=np.int64) + width, -1)
                free = np.cumsum(steps[:-1]) == 0
                removed.append(int((~free).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(free)]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "ident", "n_removed", "kept"]
            )

    return rows


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_removed, kept (null if nothing was removed, else the words kept), kept_sha256. Ids are integers."""
    inner = (min_words + 1) // 2
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where(F.col("id").isNotNull())
    # texts equal in all their words: a copy is covered as a whole and takes no further part
    table = stored(texts.mapInArrow(describe, "id long, n_words long, digest string"), "texts")
    firsts = stored(table.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    originals = firsts.select(F.col("rep").alias("id"), F.expr(_IDENT).alias("ident"))

    suffixes = stored(known.mapInArrow(anchor_rows(inner, min_words - inner + 1), "h long, id long, ident long, pos int"), "suffixes")
    matched = compare_neighbours(suffixes.join(originals, ["id", "ident"], "left_semi"), ["h"], "suffix-array").where("twin")
    places = matched.groupBy("id", "ident").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    candidates = stored(
        known.mapInArrow(packed_texts, "id long, ident long, z binary").join(places, ["id", "ident"]).dropDuplicates(["id", "ident"]), "candidates"
    )

    spans = candidates.select("id", "ident", "z", "at").mapInArrow(
        _extended_rows(min_words, inner), "h long, g long, id long, ident long, pos int, until int"
    )
    extended = compare_neighbours(stored(spans, "extended"), ["h", "g"], "extended-array")
    whole = extended.where("head < id").select("id", "ident", "pos", "until")
    heads = extended.where("head = id").groupBy("id", "ident").agg(F.collect_set(F.struct("pos", "until")).alias("spans"))
    windows = (
        candidates.join(heads, ["id", "ident"])
        .select("id", "ident", "z", "spans")
        .mapInArrow(_window_rows(min_words), "h long, g long, id long, ident long, pos int")
    )
    single = compare_neighbours(stored(windows, "windows"), ["h", "g"], "window-array").where("head < id")

    covered = whole.union(single.select("id", "ident", "pos", "pos")).groupBy("id", "ident").agg(F.collect_set(F.struct("pos", "until")).alias("spans"))
    partial = (
        candidates.join(covered, ["id", "ident"])
        .select("id", "ident", "z", "spans")
        .mapInArrow(_kept_rows(min_words), "id long, ident long, n_removed long, kept string")
    )
    marked = table.join(firsts, "digest", "left").withColumn("ident", F.expr(_IDENT))
    gone = F.coalesce(F.col("id") > F.col("rep"), F.lit(False)) & (F.col("n_words") >= min_words)
    return marked.join(partial, ["id", "ident"], "left").select(
        F.col("id").cast(kind).alias(id_col),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.lit(EMPTY_DIGEST)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("digest"))).alias("kept_sha256"),
    )
