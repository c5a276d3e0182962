"""Vector codes: four small codebooks fitted by k-means over all vectors, each assignment by Exponion search.

A component x becomes the integer floor(scale * x), a vector is cut into ``parts`` equal consecutive
parts, and a part is replaced by the index of the nearest entry of its codebook. An assignment does
not compare a part with every entry. It starts at the entry a of the round before and knows
u = d(part, a); an entry nearer than that, or as near, lies within 2 u of a by the triangle
inequality. The other entries are listed by their distance from a, so the search scans the head of
that list only, as far as d(a, entry)^2 <= 4 u^2. Distances are exact integers (in floating point
only where every sum stays below 2^53, in 64 bits below 2^63, else in unbounded integers) and ties
go to the lower index, so the result is that of comparing with all entries, bit for bit.

Spark holds the vectors in a table of the shared folder that a round rewrites with the entries it
found, so a lost executor costs a few tasks of one round. Tasks send sums and counts per entry and
component, at most parts * entries * width rows each; the books that come back have the same
bounded size whatever the number of vectors.

Defined cases: a vector that is null, or that holds null, NaN, an infinity or a component of 2^62 or
more after scaling, is dropped; a table without any other gives an empty result. Vectors are filled
up with zeros to the length of the longest, rounded up to a multiple of ``parts``; an empty vector
is all zeros. A first book has fewer entries if there are fewer vectors; vectors of equal id are
told apart by their components, null ids come last, repeated rows are repeated. An error or a sum of errors
beyond 63 bits is null. Labels of null are one label. Only the columns named are read, so others may have any
name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.storage import delete_folder, new_folder, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Labels up to this number are sent to all tasks with their sums; more are joined by shuffle.
MAX_BROADCAST_LABELS = 100_000
#: Vectors assigned at a time.
BLOCK = 8192
_LARGEST = float(2**62)


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector is there and all of its components are finite numbers that fit 63 bits when scaled."""
    fits = lambda x: F.coalesce(F.abs(x.cast("double")) * scale < _LARGEST, F.lit(False))  # noqa: E731  NaN is the largest number
    return F.coalesce(F.forall(vector, fits), F.lit(False))


def as_integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _kind(largest: int, width: int) -> type:
    """A type in which squared distances between parts with components up to ``largest`` are exact."""
    bound = width * (2 * largest + 1) ** 2
    if bound < 2**52:
        return np.float64
    return np.int64 if bound < 2**60 else object


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


class Book:
    """The entries of one part position, and for each of them all entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        kind = _kind(_largest(entries), width)
        c = entries.astype(kind)
        norm = (c * c).sum(axis=1)
        apart = norm[:, None] + norm[None, :] - 2 * c.dot(c.T)
        if kind is not object:
            apart = apart.astype(np.int64)
        index = np.broadcast_to(np.arange(k), (k, k))
        self.order = np.array([sorted(range(k), key=row.__getitem__) for row in apart]) if kind is object else np.lexsort((index, apart), axis=1)
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each part, searched from the entry ``start``."""
        k, width = self.entries.shape
        kind = _kind(max(_largest(x), _largest(self.entries)), width)
        exact = object if kind is object else np.int64
        at, c = x.astype(kind), self.entries.astype(kind)
        norm_x, norm_c = (at * at).sum(axis=1), (c * c).sum(axis=1)
        code, found = np.empty(len(x), np.int64), np.empty(len(x), exact)
        by_start = np.argsort(start, kind="stable")
        for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1):
            a = int(start[rows[0]])
            away = (norm_x[rows] + norm_c[a] - 2 * at[rows].dot(c[a])).astype(exact)
            reach = np.searchsorted(self.apart[a], 4 * away, side="right")
            # parts that scan about as far go together: at most twice as many entries as the radius asks for
            tier = np.ceil(np.log2(np.maximum(reach, 1))).astype(np.int64)
            for t in np.unique(tier):
                some = rows[tier == t]
                near = np.sort(self.order[a][: min(1 << int(t), k)])  # by index, so the first of equal ones is the lowest
                d = norm_x[some][:, None] + norm_c[near][None, :] - 2 * at[some].dot(c[near].T)
                best = d.argmin(axis=1)
                code[some], found[some] = near[best], d[np.arange(len(some)), best].astype(exact)
        return code, found


def _matrix(lists: pa.Array, length: int, scale: int) -> np.ndarray:
    """Scaled integers of a column of vectors, filled up with zeros."""
    sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = np.floor(lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    if (sizes == length).all():
        return flat.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _assigned(books: Broadcast, length: int, scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, label, vector, code -> the same with the entries now nearest, and the error of each."""
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = _matrix(part.column(2), length, scale)
                code = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1, 2)
                start = code[:, :, 0].astype(np.int64) * 256 + code[:, :, 1]
                width = length // len(books.value)
                total, now = np.zeros(part.num_rows, dtype=object), np.empty_like(start)
                for p, book in enumerate(books.value):
                    now[:, p], d = book.nearest(x[:, p * width : (p + 1) * width], start[:, p])
                    total = total + d.astype(object)
                packed = np.stack([now >> 8, now & 255], axis=2).astype(np.uint8).reshape(part.num_rows, -1)
                error = pa.array([e if e < 2**63 else None for e in total], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([r.tobytes() for r in packed], pa.binary()), error], ["id", "label", "vector", "code", "error"]
                )

    return rows


def _summed(parts: int, length: int, scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vector, code -> part, entry, at, total, n: what the vectors of a task add to each entry."""
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), length, scale)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts, 2)
            entry = code[:, :, 0].astype(np.int64) * 256 + code[:, :, 1]
            if _largest(x) * batch.num_rows >= 2**62:
                x = x.astype(object)
            width = length // parts
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                first = np.flatnonzero(np.diff(entry[order, p], prepend=-1))
                sums = np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                for e, s, n in zip(entry[order[first], p], sums, np.diff(first, append=len(order)), strict=True):
                    seen = totals.setdefault((p, int(e)), [0, np.zeros(width, dtype=object)])
                    seen[0] += int(n)
                    seen[1] = seen[1] + s.astype(object)
        keys = [(p, e, k, t, n) for (p, e), (n, total) in totals.items() for k, t in enumerate(total)]
        columns = list(zip(*keys, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "at", "total", "n"])

    return rows


def _renewed(books: list[np.ndarray], state: DataFrame, length: int, scale: int) -> list[np.ndarray]:
    """Each entry replaced by the componentwise floor of the mean of its parts; unused entries stay."""
    parts = len(books)
    rows = state.select("vector", "code").mapInArrow(_summed(parts, length, scale), "part int, entry int, at int, total decimal(38,0), n long")
    means = rows.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # parts * entries * width rows at most
    out = [b.copy() for b in books]
    for r in means:
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def fit(vectors: DataFrame, id_col: str, parts: int, entries: int, scale: int) -> tuple[list[np.ndarray], int]:
    """(first books, length of the vectors): the parts of the vectors of smallest id. ``vectors`` are usable."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    length = max(1, -(-longest // parts)) * parts
    ordered = vectors.orderBy(F.col(id_col).asc_nulls_last(), as_integers(F.col("vector"), scale)).limit(entries)
    seeds = [r[0] for r in ordered.select(as_integers(F.col("vector"), scale)).collect()]
    full = np.array([[*s, *[0] * (length - len(s))] for s in seeds], dtype=np.int64).reshape(len(seeds), length)
    return np.split(full, parts, axis=1), length


def encode(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error per usable vector; the final books).

    ``code`` has two bytes a part, the index of its entry; ``error`` is the squared distance summed
    over parts.
    """
    if not 0 < entries <= 1 << 16:
        raise ValueError("a book has 1 to 65536 entries")
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector"), scale))
    books, length = fit(kept, "id", parts, entries, scale)
    schema = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in ("id", "label", "vector")) + ", code binary, error long"
    # no round before the first: it starts at entry 0
    state, path = kept.withColumn("code", F.lit(bytes(2 * parts))), None
    if not len(books[0]):
        return state.select("id", "label", "code", F.lit(0).cast("long").alias("error")).limit(0), books
    for number in range(rounds + 1):
        sent = spark.sparkContext.broadcast([Book(b) for b in books])
        found = state.select("id", "label", "vector", "code").mapInArrow(_assigned(sent, length, scale), schema)
        before, path = path, new_folder(spark, "codes")
        with small_batches(spark):
            (found if number < rounds else found.drop("vector")).write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        if number < rounds:
            books = _renewed(books, state, length, scale)
    return state.select("id", "label", "code", "error"), books


def hex_code(code: Column) -> Column:
    """Two hex digits a part, for books of up to 256 entries."""
    return F.regexp_replace(F.lower(F.hex(code)), "00(..)", "$1")


def book_digits(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, in decimal, joined by commas."""
    return ",".join(str(int(v)) for book in books for v in functools.reduce(np.append, book, np.empty(0, np.int64)))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of its label summed; each task adds its own rows up first."""
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    few = totals.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    return coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
