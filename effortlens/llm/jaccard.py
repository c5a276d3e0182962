"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct word 5-grams. Documents of equal sets are one node. Each
node's grams are ordered from rare to frequent, by a frequency sketch of all grams of the corpus
(a fixed number of counters, so what is broadcast never grows) and then by hash; any order is
correct, this one keeps frequent grams out of the prefixes. Two sets of Jaccard similarity t or
more share a gram within the first n - ceil(t n) + 1 of both orders. Prefix grams that occur once
are dropped by an aggregate before anything is joined.

The rest meet by gram, in ``links``: first each node with one centre per gram, then, between the
components so found, only sets whose sizes and places of the gram leave a similarity of t possible.
Each pair is verified once, with the suffix filter before the sets are intersected. Components are
exact, and neither near copies nor texts of one template are compared in all pairs.

Defined cases: words are split at ASCII white space after lower-casing A-Z; a text of fewer than
``width`` words is one gram, its whole sequence; a text without words and a null text are linked
with nothing; rows of equal id are rows of their own; a null id takes part in links but is never a
component id unless the component has no other; texts of any length are hashed in blocks; an empty
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
from effortlens.llm.links import linked, relabelled
from effortlens.llm.storage import stored

WIDTH = 5
PERCENT = 80
#: Counters of the frequency sketch (4 bytes each) and how many of them travel in one row.
SKETCH = 1 << 20
SKETCH_BLOCK = 1 << 16
#: Type of a node id, a digest of 128 bits; sets of equal digest are one node.
NODE = "binary"


def _gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts as (text number, hash), sorted by both."""
    words = wordhash.hash_words(data, offsets, lower=True)
    grams = wordhash.window_hashes(words.hash, width)
    whole = words.doc[: len(grams)] == words.doc[width - 1 :] if len(grams) else np.empty(0, bool)
    doc, h = words.doc[: len(grams)][whole], grams[whole]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        own = [wordhash.window_hashes(words.hash[words.first[k] : words.first[k + 1]], int(sizes[k]))[0] for k in short]
        tag = wordhash.mix(np.array(own, dtype=np.uint64) + sizes[short].astype(np.uint64))  # apart from longer grams
        doc, h = np.concatenate([doc, short]), np.concatenate([h, tag])
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _node_ids(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, node ids of two 64-bit halves a row) of the texts; a node id is a digest of the set."""
    n = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(n)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    halves = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        np.cumsum(wordhash.mix(h ^ np.uint64(salt)), out=sums[1:])
        total = sums[ends] - sums[ends - n]
        halves.append(wordhash.mix(total * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)))
    return n, np.stack(halves, axis=1)


def _as_nodes(node: np.ndarray) -> pa.Array:
    raw = pa.py_buffer(np.ascontiguousarray(node).tobytes())
    return pa.Array.from_buffers(pa.binary(16), len(node), [None, raw]).cast(pa.binary())


def _profile(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text -> id, n, node per text; and at the end block, salt, counts of the sketch."""
        sketch = np.zeros(SKETCH, dtype=np.uint32)
        kind = None
        for batch in batches:
            ids, kind = batch.column(0), batch.column(0).type
            for i, j, data, offsets in wordhash.text_runs(batch.column(1)):
                doc, h = _gram_sets(data, offsets, width)
                n, node = _node_ids(doc, h, j - i)
                sketch += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                none = pa.nulls(j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), _as_nodes(node), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())],
                    ["id", "n", "node", "block", "salt", "counts"],
                )
        if kind is None:
            return
        wordhash.release_memory()
        blocks = range(0, SKETCH, SKETCH_BLOCK)
        empty = pa.nulls(len(blocks))
        salt = TaskContext.get().partitionId() // 512
        yield pa.RecordBatch.from_arrays(
            [
                empty.cast(kind),
                empty.cast(pa.int64()),
                empty.cast(pa.binary()),
                pa.array([b // SKETCH_BLOCK for b in blocks], pa.int32()),
                pa.array([salt] * len(blocks), pa.int32()),
                pa.array([zlib.compress(sketch[b : b + SKETCH_BLOCK].tobytes(), 1) for b in blocks], pa.binary()),
            ],
            ["id", "n", "node", "block", "salt", "counts"],
        )

    return rows


def _added(keys: list[str]):
    def total(table: pa.Table) -> pa.Table:
        """One row per group: the sum of its blocks of counters, saturated."""
        counts = np.zeros(SKETCH_BLOCK, dtype=np.uint64)
        for z in table.column("counts"):
            counts += np.frombuffer(zlib.decompress(z.as_buffer().to_pybytes()), dtype=np.uint32)
        packed = zlib.compress(np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return table.slice(0, 1).select(keys).append_column("counts", pa.array([packed], pa.binary()))

    return total


def frequency_ranks(profile: DataFrame) -> np.ndarray:
    """Frequency of each sketch counter on a log scale (one byte each), summed in two steps."""
    blocks = profile.where("block IS NOT NULL").select("block", "salt", "counts")
    some = blocks.groupBy("block", "salt").applyInArrow(_added(["block", "salt"]), "block int, salt int, counts binary")
    rows = some.groupBy("block").applyInArrow(_added(["block"]), "block int, counts binary").collect()  # SKETCH / SKETCH_BLOCK rows
    counts = np.zeros(SKETCH, dtype=np.float64)
    for row in rows:
        at = row["block"] * SKETCH_BLOCK
        counts[at : at + SKETCH_BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return np.floor(np.log2(counts + 1) * 7).astype(np.uint8)


def _prefix_rows(width: int, percent: int, ranks):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> gram, node, n, pos of the prefix grams."""
        rank = ranks.value
        for batch in batches:
            for i, j, data, offsets in wordhash.text_runs(batch.column(0)):
                doc, h = _gram_sets(data, offsets, width)
                n, node = _node_ids(doc, h, j - i)
                order = np.argsort(rank[(h % np.uint64(SKETCH)).astype(np.int64)], kind="stable")
                order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
                first = np.cumsum(n) - n
                pos = np.arange(len(h)) - first[doc]
                use = pos <= (n - (percent * n + 99) // 100)[doc]
                doc, pos = doc[use], pos[use]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wordhash.as_long(h[order][use])),
                        _as_nodes(node[doc]),
                        pa.array(n[doc].astype(np.int32)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    ["gram", "node", "n", "pos"],
                )
        wordhash.release_memory()

    return rows


def _packed_sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> node, z: the words joined by a space, compressed."""
        for batch in batches:
            for i, j, data, offsets in wordhash.text_runs(batch.column(0)):
                doc, h = _gram_sets(data, offsets, width)
                n, node = _node_ids(doc, h, j - i)
                some = np.flatnonzero(n)
                z = [zlib.compress(b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split()), 1) for k in some]
                yield pa.RecordBatch.from_arrays([_as_nodes(node[some]), pa.array(z, pa.binary())], ["node", "z"])
        wordhash.release_memory()

    return rows


def _grams_of(z: bytes, width: int) -> np.ndarray:
    text = np.frombuffer(zlib.decompress(z), np.uint8)
    return _gram_sets(text, np.array([0, len(text)]), width)[1]


def _suffix_bound(a: np.ndarray, b: np.ndarray, parts: int = 16) -> int:
    """Upper bound of the overlap: grams split into ranges by hash can only meet within a range."""
    edges = (np.arange(1, parts, dtype=np.uint64)) * np.uint64(2**64 // parts)
    in_a = np.diff(np.searchsorted(a, edges), prepend=0, append=len(a))
    in_b = np.diff(np.searchsorted(b, edges), prepend=0, append=len(b))
    return int(np.minimum(in_a, in_b).sum())


def _verified(width: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, za, zb -> a, b of the pairs that are similar."""
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            keep = []
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (a, b) in enumerate(zip(left, right, strict=True)):
                for node, column in ((a, 2), (b, 3)):
                    if node not in known:
                        if len(known) > 256:
                            known.clear()
                        known[node] = _grams_of(batch.column(column)[k].as_buffer().to_pybytes(), width)
                x = known[a] if a in known else _grams_of(batch.column(2)[k].as_buffer().to_pybytes(), width)
                y = known[b]
                needed = -(-percent * (len(x) + len(y)) // (100 + percent))
                if _suffix_bound(x, y) < needed:
                    continue
                if len(np.intersect1d(x, y, assume_unique=True)) >= needed:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return rows


def _similar(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return with_b.select("a", "b", "za", "zb").mapInArrow(_verified(width, percent), f"a {NODE}, b {NODE}")


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows id, n, node; nodes node, label): nodes of one label are linked, nodes not listed are alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profile = stored(
        texts.mapInArrow(_profile(width), f"id {kind}, n long, node {NODE}, block int, salt int, counts binary"), "profile"
    )
    members = profile.where("block IS NULL").select("id", "n", "node")
    ranks = docs.sparkSession.sparkContext.broadcast(frequency_ranks(profile))

    prefixes = texts.select("text").mapInArrow(_prefix_rows(width, percent, ranks), f"gram long, node {NODE}, n int, pos int")
    again = stored(prefixes.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    shared = stored(prefixes.join(again, "gram", "left_semi").distinct(), "shared")

    several = shared.groupBy("gram").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("gram")
    shared = stored(shared.join(several, "gram", "left_semi"), "shared")
    # how many rarer grams stand before the first that is shared, and how many are shared
    nodes = stored(shared.groupBy("node").agg(F.min("pos").alias("lead"), F.count("*").alias("n_shared")), "nodes")
    shared = stored(shared.join(nodes, "node"), "led")
    packed = texts.select("text").mapInArrow(_packed_sets(width), f"node {NODE}, z binary")
    # equal sets are made one before they are shuffled: a set may have any number of copies
    sets = stored(packed.dropDuplicates(["node"]).join(nodes.select("node"), "node", "left_semi"), "sets")

    labels = linked(shared, lambda pairs: _similar(pairs, sets, width, percent), percent)
    return members, labels


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_shingles, component_id (smallest id reachable by links)."""
    members, labels = link_components(docs, width, percent, id_col, text_col)
    marked = relabelled(members, labels)
    smallest = marked.where("n > 0").groupBy("label").agg(F.min("id").alias("component_id"))
    found = marked.join(smallest, (marked["label"] == smallest["label"]) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, however far, to one of smaller id.

    Rows that share an id stay or go together; rows with a null id stay. Only the ids that go are
    joined with the documents, so the side that may be broadcast is as small as it can be.
    """
    found = components(docs, width, percent, id_col, text_col)
    gone = stored(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")), "gone")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"))
    return boxed.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_doc.*")
