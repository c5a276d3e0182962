"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, each range is written in ascending order, as one file or as
several, and a row holds doc_id, part (the number of its range), local_start (tokens before it in
its range), n_tokens and ids. Rows know their place in their range, so files may have any name and
size and readers may split them by stripe; a document's place in the corpus is that plus the tokens
of the ranges before, an aggregate over two narrow columns. A filter on doc_id skips stripes by
their statistics and Bloom filters.

Defined cases: a null text is empty and has the end id alone; null ids come first; repeated rows
are repeated, in the order of a hash of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effortlens.llm.encoder import RUN_BYTES, drop_encoders, encoder_for
from effortlens.llm.storage import new_folder, small_batches, stored
from effortlens.llm.wordhash import release_memory, text_runs

END_ID = 0
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
}


def _encoded(path: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, text in the order of the range -> doc_id, part, local_start, n_tokens, ids."""
        encoder = encoder_for(path)
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, _, _ in text_runs(batch.column(1), RUN_BYTES):
                lengths, tokens = encoder.encode(batch.column(1).slice(i, j - i))
                ends = np.cumsum(lengths + 1)
                ids = np.full(int(ends[-1]), end_id, dtype=np.int32)
                inside = np.ones(len(ids), dtype=bool)
                inside[ends - 1] = False
                ids[inside] = tokens
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.full(j - i, part, dtype=np.int32)),
                        pa.array(place + ends - lengths - 1),
                        pa.array(lengths + 1),
                        lists,
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                place += int(ends[-1])
            del batch
            release_memory()

    return rows


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the ids to ``folder`` in ascending order of id."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = ordered.mapInArrow(_encoded(tokenizer_path, end_id), f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>")
    with small_batches(docs.sparkSession):
        rows.write.options(**ORC_OPTIONS).orc(folder)


def read_tokens(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, part, local_start, n_tokens, ids; with ``ids`` only those documents, by metadata pruning."""
    rows = spark.read.orc(folder)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, local_start, n_tokens, ids -> the same with ids_crc32 for ids."""
    drop_encoders()
    for batch in batches:
        lists = batch.column(4)
        offsets = np.asarray(lists.offsets)
        ids = np.asarray(lists.values).astype("<u4")
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], [*batch.schema.names[:4], "ids_crc32"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    rows = spark.read.orc(folder)
    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = stored(rows.mapInArrow(_checksums, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long"), "sums")
    # one row a range, numbered in their order
    ranges = summed.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = ranges.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return summed.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files to the shared folder and index them."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return token_index(docs.sparkSession, folder)
