"""Edit-aware token counts: segment trees over pre-tokens, kept per document and updated by edits.

``build_trees`` encodes every text once and keeps the tree of its token counts, all levels of it.
``apply_edits`` takes a document, its tree and a list of edits and encodes again only the leaves
that an edit touches (and a neighbour where an edit spoils the cut between them), then renews the
sums above them, so a change of a few words in a very long text costs a few hundred characters.
Both are narrow: documents are never shuffled or gathered, and a few megabytes of text are held at
a time (a longer text alone).

Defined cases: a null text is empty and has no tokens; null edits are none; edits are applied in
the order of their start, positions are code points of the text before all edits, those that reach
beyond the text end with it and one that starts before the end of the one before it starts there;
repeated rows are counted one by one; an empty table gives an empty result. A very long text has
many leaves, except where it is one pre-token, such as letters without a break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.encoder import RUN_BYTES, encoder_for
from effortlens.llm.tokentree import TokenTree, all_levels, leaf_ends, leaf_texts
from effortlens.llm.wordhash import text_runs

TREE = "struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: int, end: int, inserted: string>>"


def _tree_array(chars: list[np.ndarray], tokens: list[np.ndarray]) -> pa.Array:
    """Trees as one struct array."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in chars])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32))) for x in (chars, tokens)]
    return pa.StructArray.from_arrays(lists, ["chars", "tokens"])


def _tree_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc, text -> doc, text, tree."""
        encoder = encoder_for(path)
        for batch in batches:
            for i, j, _, _ in text_runs(batch.column(1), RUN_BYTES):
                texts = batch.column(1).slice(i, j - i)
                ends, leaves = [], []
                for text in texts.to_pylist():
                    ends.append(leaf_ends(text or ""))
                    leaves += leaf_texts(text or "", ends[-1])
                counts = np.split(encoder.count(pa.array(leaves, pa.large_string())), np.cumsum([len(e) for e in ends])[:-1])
                del leaves
                chars = [all_levels(np.diff(e, prepend=0)) for e in ends]
                trees = _tree_array(chars, [all_levels(c) for c in counts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), texts, trees], ["doc", "text", "tree"])

    return rows


def build_trees(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """doc (struct of the other columns), text, tree (leaves of the segment tree)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tree_rows(tokenizer_path), f"doc {rows.schema['doc'].dataType.simpleString()}, text string, tree {TREE}")


def count_tokens(trees: DataFrame) -> DataFrame:
    """doc and n_tokens of each kept tree, from its root; texts are not read."""
    return trees.select("doc", F.coalesce(F.try_element_at("tree.tokens", F.lit(-1)), F.lit(0)).cast("long").alias("n_tokens"))


def _in_order(edits: list[dict], n: int) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for e in sorted(edits or (), key=lambda e: (e["start"], e["end"])):
        start = min(max(e["start"], at), n)
        end = min(max(e["end"], start), n)
        out.append((start, end, e["inserted"] or ""))
        at = end
    return out


def _edited_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc, text, tree, edits -> doc, text, tree, n_before, n_tokens, n_encoded (after the edits)."""
        encoder = encoder_for(path)
        for batch in batches:
            for i, j, _, _ in text_runs(batch.column(1), RUN_BYTES):
                part = batch.slice(i, j - i)
                before, trees = [], []
                old = part.column(2)
                for k, (text, edits) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    kept = old[k]
                    tree = TokenTree(text or "", kept["chars"].values.to_numpy(), kept["tokens"].values.to_numpy())
                    before.append(tree.n_tokens)
                    for start, end, inserted in reversed(_in_order(edits, len(tree.text))):
                        tree.edit(start, end, inserted, encoder.count_few)
                    trees.append(tree)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([t.text for t in trees], pa.string()),
                        _tree_array([t.chars for t in trees], [t.tokens for t in trees]),
                        pa.array(before, pa.int64()),
                        pa.array([t.n_tokens for t in trees], pa.int64()),
                        pa.array([t.encoded_chars for t in trees], pa.int64()),
                    ],
                    ["doc", "text", "tree", "n_before", "n_tokens", "n_encoded"],
                )

    return rows


def apply_edits(trees: DataFrame, edits: Column, tokenizer_path: str) -> DataFrame:
    """doc, text and tree after the edits, n_before, n_tokens, n_encoded (characters encoded again).

    ``edits`` is a column over ``trees``: array<struct(start, end, inserted)>.
    """
    rows = trees.select("doc", "text", "tree", edits.cast(EDITS).alias("edits"))
    doc = trees.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_edited_rows(tokenizer_path), f"doc {doc}, text string, tree {TREE}, n_before long, n_tokens long, n_encoded long")


def revision(text: Column) -> Column:
    """A fixed revision to try the counts on: a line in front, a replaced stretch in the middle, the last characters gone.

    Stretches are chosen by length alone, so they begin and end inside words. Texts of fewer than
    64 characters only get the line in front.
    """
    n = F.char_length(F.coalesce(text, F.lit("")))
    half = (n / 2).cast("int")

    def edit(start: Column, end: Column, inserted: str) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(inserted).alias("inserted"))

    front = edit(F.lit(0), F.lit(0), "Revised text.\n")
    more = F.array(front, edit(half, half + 20, "s and, later  on, the rest"), edit(n - 9, n, ""))
    return F.when(n < 64, F.array(front)).otherwise(more)
