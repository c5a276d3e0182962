"""Repeated edits and moved code: what makes a large commit cheaper than its lines.

Files are those of ``diffs.file_features``: the columns of the commit, file_no, filename, diff, added, deleted.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from effortlens.operators import diffs

# Words of a message that speak of moved code, of a new unit and of a plain move; the mark of edits that only differ in what is made equal.
MOVE = r"(?i)\b(move|rename|extract|split|reorganize|relocate|migrate|monorepo|workspace|refactor.*module)\b"
NEW_UNIT = r"(?i)\b(extract\s+(crate|package|library|workspace)|create\s+(new\s+)?(crate|package|module)|split\s+into)\b"
PLAIN_MOVE = r"(?i)\b(move|rename|relocate|reorganize)\b"
SYSTEMATIC = "<SYSTEMATIC>"

_SPACE = " \t\r\n\f\v"
#: Rows that a task gives out at once.
_ROWS = 10_000
#: So few targets of a commit are compared with each source.
_FEW = 16


_FORMS = [(re.compile(pattern, re.ASCII), replacement.replace("$", "\\")) for pattern, replacement in diffs.NORMAL]


def _normal(line: str) -> str:
    """``diffs.normal_line`` of one line, stripped."""
    for pattern, replacement in _FORMS:
        line = pattern.sub(replacement, line)
    return line.strip(_SPACE)


@lru_cache(maxsize=100_000)
def _pair(deleted: str, added: str) -> tuple[str, str] | None:
    """Two changed lines, with their signs, made equal; None if they are no pair. Lines that come back are made equal once."""
    deleted, added = deleted[1:], added[1:]
    if deleted.strip(_SPACE) == added.strip(_SPACE):
        return None
    deleted, added = _normal(deleted), _normal(added)
    return (deleted, SYSTEMATIC if deleted == added else added) if deleted or added else None


def _edits(diff: str) -> Counter:
    """(deleted, added) -> n of the diff of one file."""
    met, gone, come = Counter(), [], []
    lines = diff.split("\n")
    lines.append("")
    for line in lines:
        if line.startswith("+") and not line.startswith("+++"):
            come.append(line)
        elif line.startswith("-") and not line.startswith("---"):
            gone.append(line)
        elif gone or come:
            if gone and come:
                met.update(zip(gone, come, strict=False))
            gone, come = [], []
    pairs = Counter()
    for key, n in met.items():
        if pair := _pair(*key):
            pairs[pair] += n
    return pairs


def _pair_rows(files: DataFrame, outer: bool = False) -> DataFrame:
    """The columns of ``files`` but diff, with deleted, added and n of each pair; ``outer``: a row of nulls for files without pairs."""
    kept = [f for f in files.schema if f.name != "diff"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, diff in enumerate(batch.column("diff").to_pylist()):
                found = [(*pair, n) for pair, n in _edits(diff).items()] if diff else []
                found = found or [(None, None, None)] * outer
                at += [i] * len(found)
                rows += found
            taken = batch.select([f.name for f in kept]).take(pa.array(at, pa.int64()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*taken.schema.names, "deleted", "added", "n"])

    return files.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL("deleted string, added string, n long")]))


def edit_pairs(files: DataFrame, by: list[str]) -> DataFrame:
    """by, file_no, deleted, added, n: how often a deleted line stands against an added one, both made equal.

    The k-th deleted and the k-th added line of a run of changed lines are a pair, unless they differ
    in white space at their ends only or both become empty. Where both become equal, added is
    <SYSTEMATIC>. A null diff has no pairs; nothing is left out by length. A file is counted inside its row.
    """
    return _pair_rows(files.select(*by, "file_no", "diff"))


def pattern_support(files: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, deleted, added, n_files of the pairs that at least ``least`` files of the commit have."""
    return edit_pairs(files, by).groupBy(*by, "deleted", "added").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least)


def top_patterns(files: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The ``n`` pairs of a commit that most files have: rank and those of ``pattern_support``; ties by text."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n_files").desc(), "deleted", "added"))
    return pattern_support(files, by).withColumn("rank", rank).where(F.col("rank") <= n)


def pattern_coverage(files: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """by, file_no, added, deleted, coverage (share of the file's pairs that are repeated; 0 without pairs), patterned (half of them or more).

    The pairs are made once, and files without any stay among them; in a commit without a name nothing is repeated.
    """
    rows = _pair_rows(files.select(*by, "file_no", F.col("added").alias("n_added"), F.col("deleted").alias("n_deleted"), "diff"), outer=True)
    named = reduce(and_, [F.col(c).isNotNull() for c in by])
    repeated = F.count("*").over(Window.partitionBy(*by, "deleted", "added")) >= least
    shares = rows.withColumn("repeated", repeated).groupBy(*by, "file_no", "n_added", "n_deleted").agg(
        (F.sum(F.when(F.col("repeated"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")
    )
    coverage = F.coalesce(F.when(named, F.col("share")), F.lit(0.0))
    return shares.select(*by, "file_no", F.col("n_added").alias("added"), F.col("n_deleted").alias("deleted"), coverage.alias("coverage"), (coverage >= 0.5).alias("patterned"))


def bulk_edits(files: DataFrame, by: list[str]) -> DataFrame:
    """by, n_files, n_patterned, bulk_ratio, is_bulk: is the commit a batch of like edits?

    Below five files it is none. With more than 20 files, those of ten changed lines or fewer count as
    patterned. A commit is bulk if 30 % of its files or ten files are patterned; of others n_patterned is 0.
    """
    small = ~F.col("patterned") & (F.col("added") + F.col("deleted") <= 10)
    counted = pattern_coverage(files, by).groupBy(*by).agg(
        F.count("*").alias("n_files"), F.count_if("patterned").alias("n_found"), F.count_if(small).alias("n_small")
    )
    enough = F.col("n_files") >= 5
    n = F.when(enough, F.col("n_found") + F.when(F.col("n_files") > 20, F.col("n_small")).otherwise(0)).otherwise(0)
    counted = counted.withColumn("n", n).withColumn("bulk_ratio", F.col("n") / F.col("n_files"))
    bulk = enough & ((F.col("bulk_ratio") >= 0.3) | (F.col("n") >= 10))
    return counted.select(*by, "n_files", F.when(bulk, F.col("n")).otherwise(0).cast("long").alias("n_patterned"), "bulk_ratio", bulk.alias("is_bulk"))


def _content(diff: str, sign: str) -> set[str]:
    """Distinct stripped lines of more than three characters with ``sign``."""
    return {text for x in diff.split("\n") if x.startswith(sign) and not x.startswith(sign * 2) and len(text := x[1:].strip(_SPACE)) > 3}


def _overlaps(files: list[tuple]) -> list[tuple]:
    """(source, target, overlap) of the files (file_no, diff, added, deleted) of a commit, by source, largest overlap and target.

    Few targets are each compared. Of many, so many lines are shared that at least one is among the source's rarest: only those are looked
    up, and lines that stand in many files do not pair every file with every other. An overlap needs more than ten lines on both sides.
    """
    gone = [(no, diff) for no, diff, _, n in files if diff and (n or 0) > 5]
    come = [(no, diff) for no, diff, n, _ in files if diff and (n or 0) > 5]
    if not gone or not come:
        return []
    added = {no: lines for no, diff in come if len(lines := _content(diff, "+")) > 10}
    use = defaultdict(list)
    for no, lines in added.items() if len(added) > _FEW else ():
        for line in lines:
            use[line].append(no)
    found = []
    for no, diff in gone if added else ():
        lines = _content(diff, "-")
        needed = max(int(len(lines) * 0.4), 10) + 1
        if len(lines) >= needed:
            targets = added
            if len(added) > _FEW:
                rarest = sorted([use.get(line, ()) for line in lines], key=len)[: len(lines) - needed + 1]
                targets = set().union(*rarest)
            shared = [(target, len(lines & added[target])) for target in targets if target != no]
            found += [(no, target, n / len(lines)) for target, n in shared if n >= needed and n / len(lines) > 0.4]
    return sorted(found, key=lambda x: (x[0], -x[2], x[1]))


def _taken(files: list[tuple]) -> list[tuple]:
    """Of ``_overlaps``, the first target of each source that none before it took."""
    sources, targets, kept = set(), set(), []
    for source, target, overlap in _overlaps(files):
        if source not in sources and target not in targets:
            sources.add(source)
            targets.add(target)
            kept.append((source, target, overlap))
    return kept


def _each_commit(rows: DataFrame, by: list[str], fields: list[T.StructField], pick: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """by and ``fields``: what ``pick`` makes of the other columns of the rows of a commit, which stand together.

    A task reads its commits one after another, with one of them at a time in memory.
    """
    at = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = [], []

        def read() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = batch.schema.types[:at]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds + [None] * len(fields), strict=True)]
            columns[at:] = [c.cast(to_arrow_type(f.dataType)) for c, f in zip(columns[at:], fields, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*by, *(f.name for f in fields)])

        for key, group in groupby(read(), lambda row: row[:at]):
            out += [(*key, *x) for x in pick([row[at:] for row in group])]
            if len(out) >= _ROWS:
                yield made()
                out = []
        if out:
            yield made()

    return rows.select(*by, *[c for c in rows.columns if c not in by]).mapInArrow(run, T.StructType([*(rows.schema[c] for c in by), *fields]))


def _pairs_of(files: DataFrame, by: list[str], pick: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """by, source, target, overlap as ``pick`` finds them; the window puts the files of a commit together, where they are already by commit without a shuffle."""
    whole = Window.partitionBy(*by)
    rows = files.select(*by, "file_no", "diff", "added", "deleted").dropna(subset=by)
    rows = rows.withColumn("both", (F.max("deleted").over(whole) > 5) & (F.max("added").over(whole) > 5)).where("both").drop("both")
    no = files.schema["file_no"].dataType
    return _each_commit(rows, by, [T.StructField("source", no), T.StructField("target", no), T.StructField("overlap", T.DoubleType())], pick)


def move_overlaps(files: DataFrame, by: list[str]) -> DataFrame:
    """by, source, target, overlap: files of a commit where more than 40 % of the source's deleted lines, and more than ten, are added in the target."""
    return _pairs_of(files, by, _overlaps)


def move_pairs(files: DataFrame, by: list[str]) -> DataFrame:
    """by, source, target, overlap: in file order each source takes the target of the largest overlap that none before it took; ties by file order."""
    return _pairs_of(files, by, _taken)


def _summed(files: list[tuple]) -> list[tuple]:
    """The totals of a commit, which all of its files have, the number of its pairs and their mean overlap."""
    shares = [overlap for _, _, overlap in _taken([file[:4] for file in files])]
    return [(*files[0][4:], len(shares), sum(shares) / len(shares) if shares else 0.0)]


def moves(files: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """by, n_files, n_pairs, overlap (mean), is_move, move_type (null if none) of every commit of ``messages`` (by, message).

    A commit is looked at if its message speaks of a move or as many lines come as go (60 %), and is a
    move if files pair up, or by message and 70 %. A null message speaks of nothing; a commit without files is no move.
    Files are read once: totals and pairs come out of one pass by commit.
    """
    says = lambda pattern: F.coalesce(F.col("message").rlike(pattern), F.lit(False))
    ratio = F.when((F.col("come") > 0) & (F.col("gone") > 0), F.least("come", "gone") / F.greatest("come", "gone")).otherwise(0.0)
    asked = F.coalesce("named", F.lit(False)) | (ratio >= 0.6)
    whole = Window.partitionBy(*by)
    rated = (F.col("added") > 2) & (F.col("deleted") < 3) & F.col("filename").rlike(diffs.any_of(diffs.ARTEFACTS))
    rows = files.select(*by, "file_no", "diff", "added", "deleted", F.when(rated, 1).otherwise(0).alias("rated"))
    rows = rows.join(messages.where(says(MOVE)).select(*by, F.lit(True).alias("named")).distinct(), by, "left")
    rows = rows.withColumns({"n_files": F.count("*").over(whole), "come": F.sum("added").over(whole), "gone": F.sum("deleted").over(whole), "n_artefacts": F.sum("rated").over(whole)})
    totals = ("n_files", "come", "gone", "n_artefacts")
    fields = [*(T.StructField(c, T.LongType()) for c in (*totals, "n_pairs")), T.StructField("overlap", T.DoubleType())]
    rows = rows.select(*by, "file_no", F.when(asked, F.col("diff")).alias("diff"), "added", "deleted", *totals)
    seen = messages.select(*by, "message").withColumn("named", says(MOVE)).join(_each_commit(rows, by, fields, _summed), by, "left")
    all_ = seen.na.fill(0, [*totals, "n_pairs"]).na.fill(0.0, ["overlap"]).withColumn("ratio", ratio)
    asked = (F.col("n_files") > 0) & asked
    is_move = asked & ((F.col("n_pairs") > 0) | (F.col("named") & (F.col("ratio") > 0.7)))
    wide = F.col("n_files") > 15
    plain = (F.col("n_files") < 5) & (F.col("overlap") > 0.75) & says(PLAIN_MOVE)
    kind = F.when((F.col("n_artefacts") > 0) | (wide & says(NEW_UNIT)), "ARCHITECTURAL_EXTRACT").when(plain, "SIMPLE_MOVE").otherwise("MODULE_EXTRACT")
    return all_.select(*by, "n_files", "n_pairs", "overlap", is_move.alias("is_move"), F.when(is_move, kind).alias("move_type"))
