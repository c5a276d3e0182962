"""Semantic clusters of a commit's files: by directory and role, small ones merged by path, at most fifteen.

Files are summed up to clusters by Spark; what is merged per commit is one row a cluster. Merging
goes through a commit's clusters in the order of their first files. A cluster of fewer than three
files joins the one whose directory agrees with its own in most places; who finds none then finds
none later, as clusters only grow or go, so each is looked at once, against all others as one matrix.
Then the smallest joins the next smallest until fifteen are left, by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLUSTERS, MIN_FILES, MAX_FILES = 15, 3, 30
# Folders left out at the start of a path, and roles by a part of the file name, in this order.
ROOTS = ("src", "app", "apps", "lib", "packages")
ROLES = {
    ".service": "services", ".repository": "repositories", ".controller": "controllers", ".resolver": "resolvers", ".guard": "guards",
    ".middleware": "middleware", ".module": "modules", ".dto": "dtos", ".entity": "entities", ".model": "models", ".hook": "hooks",
    ".util": "utils", ".helper": "helpers",
}
GENERAL = "_general"


def directory(filename: Column) -> Column:
    """The folders of a path without a common root and without the file."""
    parts = F.split(F.replace(filename, F.lit("\\"), F.lit("/")), "/")
    start = F.when(F.get(parts, 0).isin(*ROOTS), 2).otherwise(1)
    return F.array_join(F.slice(parts, start, F.greatest(F.size(parts) - start, F.lit(0))), "/")


def role(filename: Column) -> Column:
    found = F.lit(GENERAL)
    for part, name in reversed(ROLES.items()):
        found = F.when(F.contains(F.lower(filename), F.lit(part)), name).otherwise(found)
    return found


def merged(directories: list[str], sizes: list[int]) -> list[int]:
    """For each cluster of a commit, in order, the number of the one that it ends up in."""
    n = len(sizes)
    size, into, alive = np.array(sizes, dtype=np.int64), list(range(n)), np.ones(n, dtype=bool)
    paths = [d.split("/") for d in directories]
    names: dict[str, int] = {}
    depth = max(map(len, paths), default=0)
    places = np.full((n, depth), -1, dtype=np.int64)
    for k, path in enumerate(paths):
        places[k, : len(path)] = [names.setdefault(x, len(names)) for x in path]
    whole = np.array([names.setdefault("/".join(["", *p]), len(names)) for p in paths], dtype=np.int64)
    for k in range(n):
        if size[k] >= MIN_FILES:
            continue
        d = len(paths[k])
        agree = (places[:, :d] == places[k, :d]).sum(axis=1)
        agree[~alive | (whole == whole[k]) | (size + size[k] > MAX_FILES)] = 0
        best = int(agree.argmax()) if n else 0
        if agree[best] > 0:
            size[best] += size[k]
            alive[k], into[k] = False, best
    heap = [(int(size[k]), k, k) for k in range(n) if alive[k]]
    heapq.heapify(heap)
    turn = 0
    while len(heap) > MAX_CLUSTERS:
        small, _, a = heapq.heappop(heap)
        more, _, b = heapq.heappop(heap)
        turn -= 1
        into[a] = b
        # what has just grown comes first among its equals
        heapq.heappush(heap, (small + more, turn, b))
    for k in range(n):
        path = [k]
        while into[path[-1]] != path[-1]:
            path.append(into[path[-1]])
        for x in path:
            into[x] = path[-1]
    return into


def _merge_commits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters in the order of their commits, of each commit in the order of its files -> sha, directory, role, cluster_no, cluster.

    Commits are many and small: a task reads them one after another, with the clusters of one at a time.
    """
    held: list[tuple] = []
    for batch in batches:
        kind, out = batch.column("sha").type, []
        for row in zip(*(batch.column(c).to_pylist() for c in ("sha", "directory", "role", "n", "name")), strict=True):
            if held and row[0] != held[0][0]:
                out += _merged_rows(held)
                held = []
            held.append(row)
        if out:
            yield _as_batch(out, kind)
    if held:
        yield _as_batch(_merged_rows(held), kind)


def _merged_rows(rows: list[tuple]) -> list[tuple]:
    into = merged([r[1] for r in rows], [r[3] for r in rows])
    return [(sha, d, role, k, rows[k][4]) for (sha, d, role, _, _), k in zip(rows, into, strict=True)]


def _as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (kind, pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sha", "directory", "role", "cluster_no", "cluster"])


def file_clusters(files: DataFrame) -> DataFrame:
    """files (sha, file_no, filename, added, deleted) with directory, role, cluster_no and cluster (its name)."""
    kind = files.schema["sha"].dataType.simpleString()
    rows = files.withColumns({"directory": directory(F.col("filename")), "role": role(F.col("filename"))})
    sums = rows.groupBy("sha", "directory", "role").agg(F.count("*").alias("n"), F.min("file_no").alias("first"))
    heads = sums.groupBy("sha", "directory").agg(F.min("first").alias("dir_first"))
    d = F.col("directory")
    name = F.when((d != "") & (F.col("role") != GENERAL), F.concat_ws("/", d, "role")).otherwise(F.when(d != "", d).otherwise(F.col("role")))
    sums = sums.join(heads, ["sha", "directory"]).withColumn("name", F.regexp_replace(name, "^/+|/+$", ""))
    ordered = sums.repartition("sha").sortWithinPartitions("sha", "dir_first", "first")
    places = ordered.mapInArrow(_merge_commits, f"sha {kind}, directory string, role string, cluster_no long, cluster string")
    return rows.join(places, ["sha", "directory", "role"])


def clusters(files: DataFrame) -> DataFrame:
    """sha, cluster_no, cluster, n_files, added, deleted: at most fifteen a commit."""
    return file_clusters(files).groupBy("sha", "cluster_no", "cluster").agg(F.count("*").alias("n_files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
