"""A change of shares rewrites the buckets of its developers only, and gives what the full run gives."""

from pathlib import Path

from pyspark.sql import functions as F

from effortlens.operators import incremental
from effortlens.storage import new_path

SCHEMA = "email string, n_commits long, total_cents long, work_days long, fte_days long, share double, ratio_raw double, ratio_adjusted double"


def files(path):
    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in Path(path.removeprefix("file:")).glob("bucket=*/*.parquet")}


def test_only_touched_buckets_are_written(spark):
    rows = [(f"dev{i}@x", i % 7, 300 * i, i % 5, i % 6, 0.25, 1.0, 4.0) for i in range(200)]
    path = new_path(spark, "metrics")
    incremental.write_metrics(spark.createDataFrame(rows, SCHEMA), path)
    before = files(path)
    changes = spark.createDataFrame([("dev3@x", 0.5), ("dev8@x", None), ("nobody@x", 1.0)], "email string, share double")
    incremental.change_shares(incremental.read_metrics(spark, path, SCHEMA), changes, path)
    after = files(path)
    touched = {f"bucket={r[0]}" for r in spark.createDataFrame([("dev3@x",), ("dev8@x",)], "email string").select(incremental.bucket_of(F.col("email"))).collect()}
    assert before.keys() == after.keys() and {b for b in before if before[b] != after[b]} == touched
    found = {r["email"]: r for r in incremental.read_metrics(spark, path, SCHEMA).collect()}
    assert len(found) == 200
    total = sum(r[1] for r in rows)
    for email, n, cents, _, fte, *old in rows:
        share = {"dev3@x": 0.5, "dev8@x": n / total}.get(email, 0.25)
        r = found[email]
        assert r["share"] == share and (r["n_commits"], r["total_cents"], r["ratio_raw"]) == (n, cents, old[1])
        assert r["ratio_adjusted"] == (cents * 100.0 / (fte * 300) / share if email in ("dev3@x", "dev8@x") else old[2])


def test_flagged_developers_are_left_out(spark):
    commits = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "email string, cents long")
    assert [r["cents"] for r in incremental.without(commits, spark.createDataFrame([("a",), ("a",)], "email string")).collect()] == [2]
