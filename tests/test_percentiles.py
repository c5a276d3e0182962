"""Exact percentiles of groups that a sketch brackets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlens.operators import accuracy

SHARES = {"p0": 0.0, "p5": 0.5, "p95": 0.95, "p99": 0.99, "p1": 1.0}


@pytest.mark.parametrize("kind", ["skewed", "ties", "two", "ordered"])
def test_large_groups_agree_with_a_sort(spark, kind):
    values = {"skewed": "exp(rand(3) * 20)", "ties": "floor(rand(4) * 7)", "two": "CASE WHEN id % 2 = 0 THEN -1.5 ELSE 2e9 END", "ordered": "id * 1.0"}[kind]
    rows = spark.range(0, 70_001, 1, 8).select(F.when(F.col("id") % 50 > 0, "hot").alias("k"), F.expr(f"CAST({values} AS DOUBLE)").alias("v")).cache()
    plain = rows.toPandas()
    found = {r["k"]: r for r in accuracy.percentiles(rows, ["k"], "v", SHARES).collect()}
    for k, part in (("hot", plain[plain.k == "hot"]), (None, plain[plain.k.isna()])):
        assert [found[k][s] for s in SHARES] == pytest.approx(list(np.quantile(part.v, list(SHARES.values()))), rel=1e-12)
    whole = accuracy.percentiles(rows, [], "v", SHARES).collect()
    assert len(whole) == 1 and list(whole[0]) == pytest.approx(list(np.quantile(plain.v, list(SHARES.values()))), rel=1e-12)
    rows.unpersist()


def test_odd_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 2.0), ("b", None), (None, 5.0)], "k string, v double")
    found = {r["k"]: r["m"] for r in accuracy.percentiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert found == {"a": 1.5, None: 5.0}
    sums = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert {r["k"]: r["m"] for r in accuracy.with_percentiles(sums, rows, ["k"], "v", {"m": 0.5}).collect()} == {"a": 1.5, "b": None, None: 5.0}
    assert [tuple(r) for r in accuracy.percentiles(rows.limit(0), [], "v", {"m": 0.5}).collect()] == [(None,)]
    assert accuracy.percentiles(rows.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
