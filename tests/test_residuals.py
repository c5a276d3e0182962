"""Boosted corrections on rows that were not learned from; a model that is written and read gives the same."""

import random

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from effortlens.operators import accuracy, residuals
from effortlens.storage import new_path


def test_error_on_held_out_rows_falls_and_reruns_agree(spark):
    r = random.Random(2)
    rows = []
    for k in range(1500):
        files, kind, estimate = r.randrange(40), r.choice(["fix", "feature", "docs", None]), r.uniform(10, 500)
        truth = max(0.0, estimate + {"fix": -40, "feature": 90, "docs": -80, None: 0}[kind] + 3 * files + r.gauss(0, 10))
        rows.append((f"c{k}", estimate, truth if k % 50 else None, float(files), kind))
    frame = residuals.with_folds(spark.createDataFrame(rows, "sha string, estimate double, truth double, files double, kind string"), "sha")
    model = residuals.fit(frame, ["estimate", "files"], ["kind"], trees=8)
    found = residuals.corrected(frame, model)
    e = residuals.errors(found).first()
    assert e["n"] > 200 and e["mae_after"] < 0.5 * e["mae_before"]
    assert found.columns == [*frame.columns, "corrected"] and found.where("corrected < 0 OR corrected IS NULL").isEmpty()
    path = new_path(spark, "model")
    model.write().overwrite().save(path)
    again = residuals.corrected(frame, PipelineModel.load(path))
    other = residuals.corrected(frame, residuals.fit(frame, ["estimate", "files"], ["kind"], trees=8))
    for rerun in (again, other):
        met = found.select("sha", "corrected").join(rerun.select("sha", F.col("corrected").alias("c")), "sha")
        assert met.where("abs(corrected - c) > 1e-9").isEmpty() and met.count() == len(rows)
    unseen = frame.limit(3).withColumn("kind", F.lit("never seen"))
    assert residuals.corrected(unseen, model).where("corrected IS NOT NULL").count() == 3


def test_rows_of_equal_features_are_learned_from_as_one(spark):
    r, rows = random.Random(3), []
    for k in range(2000):
        kind, estimate = r.choice(["fix", "feature", None]), float(r.randrange(1, 5) * 50)
        rows.append((f"c{k}", estimate, max(0.0, estimate + {"fix": -40, "feature": 90, None: 5}[kind] + r.gauss(0, 10)), kind))
    frame = residuals.with_folds(spark.createDataFrame(rows, "sha string, estimate double, truth double, kind string"), "sha")
    groups = residuals.learned_groups(frame, ["estimate"], ["kind"])
    assert groups.count() == 12 and groups.agg(F.sum("_weight")).first()[0] == frame.where("fold <> 0").count()
    sums = {}
    for f in frame.collect():
        if f["fold"] != residuals.HELD_OUT:
            sums.setdefault((f["estimate"], f["kind"]), []).append(f["truth"] - f["estimate"])
    means = {k: sum(v) / len(v) for k, v in sums.items()}
    # trees that tell all twelve groups apart end at their means
    model = residuals.fit(frame, ["estimate"], ["kind"], trees=40, depth=5)
    assert model.stages[0].labels == sorted(["fix", "feature"], key=lambda x: -sum(len(v) for k, v in sums.items() if k[1] == x))
    for f in residuals.corrected(frame, model).collect():
        assert abs(f["corrected"] - max(0.0, f["estimate"] + means[f["estimate"], f["kind"]])) < 0.5


def test_few_groups_with_as_many_names(spark):
    rows = [(f"c{k}", 10.0, 12.0 + k % 3, "abc"[k % 3]) for k in range(60)]
    frame = residuals.with_folds(spark.createDataFrame(rows, "sha string, estimate double, truth double, kind string"), "sha")
    found = residuals.corrected(frame, residuals.fit(frame, [], ["kind"], trees=3))
    assert found.where("abs(corrected - truth) > 0.1").isEmpty()


def test_consensus_from_sums_is_the_median(spark):
    r = random.Random(4)
    for most in (4, 9):
        given = [(f"c{k}", r.choice([None, r.randrange(100), r.randrange(100)])) for k in range(60) for _ in range(r.randrange(1, most + 1))]
        truth = spark.createDataFrame(given, "sha string, cents long")
        found = accuracy.with_consensus(accuracy.estimates(truth), truth, "truth")
        assert found.columns == ["sha", "truth"]
        want = {x["sha"]: x["cents"] for x in accuracy.consensus(truth).collect()}
        assert {x["sha"]: x["truth"] for x in found.collect()} == want and len(want) == 60
        # no values are gathered where none has more than four
        assert ("median" in found._jdf.queryExecution().optimizedPlan().toString().lower() or "percentile" in found._jdf.queryExecution().optimizedPlan().toString().lower()) == (most > 4)
