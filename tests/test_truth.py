"""Accuracy over the truth of every commit, against pandas."""

import numpy as np

from effortlens.plans import registry
from effortlens.sources.tables import ground_truth, commits
from tests.compare import SF


def test_truth_leaves_no_commit_out(spark):
    truth = ground_truth(spark, SF).toPandas()
    rows = commits(spark, SF).toPandas()
    assert set(truth.sha) == set(rows.sha) and len(truth) == 3 * len(rows)
    assert 0 < truth.cents.isna().sum() < len(truth)

    wanted = truth.groupby("author").cents.agg(["count", "sum", "median", "mean"])
    for r in registry.QUERIES["gt_author_stats"](spark, SF).collect():
        assert np.allclose((r["n"], r["cents"], r["median_cents"], r["mean_cents"]), wanted.loc[r["author"]])

    agreed = truth.groupby("sha").cents.median()
    found = registry.QUERIES["gt_consensus"](spark, SF).toPandas().set_index("sha").cents
    assert found.to_dict() == agreed.to_dict()

    pairs = rows.join(agreed.rename("truth"), on="sha")
    for name, by in (("run_mae_corr", "model"), ("accuracy_by_category", "category")):
        answer = {r[by]: r for r in registry.QUERIES[name](spark, SF).collect()}
        groups = dict(list(pairs.dropna(subset=[by]).groupby(by)))
        assert set(answer) == set(groups) and sum(r["n"] for r in answer.values()) == pairs[by].notna().sum()
        for key, g in groups.items():
            error = (g.cents - g.truth).abs()
            ape = (error * 100 / g.truth.where(g.truth != 0)).dropna()
            r = answer[key]
            assert np.allclose((r["n"], r["mae"], r["r"], r["mape"], r["median_ape"]), (len(g), error.mean(), np.corrcoef(g.cents, g.truth)[0, 1], ape.mean(), ape.median()), atol=1e-4)
