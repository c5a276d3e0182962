"""Metrics of repositories and of periods against plain reckonings."""

from collections import defaultdict
from datetime import date, timedelta

import pytest

from effortlens.operators import spread
from effortlens.plans import measures, registry
from effortlens.sources.tables import commits
from tests.compare import SF


def test_repositories_are_placed_by_themselves(spark):
    groups = defaultdict(lambda: defaultdict(list))
    for r in commits(spark, SF).collect():
        groups[r["order_id"], r["repo"]][r["email"]].append((r["day"], r["cents"]))
    rows = {(r["order_id"], r["repo"], r["email"]): r for r in registry.QUERIES["repo_metrics"](spark, SF).collect()}
    assert len(rows) == sum(len(g) for g in groups.values())
    for (order, repo), people in groups.items():
        n = sum(len(x) for x in people.values())
        for email, mine in people.items():
            sums = defaultdict(int)
            for day, cents in mine:
                sums[day] += cents
            placed = spread.place(sorted(sums.items()))
            row, total = rows[order, repo, email], sum(sums.values())
            assert (row["n_commits"], row["total_cents"], row["work_days"]) == (len(mine), total, len({d for _, d, _ in placed}))
            assert row["overhead_cents"] == total - sum(c for _, _, c in placed)
            assert row["share"] == pytest.approx(len(mine) / n)


def test_hidden_developers_count_in_shares(spark):
    rows = spark.createDataFrame([(1, "r", e, date(2024, 1, 3), 100) for e in ("a", "a", "b", "c")], "order_id long, repo string, email string, day date, cents long")
    shown = spark.createDataFrame([("a",), ("a",), ("x",)], "email string")
    assert [(r["email"], r["share"], r["work_days"]) for r in spread.repo_metrics(rows, shown).collect()] == [("a", 0.5, 1)]
    assert spread.repo_metrics(rows.limit(0)).count() == 0


def test_periods_by_days(spark):
    days = [("a", date(2024, 3, 29)), ("a", date(2024, 3, 30)), ("a", date(2024, 4, 2)), ("b", date(2024, 5, 1))]
    done = [("a", date(2024, 3, 31)), ("a", date(2024, 4, 5)), ("c", date(2024, 5, 1))]
    frame = lambda rows: spark.createDataFrame(rows, "email string, day date")
    found = {tuple(r)[:4]: r["fte_days"] for r in spread.period_fte(frame(days), frame(done)).collect()}
    week = lambda a, b: sum((a + timedelta(i)).weekday() < 5 for i in range((b - a).days + 1))
    whole = week(date(2024, 3, 29), date(2024, 4, 5)) + 1  # and a Saturday
    assert found == {
        ("a", "ALL_TIME", None, None): whole, ("a", "YEAR", 2024, None): whole, ("a", "QUARTER", 2024, 1): 2, ("a", "MONTH", 2024, 3): 2,
        ("a", "QUARTER", 2024, 2): 4, ("a", "MONTH", 2024, 4): 4,
    }


def test_all_time_is_that_of_developer_metrics(spark):
    metrics = {r["email"]: r["fte_days"] for r in spread.developer_metrics(measures._base(spark, SF)).collect() if r["work_days"]}
    assert {r["email"]: r["fte_days"] for r in registry.QUERIES["period_fte"](spark, SF).where("period = 'ALL_TIME'").collect()} == metrics
