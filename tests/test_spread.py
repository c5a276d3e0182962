"""Effort spreading: worked cases, invariants, and the jobs against a plain reckoning."""

from collections import defaultdict
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import scope, spread
from effortlens.sources.tables import commits
from tests.compare import SF

D = lambda n: date(2026, 2, n)


def by_day(entries):
    out = defaultdict(int)
    for _, d, c in spread.place(entries):
        out[d] += c
    return dict(out)


def test_fits_in_one_day():
    assert by_day([(D(16), 400)]) == {D(16): 400}


def test_splits_over_two_days():
    assert by_day([(D(16), 800)]) == {D(16): 400, D(13): 400}


def test_overhead_is_what_five_days_cannot_hold():
    assert sum(by_day([(D(20), 3000)]).values()) == 2500


def test_no_hours_place_nothing():
    assert by_day([(D(16), 0)]) == {}


def test_weekend_then_monday():
    assert by_day([(D(14), 400), (D(16), 1000)]) == {D(14): 400, D(16): 500, D(13): 500}


def test_sunday_counts_itself():
    assert set(by_day([(D(15), 1200)])) == {D(15), D(13), D(12)}


def test_spill_tops_up_earlier_days():
    placed = by_day([(D(17), 200), (D(18), 2200), (D(19), 100)])
    assert (placed[D(17)], placed[D(18)], placed[D(19)]) == (500, 500, 100)
    assert sum(placed.values()) == 2500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 4000)), max_size=15))
def test_never_over_the_cap_nor_more_than_given(raw):
    sums = defaultdict(int)
    for n, c in raw:
        sums[date(2026, 1, 1) + timedelta(days=n)] += c
    entries = sorted(sums.items())
    placed = by_day(entries)
    assert all(0 < c <= 500 for c in placed.values())
    assert sum(placed.values()) <= sum(sums.values())


def test_parts_of_commits_add_up_to_the_placed_days(spark):
    rows = commits(spark, SF).where(scope.base())
    placed = rows.transform(spread.placed_days).groupBy("email", "day").agg(F.sum("cents").alias("c"))
    parts = spread.daily_effort(rows).groupBy("email", "day").agg(F.sum("cents").alias("p"))
    assert placed.join(parts, ["email", "day"], "full").where("NOT (c <=> p)").count() == 0


def test_metrics_keep_hours(spark):
    for r in spread.developer_metrics(commits(spark, SF).where(scope.base())).collect():
        assert r["placed_cents"] + r["overhead_cents"] == r["total_cents"]
        assert r["overhead_cents"] >= 0 and r["work_days"] >= 1


def test_empty_table_gives_no_metrics(spark):
    assert spread.developer_metrics(commits(spark, SF).where("false")).collect() == []


@pytest.mark.parametrize(("first", "length"), [(date(2026, 1, 5), n) for n in range(0, 17)] + [(date(2026, 1, 10), n) for n in range(0, 17)])
def test_weekdays_in_closed_form(spark, first, length):
    last = first + timedelta(days=length)
    wanted = sum((first + timedelta(days=k)).weekday() < 5 for k in range(length + 1))
    found = spark.range(1).select(scalars.weekdays_between(F.lit(first), F.lit(last))).first()[0]
    assert found == wanted


def test_ratio_edges(spark):
    row = spark.range(1).select(
        scalars.ratio(F.lit(2000), F.lit(0)).alias("none"),
        scalars.ratio(F.lit(6000), F.lit(20)).alias("full"),
        scalars.ratio(F.lit(3000), F.lit(20), F.lit(0.5)).alias("half"),
        scalars.ratio(F.lit(3000), F.lit(20), F.lit(0.0)).alias("no_share"),
        scalars.auto_share(F.lit(60), F.lit(100)).alias("share"),
        scalars.ratio_label(F.lit(None).cast("double")).alias("label"),
    ).first()
    assert (row["none"], row["full"], row["half"], row["no_share"], row["share"], row["label"]) == (None, 100.0, 100.0, None, 0.6, "N/A")
