"""The queries over spread days against a plain reckoning."""

from collections import defaultdict
from datetime import timedelta
from fractions import Fraction
from math import floor
from statistics import median

import pytest

from effortlens.operators import scope, spread
from effortlens.plans import registry
from effortlens.sources.tables import commits
from tests.compare import SF


@pytest.fixture(scope="module")
def plain(spark):
    """(commits by developer and day, placed cents by developer and day, overhead by developer and day, last parts of commits)."""
    own = defaultdict(lambda: defaultdict(list))
    for r in commits(spark, SF).where(scope.base()).collect():
        own[r["email"]][r["day"]].append((r["sha"], r["cents"]))
    placed, overhead = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for email, days in own.items():
        by_commit = defaultdict(int)
        for entry, day, cents in spread.place([(d, sum(c for _, c in days[d])) for d in sorted(days)]):
            placed[email][day] += cents
            total, left = sum(c for _, c in days[entry]), cents
            for k, (sha, c) in enumerate(sorted(days[entry])):
                part = left if k == len(days[entry]) - 1 else cents * c // total
                by_commit[entry, sha] += part
                left -= part
        for day, found in days.items():
            for sha, c in found:
                if c > by_commit[day, sha]:
                    overhead[email][day] += c - by_commit[day, sha]
    assert max(len(x) for days in own.values() for x in days.values()) > 1
    assert sum(sum(x.values()) for x in overhead.values()) > 0
    return own, placed, overhead


KEYS = {
    "week": lambda d: "{}-W{:02d}".format(*d.isocalendar()[:2]),
    "month": lambda d: f"{d.year}-{d.month:02d}",
    "quarter": lambda d: f"{d.year}-Q{(d.month + 2) // 3}",
    "year": lambda d: str(d.year),
}


@pytest.mark.parametrize("unit", sorted(KEYS))
def test_timeline(spark, plain, unit):
    own, placed, overhead = plain
    cells = defaultdict(lambda: [0, 0, set(), set(), set()])
    for k, side in enumerate((placed, overhead)):
        for email, days in side.items():
            for day, cents in days.items():
                x = cells[KEYS[unit](day)]
                x[k] += cents
                x[2].add((email, day))
                x[3].add(day)
                x[4].add(email)
    half_up = lambda a, b: floor(Fraction(a, b) + Fraction(1, 2))
    wanted = {
        p: (a, b, a + b, len(dd), len(ds), len(e), len(own), half_up(a, len(dd)), half_up(b, len(dd)), half_up(a + b, len(dd)), half_up(a + b, len(ds) * len(own)))
        for p, (a, b, dd, ds, e) in cells.items()
    }
    names = "placed_cents overhead_cents total_cents developer_days days active selected avg_placed_by_active avg_overhead_by_active avg_by_active avg_by_all".split()
    assert {r["period"]: tuple(r[c] for c in names) for r in registry.QUERIES[f"timeline_{unit}"](spark, SF).collect()} == wanted


def test_grouping_sets(spark, plain):
    wanted = defaultdict(int)
    for email, days in plain[1].items():
        for d, cents in days.items():
            for key in ((None,) * 3, (d.year, None, None), (d.year, d.month, None), (d.year, None, (d.month + 2) // 3)):
                wanted[email, *key] += cents
    assert {(r["email"], r["y"], r["m"], r["q"]): r["cents"] for r in registry.QUERIES["placed_grouping_sets"](spark, SF).collect()} == wanted


def test_gaps(spark, plain):
    wanted = set()
    for email, days in plain[1].items():
        active = sorted({*days, *plain[0][email]})
        for a, b in zip(active, active[1:], strict=False):
            gap = [a + timedelta(days=k) for k in range(1, (b - a).days)]
            if sum(d.weekday() < 5 for d in gap) <= 3:
                wanted |= {(email, d) for d in gap}
    rows = [tuple(r) for r in registry.QUERIES["gap_fill"](spark, SF).collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def test_ratio_fte_and_norm(spark, plain):
    own, placed, _ = plain
    ratios = {r["email"]: (r["percent"], r["colour"]) for r in registry.QUERIES["ghost_ratio"](spark, SF).collect()}
    fte = {r["email"]: r["fte_days"] for r in registry.QUERIES["fte_days"](spark, SF).collect()}
    means = []
    for email, days in own.items():
        total, n = sum(c for x in days.values() for _, c in x), len(placed[email])
        means.append(total / n)
        percent = floor(total * 100 / (n * 300) * 100 + 0.5) / 100
        assert ratios[email] == (percent, "green" if percent >= 100 else "yellow" if percent >= 80 else "red")
        first, last = min(placed[email]), max(*placed[email], *days)
        span = [first + timedelta(days=k) for k in range((last - first).days + 1)]
        assert fte[email] == sum(d.weekday() < 5 or d in placed[email] for d in span)
    assert registry.QUERIES["median_norm"](spark, SF).first()["norm"] == floor(median(means) * 100 + 0.5) / 100
