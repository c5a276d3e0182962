"""Effort spreading: hours of a day's commits are placed on that day and up to four weekdays before it.

A developer's days are placed in order, each with regard to what the days before it hold, so this
part is a loop per developer. It gets one row a day, summed by Spark beforehand, never the commits:
a group is bounded by the calendar, however many commits a developer has. Groups are read in order in
one pass, so many small ones cost no more than their rows. Shares of commits are a window again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens import params
from effortlens.functions.scalars import auto_share, ratio, weekdays_between


def days_back(day: date, count: int) -> list[date]:
    """The day itself, even on a weekend, and the weekdays before it, most recent first."""
    out, at = [day], day
    while len(out) < count:
        at -= timedelta(days=1)
        if at.weekday() < 5:
            out.append(at)
    return out


def even_split(cents: int, n: int) -> list[int]:
    low, more = divmod(cents, n)
    return [low + (i < more) for i in range(n)]


class Calendar:
    """What the days of one developer hold, while entries come in date order."""

    def __init__(self, cap: int = params.MAX_CENTS_PER_DAY, window: int = params.MAX_SPREAD_DAYS):
        self.cap, self.window = cap, window
        self.held: dict[date, int] = {}
        self.previous: date | None = None

    def place(self, day: date, cents: int) -> list[tuple[date, int]]:
        """(placed day, cents) of the next entry."""
        cap, held, previous = self.cap, self.held, self.previous
        around = days_back(day, self.window)
        fresh = [d for d in around if previous is None or d > previous]
        older = [d for d in around if previous is not None and d <= previous]
        left, self.previous = cents, day
        out: list[tuple[date, int]] = []
        if cents <= 0:
            return out

        def put(d: date, amount: int) -> int:
            amount = min(amount, cap - held.get(d, 0))
            if amount > 0:
                held[d] = held.get(d, 0) + amount
                out.append((d, amount))
            return max(amount, 0)

        n = min(-(-cents // cap), len(fresh))
        if cents <= n * cap and not any(held.get(d) for d in fresh):
            for d, part in zip(fresh, even_split(cents, n), strict=False):
                left -= put(d, part)
        else:
            for d in fresh:
                left -= put(d, left)
        for d in older:
            left -= put(d, left)
        return out


def place(entries: list[tuple[date, int]], cap: int = params.MAX_CENTS_PER_DAY, window: int = params.MAX_SPREAD_DAYS) -> list[tuple[date, date, int]]:
    """(entry day, placed day, cents) for entries in date order."""
    calendar = Calendar(cap, window)
    return [(day, d, amount) for day, cents in entries for d, amount in calendar.place(day, cents)]


def placed_days(commits: DataFrame, by: tuple[str, ...] = ("email",)) -> DataFrame:
    """Commits (``by``, day, cents) -> by, entry_day, day, cents placed; each group of ``by`` is a calendar of its own.

    Groups may be many and small: a task reads its groups one after another in batches, with the calendar of one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, calendar = None, Calendar()
        for batch in batches:
            days, cents = batch.column("day").to_pylist(), batch.column("cents").to_pylist()
            rows, placed = [], []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by), strict=True)):
                if key != at:
                    at, calendar = key, Calendar()
                for part in calendar.place(days[i], cents[i]):
                    rows.append(i)
                    placed.append(part)
            taken = batch.take(pa.array(rows, pa.int64()))
            made = [pa.array([d for d, _ in placed], pa.date32()), pa.array([c for _, c in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in by), taken.column("day"), *made], names=[*by, "entry_day", "day", "cents"])

    entries = commits.groupBy(*by, "day").agg(F.sum("cents").alias("cents"))
    keys = "".join(f"`{c}` {entries.schema[c].dataType.simpleString()}, " for c in by)
    return entries.repartition(*by).sortWithinPartitions(*by, "day").mapInArrow(run, f"{keys}entry_day date, day date, cents long")


def daily_effort(commits: DataFrame) -> DataFrame:
    """email, day, sha, entry_day, cents: each commit's part of each placed day, in proportion, the last sha taking what is left."""
    placed = placed_days(commits)
    w = Window.partitionBy("email", "entry_day", "day").orderBy("sha")
    whole = Window.partitionBy("email", "entry_day", "day")
    rows = commits.select("email", F.col("day").alias("entry_day"), "sha", F.col("cents").alias("own")).join(placed, ["email", "entry_day"])
    rows = rows.withColumn("total", F.sum("own").over(whole))
    rows = rows.withColumn("part", F.floor(F.try_divide(F.col("cents") * F.col("own"), F.col("total"))).cast("long"))
    rows = rows.withColumn("rest", F.col("cents") - F.sum("part").over(whole))
    last = F.row_number().over(w) == F.count("*").over(whole)
    cents = F.col("part") + F.when(last, F.col("rest")).otherwise(0)
    return rows.select("email", "day", "sha", "entry_day", cents.alias("cents")).where("cents > 0")


def effort_rows(commits: DataFrame) -> DataFrame:
    """email, day, placed, overhead: a commit's placed cents on the days they went to, what could not be placed on its own day."""
    parts = daily_effort(commits)
    placed = parts.groupBy("email", F.col("entry_day").alias("day"), "sha").agg(F.sum("cents").alias("placed"))
    left = commits.select("email", "day", "sha", "cents").join(placed, ["email", "day", "sha"], "left")
    left = left.select("email", "day", F.lit(0).cast("long").alias("placed"), (F.col("cents") - F.coalesce("placed", F.lit(0))).alias("overhead"))
    return parts.select("email", "day", F.col("cents").alias("placed"), F.lit(0).cast("long").alias("overhead")).unionByName(left.where("overhead > 0"))


def developer_metrics(commits: DataFrame, auto: bool = True) -> DataFrame:
    """Per developer: commits, total, placed and overhead cents, work days, FTE days, share, two ratios."""
    totals = commits.groupBy("email").agg(F.count("*").alias("n_commits"), F.sum("cents").alias("total_cents"), F.max("day").alias("last_commit"))
    days = placed_days(commits).groupBy("email", "day").agg(F.sum("cents").alias("cents"))
    placed = days.groupBy("email").agg(
        F.sum("cents").alias("placed_cents"),
        F.count("*").alias("work_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_if(F.weekday("day") >= 5).alias("weekend_days"),
    )
    everyone = commits.agg(F.sum("cents").alias("all_cents"))  # one row
    rows = totals.join(placed, "email", "left").crossJoin(F.broadcast(everyone))
    work_days = F.coalesce("work_days", F.lit(0))
    fte = F.coalesce(weekdays_between(F.col("first_day"), F.greatest("last_day", "last_commit")) + F.col("weekend_days"), F.lit(0))
    share = auto_share(F.col("total_cents"), F.col("all_cents")) if auto else F.lit(1.0)
    return rows.select(
        "email",
        "n_commits",
        "total_cents",
        F.coalesce("placed_cents", F.lit(0)).alias("placed_cents"),
        (F.col("total_cents") - F.coalesce("placed_cents", F.lit(0))).alias("overhead_cents"),
        work_days.alias("work_days"),
        fte.alias("fte_days"),
        share.alias("share"),
        ratio(F.col("total_cents"), work_days).alias("ratio_raw"),
        ratio(F.col("total_cents"), fte, share).alias("ratio_adjusted"),
    )


def repo_metrics(commits: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Per order, repository and developer, over all of their commits: commits, total and overhead cents, work days, share of the repository's commits, two ratios.

    Hours of a repository are placed by themselves, whatever the developer does elsewhere. ``visible``
    (email) leaves developers out of the result, not out of the shares.
    """
    group, who = ("order_id", "repo"), ("order_id", "repo", "email")
    totals = commits.groupBy(*who).agg(F.count("*").alias("n_commits"), F.sum("cents").alias("total_cents"))
    whole = totals.groupBy(*group).agg(F.sum("n_commits").alias("all_commits"))
    days = placed_days(commits, who).groupBy(*who).agg(F.sum("cents").alias("placed"), F.count_distinct("day").alias("work_days"))
    rows = totals.join(whole, [*group]).join(days, [*who], "left")
    if visible is not None:
        rows = rows.join(visible.select("email").distinct(), "email", "left_semi")
    work_days, share = F.coalesce("work_days", F.lit(0)), auto_share(F.col("n_commits"), F.col("all_commits"))
    return rows.select(
        *who,
        "n_commits",
        "total_cents",
        (F.col("total_cents") - F.coalesce("placed", F.lit(0))).alias("overhead_cents"),
        work_days.alias("work_days"),
        share.alias("share"),
        ratio(F.col("total_cents"), work_days).alias("ratio_raw"),
        ratio(F.col("total_cents"), work_days, share).alias("ratio_adjusted"),
    )


def _in_periods(rows: DataFrame, day: str) -> DataFrame:
    """Each row once for all time and for the year, quarter and month of its day."""
    d, none = F.col(day), F.lit(None).cast("int")
    period = lambda kind, year, part: F.struct(F.lit(kind).alias("period"), year.alias("year"), part.alias("part"))
    made = F.array(period("ALL_TIME", none, none), period("YEAR", F.year(d), none), period("QUARTER", F.year(d), F.quarter(d)), period("MONTH", F.year(d), F.month(d)))
    return rows.select("*", F.inline(made))


def period_fte(days: DataFrame, commits: DataFrame) -> DataFrame:
    """days (email, day) with placed hours, commits (email, day) -> email, period, year, part (quarter or month), fte_days.

    Weekdays from the first placed day to the later of the last placed day and the last commit of the
    period, and placed weekend days. A period without a placed day or without a commit has no row.
    """
    keys = ["email", "period", "year", "part"]
    placed = _in_periods(days.select("email", "day").distinct(), "day").groupBy(*keys)
    placed = placed.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count_if(F.weekday("day") >= 5).alias("extra"))
    last = _in_periods(commits.groupBy("email", "day").agg(F.count("*").alias("n")), "day").groupBy(*keys).agg(F.max("day").alias("commit"))
    last = last.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = placed.join(last, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return met.select(*keys, (weekdays_between(F.col("first"), F.greatest("last", "commit")) + F.col("extra")).alias("fte_days"))
