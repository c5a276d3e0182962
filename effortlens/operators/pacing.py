"""Paced release: events of a session that arrive in polls are shown one after another, each after a delay of its own.

A poll has as long as the polls before it were apart, times a padding; that time is shared out by
weight of the events' tiers, within bounds for each tier, and scaled down if the bounds ask for more.
An event is released its delay after the later of its arrival and the release of the one before it.
As release times go, x becomes max(x, arrival) + delay: with running sums D of the delays the release
of event i is D_i + max over j <= i of (arrival_j - D_(j-1)), a running maximum. Sessions are cut into
ranges by (session, poll), each range is solved by itself and shifted by where the ranges before it end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens.storage import checkpointed

#: Weight of a tier, least and most delay in ms, and what a poll's time is multiplied by.
WEIGHTS = {"milestone": 4.0, "major": 2.0, "micro": 0.5}
BOUNDS = {"milestone": (100, 800), "major": (40, 400), "micro": (15, 80)}
PADDING, FLOOR_MS, FIRST_INTERVAL_MS = 1.2, 10, 1000
OTHER = "major"

_ORDER = ["poll_ms", "event_id"]


def first_seen(events: DataFrame) -> DataFrame:
    """session, event_id, poll_ms, tier: each event once, in the first poll that has it, there with the first tier in order."""
    return events.groupBy("session", "event_id").agg(F.min(F.struct("poll_ms", "tier")).alias("e")).select("session", "event_id", "e.*")


def delays(seen: DataFrame) -> DataFrame:
    """``seen`` with delay_us: microseconds to wait before each event, whole numbers so that sums do not hang on their order."""
    tier = F.when(F.col("tier").isin(*WEIGHTS), F.col("tier")).otherwise(OTHER)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("_tier"))
    rows = seen.withColumn("_tier", tier)
    rows = rows.withColumns({"_weight": of(WEIGHTS), "_least": of({k: v[0] for k, v in BOUNDS.items()}), "_most": of({k: v[1] for k, v in BOUNDS.items()})})
    # one row a poll; polls of a session without a new event do not count
    polls = rows.groupBy("session", "poll_ms").agg(F.sum("_weight").alias("_weights"))
    gap = F.col("poll_ms") - F.lag("poll_ms").over(Window.partitionBy("session").orderBy("poll_ms"))
    polls = polls.withColumn("_budget", F.coalesce(gap, F.lit(FIRST_INTERVAL_MS)) * PADDING)
    rows = rows.join(polls, ["session", "poll_ms"])
    rows = rows.withColumn("_delay", F.greatest("_least", F.least("_most", F.col("_budget") / F.col("_weights") * F.col("_weight"))))
    rows = rows.withColumn("_us", F.floor(F.col("_delay") * 1000 + 0.5).cast("long"))
    asked = rows.groupBy("session", "poll_ms").agg(F.sum("_us").alias("_asked"))
    rows = rows.join(asked, ["session", "poll_ms"])
    budget_us = F.floor(F.col("_budget") * 1000 + 0.5)
    scaled = F.greatest(F.lit(FLOOR_MS * 1000), F.floor(F.col("_us") * budget_us / F.col("_asked") + 0.5))
    return rows.select("session", "event_id", "poll_ms", "tier", F.when(F.col("_asked") > budget_us, scaled).otherwise(F.col("_us")).cast("long").alias("delay_us"))


def released(delayed: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``delayed`` with release_us, when each event is shown; events of a poll go by id."""
    keys = ["session", *_ORDER]
    spread = delayed.repartitionByRange(*keys) if n_ranges is None else delayed.repartitionByRange(n_ranges, *keys)
    ranges = checkpointed(spread.withColumn("_range", F.spark_partition_id()))
    upto = Window.partitionBy("session", "_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.withColumn("_sum", F.sum("delay_us").over(upto))
    rows = rows.withColumn("_top", F.max(F.col("poll_ms") * 1000 - F.col("_sum") + F.col("delay_us")).over(upto))
    # a range of a session as a whole turns x into max(x, top) + sum
    ends = rows.groupBy("session", "_range").agg(F.max("_sum").alias("s"), F.max("_top").alias("t"))
    before = Window.partitionBy("session").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("all", F.sum("s").over(before))
    ends = ends.withColumn("end", F.col("all") + F.max(F.col("t") - F.col("all") + F.col("s")).over(before))
    ends = ends.select(F.col("session").alias("_session"), F.col("_range").alias("_part"), F.lag("end").over(Window.partitionBy("session").orderBy("_range")).alias("_start"))
    met = rows.join(ends, F.col("session").eqNullSafe(F.col("_session")) & (F.col("_range") == F.col("_part")))
    release = F.col("_sum") + F.greatest("_top", "_start")  # greatest passes over nulls
    return met.select("session", "event_id", "poll_ms", "tier", "delay_us", release.alias("release_us"))


def backlog(shown: DataFrame, batch: int) -> DataFrame:
    """``shown`` with waiting, the events of its session that have arrived and are not shown when it is, and catch_up, whether they are more than ``batch``."""
    upto = Window.partitionBy("session").orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = shown.select("session", "event_id", (F.col("poll_ms") * 1000).alias("_us"), F.lit(0).alias("_kind"), F.lit(1).alias("_step"))
    marks = marks.unionByName(shown.select("session", "event_id", F.col("release_us").alias("_us"), F.lit(1).alias("_kind"), F.lit(-1).alias("_step")))
    waiting = marks.withColumn("waiting", F.sum("_step").over(upto)).where("_kind = 1").select("session", "event_id", "waiting")
    return shown.join(waiting, ["session", "event_id"]).withColumn("catch_up", F.col("waiting") > batch)
