"""Streaming queries, run to the end of what is there: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.plans.check_sql import EVENTS, with_frames
from effortlens.streaming import jobs, tracker

_STEPS = ("signup", "click", "purchase", "error")


def _events(spark, d):
    return jobs.event_stream(spark, f"{d}/events.parquet")


_TRACKED = (tracker.Step("seen", ("view",)), tracker.Step("taken", ("click",), ("error",)), tracker.Step("bought", ("purchase",)))
_STALE_MS = 2 * 86_400_000


def _tracker():
    return tracker.JobTracker(_TRACKED, _STALE_MS, 86_400_000)


def _tracked(spark, d):
    """Steps as they are done, silence of more than two days and what ends it."""
    with tracker.state_store(spark):
        found = jobs.appended(tracker.transitions(_events(spark, d).drop("value"), _tracker(), "0 seconds"), "tracked")
    return found.where("kind <> 'missing'").select("job_id", "kind", "step", "at_ms")


QUERIES = {
    "stream_tracked_jobs": (
        _tracked,
        """WITH e AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ms, event_id, event_type AS code FROM events),
        s AS (SELECT job_id, step, kind, min({'ms': ms, 'id': event_id}) AS f FROM (SELECT e.*, unnest(CASE code WHEN 'view' THEN ['seen'] WHEN 'click' THEN ['taken'] WHEN 'error' THEN ['taken'] WHEN 'purchase' THEN ['bought'] ELSE [] END) AS step,
          CASE WHEN code = 'error' THEN 'warn' ELSE 'pass' END AS kind FROM e) GROUP BY ALL),
        g AS (SELECT job_id, ms, lag(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS prev, lead(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS next FROM e)
        SELECT job_id, kind, step, f.ms AS at_ms FROM s WHERE kind = 'pass' OR NOT EXISTS (SELECT 1 FROM s p WHERE p.job_id = s.job_id AND p.step = s.step AND p.kind = 'pass' AND p.f < s.f)
        UNION ALL SELECT job_id, 'live', NULL, ms FROM g WHERE ms - prev > 172800000
        UNION ALL SELECT job_id, 'stale', NULL, ms + 172800001 FROM g WHERE coalesce(next, (SELECT max(ms) FROM e)) - ms > 172800000""",
    ),
    "stream_poll": (
        lambda spark, d: jobs.appended(jobs.newer_than(_events(spark, d), 500).select("event_id", "job_id", "code"), "poll"),
        with_frames("SELECT event_id, job_id, code FROM ev WHERE event_id > 500", EVENTS),
    ),
    "stream_seen_once": (
        lambda spark, d: jobs.appended(jobs.seen_once(_events(spark, d).select("event_id", "ts", "code")).select("event_id", "code"), "once"),
        with_frames("SELECT event_id, any_value(code) AS code FROM ev GROUP BY event_id", EVENTS),
    ),
    "stream_leaderboard": (
        lambda spark, d: jobs.latest(jobs.leaderboard(_events(spark, d)), "leaderboard"),
        with_frames("SELECT job_id, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, max(event_id) AS last_event FROM ev GROUP BY job_id", EVENTS),
    ),
    "stream_steps": (
        lambda spark, d: jobs.latest(jobs.furthest_step(_events(spark, d), _STEPS), "steps"),
        with_frames(
            f"SELECT job_id, max(list_position({list(_STEPS)}, code)) - 1 AS furthest, CAST(count(DISTINCT code) AS INT) AS n_steps FROM ev WHERE code IN {_STEPS} GROUP BY job_id", EVENTS
        ),
    ),
    "stream_liveness": (
        lambda spark, d: jobs.latest(jobs.liveness(_events(spark, d), F.unix_seconds(F.to_timestamp(F.lit("2024-01-31 00:00:00"))), 86400), "liveness"),
        with_frames("SELECT job_id, max(second) AS heartbeat, epoch(TIMESTAMP '2024-01-31 00:00:00') - max(second) > 86400 AS stale FROM ev GROUP BY job_id", EVENTS),
    ),
    "stream_windows": (
        lambda spark, d: jobs.latest(jobs.windowed_counts(_events(spark, d)), "windows"),
        with_frames("SELECT second // 86400 * 86400 AS start, code, count(*) AS n FROM ev GROUP BY ALL", EVENTS),
    ),
}
