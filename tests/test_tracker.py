"""Job tracking by state and timers: transitions against a loop, silence without an event, restart without repeats."""

import random
import time

import pytest
from pyspark.sql import functions as F

from effortlens.streaming import tracker
from effortlens.streaming.jobs import appended

STEPS = (tracker.Step("accepted", ("ok",)), tracker.Step("worker", ("take",), ("retake",)), tracker.Step("clone", ("clone",)), tracker.Step("done", ("done",)))
STALE, MISSING = 600_000, 180_000
SCHEMA = "event_id long, ts timestamp, job_id long, code string"


@pytest.fixture
def store(spark):
    with tracker.state_store(spark):
        yield spark


def by_loop(events, end):
    """Transitions of (event_id, ms, job, code) in order of time, up to the clock ``end``."""
    out, jobs = set(), {}
    for event, ms, job, code in sorted(events, key=lambda e: (e[1], e[0])) + [(None, end + 1, None, None)]:
        for j, s in jobs.items() if job is None else [(job, jobs.get(job))]:
            if s is None:
                continue
            due = []
            if not s["checked"] and s["first"] + MISSING < ms + 1 and s["first"] + MISSING - 1 <= ms - 1:
                due.append((s["first"] + MISSING, "check"))
            if not s["stale"] and s["last"] + STALE <= ms - 1:
                due.append((s["last"] + STALE + 1, "stale"))
            for at, what in sorted(due):
                if what == "stale":
                    s["stale"] = True
                    out.add((j, "stale", None, at))
                else:
                    s["checked"] = True
                    check(j, s, at, out)
        if job is None:
            break
        s = jobs.setdefault(job, {"first": ms, "last": ms, "stale": False, "checked": False, "done": {}})
        if s["stale"] and ms > s["last"]:
            s["stale"] = False
            out.add((job, "live", None, ms))
        s["last"] = max(s["last"], ms)
        for step in STEPS:
            kind = "pass" if code in step.codes else "warn" if code in step.warn_codes else None
            if kind and s["done"].get(step.name) != "pass" and not (kind == "warn" and s["done"].get(step.name) == "warn"):
                s["done"][step.name] = kind
                out.add((job, kind, step.name, ms))
                if s["checked"]:
                    check(job, s, ms, out)
    return out


def check(job, s, at, out):
    furthest = max((i for i, x in enumerate(STEPS) if s["done"].get(x.name) in ("pass", "warn")), default=-1)
    for x in STEPS[: furthest + 2]:
        if x.name not in s["done"]:
            s["done"][x.name] = "missing"
            out.add((job, "missing", x.name, at))


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def written(spark, rows, folder):
    frame = spark.createDataFrame(rows, "event_id long, ms long, job_id long, code string")
    frame.select("event_id", F.timestamp_millis("ms").alias("ts"), "job_id", "code").coalesce(1).write.mode("append").parquet(folder)


def rows_of(frame):
    return [(r["job_id"], r["kind"], r["step"], r["at_ms"]) for r in frame.collect()]


def test_transitions_and_restart(store, tmp_path):
    spark, r = store, random.Random(7)
    events, ms = [], 1_700_000_000_000
    for k in range(240):
        ms += r.choice([1_000, 30_000, 100_000, 300_000])
        events.append((k, ms, r.randrange(5), r.choice(["ok", "take", "retake", "clone", "done", "noise"])))
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    tracked = lambda: tracker.transitions(stream_of(spark, folder), tracker.JobTracker(STEPS, STALE, MISSING), "0 seconds")
    written(spark, events[:120], folder)
    first = rows_of(appended(tracked(), "tracked", out))
    assert len(first) == len(set(first)) and set(first) == by_loop(events[:120], events[119][1])
    again = rows_of(appended(tracked(), "tracked", out))
    assert sorted(map(str, again)) == sorted(map(str, first))  # a restart without news repeats nothing
    written(spark, events[120:], folder)
    both = rows_of(appended(tracked(), "tracked", out))
    assert len(both) == len(set(both)) and set(both) == by_loop(events, events[-1][1])


def test_a_silent_job_turns_stale_without_an_event(store, tmp_path):
    spark, folder = store, str(tmp_path / "events")
    written(spark, [(1, 1_700_000_000_000, 3, "ok"), (2, 1_700_000_000_500, 4, "noise")], folder)
    tracked = tracker.transitions(stream_of(spark, folder), tracker.JobTracker(STEPS, 1500, 60_000, by_arrival=True))
    query = tracked.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while query.isActive and time.time() < until and spark.table("tracked").where("kind = 'stale'").count() < 2:
            time.sleep(0.5)
        found = spark.table("tracked").collect()
    finally:
        query.stop()
    assert {(r["job_id"], r["kind"]) for r in found} == {(3, "pass"), (3, "stale"), (4, "stale")} and len(found) == 3
