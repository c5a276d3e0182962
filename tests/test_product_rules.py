"""Client events, estimator health, stuck jobs, reuse by user and the home page, rule by rule."""

import datetime
import json

from pyspark.sql import functions as F

from effortlens.operators import client, health, home, reports, scope

EVENTS = "job_id long, event_id long, code string, repo string, payload string"


def test_fields_of_payloads_count_only_as_what_they_are(spark):
    commit = {"subject": " ", "authorEmail": " Ann@X.org ", "authorName": "", "estimatedHours": "5", "filesCount": 0, "additions": 3, "category": "fix"}
    rows = [
        (1, 1, "LLM_COMMIT_RESULT", None, json.dumps(commit)),
        (1, 2, "LLM_COMMIT_RESULT", None, json.dumps({"authorEmail": "ann@x.org", "authorName": " Ann Lee ", "estimatedHours": 2.25, "filesCount": 4})),
        (1, 3, "LLM_COMMIT_RESULT", None, "[1]"),
        (1, 4, "REPO_PROCESS_DONE", "o/r", json.dumps({"totalAnalyzed": 7, "totalHours": 1.5})),
        (1, 5, "REPO_FULLY_CACHED", None, json.dumps({"cachedCount": "9", "commitCount": 4})),
        (1, 6, "REPO_CLONE_DONE", "o/r", "{}"),
        (1, 7, "HEARTBEAT_SENT", None, None),
        (1, 8, None, None, None),
        (1, 9, "REPO_CLONE_START", None, None),
    ]
    shown = client.client_events(spark.createDataFrame(rows, EVENTS))
    found = {(r["event_id"], r["seq"]): (r["text"].split(".")[1], dict(r["params"]), r["developer"], r["hours"]) for r in shown.collect()}
    assert found == {
        (1, 0): ("commitAnalyzed", {"subject": "commit", "developerName": "Ann"}, "Ann", None),
        (1, 1): ("linesChanged", {"lineCount": "3"}, None, None),
        (1, 2): ("changeType", {"type": "fix"}, None, None),
        (2, 0): ("commitAnalyzed", {"subject": "commit", "developerName": "Ann Lee"}, "Ann Lee", 2.25),
        (2, 1): ("filesChanged", {"fileCount": "4"}, None, None),
        (3, 0): ("commitAnalyzed", {"subject": "commit", "developerName": "Developer"}, None, None),
        (4, 0): ("repoCompleted", {"repo": "o/r", "commitCount": "7", "totalHours": "1.5"}, None, None),
        (5, 0): ("cachedResultsFound", {"count": "4"}, None, None),
        (9, 0): ("repoConnecting", {"repo": ""}, None, None),
    }
    board = client.leaderboard(shown, spark.createDataFrame([(1, 10, 50)], "job_id long, work_days long, progress long")).collect()
    assert [(r["name"], r["hours"], r["commits"], r["expected"]) for r in board] == [("Ann Lee", 2.25, 1, 15)]


def test_statuses_of_the_estimator(spark):
    commits = lambda rows: spark.createDataFrame(rows, "method string, model string, cents long, job_id string, analysed long")
    jobs = lambda rows: spark.createDataFrame(rows, "status string, updated long, heartbeat long")
    read = lambda c, j: health.estimator_health(commits(c), jobs(j), 1000, 10_000).first()
    empty = read([], [])
    assert [empty[c] for c in ("fallback_status", "holistic_status", "job_status", "attribution_status", "overall")] == ["na"] * 5
    good = read([("FD_v3_holistic", "m", 100, None, 2000)] * 99 + [("two_pass", "m", 500, None, 2000)], [("COMPLETED", 5000, None)])
    assert (good["fallback_rate"], good["holistic_share"], good["overall"]) == (1.0, 100.0, "pass")
    bad = read(
        [("FD_cheap", "m", 1, None, 2000), ("FD_v3_holistic", None, 1, None, 2000), ("error", None, 500, None, 2000), ("two_pass", "m", 500, "benchmark", 2000), ("two_pass", "m", 500, None, 10)],
        [("PENDING", 9900, None), ("PENDING", 9800, None), ("RUNNING", 9900, 9300), ("RUNNING", 9300, None), ("RUNNING", 9300, 9900), ("LLM_COMPLETE", 500, None)],
    )
    assert (bad["recent_commits"], bad["fallbacks"], bad["stale_pending"], bad["stale_running"], bad["stalled_post_processing"]) == (2, 0, 1, 2, 0)
    assert (bad["attribution_status"], bad["job_status"], bad["holistic_status"], bad["overall"]) == ("warn", "fail", "fail", "fail")


def test_why_jobs_hang(spark):
    jobs = spark.createDataFrame(
        [(1, "PENDING", None, None, 9000), (2, "PENDING", 9990, None, 9950), (3, "RUNNING", 9990, 9000, 9900), (4, "RUNNING", 9990, None, 9000), (5, "COMPLETED", 9000, None, 1000), (6, "COMPLETED", 9000, None, 9900)],
        "job_id long, status string, updated long, heartbeat long, created long",
    )
    levels = spark.createDataFrame([(2, "error"), (3, "info")], "job_id long, level string")
    events = spark.createDataFrame([(5, 1, "ok"), (6, 2, "ok"), (3, 3, "ok"), (3, 4, "retake"), (4, 5, "done"), (4, 6, "take"), (4, 7, "ok")], "job_id long, event_id long, code string")
    states = reports.steps_of_jobs(events, {"accepted": (("ok",), ()), "worker": (("take",), ("retake",)), "done": (("done",), ())})
    found = {r["job_id"]: r["reasons"] for r in reports.stuck_jobs(jobs, levels, states, F.lit(10_000)).collect()}
    assert found == {
        1: ["pending_too_long", "missing_step"],
        2: ["error_event"],
        3: ["heartbeat_stale"],
        4: ["heartbeat_stale"],
        5: ["accepted_without_worker", "missing_step"],
        6: ["accepted_without_worker"],
    }


def test_reuse_is_of_the_same_user_and_completed_orders(spark):
    day = lambda k: datetime.date(2024, 1, k)
    columns = "order_id long, repo string, dup_sha string, day date, cents long, sha string, job_id string, method string, model string"
    rows = [(o, "r", "x", day(k), 10 * o + k, f"s{o}{k}", None, m, "a") for o, k, m in ((1, 1, "m"), (2, 2, "m"), (2, 3, "error"), (3, 4, "m"), (4, 5, "m"), (5, 6, "m"))]
    users = spark.createDataFrame([(1, 1, "RUNNING"), (2, 1, "COMPLETED"), (3, 1, "COMPLETED"), (4, 1, "RUNNING"), (5, 2, "COMPLETED")], "order_id long, user_id long, status string")
    frame = spark.createDataFrame(rows, columns)
    found = {r["order_id"]: (r["from_order"], r["cents"]) for r in scope.reusable_by_user(frame, frame, users).collect()}
    assert found == {1: (3, 34), 2: (3, 34), 3: (2, 22), 4: (3, 34)}
    assert scope.reusable_by_user(frame, frame, users, model="b").count() == 0


def test_home_counts_a_commit_once(spark):
    day = lambda k: datetime.date(2024, 1, k)
    rows = spark.createDataFrame([("r1", "x", "a", day(1)), ("r1", "x", "b", day(2)), ("r1", "y", "b", day(3)), ("r2", "x", "c", day(4))], "repo string, dup_sha string, email string, day date")
    aliases = spark.createDataFrame([("b", 7), ("c", 7), ("a", None)], "email string, contributor_id long")
    projects = spark.createDataFrame([("r1", day(20)), ("r2", None), ("r3", datetime.date(2023, 1, 1))], "repo string, analysed date")
    found = {(r["section"], r["name"], r["status"]): (r["rank"], r["commits"], r["others"]) for r in home.home_detail(rows, aliases, projects, F.to_date(F.lit("2024-02-01"))).collect()}
    assert found == {
        ("total", "repositories", None): (1, 3, 2),
        ("total", "contributors", None): (2, 3, 1),
        ("contributor", "contributor 7", None): (1, 3, 2),
        ("repository", "r1", "fresh"): (1, 2, 1),
        ("repository", "r2", "never"): (2, 1, 1),
        ("freshness", "repositories", "fresh"): (1, 1, 0),
        ("freshness", "repositories", "never"): (1, 1, 0),
        ("freshness", "repositories", "stale"): (1, 1, 0),
    }
    nothing = home.home_detail(rows.limit(0), aliases, projects.limit(0), F.to_date(F.lit("2024-02-01"))).collect()
    assert sorted((r["name"], r["commits"]) for r in nothing) == [("contributors", 0), ("repositories", 0)]
