"""Pacing, calibration and clusters against plain loops."""

import math
import random

from effortlens.operators import calibration, clusters, pacing

EVENTS = "session long, event_id long, poll_ms long, tier string"


def paced_by_loop(rows):
    seen = {}
    for session, event, poll, tier in sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or "")):
        seen.setdefault((session, event), (poll, tier))
    polls = {}
    for (session, event), (poll, tier) in seen.items():
        polls.setdefault(session, {}).setdefault(poll, []).append((event, tier))
    out = {}
    for session, by_poll in polls.items():
        before, shown = None, None
        for poll in sorted(by_poll):
            budget = (poll - before if before is not None else pacing.FIRST_INTERVAL_MS) * pacing.PADDING
            before = poll
            events = sorted(by_poll[poll])
            tiers = [t if t in pacing.WEIGHTS else pacing.OTHER for _, t in events]
            weights = sum(pacing.WEIGHTS[t] for t in tiers)
            delays = [math.floor(max(pacing.BOUNDS[t][0], min(pacing.BOUNDS[t][1], budget / weights * pacing.WEIGHTS[t])) * 1000 + 0.5) for t in tiers]
            most, asked = math.floor(budget * 1000 + 0.5), sum(delays)
            if asked > most:
                delays = [max(pacing.FLOOR_MS * 1000, math.floor(d * most / asked + 0.5)) for d in delays]
            for (event, _), d in zip(events, delays, strict=True):
                shown = max(poll * 1000, shown if shown is not None else poll * 1000) + d
                out[session, event] = (poll, d, shown)
    return out


def test_release_times_against_a_loop(spark):
    r = random.Random(4)
    rows = []
    for session in (1, 2, 3):
        at, event = 1000, 0
        for _ in range(60 if session == 1 else 8):
            at += r.choice([100, 400, 1000, 5000])
            for _ in range(r.choice([0, 1, 3, 12, 60])):
                event += 1
                rows.append((session, event, at, r.choice(["milestone", "major", "micro", "odd", None])))
            rows += [(s, e, at, "micro") for s, e, _, _ in r.sample(rows, min(4, len(rows))) if s == session]  # seen before
    want = paced_by_loop(rows)
    delayed = pacing.delays(pacing.first_seen(spark.createDataFrame(rows, EVENTS)))
    for n_ranges in (None, 7):
        shown = pacing.released(delayed, n_ranges)
        found = {(x["session"], x["event_id"]): (x["poll_ms"], x["delay_us"], x["release_us"]) for x in shown.collect()}
        assert found == want
    waiting = {(x["session"], x["event_id"]): (x["waiting"], x["catch_up"]) for x in pacing.backlog(shown, 20).collect()}
    for (session, event), (_, _, release) in want.items():
        n = sum(s == session and p * 1000 <= release < t for (s, _), (p, _, t) in want.items())
        assert waiting[session, event] == (n, n > 20)


def fitted_by_loop(rows):
    out = {}
    for scope in {s for s, e, t in rows if None not in (s, e, t)}:
        own = sorted((e, t) for s, e, t in rows if s == scope and e is not None and t is not None)
        out[scope] = calibration.pool([(e, e, sum(t for x, t in own if x == e), sum(x == e for x, _ in own)) for e in sorted({e for e, _ in own})])
    return out


def test_pooling_against_one_pass(spark):
    r = random.Random(3)
    rows = [(s, e, max(0, int(e * 0.8 + r.gauss(0, 200))), k) for k in range(2500) for s, e in [(r.choice(["fd", "module", "none"]), r.randrange(0, 2000, r.choice([1, 10])))]]
    rows += [("falling", e, 1000 - e, 0) for e in range(300)] + [("rising", e, e, 0) for e in range(300)] + [("one", 5, 7, 0), (None, 1, 1, 0), ("one", None, 3, 0), ("one", 9, None, 0)]
    frame = spark.createDataFrame(rows, "scope string, estimate long, truth long, k long")
    want = fitted_by_loop([x[:3] for x in rows])
    for n_ranges in (None, 9):
        blocks = calibration.fit(frame, n_ranges)
        found = {}
        for b in blocks.collect():
            found.setdefault(b["scope"], []).append((b["low"], b["high"], b["total"], b["weight"]))
        assert {s: sorted(b) for s, b in found.items()} == want
    assert all(a[2] * b[3] < b[2] * a[3] for s in want.values() for a, b in zip(s, s[1:], strict=False))
    assert len(want["falling"]) == 1 and len(want["rising"]) == 300

    def value(scope, x):
        found = want.get(scope)
        if not found or x is None:
            return None
        for (_, high, t, w), (low, _, t2, w2) in zip(found, found[1:], strict=False):
            if high < x < low:
                return t / w + (x - high) / (low - high) * (t2 / w2 - t / w)
        return next((t / w for low, high, t, w in found if x <= high), found[-1][2] / found[-1][3])

    asked = [(s, x) for s in ("fd", "module", "one", "falling", "unknown", None) for x in (-5, 0, 3, 777, 1999, 5000, None)]
    for x in calibration.calibrated(spark.createDataFrame(asked, "scope string, estimate long"), blocks).collect():
        v = value(x["scope"], x["estimate"])
        assert (x["calibrated"] is None) == (v is None) and (v is None or abs(x["calibrated"] - v) < 1e-9)
    assert calibration.fit(frame.limit(0)).collect() == []


def clusters_by_loop(files):
    """(name, file numbers) of one commit, merged one at a time."""
    groups = {}
    for no, (directory, role) in enumerate(files):
        groups.setdefault(directory, {}).setdefault(role, []).append(no)
    found = [[d, (f"{d}/{r}" if d and r != clusters.GENERAL else d or r).strip("/"), list(n)] for d, roles in groups.items() for r, n in roles.items()]
    changed = True
    while changed:
        changed = False
        for s in [c for c in found if len(c[2]) < clusters.MIN_FILES]:
            best, most = None, 0
            for c in found:
                if c is s or c[0] == s[0] or len(c[2]) + len(s[2]) > clusters.MAX_FILES:
                    continue
                agree = sum(a == b for a, b in zip(s[0].split("/"), c[0].split("/"), strict=False))
                if agree > most:
                    best, most = c, agree
            if best:
                best[2] += s[2]
                found = [c for c in found if c is not s]
                changed = True
                break
    while len(found) > clusters.MAX_CLUSTERS:
        found.sort(key=lambda c: len(c[2]))
        small = found.pop(0)
        found[0][2] += small[2]
    return {(name, tuple(sorted(n))) for _, name, n in found}


def test_clusters_against_one_at_a_time(spark):
    rows, want = [], {}
    for sha in range(14):
        r = random.Random(sha)
        n = r.choice([1, 5, 40, 150])
        names = ["/".join(r.choices(["src", "a", "b", "c", "d"], k=r.randrange(0, 4)) + [r.choice(["x.py", "y.service.ts", "z.dto.ts", "Main.Model.kt"])]) for _ in range(n)]
        rows += [(f"s{sha}", k, name, k + 1, k % 3) for k, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "sha string, file_no long, filename string, added long, deleted long").repartition(5)
    placed = clusters.file_clusters(frame).collect()
    for sha in {x[0] for x in rows}:
        mine = sorted((x for x in placed if x["sha"] == sha), key=lambda x: x["file_no"])
        found = {}
        for x in mine:
            found.setdefault((x["cluster_no"], x["cluster"]), []).append(x["file_no"])
        assert {(name, tuple(n)) for (_, name), n in found.items()} == clusters_by_loop([(x["directory"], x["role"]) for x in mine])
    sums = clusters.clusters(frame)
    assert sums.groupBy("sha").count().agg({"count": "max"}).first()[0] <= 15
    assert sums.agg({"n_files": "sum"}).first()[0] == len(rows)
    named = {x["filename"]: (x["directory"], x["role"]) for x in placed}
    assert named.get("src/a/x.py", ("a", "_general")) == ("a", "_general")


def test_directories_and_roles(spark):
    names = ["x.py", "src/x.py", "lib/a/b.service.ts", "a\\b\\C.Guard.js", "/top/x", "pkg/src/x.helper.util"]
    rows = spark.createDataFrame([(n,) for n in names], "f string").select(clusters.directory(clusters.F.col("f")), clusters.role(clusters.F.col("f"))).collect()
    assert [tuple(x) for x in rows] == [("", "_general"), ("", "_general"), ("a", "services"), ("a/b", "guards"), ("/top", "_general"), ("pkg/src", "utils")]


def test_a_commit_of_many_directories_is_bounded():
    directories = [f"r{k % 5}/d{k}/e{k % 7}" for k in range(6000)]
    into = clusters.merged(directories, [1] * len(directories))
    assert len(set(into)) <= 15
