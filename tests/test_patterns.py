"""Repeated edits, moved code and groups of developers against plain reckonings, and on odd inputs."""

import random
import re
from collections import Counter

import pytest

from effortlens.operators import diffs, identity, patterns
from effortlens.plans import patterns as plan
from effortlens.plans import registry
from tests.compare import SF
from tests.test_identity import match

RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def files_of(spark, rows):
    return diffs.file_features(diffs.split_files(spark.createDataFrame(rows, "sha string, diff string")))


def one_file(name, *lines):
    return "\n".join([f"diff --git a/{name} b/{name}", *lines]) + "\n"


def test_pairs_of_odd_diffs(spark):
    text = one_file("a.py", "-x = 1", "-gone", "+x = 2", "@@", "-  same", "+same  ", "-", "+", "--- a", "+only added", " kept", "-b('u')", "+c(\"v\")", "-\t", "+new")
    rows = files_of(spark, [("s", text), ("n", None), ("e", ""), ("p", "no file at all")])
    found = {(r["sha"], r["deleted"], r["added"]): r["n"] for r in patterns.edit_pairs(rows, ["sha"]).collect()}
    # The sign of "--- a" makes it no change, so it parts the run before it.
    assert found == {("s", "x = <NUM>", patterns.SYSTEMATIC): 1, ("s", "b('<STR>')", 'c("<STR>")'): 1, ("s", "", "new"): 1}
    assert patterns.bulk_edits(rows.limit(0), ["sha"]).count() == 0


@pytest.mark.parametrize("n_like,n_other,wanted", [(4, 0, (4, 0, False)), (5, 0, (5, 5, True)), (2, 10, (12, 0, False)), (3, 7, (10, 3, True)), (3, 18, (21, 21, True))])
def test_bulk_edits_by_hand(spark, n_like, n_other, wanted):
    like = [one_file(f"f{i}", "-old_name()", "+new_name()") for i in range(n_like)]
    other = [one_file(f"g{i}", f"-{chr(97 + i) * 3}", f"+{chr(97 + i) * 4}") for i in range(n_other)]
    row = patterns.bulk_edits(files_of(spark, [("s", "".join(like + other))]), ["sha"]).first()
    assert (row["n_files"], row["n_patterned"], row["is_bulk"]) == wanted


def plain_moves(files, message):
    """n_pairs, mean overlap and type of the commit, or None."""
    content = lambda f, s: {x for line in f["diff"].split("\n") if line.startswith(s) and not line.startswith(s * 2) and len(x := line[1:].strip()) > 3}
    come, gone = sum(f["added"] for f in files), sum(f["deleted"] for f in files)
    ratio = min(come, gone) / max(come, gone) if come and gone else 0
    named = bool(message and re.search(patterns.MOVE, message))
    if not files or (not named and ratio < 0.6):
        return None
    used, shares = set(), []
    for f in files:
        lines = content(f, "-") if f["deleted"] > 5 else set()
        options = []
        for g in files:
            both = len(lines & content(g, "+")) if g["added"] > 5 and g is not f and g["file_no"] not in used else 0
            if both > 10 and both / len(lines) > 0.4:
                options.append((-both / len(lines), g["file_no"]))
        if options:
            used.add(min(options)[1])
            shares.append(-min(options)[0])
    if not shares and not (named and ratio > 0.7):
        return None
    mean, n = sum(shares) / len(shares) if shares else 0.0, len(files)
    new_unit = any(f["added"] > 2 and f["deleted"] < 3 and re.search(diffs.any_of(diffs.ARTEFACTS), f["filename"]) for f in files)
    if new_unit or (n > 15 and message and re.search(patterns.NEW_UNIT, message)):
        return len(shares), mean, "ARCHITECTURAL_EXTRACT"
    return len(shares), mean, "SIMPLE_MOVE" if n < 5 and mean > 0.75 and message and re.search(patterns.PLAIN_MOVE, message) else "MODULE_EXTRACT"


def test_moves_against_all_pairs(spark):
    files = {}
    for r in sorted(plan._moved_files(spark, SF).collect(), key=lambda r: r["file_no"]):
        files.setdefault(r["sha"], []).append(r)
    messages = {r["sha"]: r["message"] for r in plan._messages(spark, SF).collect()}
    found = {r["sha"]: (r["n_pairs"], r["overlap"], r["move_type"]) if r["is_move"] else None for r in registry.QUERIES["moves"](spark, SF).collect()}
    wanted = {s: plain_moves(files.get(s, []), m) for s, m in messages.items()}
    assert found == {s: m and (m[0], pytest.approx(m[1], abs=1e-6), m[2]) for s, m in wanted.items()}
    assert {m[2] for m in wanted.values() if m} >= {"SIMPLE_MOVE", "MODULE_EXTRACT"} and None in wanted.values()


def test_moves_to_a_new_unit_and_without_files(spark):
    lines = [f"line {i} of it" for i in range(30)]
    text = one_file("old.rs", *[f"-{x}" for x in lines]) + one_file("new/lib.rs", *[f"+{x}" for x in lines]) + one_file("new/Cargo.toml", "+a", "+b", "+c")
    rows = files_of(spark, [("s", text)])
    messages = spark.createDataFrame([("s", None), ("t", "move nothing")], "sha string, message string")
    found = {r["sha"]: (r["n_files"], r["n_pairs"], r["is_move"], r["move_type"]) for r in patterns.moves(rows, messages, ["sha"]).collect()}
    assert found == {"s": (3, 1, True, "ARCHITECTURAL_EXTRACT"), "t": (0, 0, False, None)}


def test_developer_groups_against_all_pairs(spark):
    people = [tuple(r) for r in plan._developers(spark, SF).select("id", "name", "login", "email", "commits").collect()]
    saved = {}
    for r in plan._saved(spark, SF).collect():
        for mail in (r["email"].lower(), r["primary_email"].lower()):
            saved[mail] = min(saved.get(mail, "~"), r["primary_email"].lower())
    wanted, free = {}, [p for p in people if p[3].lower() not in saved]
    for head in set(saved.values()):
        members = [p for p in people if saved.get(p[3].lower()) == head]
        primary = min((p[0] for p in members if p[3].lower() == head), default=None)
        wanted |= {p[0]: (min(q[0] for q in members), primary, None, False, True) for p in members}
    pairs = [(p[0], q[0], m[0]) for i, p in enumerate(free) for q in free[i + 1 :] if (m := match(p, q))]
    group = {p[0]: p[0] for p in free}
    moved = True
    while moved:
        moved = False
        for a, b, _ in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                moved = True
    best = {}
    for a, _, c in pairs:
        best[group[a]] = max(best.get(group[a], "LOW"), c, key=RANK.get)
    for g in set(group.values()):
        members = [p for p in free if group[p[0]] == g]
        primary = min(members, key=lambda p: (-(p[4] or 0), p[0]))[0]
        wanted |= {p[0]: (g, primary, best.get(g), best.get(g) == "HIGH", False) for p in members}
    rows = registry.QUERIES["developer_groups_ranked"](spark, SF).collect()
    assert len(rows) == len(people)
    assert {r["id"]: (r["group_id"], r["primary_id"], r["confidence"], r["auto_merged"], r["is_saved"]) for r in rows} == wanted
    assert any(w[4] for w in wanted.values()) and any(w[3] for w in wanted.values())


def test_developer_groups_of_nobody_and_without_saved_ones(spark):
    schema = "id long, name string, login string, email string, commits long"
    people = spark.createDataFrame([(1, "Ann Smith", None, "a@x.org", None), (2, "ann  smith", None, "b@x.org", 3), (3, None, None, None, None)], schema)
    saved = spark.createDataFrame([], "email string, primary_email string")
    found = {r["id"]: (r["group_id"], r["primary_id"], r["confidence"]) for r in identity.developer_groups(people, saved).collect()}
    assert found == {1: (1, 2, "HIGH"), 2: (1, 2, "HIGH"), 3: (3, 3, None)}
    assert identity.developer_groups(people.limit(0), saved).count() == 0


def plain_authors(rows):
    rows = [(m.lower(), n or None, g or None, r, d) for m, n, g, r, d in rows if m]
    head = {m: m for m, *_ in rows}
    for _ in head:
        for login in {g for _, _, g, _, _ in rows if g}:
            mails = {m for m, _, g, _, _ in rows if g == login}
            least = min(head[m] for m in mails)
            head |= {m: least for m in mails}
    out = {}
    for h in set(head.values()):
        mine = [r for r in rows if head[r[0]] == h]
        first = lambda k: min(((r[4], r[k]) for r in mine if r[k]), default=(None, None))[1]  # noqa: E731, B023
        out[h] = (len({r[0] for r in mine}), first(1), first(2), len(mine), len({r[3] for r in mine}), min(r[4] for r in mine), max(r[4] for r in mine))
    return out


def test_author_groups_against_a_plain_reckoning(spark):
    r = random.Random(3)
    mails = ["a@x", "A@X", "b@x", "c@x", "d@x", "e@x", "", None]
    rows = [(r.choice(mails), r.choice(("Ann", "Bo", "", None)), r.choice(("u1", "u2", "u3", "", None, None, None)), r.choice("pqr"), f"2024-01-{r.randrange(1, 28):02}") for _ in range(12)]
    rows += [("z@x", "Zed", None, "p", "2024-02-01")] * 2
    for part in (rows, rows[:5], [(None, "x", "u", "p", "2024-01-01")]):
        found = {x["email"]: tuple(x)[1:] for x in identity.author_groups(spark.createDataFrame(part, "email string, name string, login string, repo string, day string")).collect()}
        assert found == plain_authors(part)


def test_author_groups_leave_no_commit_out(spark):
    rows = plan._authors(spark, SF).collect()
    found = registry.QUERIES["author_groups"](spark, SF).collect()
    assert {x["email"]: tuple(x)[1:] for x in found} == plain_authors([tuple(x) for x in rows])
    assert Counter(x["emails"] > 1 for x in found)[True] > 0
