"""Aliases, merges and greedy groups: rules one by one, and random graphs against the loop."""

import json
import random

from effortlens.operators import projection

RAW = "order_id long, workspace long, developers string, mapping string"
ALIAS = "alias_id string, workspace long, provider string, provider_id string, email string, username string, contributor_id string, status string"
PERSON = "contributor_id string, workspace long, name string, email string"


def extracted(spark, developers, mapping=None):
    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    rows = projection.extract_aliases(spark.createDataFrame([(1, 7, text(developers), text(mapping))], RAW)).collect()
    return {r["email"]: (r["name"], r["username"], r["provider_id"], r["source"]) for r in rows}


def test_extraction(spark):
    devs = [{"email": " A@X.org ", "name": "", "login": "al"}, {"email": "b@x.org", "id": 5}, {"name": "nobody"}, {"email": "a@x.org", "name": "Ann", "username": "ann"}]
    groups = {"10": {"primary": {"email": "B@x.org"}, "merged_from": [{"email": "c@x.org", "login": "see"}, {"email": ""}]}, "9": {"primary": {"email": "c@x.org", "login": "x"}}, "z": None, "y": {"merged_from": [{"email": "d@x.org"}, {"email": "d@x.org", "id": 1}]}}
    found = extracted(spark, devs, groups)
    assert found == {
        "a@x.org": ("Ann", "ann", None, "primary"),  # the last of equal ones
        "b@x.org": ("b@x.org", None, "5", "primary"),  # chosen before a group's primary
        "c@x.org": ("see", "see", None, "merged_from"),  # its group comes first
        "d@x.org": ("d@x.org", None, None, "merged_from"),
    }
    assert extracted(spark, "no json", "[]") == {} and extracted(spark, None, None) == {}
    assert extracted(spark, [], {"g": {"primary": {"email": "p@x.org", "login": "pp"}}}) == {"p@x.org": ("p@x.org", "pp", None, "primary")}


def projected(spark, raw, aliases, people):
    rows = [(1, 7, e, n, u, p, projection.PROVIDER, s, [0, k, 0]) for k, (e, n, u, p, s) in enumerate(raw)]
    frame = spark.createDataFrame(rows, "order_id long, workspace long, email string, name string, username string, provider_id string, provider string, source string, rank array<int>")
    known = spark.createDataFrame([(a, 7, projection.PROVIDER, *rest) for a, *rest in aliases], ALIAS)
    made = projection.project(frame, known, spark.createDataFrame([(c, 7, n, e) for c, n, e in people], PERSON))
    return made, known


def test_projection_rules(spark):
    aliases = [
        ("m", "1", "old@x", "hand", "c1", "MANUAL"),
        ("n", None, "free@x", None, None, "MANUAL"),
        ("o", "2", "two@x", None, None, "SUGGESTED"),
        ("p", "3", "three@x", "tri", "c3", "AUTO_MERGED"),
        ("q", None, "new3@x", None, None, "UNRESOLVED"),
        ("r", "4", "four@x", None, "c4", "AUTO_MERGED"),
        ("s", None, "new4@x", None, "c4", "AUTO_MERGED"),
    ]
    people = [("c1", "One", "one@x"), ("c2", "Two", "two@x"), ("c3", "Three", "three@x"), ("c4", "Four", "four@x")]
    raw = [
        ("moved@x", "a", "newname", "1", "primary"),
        ("free@x", "b", "tri", None, "primary"),
        ("two@x", "c", None, "2", "merged_from"),
        ("new3@x", "d", None, "3", "primary"),
        ("new4@x", "e", None, "4", "primary"),
        ("first@x", "f", None, None, "primary"),
        ("lost@x", "g", None, None, "merged_from"),
        ("byname@x", "h", "tri", "99", "merged_from"),
    ]
    made, known = projected(spark, raw, aliases, people)
    got = {r["email"]: r for r in made.collect()}
    act = lambda e: (got[e]["action"], got[e]["alias_id"], got[e]["contributor_id"], got[e]["status"], got[e]["alias_email"], got[e]["absorbed"])
    assert act("moved@x") == ("touch", "m", "c1", "MANUAL", "moved@x", None)
    assert act("free@x") == ("touch", "n", None, "MANUAL", "free@x", None)  # manual: not attached, though c3 matches
    assert act("two@x") == ("attach", "o", "c2", "AUTO_MERGED", "two@x", None)
    assert act("new3@x") == ("touch", "p", "c3", "AUTO_MERGED", "new3@x", "q")  # the orphan is absorbed
    assert act("new4@x") == ("touch", "r", "c4", "AUTO_MERGED", "four@x", None)  # the e-mail belongs to another alias
    assert act("first@x")[0] == "found" and act("first@x")[2]
    assert act("lost@x") == ("queue", None, None, "UNRESOLVED", "lost@x", None)
    assert act("byname@x")[:4] == ("create", None, "c3", "AUTO_MERGED")
    after = {r["alias_id"]: r for r in projection.projected_aliases(made, known).collect()}
    assert len(after) == len(aliases) - 1 + 3 and "q" not in after and after["m"]["username"] == "newname"
    assert {r["email"] for r in projection.unresolved(projection.projected_aliases(made, known)).collect()} == {"free@x", "lost@x"}
    assert [r["name"] for r in projection.new_contributors(made).collect()] == ["f"]
    # what a second pass sees is settled
    again, _ = projected(spark, raw, [[r[c] for c in ("alias_id", "provider_id", "email", "username", "contributor_id", "status")] for r in after.values()], [*people, (act("first@x")[2], "f", "first@x")])
    assert {r["action"] for r in again.collect()} == {"touch"}


def test_merge_then_unmerge_restores(spark):
    aliases = spark.createDataFrame([(a, 7, "github", None, f"{a}@x", None, c, "MANUAL") for a, c in (("a1", "c1"), ("a2", "c1"), ("b1", "c2"), ("d1", "c4"))], ALIAS)
    people = spark.createDataFrame([("c1", 7, "One", "a1@x"), ("c2", 7, "b1@x", "b1@x"), ("c3", 8, "Other", "o@x"), ("c4", 7, "Four", "d1@x")], PERSON)
    asked = [("c2", "c1"), ("c1", "c1"), ("c9", "c1"), ("c1", "c3"), ("c4", "c9")]
    checked = projection.checked_merges(spark.createDataFrame(asked, "source string, target string"), people)
    assert {(r["source"], r["target"]): r["error"] for r in checked.collect()} == {
        ("c2", "c1"): None, ("c1", "c1"): "same contributor", ("c9", "c1"): "no such source", ("c1", "c3"): "other workspace", ("c4", "c9"): "no such target",
    }
    merged, left = projection.merge(checked, aliases, people)
    assert {r["alias_id"]: r["contributor_id"] for r in merged.collect()} == {"a1": "c1", "a2": "c1", "b1": "c1", "d1": "c4"}
    assert {r["contributor_id"] for r in left.collect()} == {"c1", "c3", "c4"}
    back = projection.checked_unmerges(spark.createDataFrame([("c1", ["b1"]), ("c4", ["d1"]), ("c3", ["a1"])], "contributor_id string, alias_ids array<string>"), merged, left)
    assert {r["contributor_id"]: r["error"] for r in back.collect()} == {"c1": None, "c4": "all aliases", "c3": "alias of another contributor"}
    restored, everyone = projection.unmerge(back, merged, left)
    name = {r["contributor_id"]: (r["name"], r["email"]) for r in everyone.collect()}
    before = {r["contributor_id"]: (r["name"], r["email"]) for r in people.collect()}
    assert sorted(name.values()) == sorted(before.values())
    owner = lambda rows, names: {r["alias_id"]: names[r["contributor_id"]] for r in rows.collect()}
    assert owner(restored, name) == owner(aliases, before)


def test_chains_and_circles_of_merges(spark):
    people = spark.createDataFrame([(f"c{i}", 1, "n", f"{i}@x") for i in range(40)], PERSON)
    asked = [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("c30", "c31"), ("c31", "c32"), ("c32", "c30"), ("c33", "c30"), ("c35", "c36"), ("c35", "c37")]
    found = {(r["source"], r["target"]): (r["error"], r["final"]) for r in projection.checked_merges(spark.createDataFrame(asked, "source string, target string"), people).collect()}
    assert all(found[f"c{i}", f"c{i + 1}"] == (None, "c20") for i in range(20))
    assert all(found[k] == ("merges end in a circle", None) for k in (("c30", "c31"), ("c31", "c32"), ("c32", "c30"), ("c33", "c30")))
    assert found["c35", "c36"][0] == found["c35", "c37"][0] == "source is merged twice"


def by_loop(people):
    """(email -> (seed, size)) of the sequential grouping."""
    def similar(a, b):
        x, y = a[2].lower().strip(), b[2].lower().strip()
        if (a[3] and a[3] == b[3]) or x == y:
            return True
        p, q = x.split(), y.split()
        return len(p) > 1 and len(q) > 1 and p[-1] == q[-1] and p[0][0] == q[0][0]

    done, out = set(), {}
    people = sorted({p[1]: p for p in sorted(people, reverse=True)}.values())  # the first row of each e-mail
    for i, a in enumerate(people):
        if a[1] in done:
            continue
        done.add(a[1])
        group = [a[1]]
        for b in people[i + 1 :]:
            if b[1] not in done and similar(a, b):
                done.add(b[1])
                group.append(b[1])
        out |= {e: (a[0], len(group)) for e in group}
    return out


def test_greedy_groups_against_the_loop(spark):
    for seed in range(4):
        r = random.Random(seed)
        n = 60 if seed else 300
        people = [(k, f"e{r.randrange(n)}", " ".join(filter(None, [r.choice(["Ann", "Al", "Bo", ""]), f"Last{r.randrange(n // 4)}" if r.random() < 0.8 else ""])), r.choice([None, "", f"u{r.randrange(n // 3)}"])) for k in range(n)]
        found = projection.greedy_groups(spark.createDataFrame(people, "rank long, email string, name string, login string")).collect()
        assert {x["email"]: (x["seed"], x["size"]) for x in found} == by_loop(people)
    # a chain: each shares a login with the one before and a name with the one after
    chain = [(k, f"e{k}", f"Name{k // 2} X{k // 2}", f"u{(k + 1) // 2}") for k in range(30)]
    found = projection.greedy_groups(spark.createDataFrame(chain, "rank long, email string, name string, login string")).collect()
    assert {x["email"]: (x["seed"], x["size"]) for x in found} == by_loop(chain)
    assert projection.greedy_groups(spark.createDataFrame([], "rank long, email string, name string, login string")).collect() == []
