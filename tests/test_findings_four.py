"""Findings of the fourth review: what failed before is held by a small case."""

import random

import duckdb
import pytest

from effortlens.operators import diffs, patterns
from effortlens.plans import features, registry
from effortlens.plans import patterns as plan
from effortlens.plans.check_sql import with_frames
from tests.compare import SF, cell, spark_rows


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edit_pairs_agree_with_sql_on_odd_lines(spark):
    head = "diff --git a/f b/f\n"
    texts = [
        head + "-é1 = a.b.c\n+é2 = a.b.c.d\n" * 60 + " kept\n-x\n-y\n+z\n+y \n",
        head + "-é1\n+1é\n \n+++\n---\n-Über 'q' \"r\"\n+Über 's'\n+import a.b\n-import  c\n",
        head + "-\n+\n-1\n@@\n+1\n\n-<SYSTEMATIC>\n+2",
        head,
    ]
    raw = "raw(sha, diff) AS (VALUES " + ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in enumerate(texts)) + ")"
    with duckdb.connect() as con:
        found = con.execute(with_frames("SELECT added, deleted, file_no, n, sha FROM pairs", raw, features.FILES, plan.PAIRS)).fetchall()
    files = diffs.split_files(spark.createDataFrame(list(enumerate(texts)), "sha int, diff string"))
    assert spark_rows(patterns.edit_pairs(files, ["sha"]))[1] == sorted(tuple(cell(x) for x in r) for r in found)


@pytest.mark.parametrize("name", ["edit_pairs", "top_patterns"])
def test_like_pairs_are_counted_in_their_file_and_texts_made_of_gathered_keys(spark, name):
    found = optimized(registry.QUERIES[name](spark, SF))
    assert "collect_list(struct(l_linenumber" in found  # no text is sorted by its order
    assert found.count("MapInArrow") == 1 and "inline(" not in found and "regexp_replace" not in found


@pytest.mark.parametrize("name", ["pattern_coverage", "bulk_edits"])
def test_coverage_makes_the_pairs_of_a_commit_once(spark, name):
    found = optimized(registry.QUERIES[name](spark, SF))
    assert found.count("MapInArrow") == 1 and "Join" not in found


def test_coverage_of_files_without_pairs_and_commits_without_a_name(spark):
    text = "".join(f"diff --git a/f{k} b/f{k}\n-old\n+new\n" for k in range(3)) + "diff --git a/g b/g\n+new\n"
    files = diffs.file_features(diffs.split_files(spark.createDataFrame([("s", text), (None, text), ("n", None)], "sha string, diff string")))
    found = {tuple(r) for r in patterns.pattern_coverage(files, ["sha"]).collect()}
    assert found == {(s, k, 1, int(k < 3), float(s is not None and k < 3), s is not None and k < 3) for s in ("s", None) for k in range(4)}


@pytest.mark.parametrize("name", ["move_overlaps", "moves"])
def test_moved_lines_are_compared_in_one_pass_by_commit_without_a_shuffle_of_texts(spark, name):
    df = registry.QUERIES[name](spark, SF)
    found = optimized(df)
    assert found.count("MapInArrow") == 1 and found.count("posexplode") == 1 and "xxhash64" not in found
    commits = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "Exchange" not in commits.split("posexplode")[0].split("SortMergeJoin")[0]


def test_overlaps_of_few_and_of_many_targets_against_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for sha, n in (("few", 8), ("many", 40)):
        for no in range(2 * n):
            lines = [f"  common {k}" for k in range(r.randrange(9))] + [f"line {r.randrange(2)} {k}\t" for k in range(r.randrange(30))] + ["abc", "  "]
            signs = [("-", "+")[r.randrange(10) < (9 if no % 2 else 1)] for _ in lines]
            rows.append((sha, no, "\n".join(s + x for s, x in zip(signs, lines, strict=True)), signs.count("+"), signs.count("-")))
    rows += [(None, no, rows[no][2], 40, 40) for no in range(8)] + [("none", 0, None, None, None)]
    wanted = set()
    content = lambda diff, sign: {x for line in diff.split("\n") if line[0] == sign and len(x := line[1:].strip()) > 3}
    for sha, a, gone, _, n_gone in rows:
        for other, b, come, n_come, _ in rows if sha in ("few", "many") else ():
            if sha == other and a != b and n_gone > 5 and n_come > 5:
                n = len(content(gone, "-") & content(come, "+"))
                if n > 10 and n / len(content(gone, "-")) > 0.4:
                    wanted.add((sha, a, b, n / len(content(gone, "-"))))
    files = spark.createDataFrame(rows, "sha string, file_no int, diff string, added int, deleted int").repartition(7)
    assert {tuple(x) for x in patterns.move_overlaps(files, ["sha"]).collect()} == wanted
    assert {x[0] for x in wanted} == {"few", "many"}
