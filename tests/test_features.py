"""Odd inputs of the log parser, the diff features, the rules and the sinks."""

import pytest
from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import benchmarks, diffs, estimates, reports
from effortlens.sources.gitlog import parse_log

SHA = "0123456789abcdef0123456789abcdef01234567"


def test_git_log_of_odd_texts(spark):
    log = "\n".join(
        [
            "noise | a | b | c | d",
            f"{SHA}|A@x.org|Ann|2024-01-02|fix | with | pipes",
            "",
            "3\t1\tsrc/a b.py",
            "-\t-\timg.png",
            "",
            "10\t10\tafter the blank line",
            f"{SHA[::-1]}|b@x.org|Bo|2024-01-03|no statistics",
            f"{SHA[:39]}f|c@x.org|Cy|2024-01-04|directly",
            "5\t0\tx",
            "not a statistic",
            "7\t7\tnot counted",
            f"{SHA}|too|few",
        ]
    )
    rows = spark.createDataFrame([("r", log), ("n", None), ("e", "")], "repo string, log string")
    found = {r["sha"]: r for r in parse_log(rows).collect()}
    assert {s: (r["message"], r["added"], r["deleted"], r["n_files"]) for s, r in found.items()} == {
        SHA: ("fix | with | pipes", 3, 1, 2),
        SHA[::-1]: ("no statistics", 0, 0, 0),
        SHA[:39] + "f": ("directly", 5, 0, 1),
    }
    assert {r["email"] for r in parse_log(rows, excluded_emails=("a@X.ORG",)).collect()} == {"b@x.org", "c@x.org"}
    assert parse_log(rows.limit(0)).count() == 0


def test_diff_of_odd_texts(spark):
    text = "preface\ndiff --git a/x b/y b/z.md\n--- a/x\n+++ b/z.md\n+one\n-two\n++\n--\ndiff --git broken\n+a"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no files")], "sha int, diff string")
    found = diffs.file_features(diffs.split_files(rows)).orderBy("sha", "file_no").collect()
    assert [(r["sha"], r["file_no"], r["filename"], r["added"], r["deleted"], r["tags"]) for r in found] == [
        (1, 0, "z.md", 2, 2, ["docs"]),
        (1, 1, "diff --git broken", 1, 0, []),
    ]


def test_formatting_and_moves(spark):
    body = "\n".join(f"+  line {k}" for k in range(60)) + "\n" + "\n".join(f"-line {k}" for k in range(60))
    rows = spark.createDataFrame([(1, f"diff --git a/a.py b/a.py\n{body}")], "sha int, diff string")
    assert diffs.file_features(diffs.split_files(rows)).first()["tags"] == ["likely_move", "formatting_only"]


@pytest.mark.parametrize(
    ("branch", "holistic", "extra", "want"), [(4.0, 6.0, 1.0, 6.0), (1.0, 5.0, 0.0, 1.0), (0.0, 0.05, 0.5, 0.525), (3.0, 6.0, 0.0, 4.5)]
)
def test_combined_estimates(spark, branch, holistic, extra, want):
    got = spark.range(1).select(estimates.combined(F.lit(branch), F.lit(holistic), F.lit(extra)).alias("h")).first()["h"]
    assert got == pytest.approx(want)


def test_sinks_with_null_keys_and_ties(spark):
    schema = "k int, m int, v int, day int"
    old = spark.createDataFrame([(1, None, 10, 5), (2, 2, 20, 5)], schema)
    new = spark.createDataFrame([(1, None, 11, 3), (1, None, 12, 4), (3, 1, 30, 1), (3, 1, 30, 1)], schema)
    assert sorted(map(tuple, reports.upsert(old, new, ["k", "m"], "v", ("day",)).collect()), key=str) == [(1, None, 12, 5), (2, 2, 20, 5), (3, 1, 30, 1)]
    assert sorted(map(tuple, reports.insert_new(old, new, ["k", "m"]).collect()), key=str) == [(1, None, 10, 5), (2, 2, 20, 5), (3, 1, 30, 1)]
    assert reports.delete_where(old, F.col("m") == 2).count() == 1
    rows = spark.createDataFrame([("A", 2), ("a", 1), ("B", 3)], "name string, at int")
    assert sorted(map(tuple, reports.first_wins(rows, "name", "at").collect())) == [("B", 3), ("a", 1)]


def test_comparison_of_few_rows_has_no_correlation(spark):
    rows = spark.createDataFrame([("a", 5, None), ("b", 5, "x")], "sha string, cents int, category string")
    got = benchmarks.compare_runs(rows, rows).first()
    assert (got["matched"], got["r"], got["same_category_percent"]) == (2, None, 100.0)
    flat = spark.createDataFrame([(str(k), 5, "x") for k in range(4)], "sha string, cents int, category string")
    assert benchmarks.compare_runs(flat, flat).first()["r"] == 0.0


def test_scalars_of_odd_values(spark):
    row = spark.range(1).select(
        scalars.scrubbed(F.lit("api_key"), F.lit("x")).alias("a"),
        scalars.scrubbed(F.lit("url"), F.lit("https://u:p@h/x /home/ann/y")).alias("b"),
        scalars.worst_status(F.lit("na"), F.lit("warn"), F.lit("pass")).alias("c"),
        scalars.finite(F.lit(float("nan"))).alias("d"),
        scalars.seconds_since(F.lit(None).cast("double"), F.lit(5.0)).alias("e"),
        scalars.order_label(F.array(*[F.lit(x) for x in "abcde"])).alias("f"),
        scalars.last_name(F.lit("  ")).alias("g"),
        scalars.failure_class(F.lit("unauthorized, HTTP 503")).alias("h"),
        scalars.day_end(F.to_date(F.lit("2024-02-29"))).cast("string").alias("i"),
        scalars.seeded_random(F.lit(3)).between(0, 1).alias("j"),
        scalars.fingerprint(F.lit("a"), F.lit(None)).alias("k"),
    ).first()
    assert list(row)[:10] == ["***REDACTED***", "https://***@h/x <tmpdir>/y", "warn", 0.0, None, "a, b, c +2", "", "CONFIG_FATAL", "2024-02-29 23:59:59.999", True]
    assert len(row["k"]) == 64
