"""Scalar functions over the tables, and the gate of a baseline: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import accuracy, benchmarks, estimates, residuals
from effortlens.plans.check_sql import COMMITS, EVENTS, with_frames
from effortlens.sources.documents import order_repos
from effortlens.sources.tables import commits, ground_truth, job_events, table
from effortlens.storage import checkpointed

#: Metrics that a baseline asks for; one of them never has a sample.
_REQUIRED = ("view", "click", "purchase", "never")


def _labels(spark, d):
    """Every line item's numbers as shares, ratios, labels, times and scrubbed settings."""
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    cents, share = F.floor(F.col("l_quantity") * 10 + 0.5).cast("long"), (k % 9 - 1) / 4
    at = F.to_timestamp("l_shipdate")
    names = F.transform(F.sequence(F.lit(1), (k % 6 + 1).cast("int")), lambda i: F.concat(F.lit("repo"), i.cast("string")))
    names = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(names)
    value = F.when(p % 11 == 0, F.lit(float("nan"))).when(p % 11 == 1, F.lit(float("-inf"))).when(p % 11 == 2, F.lit(None).cast("double")).otherwise(F.col("l_discount").cast("double"))
    setting = F.element_at(F.array(F.lit("API_KEY"), F.lit("url"), F.lit("folder")), (n % 3 + 1).cast("int"))
    text = F.element_at(F.array(F.lit("https://me:pw@host/x"), F.concat(F.lit("/home/u"), (k % 5).cast("string"), F.lit("/repo")), F.concat(F.lit("/tmp/a"), (p % 5).cast("string"), F.lit("/b"))), (k % 3 + 1).cast("int"))
    ratio = scalars.ratio(cents, k % 3, share)
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(ratio, 6).alias("ratio"),
        scalars.ratio_label(ratio).alias("label"),
        F.round(scalars.auto_share((p % 13).cast("double"), (k % 20).cast("double")), 6).alias("share"),
        scalars.utc_day(at).alias("day"),
        F.unix_millis(scalars.day_start(F.to_date("l_shipdate"))).alias("starts_ms"),
        F.unix_millis(scalars.day_end(F.to_date("l_shipdate"))).alias("ends_ms"),
        scalars.seconds_since(F.when(n % 4 != 0, k * 1.5), F.lit(5000)).alias("since"),
        scalars.order_label(names).alias("order_label"),
        scalars.finite(value).alias("finite"),
        scalars.scrubbed(setting, text).alias("scrubbed"),
        scalars.fingerprint(k, F.when(n % 2 == 0, n), setting).alias("fingerprint"),
        estimates.root_or_failed(cents / 100, k % 10 == 1, p % 8 == 3).alias("hours"),
    )


def _gate(spark, d):
    required = spark.createDataFrame([(m,) for m in _REQUIRED], "metric string")
    samples = job_events(spark, d).select(F.col("code").alias("metric"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return benchmarks.metric_gate(samples, required, 50)


def _report_metrics(spark, d):
    """Samples of each metric in the reports of users (a report is an hour of a user): how many, in how many reports, least, most, mean, and samples a report."""
    rows = job_events(spark, d).select(F.col("code").alias("metric"), F.concat_ws("-", "job_id", F.floor(F.col("second") / 3600)).alias("report"), "value")
    return benchmarks.report_metrics(rows).withColumns({c: F.round(c, 6) for c in ("mean", "per_report")})


def _order_repos(spark, d):
    """Each order's repositories out of JSON: names in both spellings, some twice in other case, some without an owner or a name."""
    k, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    name = F.concat(F.when(n % 3 == 0, F.lit("Org/Repo")).otherwise("org/repo"), (k % 4).cast("string"))
    element = F.struct(
        F.when((p % 2 == 0) & (p % 10 != 0), name).alias("full_name"), F.when(p % 2 == 1, name).alias("fullName"), F.when(p % 3 == 0, p).alias("stars"), F.when(p % 5 == 0, "Go").alias("language"), F.when(n % 2 == 0, True).alias("private"),
    )
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(n, k, p, element.alias("e")))), lambda x: x["e"])).alias("selected_repos"))
    return order_repos(rows).select("order_id", "full_name", "owner", "name", "stars", "language", "is_private")


def _residuals(spark, d):
    """Commits that were held out: how far estimates are from the experts' median before and after the correction, in whole cents."""
    truth = ground_truth(spark, d)
    rows = commits(spark, d).join(accuracy.estimates(truth), "sha").select("sha", F.col("cents").cast("double").alias("estimate"), "n", "total", "lo", "hi", F.substring("repo", 9, 2).cast("double").alias("repo_no"), "category", "method")
    rows = accuracy.with_consensus(checkpointed(residuals.with_folds(rows, "sha")), truth, "truth")
    judged = residuals.corrected(rows, residuals.fit(rows, ["estimate", "repo_no"], ["category", "method"]))
    return residuals.errors(judged).select("n", *[F.round(c).cast("long").alias(c) for c in ("mae_before", "mae_after")])


QUERIES = {
    "residual_correction": (_residuals, None),
    "scalar_labels": (
        _labels,
        r"""WITH x AS (SELECT *, CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) AS cents, (l_orderkey % 9 - 1) / 4 AS share0, ['API_KEY', 'url', 'folder'][l_linenumber % 3 + 1] AS setting,
          ['https://me:pw@host/x', '/home/u' || (l_orderkey % 5) || '/repo', '/tmp/a' || (l_partkey % 5) || '/b'][l_orderkey % 3 + 1] AS txt, CAST(l_shipdate AS DATE) AS day0, [('repo' || i) for i in range(1, l_orderkey % 6 + 2)] AS names FROM lineitem),
        y AS (SELECT *, CASE WHEN l_orderkey % 3 >= 1 AND share0 > 0 THEN cents * 100.0::DOUBLE / (l_orderkey % 3 * 300) / share0 END AS r FROM x)
        SELECT l_orderkey, l_linenumber, round(r, 6) AS ratio, coalesce(CAST(CAST(floor(r + 0.5) AS BIGINT) AS VARCHAR) || '%', 'N/A') AS label,
          round(CASE WHEN l_orderkey % 20 = 0 OR l_partkey % 13 >= l_orderkey % 20 THEN 1.0::DOUBLE ELSE (l_partkey % 13) / (l_orderkey % 20) END, 6) AS share, strftime(day0, '%Y-%m-%d') AS day, epoch_ms(CAST(day0 AS TIMESTAMP)) AS starts_ms,
          epoch_ms(CAST(day0 + 1 AS TIMESTAMP)) - 1 AS ends_ms, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(greatest(0, floor(5000 - l_orderkey * 1.5::DOUBLE)) AS BIGINT) END AS since,
          CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3) ELSE '' END END AS order_label,
          CASE l_partkey % 11 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS finite,
          CASE WHEN setting = 'API_KEY' THEN '***REDACTED***' ELSE CASE l_orderkey % 3 WHEN 0 THEN 'https://***@host/x' WHEN 1 THEN '<tmpdir>/repo' ELSE '<tmpdir>/b' END END AS scrubbed,
          sha256(l_orderkey || '|' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END || '|' || setting) AS fingerprint,
          CASE WHEN l_orderkey % 10 = 1 THEN 0.5::DOUBLE WHEN l_partkey % 8 = 3 THEN 5.0 ELSE cents / 100 END AS hours FROM y""",
    ),
    "baseline_gate": (
        _gate,
        with_frames(f"SELECT m AS metric, count(value) AS n, count(value) >= 50 AS enough FROM unnest({list(_REQUIRED)}) AS u(m) LEFT JOIN (SELECT code, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM ev) ON code = m GROUP BY m", EVENTS),
    ),
    "report_metrics": (
        _report_metrics,
        with_frames(
            "SELECT code AS metric, count(value) AS n, count(DISTINCT job_id || '-' || (second // 3600)) AS n_reports, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(count(value) / count(DISTINCT job_id || '-' || (second // 3600)), 6) AS per_report FROM ev GROUP BY code",
            EVENTS,
        ),
    ),
    "order_repos": (
        _order_repos,
        """WITH r AS (SELECT l_orderkey AS order_id, CASE WHEN l_linenumber % 3 = 0 THEN 'Org/Repo' ELSE 'org/repo' END || (l_suppkey % 4) AS full_name, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS stars, CASE WHEN l_partkey % 5 = 0 THEN 'Go' END AS language,
          CASE WHEN l_linenumber % 2 = 0 THEN TRUE END AS is_private FROM lineitem WHERE l_partkey % 10 <> 0
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(CASE WHEN l_linenumber % 3 = 0 THEN 'Org/Repo' ELSE 'org/repo' END || (l_suppkey % 4)) ORDER BY l_linenumber, l_suppkey, l_partkey) = 1)
        SELECT order_id, full_name, string_split(full_name, '/')[1] AS owner, string_split(full_name, '/')[2] AS name, stars, language, is_private FROM r""",
    ),
    "commit_shortcuts": (
        lambda spark, d: commits(spark, d).groupBy(estimates.root_or_failed(F.col("cents") / 100, F.coalesce(F.col("method") == "root_commit", F.lit(False)), F.coalesce(F.col("method") == "error", F.lit(False))).alias("hours")).agg(F.count("*").alias("n")),
        with_frames("SELECT CASE method WHEN 'root_commit' THEN 0.5::DOUBLE WHEN 'error' THEN 5.0 ELSE cents / 100 END AS hours, count(*) AS n FROM commits GROUP BY 1", COMMITS),
    ),
}
