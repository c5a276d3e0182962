"""Health of the estimator over a window: counts of one scan a table, rates, statuses and the worst of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.functions.scalars import worst_status

# Methods by what they rest on, statuses of failed jobs, seconds after which a job is stale.
HEURISTIC_METHODS = ("FD_cheap", "FD_bulk_scaffold", "FD_v2_heuristic_only", "FD_v3_heuristic_only", "FD_v3_fallback", "FD_fallback")
LARGE_MODEL_METHODS = ("FD_v3_holistic", "FD_v2_single_holistic", "FD_v2_single_call", "FD_v2_cluster_holistic", "FD_v2_cluster")
HOLISTIC_METHODS = ("FD_v3_holistic",)
NON_HOLISTIC_METHODS = ("FD_v3_heuristic_only", "FD_v3_fallback")
SPECIAL_METHODS = ("root_commit_skip", "error")
FAILED = ("FAILED", "FAILED_RETRYABLE", "FAILED_FATAL")
STALE_PENDING, STALE_RUNNING, STALE_POST_PROCESSING = 120, 600, 300
FALLBACK_CENTS = 500


def misattributed() -> Column:
    """A model where none was asked, or none where a large one was."""
    named = F.col("method").isin(*HEURISTIC_METHODS, *SPECIAL_METHODS) & F.col("model").isNotNull()
    return named | (F.col("method").isin(*LARGE_MODEL_METHODS) & F.col("model").isNull())


def _few(issues: Column, seen: Column) -> Column:
    return F.when(issues > 2, "fail").when(issues > 0, "warn").when(seen > 0, "pass").otherwise("na")


def estimator_health(commits: DataFrame, jobs: DataFrame, since: int, now: int) -> DataFrame:
    """One row: thirteen counts, two rates in percent, four statuses and the overall one.

    commits (method, model, cents, job_id, analysed), jobs (status, updated, heartbeat); times in
    seconds. Commits of jobs of their own are left out. A running job without a heartbeat counts by
    its update.
    """
    method, model = F.col("method"), F.col("model")
    production = method.isNotNull() & ~method.isin(*SPECIAL_METHODS)
    counts = commits.where(F.col("job_id").isNull() & (F.col("analysed") >= since)).agg(
        F.count_if(production).alias("recent_commits"),
        F.count_if(production & (F.col("cents") == FALLBACK_CENTS)).alias("fallbacks"),
        F.count_if(method.startswith("FD")).alias("fd_total"),
        F.count_if(method.isin(*HOLISTIC_METHODS)).alias("fd_holistic"),
        F.count_if(method.isin(*NON_HOLISTIC_METHODS)).alias("fd_non_holistic"),
        F.count_if(method.isin(*HEURISTIC_METHODS) & model.isNotNull()).alias("heuristic_attributed"),
        F.count_if(method.isin(*SPECIAL_METHODS) & model.isNotNull()).alias("special_attributed"),
        F.count_if(method.isin(*LARGE_MODEL_METHODS) & model.isNull()).alias("model_missing"),
    )
    status, updated = F.col("status"), F.col("updated")
    between = lambda at, age: (at >= since) & (at < now - age)
    works = jobs.agg(
        F.count_if(updated >= since).alias("recent_jobs"),
        F.count_if(status.isin(*FAILED) & (updated >= since)).alias("failed_jobs"),
        F.count_if((status == "PENDING") & between(updated, STALE_PENDING)).alias("stale_pending"),
        F.count_if((status == "RUNNING") & between(F.coalesce("heartbeat", "updated"), STALE_RUNNING)).alias("stale_running"),
        F.count_if((status == "LLM_COMPLETE") & between(updated, STALE_POST_PROCESSING)).alias("stalled_post_processing"),
    )
    rows = counts.crossJoin(works)  # one row each
    percent = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100)
    rows = rows.withColumns({"fallback_rate": percent("fallbacks", "recent_commits"), "holistic_share": percent("fd_holistic", "fd_total")})
    low, high = F.col("fallback_rate"), F.col("holistic_share")
    issues = F.col("failed_jobs") + F.col("stale_pending") + F.col("stale_running") + F.col("stalled_post_processing")
    wrong = F.col("heuristic_attributed") + F.col("special_attributed") + F.col("model_missing")
    rows = rows.withColumns(
        {
            "fallback_status": F.when(low.isNull(), "na").when(low <= 1, "pass").when(low <= 3, "warn").otherwise("fail"),
            "holistic_status": F.when(high.isNull(), "na").when(high >= 95, "pass").when(high >= 80, "warn").otherwise("fail"),
            "job_status": _few(issues, F.col("recent_jobs")),
            "attribution_status": _few(wrong, F.col("recent_commits")),
        }
    )
    return rows.withColumn("overall", worst_status(*[F.col(c) for c in ("fallback_status", "holistic_status", "job_status", "attribution_status")]))


def suspicious(commits: DataFrame, since: int, most: int = 5) -> DataFrame:
    """The newest misattributed commits: sha, method, model, repo, analysed."""
    rows = commits.where(F.col("job_id").isNull() & (F.col("analysed") >= since) & misattributed())
    return rows.orderBy(F.col("analysed").desc(), "sha").limit(most).select("sha", "method", "model", "repo", "analysed")
