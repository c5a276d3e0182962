"""Previews, ledgers, reconciliation and job health: aggregates over job, event and ledger frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preview_by_repo(scoped: DataFrame, cached: DataFrame) -> DataFrame:
    """Per repo: total, cached and new commits; ``cached`` has distinct (repo, dup_sha)."""
    hits = cached.select("repo", "dup_sha").distinct().withColumn("hit", F.lit(1))
    rows = scoped.select("repo", "dup_sha").distinct().join(hits, ["repo", "dup_sha"], "left")
    grouped = rows.groupBy("repo").agg(F.count("*").alias("total"), F.count("hit").alias("cached"))
    return grouped.withColumn("fresh", F.col("total") - F.col("cached"))


def billing_stats(jobs: DataFrame) -> DataFrame:
    """One scan: sums by status, circulation, and what finished jobs still hold."""
    done = F.col("status") == "COMPLETED"
    leak = F.col("reserved") - F.col("consumed") - F.col("released")
    return jobs.agg(
        F.sum("reserved").alias("reserved"),
        F.coalesce(F.sum(F.when(done, F.col("consumed"))), F.lit(0)).alias("consumed_done"),
        F.coalesce(F.sum(F.when(F.col("status") == "RUNNING", F.greatest(leak, F.lit(0)))), F.lit(0)).alias("held_running"),
        F.count_if(done & (leak > 0)).alias("leaks"),
        F.coalesce(F.sum(F.when(done & (leak > 0), leak)), F.lit(0)).alias("leaked"),
    )


def violations(jobs: DataFrame) -> DataFrame:
    """job_id, rule of every broken invariant of the ledger."""
    rules = {
        "consumed_over_reserved": F.col("consumed") > F.col("reserved"),
        "settled_over_reserved": F.col("consumed") + F.col("released") > F.col("reserved"),
        "terminal_with_remainder": (F.col("status") == "COMPLETED") & (F.col("consumed") + F.col("released") < F.col("reserved")),
    }
    broken = F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda r: r.isNotNull())
    return jobs.select("job_id", F.explode(broken).alias("rule"))


def running_balance(jobs: DataFrame) -> DataFrame:
    """The ledger of each user replayed in order of job."""
    w = Window.partitionBy("user_id").orderBy("created", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    return jobs.select("user_id", "job_id", F.sum(F.col("reserved") - F.col("consumed")).over(w).alias("balance"))


def debit(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.greatest(F.lit(0), F.col("reserved") - F.col("released") - F.col("consumed")).alias("debit"))


def watchdog(jobs: DataFrame, as_of: Column, stale_days: int = 365, max_retries: int = 3) -> DataFrame:
    """job_id, action of unfinished jobs: fail, retry, requeue or leave."""
    age = F.datediff(as_of, "created")
    action = (
        F.when((F.col("status") == "RUNNING") & (age > stale_days) & (F.col("retries") >= max_retries), "fail")
        .when((F.col("status") == "RUNNING") & (age > stale_days), "retry")
        .when((F.col("status") == "PENDING") & (age > stale_days), "requeue")
        .otherwise("leave")
    )
    return jobs.where("status <> 'COMPLETED'").select("job_id", action.alias("action"))


def latest_per(jobs: DataFrame, key: str) -> DataFrame:
    """The newest job of each key, the largest id on ties."""
    return jobs.groupBy(key).agg(F.max_by("job_id", F.struct("created", "job_id")).alias("job_id"), F.max("created").alias("created"))


def event_profile(events: DataFrame) -> DataFrame:
    """Per job: events, errors, last code, sum of the payload's k."""
    k = F.coalesce(F.try_to_number(F.get_json_object("payload", "$.k"), F.lit("999999999")), F.lit(0)).cast("long")
    return events.groupBy("job_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("code") == "error").alias("errors"),
        F.max_by("code", "event_id").alias("last_code"),
        F.sum(k).alias("k_sum"),
    )


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events of each job."""
    w = Window.partitionBy("job_id").orderBy(F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("job_id", "event_id", "rank")


def steps_done(events: DataFrame, steps: list[str]) -> DataFrame:
    """Per job: highest step reached and how many of the steps below it are missing."""
    place = F.lit(None).cast("int")
    for i, s in enumerate(steps):
        place = F.when(F.col("code") == s, i).otherwise(place)
    rows = events.select("job_id", place.alias("step")).where("step IS NOT NULL")
    return rows.groupBy("job_id").agg(F.max("step").alias("top"), (F.max("step") + 1 - F.countDistinct("step")).alias("missing"))


def progress(done: Column, total: Column, stored: Column) -> Column:
    return F.greatest(stored, F.least(F.lit(99), F.coalesce(F.floor(F.try_divide(done, total) * 90), F.lit(0))))
