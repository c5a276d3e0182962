"""The home page of a workspace: totals, the leading contributors and repositories, and how fresh repositories are.

Commits in scope are reduced once, to a row per repository and address; contributors, repositories and
totals are all summed from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.functions.scalars import freshness
from effortlens.operators.scope import newest_per
from effortlens.operators.temporal import attributed
from effortlens.storage import checkpointed

TOP = 5


def in_scope(commits: DataFrame, start: str | None = None, end: str | None = None, repos: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Commits from ``start`` to ``end``, of the repositories ``repos`` (repo) and of authors while they were in a team of ``members``."""
    rows = commits
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    if repos is not None:
        rows = rows.join(repos.select("repo").distinct(), "repo", "left_semi")
    if members is not None:
        rows = attributed(rows, members).drop("team").distinct()
    return rows


def home_detail(scoped: DataFrame, aliases: DataFrame, projects: DataFrame, as_of: Column, top: int = TOP) -> DataFrame:
    """section, rank, name, commits, others, last_day, status.

    scoped (repo, dup_sha, email, day): a commit counts once a repository, its newest row. aliases
    (email, contributor_id): an address without a contributor stands for itself. projects (repo,
    analysed): what is never analysed has no date. Sections: total (others: repositories, and its own
    row of contributors), contributor (others: repositories), repository (others: contributors, with
    its freshness) and freshness (a row a status, commits: repositories). Ties by last day and name.
    """
    once = newest_per(scoped.select("repo", "dup_sha", "email", "day"), ["repo", "dup_sha"], [-F.unix_date("day"), F.col("email")])
    pairs = once.groupBy("repo", "email").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
    owner = aliases.where("contributor_id IS NOT NULL").groupBy("email").agg(F.min("contributor_id").alias("c"))
    key = F.coalesce(F.concat(F.lit("contributor "), F.col("c").cast("string")), F.concat(F.lit("unresolved:"), "email"))
    pairs = checkpointed(pairs.join(owner, "email", "left").select("repo", key.alias("who"), "n", "last_day"))

    def listed(section: str, name: str, other: str) -> DataFrame:
        sums = pairs.groupBy(F.col(name).alias("name")).agg(F.sum("n").alias("commits"), F.count_distinct(other).alias("others"), F.max("last_day").alias("last_day"))
        first = sums.orderBy(F.col("commits").desc(), F.col("last_day").desc_nulls_last(), "name").limit(top)
        # so few rows that they are numbered in one
        numbered = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("commits")).alias("a"), (-F.unix_date("last_day")).alias("b"), "name", "commits", "others", "last_day"))).alias("l"))
        rows = numbered.select(F.posexplode("l").alias("at", "e"))
        return rows.select(F.lit(section).alias("section"), (F.col("at") + 1).alias("rank"), "e.name", "e.commits", "e.others", "e.last_day")

    state = projects.groupBy("repo").agg(F.max("analysed").alias("analysed"))
    status = F.when(F.col("analysed").isNull(), "never").otherwise(freshness(F.col("analysed"), as_of))
    state = state.select(F.col("repo").alias("_repo"), status.alias("status"))
    nothing = F.lit(None).cast("string").alias("status")
    totals = pairs.agg(F.sum("n").alias("commits"), F.count_distinct("repo").alias("repos"), F.count_distinct("who").alias("people"), F.max("last_day").alias("last_day"))
    total = totals.select(F.lit("total").alias("section"), F.lit(1).alias("rank"), F.lit("repositories").alias("name"), F.coalesce("commits", F.lit(0)).alias("commits"), F.col("repos").alias("others"), "last_day", nothing)
    people = totals.select(F.lit("total").alias("section"), F.lit(2).alias("rank"), F.lit("contributors").alias("name"), F.coalesce("commits", F.lit(0)).alias("commits"), F.col("people").alias("others"), "last_day", nothing)
    contributors = listed("contributor", "who", "repo").withColumn("status", F.lit(None).cast("string"))
    repositories = listed("repository", "repo", "who").join(state, F.col("name") == F.col("_repo"), "left").drop("_repo").withColumn("status", F.coalesce("status", F.lit("never")))
    fresh = state.groupBy("status").agg(F.count("*").alias("commits")).select(F.lit("freshness").alias("section"), F.lit(1).alias("rank"), F.lit("repositories").alias("name"), "commits", F.lit(0).cast("long").alias("others"), F.lit(None).cast("date").alias("last_day"), "status")
    return total.unionByName(people).unionByName(contributors).unionByName(repositories).unionByName(fresh)
