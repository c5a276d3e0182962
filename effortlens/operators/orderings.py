"""Orders of the product's lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a list of candidates.
MOST_CANDIDATES = 100


def candidate_order(sort: str) -> list[Column]:
    """By name, repositories, commits, or else by last activity; ties by commits, repositories and name."""
    name, commits, repos = F.col("email"), F.col("commits").desc(), F.col("repos").desc()
    return {"name": [name], "repositories": [repos, commits, name], "commits": [commits, repos, name]}.get(sort, [F.col("last_day").desc_nulls_last(), commits, name])


def candidates(rows: DataFrame, members: DataFrame, sort: str = "activity", most: int = MOST_CANDIDATES) -> DataFrame:
    """People (email) with commits who are no members: commits, repos, first and last day."""
    people = rows.join(members.select("email").distinct(), "email", "left_anti").groupBy("email")
    found = people.agg(F.count("*").alias("commits"), F.count_distinct("repo").alias("repos"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return found.orderBy(*candidate_order(sort)).limit(most)


def run_order() -> list[Column]:
    """The original run first, then by error, those without one last and by creation; ties by run."""
    return [F.col("job_id").isNotNull(), F.col("mae").asc_nulls_last(), F.col("created"), F.col("job_id")]


def group_order() -> list[Column]:
    """Suggestions, groups merged by themselves, saved ones, the others; the larger first, ties by id."""
    suggested = ~F.col("merged") & F.col("confidence").isNotNull() & (F.col("n") > 1)
    return [F.coalesce(suggested, F.lit(False)).desc(), F.col("auto_merged").desc(), F.col("is_saved").desc(), F.col("n").desc(), F.col("group_id")]
