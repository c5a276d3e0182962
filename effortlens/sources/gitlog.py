"""Commits from the text of ``git log --numstat`` with headers sha|email|name|date|subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_HEADER = r"^[0-9a-f]{40}$"
_STAT = r"^(\d+|-)\t(\d+|-)\t(.+)"


def parse_log(logs: DataFrame, log_col: str = "log", excluded_emails: tuple[str, ...] = ()) -> DataFrame:
    """The other columns and sha, email, name, date, message, added, deleted, n_files of each commit.

    A text is cut in front of every line that looks like a header, so that one commit is one row and
    nothing is ordered or gathered. A subject may hold the separator. A blank line may follow the
    header; the statistics end at the next line that is none. Binary files count as files of no lines.
    Authors are excluded ignoring case. A null or empty text has no commits.
    """
    others = [F.col(f"`{c}`") for c in logs.columns if c != log_col]
    marked = F.regexp_replace(F.col(log_col), r"(?m)^[ \t]*(?=[0-9a-f]{40}\|)", "\u0001")
    parts = logs.select(*others, F.explode(F.slice(F.split(marked, "\u0001"), 2, 1 << 30)).alias("part"))
    lines = F.split("part", "\n")
    fields = F.split(F.trim(F.get(lines, F.lit(0))), r"\|")
    rows = parts.select(*others, fields.alias("f"), F.slice(lines, 2, 1 << 30).alias("rest")).where((F.size("f") >= 5) & F.get("f", F.lit(0)).rlike(_HEADER))
    body = F.when(F.trim(F.get("rest", F.lit(0))) == "", F.slice("rest", 2, 1 << 30)).otherwise(F.col("rest"))
    # position of the first line that is no statistic
    stop = F.array_position(F.transform(body, lambda x: x.rlike(_STAT)), F.lit(False))
    stats = F.when(stop > 0, F.slice(body, 1, (stop - 1).cast("int"))).otherwise(body)
    number = lambda k: F.aggregate(
        "stats", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.regexp_extract(x, _STAT, k).try_cast("long"), F.lit(0).cast("long"))
    )
    found = rows.select(*others, "f", stats.alias("stats"))
    commits = found.select(
        *others,
        *[F.get("f", F.lit(k)).alias(name) for k, name in enumerate(("sha", "email", "name", "date"))],
        F.array_join(F.slice("f", 5, 1 << 30), "|").alias("message"),
        number(1).alias("added"),
        number(2).alias("deleted"),
        F.size("stats").alias("n_files"),
    )
    banned = [e.lower() for e in excluded_emails]
    return commits.where(~F.lower("email").isin(banned)) if banned else commits


def history(logs: DataFrame, by: list[str], since: str | None = None, until: str | None = None, max_count: int | None = None, excluded_emails: tuple[str, ...] = (), log_col: str = "log") -> DataFrame:
    """The commits of ``parse_log`` in a range of time, the newest ``max_count`` of each group of ``by``.

    Both ends count. Authors are excluded after the count is taken, so a group may have fewer. Commits
    of one time are taken by sha; one whose date is none is in no range.
    """
    rows = parse_log(logs, log_col).withColumn("_at", F.col("date").try_cast("timestamp"))
    if since is not None:
        rows = rows.where(F.col("_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col("_at") <= F.lit(until).cast("timestamp"))
    if max_count is not None:
        newest = Window.partitionBy(*by).orderBy(F.col("_at").desc_nulls_last(), "sha")
        rows = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max_count).drop("_rank")
    banned = [e.lower() for e in excluded_emails]
    return (rows.where(~F.lower("email").isin(banned)) if banned else rows).drop("_at")
