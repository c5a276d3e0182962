"""Lists in the product's orders, and histories cut by range and count: name -> (query, SQL to check it with)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from effortlens.operators import home, orderings, scope
from effortlens.plans import features
from effortlens.plans.check_sql import ALIASES, COMMITS, MEMBERS, TRUTH, with_frames
from effortlens.sources.gitlog import history
from effortlens.sources.tables import aliases, commits, ground_truth, memberships, table
from effortlens.sources.writers import markdown

_BASE = "job_id IS NULL AND method <> 'error'"
_SORTS = {
    "name": "email",
    "repositories": "repos DESC, commits DESC, email",
    "commits": "commits DESC, repos DESC, email",
    "activity": "last_day DESC NULLS LAST, commits DESC, email",
}


def _candidates(spark, d):
    """The first ten people outside team 1 in each of the four orders."""
    rows, members = commits(spark, d).where(scope.base()), memberships(spark, d).where("team = 1")
    parts = [orderings.candidates(rows, members, s, 10).withColumn("sort", F.lit(s)) for s in _SORTS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _runs(spark, d):
    """Every job and repository is a run, commits without a job the original one; repositories with an even number have no truth."""
    truth = ground_truth(spark, d).where("author = 'expert1'").select("sha", F.col("cents").alias("truth"))
    odd = F.substring("repo", 9, 2).cast("int") % 2 == 1
    run = F.when(F.col("job_id").isNotNull(), F.concat_ws("/", "job_id", "repo"))
    error = F.when(odd, F.abs(F.col("cents") - F.col("truth")))
    runs = commits(spark, d).join(truth, "sha", "left").groupBy(run.alias("job_id")).agg(F.round(F.avg(error), 6).alias("mae"), F.min("day").alias("created"))
    return runs.orderBy(*orderings.run_order()).limit(40)


def _groups(spark, d):
    """Parts of a brand and size are a group: merged, saved or neither."""
    g = table(spark, d, "part").groupBy(F.concat_ws("-", "p_brand", F.col("p_size") % 10).alias("group_id")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    flags = g.select("group_id", "n", (F.col("k") % 4 == 0).alias("merged"), F.when(F.col("k") % 3 != 0, "HIGH").alias("confidence"), (F.col("k") % 8 == 0).alias("auto_merged"), (F.col("k") % 5 == 0).alias("is_saved"))
    return flags.orderBy(*orderings.group_order()).limit(60)


def _report(spark, d):
    """Commits, hours and developers of every repository as the lines of a report."""
    rows = commits(spark, d).where(scope.base()).groupBy("repo").agg(F.count("*").alias("commits"), F.sum("cents").alias("cents"), F.count_distinct("email").alias("developers"))
    return markdown(rows, [F.col("commits").desc(), F.col("repo")])


_TEAMS = (0, 2, 3)


def _home(spark, d):
    """The home page of three teams over four years; every fifth repository was never analysed."""
    members = memberships(spark, d).where(F.col("team").isin(*_TEAMS))
    rows = home.in_scope(commits(spark, d).where(scope.base()).select("repo", "dup_sha", "email", "day"), "1995-01-01", "1998-12-31", members=members)
    number = F.regexp_extract("repo", "[0-9]+$", 0).cast("int")
    projects = commits(spark, d).groupBy("repo").agg(F.max("day").alias("day")).select("repo", F.when(number % 5 != 0, F.date_sub("day", number * 4)).alias("analysed"))
    return home.home_detail(rows, aliases(spark, d), projects, F.to_date(F.lit("1998-10-20")))


_HOME = (
    COMMITS, ALIASES, MEMBERS,
    f"""once AS (SELECT repo, dup_sha, email, day FROM (SELECT DISTINCT c.repo, c.dup_sha, c.email, c.day FROM commits c JOIN members m ON m.email = c.email AND day >= starts AND (ends IS NULL OR day < ends)
      WHERE team IN {_TEAMS} AND day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND {_BASE}) QUALIFY row_number() OVER (PARTITION BY repo, dup_sha ORDER BY day DESC, email) = 1)""",
    "known AS (SELECT repo, day, coalesce('contributor ' || contributor_id, 'unresolved:' || email) AS who FROM once LEFT JOIN aliases USING (email))",
    """state AS (SELECT repo, CASE WHEN k % 5 = 0 THEN 'never' WHEN d - k * 4 >= DATE '1998-10-20' - 30 THEN 'fresh' ELSE 'stale' END AS status FROM (
      SELECT repo, CAST(regexp_extract(repo, '[0-9]+$') AS INT) AS k, max(day) AS d FROM commits GROUP BY repo))""",
)


def _top(section, name, other):
    return f"""SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY commits DESC, last_day DESC, name) AS INT) AS rank, name, commits, others, last_day FROM (
      SELECT {name} AS name, count(*) AS commits, count(DISTINCT {other}) AS others, max(day) AS last_day FROM known GROUP BY 1) QUALIFY rank <= 5"""


QUERIES = {
    "home_detail": (
        _home,
        with_frames(
            f"""SELECT 'total' AS section, CAST(1 AS INT) AS rank, 'repositories' AS name, count(*) AS commits, count(DISTINCT repo) AS others, max(day) AS last_day, CAST(NULL AS VARCHAR) AS status FROM known
            UNION ALL SELECT 'total', 2, 'contributors', count(*), count(DISTINCT who), max(day), NULL FROM known UNION ALL SELECT *, NULL FROM ({_top("contributor", "who", "repo")})
            UNION ALL SELECT t.*, coalesce(status, 'never') FROM ({_top("repository", "repo", "who")}) t LEFT JOIN state ON repo = name
            UNION ALL SELECT 'freshness', 1, 'repositories', count(*), 0, NULL, status FROM state GROUP BY status""",
            *_HOME,
        ),
    ),
    "report_markdown": (
        _report,
        with_frames(
            f"""SELECT CAST(0 AS INT) AS no, '| repo | commits | cents | developers |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- |'
            UNION ALL SELECT CAST(row_number() OVER (ORDER BY n DESC, repo) + 1 AS INT), '| ' || concat_ws(' | ', repo, n, c, e) || ' |' FROM (SELECT repo, count(*) AS n, sum(cents) AS c, count(DISTINCT email) AS e FROM commits WHERE {_BASE} GROUP BY repo)""",
            COMMITS,
        ),
    ),
    "candidate_orders": (
        _candidates,
        with_frames(
            " UNION ALL ".join(f"(SELECT email, commits, repos, first_day, last_day, '{s}' AS sort FROM people ORDER BY {o} LIMIT 10)" for s, o in _SORTS.items()),
            COMMITS, MEMBERS,
            f"""people AS (SELECT email, count(*) AS commits, count(DISTINCT repo) AS repos, min(day) AS first_day, max(day) AS last_day FROM commits WHERE {_BASE} AND email NOT IN (SELECT email FROM members WHERE team = 1) GROUP BY email)""",
        ),
    ),
    "ordered_runs": (
        _runs,
        with_frames(
            """SELECT job_id, mae, created FROM (SELECT job_id || '/' || repo AS job_id, round(avg(CASE WHEN CAST(substring(repo, 9, 2) AS INT) % 2 = 1 THEN abs(c.cents - t.cents) END), 6) AS mae, min(day) AS created
            FROM commits c LEFT JOIN (SELECT sha, cents FROM truth WHERE author = 'expert1') t USING (sha) GROUP BY job_id || '/' || repo) ORDER BY job_id IS NOT NULL, mae ASC NULLS LAST, created, job_id LIMIT 40""",
            COMMITS, TRUTH,
        ),
    ),
    "ordered_groups": (
        _groups,
        """SELECT group_id, n, k % 4 = 0 AS merged, CASE WHEN k % 3 <> 0 THEN 'HIGH' END AS confidence, k % 8 = 0 AS auto_merged, k % 5 = 0 AS is_saved FROM (
          SELECT p_brand || '-' || (p_size % 10) AS group_id, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
        ORDER BY (k % 4 <> 0 AND k % 3 <> 0 AND n > 1) DESC, k % 8 = 0 DESC, k % 5 = 0 DESC, n DESC, group_id LIMIT 60""",
    ),
    "git_history": (
        lambda spark, d: history(features._logs(spark, d), ["repo"], "1993-02-01", "1996-12-31", 15, ("DEV3@x.org",)).select("repo", "sha", "email", "date", "added", "deleted"),
        """SELECT repo, sha, email, date, added, deleted FROM (SELECT 'r' || (o_custkey % 40) AS repo, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS sha, 'Dev' || (o_custkey % 5) || '@x.org' AS email, strftime(o_orderdate, '%Y-%m-%d') AS date,
          CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END + 7 AS added, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 3 END + o_custkey % 9 AS deleted FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1993-02-01' AND DATE '1996-12-31'
          QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY CAST(o_orderdate AS DATE) DESC, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40)) <= 15) WHERE email <> 'Dev3@x.org'""",
    ),
}
