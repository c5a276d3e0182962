"""Scope, listing, reuse and team queries: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.operators import billing, scope, temporal
from effortlens.plans.check_sql import ALIASES, COMMITS, MEMBERS, with_frames
from effortlens.sources.tables import aliases, commits, memberships, table

_BASE = "job_id IS NULL AND method <> 'error'"


def _scoped(s, order=3, columns=("sha", "day", "cents")):
    return lambda spark, d: scope.scoped(commits(spark, d), s, order).select(*columns)


def _base(spark, d):
    return commits(spark, d).where(scope.base())


def _cache(mode, model=None):
    def run(spark, d):
        c = commits(spark, d)
        return scope.reusable_estimates(c.where(scope.base(3)), c, 3, mode, model).select("repo", "dup_sha", "cents")

    return run


def _cache_sql(more):
    return with_frames(
        f"""SELECT repo, dup_sha, cents FROM (SELECT *, row_number() OVER (PARTITION BY repo, dup_sha ORDER BY day DESC, sha) AS r FROM commits
        WHERE {_BASE} AND order_id <> 3 AND {more} AND (repo, dup_sha) IN (SELECT repo, dup_sha FROM commits WHERE order_id = 3 AND {_BASE})) WHERE r = 1""",
        COMMITS,
    )


def _preview(spark, d):
    c = commits(spark, d)
    wanted = c.where(scope.base(3))
    return billing.preview_by_repo(wanted, scope.reusable_estimates(wanted, c, 3))


def _grouped(key):
    return lambda spark, d: _base(spark, d).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def _repo_counts(spark, d):
    rows = _base(spark, d).join(aliases(spark, d), "email", "left")
    who = F.coalesce(F.col("contributor_id").cast("string"), "email")
    return rows.groupBy("repo").agg(F.countDistinct("sha").alias("shas"), F.countDistinct(who).alias("people"), F.max("day").alias("last_day"))


def _team_repos(spark, d):
    rows = temporal.attributed(_base(spark, d).select("repo", "dup_sha", "email", "day"), memberships(spark, d))
    return rows.groupBy("team", "repo").agg(F.countDistinct("dup_sha").alias("shas"), F.countDistinct("email").alias("people"), F.max("day").alias("last_day"))


def _team_list(spark, d):
    seen = temporal.attributed(_base(spark, d).select("repo", "email", "day"), memberships(spark, d))
    active = seen.groupBy("team").agg(F.countDistinct("email").alias("active"), F.countDistinct("repo").alias("repos"))
    size = memberships(spark, d).groupBy("team").agg(F.countDistinct("email").alias("members"))
    return size.join(active, "team", "left").select("team", "members", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("repos", F.lit(0)).alias("repos"))


def _overlap(spark, d):
    day = lambda x: F.to_date(F.lit(x))
    hit = temporal.overlaps(F.col("starts"), F.col("ends"), day("1996-02-01"), day("1996-03-01"))
    return memberships(spark, d).where(hit).select("team", "email")


def _threads(spark, d):
    t = table(spark, d, "conversations").where("turn IS NOT NULL")
    roots = t.where("turn = 0").select("conv_id", F.char_length("text").alias("root_chars"))
    replies = t.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    joined = roots.join(replies, "conv_id", "left")
    return joined.select("conv_id", "root_chars", F.coalesce(F.array_join(F.transform("r", lambda x: x["role"]), ","), F.lit("")).alias("roles"))


_IN_YEARS = "(year(day) = 1996 OR year(day) = 1998)"
_Q = lambda where, cols="sha, day, cents": with_frames(f"SELECT {cols} FROM commits WHERE {_BASE} AND {where}", COMMITS)

QUERIES = {
    "scope_all_time": (_scoped(scope.Scope()), _Q("order_id = 3")),
    "scope_date_range": (
        _scoped(scope.Scope("DATE_RANGE", "1996-01-01", "1996-12-31")),
        _Q("order_id = 3 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    ),
    "scope_years": (_scoped(scope.Scope("SELECTED_YEARS", years=(1996, 1998))), _Q(f"order_id = 3 AND {_IN_YEARS}")),
    "scope_years_empty": (_scoped(scope.Scope("SELECTED_YEARS")), _Q("false")),
    "scope_last_n": (_scoped(scope.Scope("LAST_N", n=100)), _Q("order_id = 3 ORDER BY day DESC, sha LIMIT 100")),
    "scope_count": (
        lambda spark, d: scope.scoped_count(commits(spark, d), scope.Scope("LAST_N", n=500), 3),
        _Q("order_id = 3", "least(count(*), 500) AS n"),
    ),
    "commit_stats": (
        lambda spark, d: _base(spark, d).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), (F.sum("cents") / F.count("*")).alias("mean_cents")
        ),
        _Q("true", "count(*) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, sum(cents) / count(*) AS mean_cents"),
    ),
    "category_breakdown": (_grouped("category"), _Q("category IS NOT NULL GROUP BY category", "category, count(*) AS n")),
    "complexity_breakdown": (_grouped("complexity"), _Q("complexity IS NOT NULL GROUP BY complexity", "complexity, count(*) AS n")),
    "repo_breakdown": (
        lambda spark, d: _base(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.max("day").alias("last_day")),
        _Q("true GROUP BY repo", "repo, count(*) AS n, max(day) AS last_day"),
    ),
    "author_breakdown": (
        lambda spark, d: _base(spark, d).groupBy("email").agg(
            F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max_by("repo", F.struct("day", "sha")).alias("last_repo")
        ),
        _Q("true GROUP BY email", "email, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, arg_max(repo, {'d': day, 's': sha}) AS last_repo"),
    ),
    "commit_page": (
        lambda spark, d: scope.page(_base(spark, d), "cents", True, 3, 50).select("sha", "cents", "repo"),
        _Q("true ORDER BY cents DESC, sha LIMIT 50 OFFSET 100", "sha, cents, repo"),
    ),
    "text_search": (
        lambda spark, d: _base(spark, d).where(scope.contains_any("PO1", "repo", "email")).select("sha", "repo"),
        _Q("(contains(lower(repo), 'po1') OR contains(lower(email), 'po1'))", "sha, repo"),
    ),
    "facet_filter": (
        lambda spark, d: commits(spark, d).where(F.col("category").isin("A", "R") & F.col("method").startswith("FD") & F.col("email").endswith("7@example.org")).select("sha"),
        with_frames("SELECT sha FROM commits WHERE category IN ('A', 'R') AND starts_with(method, 'FD') AND ends_with(email, '7@example.org')", COMMITS),
    ),
    "cache_lookup_any": (_cache("any"), _cache_sql("true")),
    "cache_lookup_model": (_cache("model", "m1"), _cache_sql("model = 'm1'")),
    "cache_lookup_off": (_cache("off"), _cache_sql("false")),
    "preview_by_repo": (
        _preview,
        with_frames(
            f"""SELECT s.repo, count(*) AS total, count(h.dup_sha) AS cached, count(*) - count(h.dup_sha) AS fresh
            FROM (SELECT DISTINCT repo, dup_sha FROM commits WHERE order_id = 3 AND {_BASE}) s
            LEFT JOIN (SELECT DISTINCT repo, dup_sha FROM commits WHERE order_id <> 3 AND {_BASE}) h USING (repo, dup_sha) GROUP BY s.repo""",
            COMMITS,
        ),
    ),
    "dedup_anti_join": (
        lambda spark, d: _base(spark, d).where("order_id = 3").join(commits(spark, d).where("job_id = 'job0'").select("dup_sha"), "dup_sha", "left_anti").select("sha"),
        _Q("order_id = 3 AND dup_sha NOT IN (SELECT dup_sha FROM commits WHERE job_id = 'job0')", "sha"),
    ),
    "benchmark_pin_semi_join": (
        lambda spark, d: _base(spark, d).join(commits(spark, d).where("job_id = 'job1'").select("repo").distinct(), "repo", "left_semi").groupBy("repo").agg(F.count("*").alias("n")),
        _Q("repo IN (SELECT repo FROM commits WHERE job_id = 'job1') GROUP BY repo", "repo, count(*) AS n"),
    ),
    "newest_per_sha": (
        lambda spark, d: scope.newest_per(commits(spark, d).select("dup_sha", "day", "sha", "cents"), ["dup_sha"], [-F.unix_date("day"), F.col("sha")]).select("dup_sha", "sha", "cents"),
        with_frames("SELECT dup_sha, sha, cents FROM (SELECT *, row_number() OVER (PARTITION BY dup_sha ORDER BY day DESC, sha) AS r FROM commits) WHERE r = 1", COMMITS),
    ),
    "repo_canonical_counts": (
        _repo_counts,
        with_frames(
            f"""SELECT repo, count(DISTINCT sha) AS shas, count(DISTINCT coalesce(CAST(contributor_id AS VARCHAR), email)) AS people, max(day) AS last_day
            FROM commits LEFT JOIN aliases USING (email) WHERE {_BASE} GROUP BY repo""",
            COMMITS,
            ALIASES,
        ),
    ),
    "team_repos_interval": (
        _team_repos,
        with_frames(
            f"""SELECT team, repo, count(DISTINCT dup_sha) AS shas, count(DISTINCT email) AS people, max(day) AS last_day
            FROM commits JOIN members USING (email) WHERE {_BASE} AND day >= starts AND (ends IS NULL OR day < ends) GROUP BY team, repo""",
            COMMITS,
            MEMBERS,
        ),
    ),
    "team_list": (
        _team_list,
        with_frames(
            f"""SELECT m.team, count(DISTINCT m.email) AS members, count(DISTINCT c.email) AS active, count(DISTINCT c.repo) AS repos
            FROM members m LEFT JOIN (SELECT * FROM commits WHERE {_BASE}) c ON c.email = m.email AND day >= starts AND (ends IS NULL OR day < ends) GROUP BY m.team""",
            COMMITS,
            MEMBERS,
        ),
    ),
    "membership_overlap": (
        _overlap,
        with_frames("SELECT team, email FROM members WHERE starts < DATE '1996-03-01' AND (ends IS NULL OR ends > DATE '1996-02-01')", MEMBERS),
    ),
    "home_top_repos": (
        lambda spark, d: _base(spark, d).groupBy("repo").agg(F.countDistinct("dup_sha").alias("n"), F.max("day").alias("last_day")).orderBy(F.col("n").desc(), F.col("last_day").desc(), "repo").limit(5),
        _Q("true GROUP BY repo ORDER BY n DESC, last_day DESC, repo LIMIT 5", "repo, count(DISTINCT dup_sha) AS n, max(day) AS last_day"),
    ),
    "home_top_contributors": (
        lambda spark, d: _base(spark, d).groupBy("email").agg(F.count("*").alias("n"), F.max("day").alias("last_day")).orderBy(F.col("n").desc(), F.col("last_day").desc(), "email").limit(5),
        _Q("true GROUP BY email ORDER BY n DESC, last_day DESC, email LIMIT 5", "email, count(*) AS n, max(day) AS last_day"),
    ),
    "comment_threads": (
        _threads,
        """SELECT r.conv_id, length(r.text) AS root_chars, coalesce((SELECT string_agg(role, ',' ORDER BY turn, role) FROM conversations c WHERE c.conv_id = r.conv_id AND c.turn > 0), '') AS roles
        FROM conversations r WHERE r.turn = 0""",
    ),
}
