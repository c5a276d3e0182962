"""Roll-up, listing, sink and health queries: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import client, health, reports, scope, spread, temporal
from effortlens.plans.check_sql import ALIASES, COMMITS, EVENTS, JOBS, MEMBERS, PLACED, with_frames, with_recursive_frames
from effortlens.sources.tables import aliases, commits, job_events, jobs, memberships, table

_BASE = "job_id IS NULL AND method <> 'error'"
_AS_OF = "DATE '1998-08-01'"


def _as_of():
    return F.to_date(F.lit("1998-08-01"))


def _base(spark, d):
    return commits(spark, d).where(scope.base())


_METHODS = (*health.HEURISTIC_METHODS, *health.LARGE_MODEL_METHODS, "two_pass", *health.SPECIAL_METHODS)
_SINCE, _NOW = 900_000, 986_400


def _estimates(spark, d):
    """Commits by all methods, analysed in the seconds up to a stated now."""
    pick = (F.col("cents") % 3 * 5 + F.length("repo")) % (len(_METHODS) + 1)
    methods = F.array(*[F.lit(m) for m in _METHODS], F.lit(None))
    return commits(spark, d).select("sha", F.get(methods, pick.cast("int")).alias("method"), "model", "repo", "cents", F.when(F.col("job_id") != "job0", F.col("job_id")).alias("job_id"), (_NOW - F.col("cents") * 977 % 200_000).alias("analysed"))


def _worked_jobs(spark, d):
    key = F.col("job_id")
    states = F.array(*[F.lit(x) for x in ("COMPLETED", "RUNNING", "PENDING", "LLM_COMPLETE", *health.FAILED)])
    return jobs(spark, d).select(F.get(states, (key % 7).cast("int")).alias("status"), (_NOW - key * 31 % 150_000).alias("updated"), F.when(key % 3 != 0, _NOW - key * 7 % 130_000).alias("heartbeat"))


def _in(names):
    return "method IN (" + ", ".join(f"'{n}'" for n in names) + ")"


_HEURISTIC, _LARGE, _SPECIAL = _in(health.HEURISTIC_METHODS), _in(health.LARGE_MODEL_METHODS), _in(health.SPECIAL_METHODS)
_PRODUCTION = f"method IS NOT NULL AND NOT {_SPECIAL}"
_HEALTH = (
    COMMITS,
    JOBS,
    f"""est AS (SELECT * FROM (SELECT sha, {list(_METHODS)}[l_pick + 1] AS method, model, repo, cents, CASE WHEN job_id <> 'job0' THEN job_id END AS job_id, {_NOW} - cents * 977 % 200000 AS analysed
      FROM (SELECT *, CAST(cents % 3 * 5 + length(repo) AS INT) % {len(_METHODS) + 1} AS l_pick FROM commits)) WHERE job_id IS NULL AND analysed >= {_SINCE})""",
    f"""hc AS (SELECT count(*) FILTER ({_PRODUCTION}) AS recent_commits, count(*) FILTER ({_PRODUCTION} AND cents = 500) AS fallbacks, count(*) FILTER (starts_with(method, 'FD')) AS fd_total,
      count(*) FILTER ({_in(health.HOLISTIC_METHODS)}) AS fd_holistic, count(*) FILTER ({_in(health.NON_HOLISTIC_METHODS)}) AS fd_non_holistic, count(*) FILTER ({_HEURISTIC} AND model IS NOT NULL) AS heuristic_attributed,
      count(*) FILTER ({_SPECIAL} AND model IS NOT NULL) AS special_attributed, count(*) FILTER ({_LARGE} AND model IS NULL) AS model_missing FROM est)""",
    f"""wj AS (SELECT ['COMPLETED', 'RUNNING', 'PENDING', 'LLM_COMPLETE', 'FAILED', 'FAILED_RETRYABLE', 'FAILED_FATAL'][job_id % 7 + 1] AS status, {_NOW} - job_id * 31 % 150000 AS updated,
      CASE WHEN job_id % 3 <> 0 THEN {_NOW} - job_id * 7 % 130000 END AS heartbeat FROM jobs)""",
    f"""hj AS (SELECT count(*) FILTER (updated >= {_SINCE}) AS recent_jobs, count(*) FILTER (starts_with(status, 'FAILED') AND updated >= {_SINCE}) AS failed_jobs,
      count(*) FILTER (status = 'PENDING' AND updated >= {_SINCE} AND updated < {_NOW - 120}) AS stale_pending,
      count(*) FILTER (status = 'RUNNING' AND coalesce(heartbeat, updated) >= {_SINCE} AND coalesce(heartbeat, updated) < {_NOW - 600}) AS stale_running,
      count(*) FILTER (status = 'LLM_COMPLETE' AND updated >= {_SINCE} AND updated < {_NOW - 300}) AS stalled_post_processing FROM wj)""",
)


_CODES = (
    "REPO_CLONE_START", "REPO_CLONE_DONE", "REPO_EXTRACT_START", "REPO_EXTRACT_DONE", "LLM_EVAL_START", "LLM_COMMIT_RESULT", "LLM_COMMIT_RESULT", "LLM_COMMIT_RESULT", "REPO_FULLY_CACHED",
    "CACHE_REUSED", "REPO_PROCESS_DONE", "LLM_EVAL_DONE", "REPO_EMPTY_SCOPE", "WORKER_ACQUIRED", "HEARTBEAT_SENT", "OTHER",
)


def _client(spark, d):
    """Events of fifty jobs, one a line item, with payloads in which fields are absent, blank or zero."""
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    cents = F.floor(F.col("l_quantity") * 10 + 0.5).cast("long")
    payload = F.struct(
        F.when(p % 3 != 0, k).alias("commitCount"), F.when(p % 4 != 0, F.concat(F.lit("  fix "), p.cast("string"), F.lit(" "))).otherwise(" ").alias("subject"), F.when(k % 5 != 0, F.concat(F.lit(" Dev"), k.cast("string"), F.lit("@Example.org"))).alias("authorEmail"),
        F.when(k % 3 != 0, F.concat_ws(" ", F.lit("Dev"), k, p % 3)).alias("authorName"), F.when(p % 7 != 0, cents / 100).alias("estimatedHours"), (p % 4).alias("filesCount"), (p % 50).alias("additions"), F.when(p % 2 == 0, p % 20).alias("deletions"),
        F.when(p % 3 == 1, "feature").alias("category"), F.when(p % 2 == 0, p % 9).alias("cachedCount"), F.when(p % 3 == 0, p % 8).alias("cacheHitCount"), (p % 30).alias("totalAnalyzed"), F.when(p % 5 != 0, cents / 100).alias("totalHours"),
    )
    code = F.get(F.array(*[F.lit(c) for c in _CODES], F.lit(None)), ((p + F.col("l_linenumber")) % (len(_CODES) + 1)).cast("int"))
    event_id = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + k % 100
    events = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("job_id"), event_id.alias("event_id"), code.alias("code"), F.when(p % 6 != 0, F.concat(F.lit("org/repo"), (p % 20).cast("string"))).alias("repo"), F.to_json(payload).alias("payload"))
    return client.client_events(events)


def _job_progress(spark, d):
    job = F.col("l_orderkey") % 50
    return table(spark, d, "lineitem").select(job.alias("job_id"), (job % 30).alias("work_days"), (job % 101).alias("progress")).distinct()


_SHOWN = (
    f"""raw AS (SELECT l_orderkey % 50 AS job_id, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS event_id, {list(_CODES)}[(l_partkey + l_linenumber) % {len(_CODES) + 1} + 1] AS code,
      CASE WHEN l_partkey % 6 <> 0 THEN 'org/repo' || (l_partkey % 20) ELSE '' END AS repo, l_suppkey AS k, l_partkey AS p, floor(l_quantity * 10 + 0.5) / 100 AS h FROM lineitem)""",
    """named AS (SELECT *, CASE WHEN k % 5 <> 0 THEN substring(sha256('dev' || k || '@example.org'), 1, 12) END AS dev, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 <> 0 THEN concat_ws(' ', 'Dev', k, p % 3) ELSE 'Dev' || k END END AS name,
      p % 50 + CASE WHEN p % 2 = 0 THEN p % 20 ELSE 0 END AS n_lines, CASE WHEN h = floor(h) THEN CAST(CAST(h AS BIGINT) AS VARCHAR) ELSE CAST(h AS VARCHAR) END AS ht FROM raw)""",
    """lists AS (SELECT job_id, event_id, dev, name, h, p, list_filter(CASE code
      WHEN 'REPO_CLONE_START' THEN [['milestone', 'repo', 'repoConnecting', 'repo=' || repo]] WHEN 'REPO_EXTRACT_START' THEN [['major', 'phase', 'extractingHistory', 'repo=' || repo]]
      WHEN 'REPO_EXTRACT_DONE' THEN [['major', 'stat', 'historyExtracted', 'commitCount=' || CASE WHEN p % 3 <> 0 THEN k ELSE 0 END]] WHEN 'LLM_EVAL_START' THEN [['milestone', 'phase', 'aiAnalysisStarted', 'commitCount=' || CASE WHEN p % 3 <> 0 THEN k ELSE 0 END]]
      WHEN 'LLM_COMMIT_RESULT' THEN [['major', 'commit', 'commitAnalyzed', 'subject=' || CASE WHEN p % 4 <> 0 THEN 'fix ' || p ELSE 'commit' END || ';developerName=' || coalesce(name, 'Developer')],
        CASE WHEN p % 4 > 0 THEN ['micro', 'stat', 'filesChanged', 'fileCount=' || (p % 4)] END, CASE WHEN n_lines > 0 THEN ['micro', 'stat', 'linesChanged', 'lineCount=' || n_lines] END, CASE WHEN p % 3 = 1 THEN ['micro', 'stat', 'changeType', 'type=feature'] END]
      WHEN 'REPO_FULLY_CACHED' THEN [['major', 'stat', 'cachedResultsFound', 'count=' || CASE WHEN p % 2 = 0 THEN p % 9 WHEN p % 3 <> 0 THEN k ELSE 0 END]] WHEN 'CACHE_REUSED' THEN [['micro', 'stat', 'cacheReused', 'count=' || CASE WHEN p % 3 = 0 THEN p % 8 ELSE 0 END]]
      WHEN 'REPO_PROCESS_DONE' THEN [['milestone', 'repo', 'repoCompleted', 'repo=' || repo || ';commitCount=' || (p % 30) || ';totalHours=' || CASE WHEN p % 5 <> 0 THEN ht ELSE '0' END]]
      WHEN 'LLM_EVAL_DONE' THEN [['major', 'phase', 'aiAnalysisDone', '']] WHEN 'REPO_EMPTY_SCOPE' THEN [['major', 'repo', 'repoEmptyScope', 'repo=' || repo]] ELSE [] END, lambda x: x IS NOT NULL) AS l FROM named)""",
    """shown AS (SELECT job_id, event_id, i - 1 AS seq, l[i][1] AS tier, l[i][2] AS category, 'clientProgress.' || l[i][3] AS text, l[i][4] AS params, CASE WHEN l[i][3] = 'commitAnalyzed' THEN dev END AS developer_id,
      CASE WHEN l[i][3] = 'commitAnalyzed' THEN name END AS developer, CASE WHEN l[i][3] = 'commitAnalyzed' AND p % 7 <> 0 THEN h END AS hours FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lists))""",
)


def _order_owners(spark, d):
    """order_id, owner, status of the 97 orders that jobs belong to."""
    return jobs(spark, d).groupBy("order_id").agg(F.min("user_id").alias("owner"), F.max_by("status", F.struct("created", "job_id")).alias("status"))


OWNERS = "owners AS (SELECT order_id, min(user_id) AS owner, arg_max(status, {'a': created, 'b': job_id}) AS status FROM jobs GROUP BY order_id)"


def _order_users(spark, d):
    """order_id, user_id, status: three users have the orders between them."""
    return _order_owners(spark, d).select("order_id", (F.col("order_id") % 3).alias("user_id"), "status")


def _reusable(spark, d):
    """Per order: its commits, those that a completed order of the same user or the order itself has estimated, and what is left to bill."""
    users = _order_users(spark, d)
    wanted = _base(spark, d).select("order_id", "repo", "dup_sha").join(users.select("order_id", "user_id"), "order_id")
    done = commits(spark, d).where("method IS NULL OR method <> 'error'").where("job_id IS NOT NULL").select("order_id", "repo", "dup_sha").join(users, "order_id")
    others = done.where("status = 'COMPLETED'").select("user_id", "repo", "dup_sha")
    own = wanted.select("order_id", "repo", "dup_sha").distinct().join(users.select("order_id", "user_id"), "order_id")
    hits = own.join(others.distinct(), ["user_id", "repo", "dup_sha"], "left_semi").select("order_id", "repo", "dup_sha")
    mine = done.select("order_id", "repo", "dup_sha")
    return reports.preview_totals(wanted.select("order_id", "repo", "dup_sha"), hits.union(mine), ["repo", "dup_sha"], by=["order_id"])


def _excluded_people(spark, d):
    """Commits that developers not left out have, in one first run, at most 900."""
    counts = _base(spark, d).groupBy("order_id", "email").agg(F.count("*").alias("n"))
    kept = counts.where(~F.col("email").isin("dev1@example.org", "dev2@example.org"))
    return kept.groupBy("order_id").agg(F.least(F.sum("n"), F.lit(900)).alias("total"))


def _order_metrics(spark, d):
    """order_id, email, commits, cents, work_days: hours of an order are placed by themselves."""
    rows = _base(spark, d)
    days = spread.placed_days(rows, ("order_id", "email")).groupBy("order_id", "email").agg(F.count_distinct("day").alias("days"))
    return rows.groupBy("order_id", "email").agg(F.sum("cents").alias("cents"), F.count("*").alias("commits")).join(days, ["order_id", "email"], "left")


def _order_rollup(spark, d):
    ratio = scalars.ratio(F.col("cents"), F.col("days"))
    return _order_metrics(spark, d).groupBy("order_id").agg(
        F.round(F.avg(ratio), 6).alias("mean_ratio"), F.sum("cents").alias("cents"), F.sum("commits").alias("commits"), F.count("*").alias("developers")
    )


_BY_ORDER = COMMITS.replace("commits AS", "all_commits AS", 1) + ", commits AS (SELECT * REPLACE (order_id || '/' || email AS email) FROM all_commits)"
_DEV = "dev AS (SELECT CAST(string_split(email, '/')[1] AS BIGINT) AS order_id, email, n_commits AS commits, total_cents AS cents, work_days AS days FROM pmetrics)"
_RATIO = "CASE WHEN days >= 1 THEN cents * 100.0::DOUBLE / (days * 300) END"
_EROWS = """erows AS (SELECT email, day, cents, 'placed' AS type FROM effort UNION ALL SELECT email, day, cents - coalesce(p, 0), 'overhead' FROM base
  LEFT JOIN (SELECT email, entry_day AS day, sha, sum(cents) AS p FROM effort GROUP BY ALL) USING (email, day, sha) WHERE cents - coalesce(p, 0) > 0)"""


def _overhead(spark, d):
    """Placed hours and, on the author's day, those that found none: one frame with a type tag."""
    rows = spread.effort_rows(_base(spark, d))
    tagged = rows.select("day", (F.col("placed") + F.col("overhead")).alias("cents"), F.when(F.col("placed") > 0, "placed").otherwise("overhead").alias("type"))
    return tagged.groupBy("type", scalars.period_key(F.col("day"), "year").alias("period")).agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))


def _work_ratios(spark, d):
    """email, ratio: null below twenty work days."""
    m = spread.developer_metrics(_base(spark, d))
    return m.select("email", F.when(F.col("work_days") >= 20, F.round("ratio_raw", 6)).alias("ratio"))


def _slice(spark, d):
    """Placed days and hours of every team member in one quarter, zero for those without."""
    days = spread.placed_days(_base(spark, d)).where(F.col("day").between("1996-01-01", "1996-03-31"))
    sums = days.groupBy("email").agg(F.countDistinct("day").alias("days"), F.sum("cents").alias("cents"))
    rows = memberships(spark, d).select("email").distinct().join(sums, "email", "left")
    return rows.select("email", F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("cents", F.lit(0)).alias("cents"))


def _identity_evidence(spark, d):
    """Commits of contributor 4 by any of its addresses."""
    mine = aliases(spark, d).where("contributor_id = 4").select("email")
    return _base(spark, d).join(F.broadcast(mine), "email", "left_semi").orderBy(F.col("day").desc(), "sha").limit(50).select("sha", "email", "day")


def _repo_detail(spark, d):
    """One repository: unique commits by resolved contributor or by unresolved address."""
    unique = scope.newest_per(_base(spark, d).where("repo = 'org/repo3'").select("dup_sha", "day", "sha", "email"), ["dup_sha"], [-F.unix_date("day"), F.col("sha")])
    who = unique.join(aliases(spark, d), "email", "left")
    name = F.coalesce(F.concat(F.lit("c"), F.col("contributor_id").cast("string")), "email")
    return who.groupBy(name.alias("who"), F.col("contributor_id").isNotNull().alias("resolved")).agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


def _contributor_health(spark, d):
    """Suppliers of a nation as the addresses of one person."""
    rows = table(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 9 != 0).alias("resolved"))
    g = rows.groupBy("s_nationkey").agg(F.count_if("resolved").alias("a"), F.count_if(~F.col("resolved")).alias("b"))
    health = F.when(F.col("b") == 0, "healthy").when(F.col("a") > 0, "attention").otherwise("unresolved")
    return g.groupBy(health.alias("health")).agg(F.count("*").alias("n"), F.sum("a").alias("resolved"), F.sum("b").alias("unresolved"))


def _queue(spark, d):
    """Unresolved addresses, newest seen first, with how many there are."""
    seen = _base(spark, d).groupBy("email").agg(F.max("day").alias("seen"))
    return aliases(spark, d).where("contributor_id IS NULL").join(seen, "email", "left").orderBy(F.col("seen").desc_nulls_last(), "email").limit(20).select("email", "seen")


def _candidates(spark, d):
    """People who are not in team 0: commits, repositories, first and last day; the most active first."""
    member = memberships(spark, d).where("team = 0").select("email").distinct()
    rows = _base(spark, d).join(member, "email", "left_anti")
    g = rows.groupBy("email").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return g.orderBy(F.col("n").desc(), "email").limit(100)


def _team_activity(spark, d):
    seen = temporal.attributed(_base(spark, d).select("repo", "email", "day"), memberships(spark, d))
    return seen.where(F.col("day").between("1996-06-01", "1997-06-01")).groupBy("team").agg(F.countDistinct("email").alias("active"), F.max("day").alias("last_day"), F.min("day").alias("first_day"))


def _usage(spark, d):
    calls = job_events(spark, d).select(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"))).alias("provider"), (F.col("event_id") % 900).alias("tokens"), (F.col("job_id") % 77).alias("millis"))
    return reports.usage(calls, ["provider"], 0.4).withColumn("cost", F.round("cost", 9))


def _stuck(spark, d):
    key = F.col("job_id")
    now = F.lit(10_000)
    j = jobs(spark, d).select(
        "job_id", F.when(key % 11 == 0, "LLM_COMPLETE").otherwise(F.col("status")).alias("status"), F.when(key % 17 != 0, now - key % 500).alias("updated"),
        F.when(key % 3 != 0, now - key % 1300).alias("heartbeat"), (now - key % 2000).alias("created"),
    )
    last = job_events(spark, d).groupBy("job_id").agg(F.max_by("code", F.struct("second", "event_id")).alias("code"))
    levels = last.select("job_id", F.when(F.col("code") == "error", "error").otherwise("info").alias("level"))
    states = reports.steps_of_jobs(job_events(spark, d), {"accepted": (("view",), ()), "worker": (("click",), ("error",)), "done": (("purchase",), ())})
    return reports.stuck_jobs(j, levels, states, now).select("job_id", F.array_join("reasons", ",").alias("reasons"))


_STEPS = ("signup", "click", "purchase", "error")


def _steps(spark, d):
    e = job_events(spark, d).select("job_id", F.col("code").alias("step"), "second")
    return reports.step_states(_STEPS, e.where(F.col("step").isin(*_STEPS)), F.lit(2_000_000_000))


def _stored_projects(spark, d):
    """When each repository was last analysed, as kept and as new commits say."""
    old = _base(spark, d).where("order_id < 5").groupBy("repo").agg(F.max("day").alias("analysed"), F.count("*").alias("n"))
    new = _base(spark, d).where("order_id >= 5").groupBy("repo").agg(F.max("day").alias("analysed"), F.count("*").alias("n"))
    return old, new


def _names(spark, d):
    return table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("name"), F.col("p_partkey").alias("position")
    )


def _scalars(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = F.col("l_partkey")
    text = F.concat(F.lit("dev"), p.cast("string"), F.lit("@example.org"))
    return t.select(
        "l_orderkey",
        "l_linenumber",
        scalars.string_hash(text).alias("hash"),
        F.round(scalars.bubble_radius(p.cast("double"), F.lit(2000.0) - F.col("l_suppkey") * 1000, F.col("l_linenumber") == 7), 6).alias("radius"),
        F.round(scalars.heat_intensity(p % 260), 6).alias("heat"),
        scalars.confidence(F.when(p % 3 == 0, "FD_x").when(p % 3 == 1, "error").otherwise("two_pass")).alias("confidence"),
        scalars.attributed_model(F.when(p % 3 == 0, "FD_x").when(p % 3 == 1, "error").otherwise("two_pass"), F.when(p % 2 == 0, "big").otherwise(""), F.lit("std")).alias("model"),
        scalars.size_label(p * 997).alias("size"),
        scalars.since_label(p * 86400 / 7).alias("since"),
        scalars.usable_context(p * 400, p % 2 == 0).alias("context"),
        scalars.activity_level(p % 15).alias("level"),
        scalars.positive_number(F.when(p % 4 == 0, "abc").when(p % 4 == 1, "-3").otherwise(p.cast("string"))).alias("number"),
        scalars.range_is_eligible(_as_of(), F.date_add(_as_of(), (p % 60).cast("int"))).alias("eligible"),
        scalars.candidate_repo(p % 50, p % 300, 3, 12, 4.0).alias("candidate"),
    )


_P = "l_partkey"
_SIZE = f"({_P} * 997)"
_SEC = f"({_P} * 86400 / 7.0::DOUBLE)"
_SCALARS = f"""SELECT l_orderkey, l_linenumber,
  CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT) AS hash,
  round(CASE WHEN l_linenumber = 7 THEN 5.0 WHEN 2000.0 - l_suppkey * 1000 <= 0 THEN 8.0 ELSE 6 + sqrt({_P} / (2000.0::DOUBLE - l_suppkey * 1000)) * 34 END, 6) AS radius,
  round(CASE WHEN k >= 100 THEN 0.2 + least((k - 100) / 100.0::DOUBLE, 1) * 0.6 WHEN k >= 80 THEN 0.2 + least((100 - k) / 20.0::DOUBLE, 1) * 0.4 ELSE 0.2 + least((80 - k) / 80.0::DOUBLE, 1) * 0.6 END, 6) AS heat,
  CASE {_P} % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.1 ELSE 0.8 END AS confidence,
  CASE {_P} % 3 WHEN 1 THEN NULL WHEN 0 THEN CASE WHEN {_P} % 2 = 0 THEN 'big' END ELSE 'std' END AS model,
  CASE WHEN {_SIZE} < 1024 THEN {_SIZE} || ' KB' WHEN {_SIZE} / 1024.0 < 1024 THEN printf('%.1f MB', floor({_SIZE} / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.2f GB', floor({_SIZE} / 1048576.0::DOUBLE * 100 + 0.5) / 100) END AS size,
  CASE WHEN {_SEC} < 60 THEN 'just now' WHEN {_SEC} < 3600 THEN CAST(floor({_SEC} / 60) AS BIGINT) || 'm ago' WHEN {_SEC} < 86400 THEN CAST(floor({_SEC} / 3600) AS BIGINT) || 'h ago'
    WHEN {_SEC} < 604800 THEN CAST(floor({_SEC} / 86400) AS BIGINT) || 'd ago' WHEN {_SEC} < 2419200 THEN CAST(floor({_SEC} / 604800) AS BIGINT) || 'w ago'
    WHEN {_SEC} < 31104000 THEN CAST(floor({_SEC} / 2592000) AS BIGINT) || 'mo ago' ELSE CAST(floor({_SEC} / 31536000) AS BIGINT) || 'y ago' END AS since,
  CAST(greatest(4096, least(262144, CASE WHEN {_P} % 2 = 0 THEN floor({_P} * 400 * 0.75) ELSE {_P} * 400 END)) AS BIGINT) AS context,
  CASE WHEN {_P} % 15 >= 10 THEN 'high' WHEN {_P} % 15 >= 3 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN {_P} % 4 >= 2 THEN CAST({_P} AS DOUBLE) END AS number, {_P} % 60 >= 30 AS eligible, {_P} % 50 BETWEEN 2 AND 36 AND {_P} % 300 >= 26 AS candidate
  FROM (SELECT *, {_P} % 260 AS k, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split('dev' || {_P} || '@example.org', ''), lambda c: CAST(ascii(c) AS HUGEINT))),
    lambda a, c: (a * 31 + c) % 4294967296) AS h FROM lineitem)"""


def _people(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("Ann  Lee", "A. Lee", "ann lee", "Bo Lee", "A Ray", "Amy Ray", "Cher", "B. LEE")]), (F.col("c_custkey") % 8 + 1).cast("int")).alias("name"))


def _name_matches(spark, d):
    p = _people(spark, d).withColumn("other", F.element_at(F.array(*[F.lit(x) for x in ("Ann Lee", "Amy Ray", "Cher")]), (F.floor(F.col("c_custkey") / 8) % 3 + 1).cast("int")))
    a, b = F.col("name"), F.col("other")
    return p.groupBy("name", "other").agg(F.count("*").alias("n")).select(
        "name", "other", "n", scalars.is_initial_match(a, b).alias("initial"), scalars.names_similar(a, b).alias("similar"), scalars.initials(a).alias("initials"), scalars.last_name(a).alias("last")
    )


_Q = lambda sql, *frames: with_frames(sql, *(frames or (COMMITS,)))

QUERIES = {
    "order_join": (
        lambda spark, d: _base(spark, d).join(_order_owners(spark, d), "order_id").groupBy("order_id", "owner", "status").agg(F.count("*").alias("n")),
        _Q(f"SELECT order_id, owner, status, count(*) AS n FROM commits JOIN owners USING (order_id) WHERE {_BASE} GROUP BY ALL", COMMITS, JOBS, OWNERS),
    ),
    "preview_totals": (
        _reusable,
        _Q(
            f"""SELECT s.order_id, count(*) AS total, count(*) FILTER (cached) AS cached, greatest(0, count(*) - count(*) FILTER (cached)) AS billable FROM (
              SELECT w.order_id, EXISTS (SELECT 1 FROM done WHERE done.repo = w.repo AND done.dup_sha = w.dup_sha AND (done.order_id = w.order_id OR (done.user_id = w.user_id AND done.status = 'COMPLETED'))) AS cached
              FROM (SELECT DISTINCT c.order_id, u.user_id, repo, dup_sha FROM commits c JOIN users u ON u.order_id = c.order_id WHERE {_BASE}) w) s GROUP BY s.order_id""",
            COMMITS, JOBS, OWNERS, "users AS (SELECT order_id, order_id % 3 AS user_id, status FROM owners)",
            "done AS (SELECT c.order_id, u.user_id, u.status, repo, dup_sha FROM commits c JOIN users u ON u.order_id = c.order_id WHERE job_id IS NOT NULL AND (method IS NULL OR method <> 'error'))",
        ),
    ),
    "reusable_by_user": (
        lambda spark, d: scope.reusable_by_user(_base(spark, d), commits(spark, d), _order_users(spark, d)),
        _Q(
            f"""SELECT w.order_id, w.repo, w.dup_sha, b.f.cents AS cents, b.f.sha AS sha, b.f.from_order AS from_order FROM (SELECT DISTINCT c.order_id, u.user_id, repo, dup_sha FROM commits c JOIN users u ON u.order_id = c.order_id WHERE {_BASE}) w,
            LATERAL (SELECT arg_min({{'cents': e.cents, 'sha': e.sha, 'from_order': e.order_id}}, {{'a': -epoch(e.day), 'b': e.sha, 'c': e.order_id}}) AS f FROM held e
              WHERE e.user_id = w.user_id AND e.repo = w.repo AND e.dup_sha = w.dup_sha AND e.order_id <> w.order_id) b WHERE b.f IS NOT NULL""",
            COMMITS, JOBS, OWNERS, "users AS (SELECT order_id, order_id % 3 AS user_id, status FROM owners)",
            f"held AS (SELECT c.order_id, u.user_id, repo, dup_sha, day, cents, sha FROM commits c JOIN users u ON u.order_id = c.order_id WHERE status = 'COMPLETED' AND {_BASE})",
        ),
    ),
    "preview_first_run": (
        _excluded_people,
        _Q(f"SELECT order_id, CAST(least(count(*), 900) AS BIGINT) AS total FROM commits WHERE {_BASE} AND email NOT IN ('dev1@example.org', 'dev2@example.org') GROUP BY order_id"),
    ),
    "order_rollup": (
        _order_rollup,
        with_recursive_frames(
            f"SELECT order_id, round(avg({_RATIO}), 6) AS mean_ratio, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(commits) AS BIGINT) AS commits, count(*) AS developers FROM dev GROUP BY order_id", _BY_ORDER, PLACED, _DEV
        ),
    ),
    "order_kpis": (
        lambda spark, d: _order_metrics(spark, d).where("order_id = 3")
        .agg(F.sum("commits").alias("commits"), F.round(F.avg(F.when(F.col("days") >= 2, F.coalesce(scalars.ratio(F.col("cents"), F.col("days")), F.lit(0.0)))), 6).alias("mean_ratio"), F.sum("days").alias("work_days")),
        with_recursive_frames(
            f"SELECT CAST(sum(commits) AS BIGINT) AS commits, round(avg({_RATIO}) FILTER (days >= 2), 6) AS mean_ratio, CAST(sum(days) AS BIGINT) AS work_days FROM dev WHERE order_id = 3", _BY_ORDER, PLACED, _DEV
        ),
    ),
    "effort_timeline": (
        _overhead,
        with_recursive_frames("SELECT type, CAST(year(day) AS VARCHAR) AS period, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM erows GROUP BY ALL", COMMITS, PLACED, _EROWS),
    ),
    "people_union": (
        lambda spark, d: _base(spark, d).select("email").union(memberships(spark, d).select("email")).distinct().orderBy("email"),
        _Q(f"SELECT email FROM commits WHERE {_BASE} UNION SELECT email FROM members", COMMITS, MEMBERS),
    ),
    "team_repo_union": (
        lambda spark, d: temporal.attributed(_base(spark, d).select("repo", "email", "day"), memberships(spark, d)).where("team IN (0, 1)").select("repo").union(_base(spark, d).where("order_id = 3").select("repo")).distinct(),
        _Q(f"SELECT repo FROM commits JOIN members USING (email) WHERE {_BASE} AND team IN (0, 1) AND day >= starts AND (ends IS NULL OR day < ends) UNION SELECT repo FROM commits WHERE order_id = 3 AND {_BASE}", COMMITS, MEMBERS),
    ),
    "contributor_filter": (
        lambda spark, d: reports.within(aliases(spark, d).where("contributor_id IS NOT NULL"), "contributor_id", aliases(spark, d).where("contributor_id % 3 = 0")).select("email", "contributor_id"),
        _Q("SELECT email, contributor_id FROM aliases WHERE contributor_id % 3 = 0", ALIASES),
    ),
    "user_orders": (
        lambda spark, d: reports.child_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), jobs(spark, d), "user_id"),
        _Q("SELECT c_custkey AS user_id, count(job_id) AS n_children FROM customer LEFT JOIN jobs ON user_id = c_custkey GROUP BY c_custkey", JOBS),
    ),
    "commit_pages": (
        lambda spark, d: _base(spark, d).agg(F.count("*").alias("n")).select("n", reports.total_pages(F.col("n"), 75).alias("pages")),
        _Q(f"SELECT count(*) AS n, CAST(ceil(count(*) / 75) AS BIGINT) AS pages FROM commits WHERE {_BASE}"),
    ),
    "team_activity": (
        _team_activity,
        _Q(
            f"""SELECT team, count(DISTINCT email) AS active, max(day) AS last_day, min(day) AS first_day FROM commits JOIN members USING (email) WHERE {_BASE} AND day >= starts AND (ends IS NULL OR day < ends)
            AND day BETWEEN DATE '1996-06-01' AND DATE '1997-06-01' GROUP BY team""",
            COMMITS, MEMBERS,
        ),
    ),
    "team_candidates": (
        _candidates,
        _Q(
            f"""SELECT email, count(*) AS n, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, min(day) AS first_day, max(day) AS last_day FROM commits WHERE {_BASE}
            AND email NOT IN (SELECT email FROM members WHERE team = 0) GROUP BY email ORDER BY n DESC, email LIMIT 100""",
            COMMITS, MEMBERS,
        ),
    ),
    "earliest_activity": (
        lambda spark, d: aliases(spark, d).join(_base(spark, d).groupBy("email").agg(F.min("day").alias("first")), "email", "left").groupBy("contributor_id").agg(F.coalesce(F.min("first"), _as_of()).alias("since")),
        _Q(f"SELECT contributor_id, coalesce(min(day), {_AS_OF}) AS since FROM aliases LEFT JOIN (SELECT * FROM commits WHERE {_BASE}) USING (email) GROUP BY contributor_id", COMMITS, ALIASES),
    ),
    "activity_scores": (
        lambda spark, d: reports.weekly_activity(_base(spark, d), ["repo"], _as_of()).withColumn("score", F.round("score", 6)).withColumn("level", scalars.activity_level(F.col("score"))),
        _Q(
            f"""SELECT repo, count(*) AS commits, count(DISTINCT w) AS active_weeks, round(count(*) / 12, 6) AS score, count(DISTINCT w) / 12 >= 0.6 AND count(*) >= 20 AS full_time,
            CASE WHEN round(count(*) / 12, 6) >= 10 THEN 'high' WHEN round(count(*) / 12, 6) >= 3 THEN 'medium' ELSE 'low' END AS level
            FROM (SELECT repo, ({_AS_OF} - day) // 7 AS w, {_AS_OF} - day AS a FROM commits WHERE {_BASE}) WHERE a >= 0 AND w < 12 GROUP BY repo"""
        ),
    ),
    "people_estimate": (
        lambda spark, d: _base(spark, d).groupBy("repo").agg(F.greatest(F.countDistinct(F.when(~F.col("email").contains("dev1"), F.col("email"))), F.countDistinct(F.when(F.col("cents") % 2 == 0, F.col("email")))).alias("people")),
        _Q(f"SELECT repo, greatest(count(DISTINCT email) FILTER (NOT contains(email, 'dev1')), count(DISTINCT email) FILTER (cents % 2 = 0)) AS people FROM commits WHERE {_BASE} GROUP BY repo"),
    ),
    "usage_by_provider": (
        _usage,
        _Q(
            """SELECT coalesce(CASE WHEN event_id % 4 <> 0 THEN 'p' || (event_id % 3) END, 'unknown') AS provider, count(*) AS calls, CAST(sum(event_id % 900) AS BIGINT) AS tokens, CAST(sum(job_id % 77) AS BIGINT) AS millis,
            round(sum(event_id % 900) / 1e6 * 0.4::DOUBLE, 9) AS cost FROM ev GROUP BY 1""",
            EVENTS,
        ),
    ),
    "date_bounds": (
        lambda spark, d: table(spark, d, "orders").join(commits(spark, d).where("job_id IS NOT NULL").groupBy(F.col("order_id").alias("o")).agg(F.min("day").alias("a"), F.max("day").alias("b")), F.col("o_orderkey") == F.col("o"), "left")
        .select("o_orderkey", F.coalesce("a", F.to_date("o_orderdate")).alias("first_day"), F.coalesce("b", F.date_add(F.to_date("o_orderdate"), 30)).alias("last_day")),
        _Q(
            """SELECT o_orderkey, coalesce(a, CAST(o_orderdate AS DATE)) AS first_day, coalesce(b, CAST(o_orderdate AS DATE) + 30) AS last_day FROM orders
            LEFT JOIN (SELECT order_id, min(day) AS a, max(day) AS b FROM commits WHERE job_id IS NOT NULL GROUP BY order_id) ON order_id = o_orderkey"""
        ),
    ),
    "workspace_summary": (
        lambda spark, d: _base(spark, d).groupBy("repo").agg(F.max(F.when(F.col("repo") != "org/repo7", F.col("day"))).alias("day"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("day") >= F.date_sub(_as_of(), 30)).alias("fresh"), F.count_if(F.col("day").isNull()).alias("never"))
        .withColumn("stale", F.col("total") - F.col("fresh") - F.col("never")).withColumn("stage", scalars.workspace_stage(F.col("never") * 0, F.col("total"), F.col("fresh"))),
        _Q(
            f"""SELECT total, fresh, never, total - fresh - never AS stale, CASE WHEN total > 0 AND fresh > 0 THEN 'first_data' ELSE 'empty' END AS stage FROM (SELECT count(*) AS total, count(*) FILTER (day >= {_AS_OF} - 30) AS fresh,
            count(*) FILTER (day IS NULL) AS never FROM (SELECT max(CASE WHEN repo <> 'org/repo7' THEN day END) AS day FROM commits WHERE {_BASE} GROUP BY repo))"""
        ),
    ),
    "stale_repos": (
        lambda spark, d: _base(spark, d).groupBy("repo", "order_id").agg(F.max("day").alias("day")).where(scalars.freshness(F.col("day"), F.to_date(F.lit("2001-10-20"))) == "stale").select("repo", "order_id", "day"),
        _Q(f"SELECT repo, order_id, max(day) AS day FROM commits WHERE {_BASE} GROUP BY repo, order_id HAVING max(day) < DATE '2001-10-20' - 30"),
    ),
    "repository_detail": (
        _repo_detail,
        _Q(
            f"""SELECT coalesce('c' || contributor_id, email) AS who, contributor_id IS NOT NULL AS resolved, count(*) AS n, max(day) AS last_day FROM (SELECT *, row_number() OVER (PARTITION BY dup_sha ORDER BY day DESC, sha) AS r
            FROM commits WHERE repo = 'org/repo3' AND {_BASE}) LEFT JOIN aliases USING (email) WHERE r = 1 GROUP BY ALL""",
            COMMITS, ALIASES,
        ),
    ),
    "order_scope_counts": (
        lambda spark, d: _base(spark, d).join(aliases(spark, d), "email", "left").groupBy("order_id").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("contributor_id").alias("people"), F.countDistinct("dup_sha").alias("commits"), F.max_by("repo", F.struct("day", "sha")).alias("latest_repo")),
        _Q(f"SELECT order_id, count(DISTINCT repo) AS repos, count(DISTINCT contributor_id) AS people, count(DISTINCT dup_sha) AS commits, arg_max(repo, {{'a': day, 'b': sha}}) AS latest_repo FROM commits LEFT JOIN aliases USING (email) WHERE {_BASE} GROUP BY order_id", COMMITS, ALIASES),
    ),
    "latest_analysis": (
        lambda spark, d: _base(spark, d).join(jobs(spark, d).where("status = 'COMPLETED'").groupBy().agg(F.max_by("order_id", F.struct("created", "job_id")).alias("o")).select((F.col("o") % 10).alias("order_id")), "order_id")
        .agg(F.countDistinct("email").alias("people"), F.count("*").alias("commits"), F.countDistinct("repo").alias("repos")),
        _Q(
            f"""SELECT count(DISTINCT email) AS people, count(*) AS commits, count(DISTINCT repo) AS repos FROM commits WHERE {_BASE} AND order_id =
            (SELECT arg_max(order_id, {{'a': created, 'b': job_id}}) % 10 FROM jobs WHERE status = 'COMPLETED')""",
            COMMITS, JOBS,
        ),
    ),
    "estimator_health": (
        lambda spark, d: health.estimator_health(_estimates(spark, d), _worked_jobs(spark, d), _SINCE, _NOW),
        _Q(
            """SELECT * EXCLUDE (l), CASE WHEN list_contains(l, 'fail') THEN 'fail' WHEN list_contains(l, 'warn') THEN 'warn' WHEN list_contains(l, 'pass') THEN 'pass' ELSE 'na' END AS overall FROM (
              SELECT *, [fallback_status, holistic_status, job_status, attribution_status] AS l FROM (SELECT *,
                CASE WHEN fallback_rate IS NULL THEN 'na' WHEN fallback_rate <= 1 THEN 'pass' WHEN fallback_rate <= 3 THEN 'warn' ELSE 'fail' END AS fallback_status,
                CASE WHEN holistic_share IS NULL THEN 'na' WHEN holistic_share >= 95 THEN 'pass' WHEN holistic_share >= 80 THEN 'warn' ELSE 'fail' END AS holistic_status,
                CASE WHEN failed_jobs + stale_pending + stale_running + stalled_post_processing > 2 THEN 'fail' WHEN failed_jobs + stale_pending + stale_running + stalled_post_processing > 0 THEN 'warn' WHEN recent_jobs > 0 THEN 'pass' ELSE 'na' END AS job_status,
                CASE WHEN heuristic_attributed + special_attributed + model_missing > 2 THEN 'fail' WHEN heuristic_attributed + special_attributed + model_missing > 0 THEN 'warn' WHEN recent_commits > 0 THEN 'pass' ELSE 'na' END AS attribution_status
              FROM (SELECT *, fallbacks / nullif(recent_commits, 0) * 100 AS fallback_rate, fd_holistic / nullif(fd_total, 0) * 100 AS holistic_share FROM hc, hj)))""",
            *_HEALTH,
        ),
    ),
    "suspicious_estimates": (
        lambda spark, d: health.suspicious(_estimates(spark, d), _SINCE),
        _Q(f"SELECT sha, method, model, repo, analysed FROM est WHERE ({_HEURISTIC} AND model IS NOT NULL) OR ({_SPECIAL} AND model IS NOT NULL) OR ({_LARGE} AND model IS NULL) ORDER BY analysed DESC, sha LIMIT 5", *_HEALTH),
    ),
    "stuck_jobs": (
        _stuck,
        _Q(
            """SELECT job_id, array_to_string(r, ',') AS reasons FROM (SELECT j.job_id, list_filter([CASE WHEN st = 'PENDING' AND idle > 120 THEN 'pending_too_long' END,
            CASE WHEN s0 AND NOT s1 AND idle > 120 THEN 'accepted_without_worker' END,
            CASE WHEN st = 'RUNNING' AND (CASE WHEN j.job_id % 3 <> 0 THEN j.job_id % 1300 ELSE j.job_id % 2000 END) > 600 THEN 'heartbeat_stale' END, CASE WHEN st = 'LLM_COMPLETE' AND idle > 300 THEN 'post_processing_stale' END,
            CASE WHEN code = 'error' THEN 'error_event' END,
            CASE WHEN j.job_id % 2000 >= 180 AND (NOT coalesce(s0, FALSE) OR (NOT s1 AND (s0 OR s2)) OR (NOT s2 AND s1)) THEN 'missing_step' END], lambda x: x IS NOT NULL) AS r
            FROM (SELECT *, CASE WHEN job_id % 11 = 0 THEN 'LLM_COMPLETE' ELSE status END AS st, CASE WHEN job_id % 17 <> 0 THEN job_id % 500 ELSE job_id % 2000 END AS idle FROM jobs) j
            LEFT JOIN (SELECT job_id, arg_max(code, {'a': second, 'b': event_id}) AS code, bool_or(code = 'view') AS s0, bool_or(code IN ('click', 'error')) AS s1, bool_or(code = 'purchase') AS s2 FROM ev GROUP BY job_id) USING (job_id)) WHERE len(r) > 0""",
            JOBS, EVENTS,
        ),
    ),
    "step_states": (
        _steps,
        _Q(
            f"""SELECT job_id, step, CAST(i AS INT) AS "index", CASE WHEN done THEN 'done' WHEN i > m THEN 'pending' ELSE 'missing' END AS state FROM (SELECT *, max(CASE WHEN done THEN i END) OVER (PARTITION BY job_id) AS m FROM (
            SELECT j.job_id, s.step, s.i, d.job_id IS NOT NULL AS done FROM (SELECT DISTINCT job_id FROM ev WHERE code IN {_STEPS}) j, (SELECT unnest({list(_STEPS)}) AS step, unnest([0, 1, 2, 3]) AS i) s
            LEFT JOIN (SELECT DISTINCT job_id, code FROM ev) d ON d.job_id = j.job_id AND d.code = s.step))""",
            EVENTS,
        ),
    ),
    "client_events": (
        lambda spark, d: _client(spark, d).drop("developer").withColumn("params", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")),
        _Q("SELECT job_id, event_id, seq, tier, category, text, params, developer_id, hours FROM shown", *_SHOWN),
    ),
    "leaderboard": (
        lambda spark, d: client.leaderboard(_client(spark, d), _job_progress(spark, d)),
        _Q(
            """SELECT job_id, developer_id, arg_max(developer, {'a': event_id, 'b': seq, 'c': developer}) AS name, floor(CAST(sum(floor(hours * 10000 + 0.5)) FILTER (hours IS NOT NULL) AS BIGINT) / 100 + 0.5) / 100 AS hours, count(hours) AS commits,
            CAST(floor(3.0::DOUBLE * (job_id % 30) * (job_id % 101) / 100 + 0.5) AS BIGINT) AS expected FROM shown WHERE developer_id IS NOT NULL GROUP BY job_id, developer_id HAVING count(hours) > 0""",
            *_SHOWN,
        ),
    ),
    "effective_progress": (
        lambda spark, d: jobs(spark, d).select("job_id", F.greatest(F.col("retries") * 10, F.least(F.lit(99), F.floor(F.try_divide(F.col("consumed"), F.col("reserved")) * 90))).cast("long").alias("progress")),
        _Q("SELECT job_id, CAST(greatest(retries * 10, least(99, CASE WHEN reserved > 0 THEN floor(consumed / reserved::DOUBLE * 90) END)) AS BIGINT) AS progress FROM jobs", JOBS),
    ),
    "available_credits": (
        lambda spark, d: jobs(spark, d).groupBy("user_id").agg(F.sum("reserved").alias("held"), F.sum(F.when(F.col("created") >= F.date_sub(_as_of(), 365), F.col("released")).otherwise(0)).alias("subscription"), F.sum("consumed").alias("permanent"))
        .select("user_id", "subscription", (F.col("permanent") + F.col("subscription") - F.col("held")).alias("available")),
        _Q(f"SELECT user_id, CAST(sum(CASE WHEN created >= {_AS_OF} - 365 THEN released ELSE 0 END) AS BIGINT) AS subscription, CAST(sum(consumed) + sum(CASE WHEN created >= {_AS_OF} - 365 THEN released ELSE 0 END) - sum(reserved) AS BIGINT) AS available FROM jobs GROUP BY user_id", JOBS),
    ),
    "promo_codes": (
        lambda spark, d: table(spark, d, "part").where(scalars.promo_is_open(F.col("p_size") % 3 != 0, F.date_add(_as_of(), (F.col("p_size") - 20).cast("int")), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 4 != 0, F.lit(5)), _as_of())).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_size > 20 AND (p_partkey % 4 = 0 OR p_partkey % 10 < 5)",
    ),
    "contributor_health": (
        _contributor_health,
        """SELECT CASE WHEN b = 0 THEN 'healthy' WHEN a > 0 THEN 'attention' ELSE 'unresolved' END AS health, count(*) AS n, CAST(sum(a) AS BIGINT) AS resolved, CAST(sum(b) AS BIGINT) AS unresolved
        FROM (SELECT s_nationkey, count(*) FILTER (s_suppkey % 9 <> 0) AS a, count(*) FILTER (s_suppkey % 9 = 0) AS b FROM supplier GROUP BY s_nationkey) GROUP BY 1""",
    ),
    "identity_queue": (
        _queue,
        _Q(f"SELECT email, seen FROM aliases LEFT JOIN (SELECT email, max(day) AS seen FROM commits WHERE {_BASE} GROUP BY email) USING (email) WHERE contributor_id IS NULL ORDER BY seen DESC NULLS LAST, email LIMIT 20", COMMITS, ALIASES),
    ),
    "identity_evidence": (
        _identity_evidence,
        _Q(f"SELECT sha, email, day FROM commits WHERE {_BASE} AND email IN (SELECT email FROM aliases WHERE contributor_id = 4) ORDER BY day DESC, sha LIMIT 50", COMMITS, ALIASES),
    ),
    "domain_matches": (
        lambda spark, d: table(spark, d, "customer").where(F.concat(F.lit("u@n"), F.col("c_nationkey").cast("string"), F.lit(".example")).endswith("@n3.example")).orderBy("c_custkey").limit(10).select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 10",
    ),
    "latest_rows": (
        lambda spark, d: scope.newest_per(commits(spark, d).select("repo", "dup_sha", "day", "sha"), ["repo", "dup_sha"], [-F.unix_date("day"), F.col("sha")]).orderBy(F.col("day").desc(), "sha").limit(300).select("repo", "sha"),
        _Q("SELECT repo, sha FROM (SELECT *, row_number() OVER (PARTITION BY repo, dup_sha ORDER BY day DESC, sha) AS r FROM commits) WHERE r = 1 ORDER BY day DESC, sha LIMIT 300"),
    ),
    "beeswarm": (
        lambda spark, d: reports.stacked(_base(spark, d).groupBy("email").agg(F.sum("cents").alias("cents")).withColumn("bin", F.floor(F.col("cents") / 2000)), "bin", ["email"]).select("email", "bin", "offset"),
        _Q(
            f"""SELECT email, bin, CAST(CASE WHEN k % 2 = 1 THEN ceil(k / 2) ELSE -ceil(k / 2) END AS BIGINT) AS "offset" FROM (SELECT email, CAST(floor(c / 2000) AS BIGINT) AS bin, row_number() OVER (PARTITION BY floor(c / 2000) ORDER BY email) - 1 AS k
            FROM (SELECT email, sum(cents) AS c FROM commits WHERE {_BASE} GROUP BY email))"""
        ),
    ),
    "event_tail": (
        lambda spark, d: job_events(spark, d).orderBy(F.col("event_id").desc()).limit(30).orderBy("event_id").select("event_id", "code"),
        _Q("SELECT event_id, code FROM (SELECT * FROM ev ORDER BY event_id DESC LIMIT 30) ORDER BY event_id", EVENTS),
    ),
    "newest_lists": (
        lambda spark, d: reports.top_per(jobs(spark, d), ["status"], [F.col("created").desc(), F.col("job_id")], 30).select("status", "job_id", "rank"),
        _Q("SELECT status, job_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created DESC, job_id) AS r FROM jobs) WHERE r <= 30", JOBS),
    ),
    "ratio_listing": (
        lambda spark, d: _work_ratios(spark, d).orderBy(F.col("ratio").desc_nulls_last(), "email").limit(60).select("email", "ratio", scalars.colour(F.col("ratio")).alias("zone")),
        with_recursive_frames(
            """SELECT email, ratio, CASE WHEN ratio IS NULL THEN 'gray' WHEN ratio >= 100 THEN 'green' WHEN ratio >= 80 THEN 'yellow' ELSE 'red' END AS zone FROM (SELECT email,
            CASE WHEN work_days >= 20 THEN round(CAST(total_cents AS DOUBLE) * 100 / (work_days * 300), 6) END AS ratio FROM pmetrics) ORDER BY ratio DESC NULLS LAST, email LIMIT 60""",
            COMMITS,
            PLACED,
        ),
    ),
    "featured_listing": (
        lambda spark, d: table(spark, d, "part").orderBy((F.col("p_size") > 45).desc(), F.col("p_size").asc(), F.col("p_retailprice").desc(), "p_partkey").offset(20).limit(20).select("p_partkey"),
        "SELECT p_partkey FROM part ORDER BY p_size > 45 DESC, p_size, p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20",
    ),
    "visible_views": (
        lambda spark, d: table(spark, d, "part").where((F.col("p_size") % 2 == 0) | (F.col("p_partkey") % 9 == 0)).where(F.lower("p_name").contains("a")).orderBy("p_name", "p_partkey").limit(40).select("p_partkey", "p_name"),
        "SELECT p_partkey, p_name FROM part WHERE (p_size % 2 = 0 OR p_partkey % 9 = 0) AND contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 40",
    ),
    "order_listing": (
        lambda spark, d: table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "c_name"),
        "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    ),
    "insert_skip_duplicates": (
        lambda spark, d: reports.insert_new(_base(spark, d).where("order_id = 1").select("dup_sha", "repo").distinct(), _base(spark, d).where("order_id = 2").select("dup_sha", "repo"), ["dup_sha", "repo"]),
        _Q(f"SELECT DISTINCT dup_sha, repo FROM commits WHERE order_id IN (1, 2) AND {_BASE}"),
    ),
    "forward_upsert": (
        lambda spark, d: reports.upsert(*_stored_projects(spark, d), ["repo"], "n", ("analysed",)),
        _Q(
            f"""SELECT coalesce(a.repo, b.repo) AS repo, greatest(a.d, b.d) AS analysed, coalesce(b.n, a.n) AS n FROM (SELECT repo, max(day) AS d, count(*) AS n FROM commits WHERE order_id < 5 AND {_BASE} GROUP BY repo) a
            FULL JOIN (SELECT repo, max(day) AS d, count(*) AS n FROM commits WHERE order_id >= 5 AND {_BASE} GROUP BY repo) b ON a.repo = b.repo"""
        ),
    ),
    "delete_and_copy": (
        lambda spark, d: reports.delete_where(commits(spark, d), F.col("method") == "error").unionByName(reports.copied(_base(spark, d).where("order_id = 1"), order_id=99, repo="copy/of")).groupBy("order_id", "repo").agg(F.count("*").alias("n")),
        _Q(f"SELECT order_id, repo, count(*) AS n FROM (SELECT order_id, repo FROM commits WHERE method IS NULL OR method <> 'error' UNION ALL SELECT 99, 'copy/of' FROM commits WHERE order_id = 1 AND {_BASE}) GROUP BY ALL"),
    ),
    "first_wins_names": (
        lambda spark, d: reports.first_wins(_names(spark, d), "name", "position"),
        "SELECT arg_min(name, p) AS name, min(p) AS position FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS name, p_partkey AS p FROM part) GROUP BY lower(name)",
    ),
    "range_slice": (
        _slice,
        with_recursive_frames(
            "SELECT email, count(DISTINCT day) AS days, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents FROM (SELECT DISTINCT email FROM members) LEFT JOIN (SELECT * FROM pdays WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') USING (email) GROUP BY email",
            COMMITS, MEMBERS, PLACED,
        ),
    ),
    "scalar_functions": (_scalars, _SCALARS),
    "name_matches": (
        _name_matches,
        """SELECT name, other, count(*) AS n, lw = lo AND fw <> fo AND ((regexp_matches(fw, '^[^.]\\.?$') AND fw[1] = fo[1]) OR (regexp_matches(fo, '^[^.]\\.?$') AND fw[1] = fo[1])) AS initial,
        lower(trim(name)) = lower(trim(other)) OR (len(pw) > 1 AND len(po) > 1 AND lw = lo AND fw[1] = fo[1]) AS similar, array_to_string(list_transform(pw, lambda x: x[1]), '') AS initials, lw AS last
        FROM (SELECT *, pw[1] AS fw, pw[-1] AS lw, po[1] AS fo, po[-1] AS lo FROM (SELECT name, other, string_split_regex(lower(trim(name)), '\\s+') AS pw, string_split_regex(lower(trim(other)), '\\s+') AS po FROM (
        SELECT ['Ann  Lee', 'A. Lee', 'ann lee', 'Bo Lee', 'A Ray', 'Amy Ray', 'Cher', 'B. LEE'][c_custkey % 8 + 1] AS name, ['Ann Lee', 'Amy Ray', 'Cher'][c_custkey // 8 % 3 + 1] AS other FROM customer))) GROUP BY ALL""",
    ),
}
