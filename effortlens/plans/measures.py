"""Effort, timeline, identity, health and accuracy queries: name -> (query, SQL to check it with or None)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import accuracy, billing, calibration, clusters, identity, incremental, pacing, scope, spread, timeline
from effortlens.plans.check_sql import ALIASES, COMMITS, EVENTS, JOBS, PLACED, TRUTH, with_frames, with_recursive_frames
from effortlens.sources.tables import aliases, commits, dev_email, ground_truth, job_events, jobs, table
from effortlens.storage import checkpointed, new_path

_BASE = "job_id IS NULL AND method <> 'error'"
_ROWS = """erows AS (SELECT email, day, cents AS placed, 0 AS overhead FROM effort UNION ALL SELECT email, day, 0, cents - coalesce(p, 0) FROM base
  LEFT JOIN (SELECT email, entry_day AS day, sha, sum(cents) AS p FROM effort GROUP BY ALL) USING (email, day, sha) WHERE cents - coalesce(p, 0) > 0)"""


def _base(spark, d):
    return commits(spark, d).where(scope.base())


def _placed(spark, d):
    """email, day, cents placed by spreading: at most the daily cap on each day."""
    return spread.placed_days(_base(spark, d)).groupBy("email", "day").agg(F.sum("cents").alias("cents"))


def _ratios(spark, d):
    percent = F.floor(F.col("ratio_raw") * 100 + 0.5) / 100
    return spread.developer_metrics(_base(spark, d)).select("email", percent.alias("percent"), scalars.colour(percent).alias("colour"))


def _norm(means):
    """The median of all developers' means, which are stored as they are read three times."""
    return accuracy.percentiles(checkpointed(means.select("mean")), [], "mean", {"norm": 0.5}).select(_r("norm", 2).alias("norm"))


def _median_norm(spark, d):
    means = spread.developer_metrics(_base(spark, d)).where("work_days > 0 AND total_cents > 0").select((F.col("total_cents") / F.col("work_days")).alias("mean"))
    return _norm(means)


def _timeline(unit):
    key = {
        "week": "CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0')",
        "month": "strftime(day, '%Y-%m')",
        "quarter": "year(day) || '-Q' || quarter(day)",
        "year": "CAST(year(day) AS VARCHAR)",
    }[unit]
    whole = lambda x, n: f"CAST(floor(({x}) / ({n}) + 0.5) AS BIGINT)"
    sql = f"""SELECT *, {whole("placed_cents", "developer_days")} AS avg_placed_by_active, {whole("overhead_cents", "developer_days")} AS avg_overhead_by_active,
      {whole("total_cents", "developer_days")} AS avg_by_active, {whole("total_cents", "days * selected")} AS avg_by_all FROM (
      SELECT period, CAST(sum(p) AS BIGINT) AS placed_cents, CAST(sum(o) AS BIGINT) AS overhead_cents, count(*) AS developer_days, count(DISTINCT day) AS days, count(DISTINCT email) AS active,
        (SELECT count(DISTINCT email) FROM base) AS selected, CAST(sum(p + o) AS BIGINT) AS total_cents
      FROM (SELECT {key} AS period, email, day, sum(placed) AS p, sum(overhead) AS o FROM erows GROUP BY ALL) GROUP BY period)"""
    run = lambda spark, d: timeline.effort_buckets(spread.effort_rows(_base(spark, d)), _base(spark, d), unit)
    return run, with_recursive_frames(sql, COMMITS, PLACED, _ROWS)


def _workdays(spark, d):
    g = _base(spark, d).groupBy("email").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return g.select("email", scalars.weekdays_between(F.col("a"), F.col("b")).alias("weekdays"))


def _everyone(spark, d):
    """Every customer as a developer: name, sometimes a login, e-mail; two to three share a name, some names are misspelt or begin with an initial."""
    key = F.col("c_custkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("ann", "anne", "ben", "b.", "cora", "dora", "finn")]), (key % 7 + 1).cast("int"))
    last = F.substring(F.md5(F.floor(key / 20).cast("string")), 1, 8)
    last = F.when(key % 11 == 0, F.concat(F.substring(last, 1, 7), F.lit("z"))).otherwise(last)
    domain = F.when(key % 3 == 0, "Gmail.com").otherwise(F.concat(F.lit("Firm"), F.col("c_nationkey").cast("string"), F.lit(".example")))
    login = F.when(key % 5 == 0, F.concat(F.lit("u"), F.floor(key / 13).cast("string")))
    email = F.concat(F.lit("p"), F.floor(key / 2).cast("string"), F.lit("@"), domain)
    return table(spark, d, "customer").select(key.alias("id"), F.concat_ws(" ", word, last).alias("name"), login.alias("login"), email.alias("email"))


_PEOPLE = """people AS (SELECT id, name, string_split(name, ' ')[1] AS first, string_split(name, ' ')[-1] AS last, login, email, string_split(email, '@')[2] AS domain FROM (
  SELECT k AS id, ['ann', 'anne', 'ben', 'b.', 'cora', 'dora', 'finn'][k % 7 + 1] || ' ' || CASE WHEN k % 11 = 0 THEN substr(md5(CAST(k // 20 AS VARCHAR)), 1, 7) || 'z' ELSE substr(md5(CAST(k // 20 AS VARCHAR)), 1, 8) END AS name,
    CASE WHEN k % 5 = 0 THEN 'u' || (k // 13) END AS login, 'p' || (k // 2) || '@' || CASE WHEN k % 3 = 0 THEN 'gmail.com' ELSE 'firm' || n || '.example' END AS email FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer)))"""
_MATCHES = """ranked AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.name = b.name THEN 5 WHEN a.login = b.login THEN 4
    WHEN a.last = b.last AND a.first[1] = b.first[1] AND a.first <> b.first AND (a.first = 'b.' OR b.first = 'b.') THEN 3
    WHEN a.domain = b.domain AND a.domain <> 'gmail.com' AND levenshtein(a.name, b.name) <= 3 THEN 2 WHEN levenshtein(a.name, b.name) <= 2 THEN 1 END AS rank FROM people a JOIN people b ON a.id < b.id AND a.email <> b.email),
  matches AS (SELECT a, b, ['LOW', 'MEDIUM', 'MEDIUM', 'HIGH', 'HIGH'][rank] AS confidence, ['spelling', 'domain', 'initial', 'login', 'name'][rank] AS reason FROM ranked WHERE rank IS NOT NULL)"""


def _match_chain(spark, d):
    """Every supplier can be found; keys beyond the suppliers, and absent ones, miss."""
    key = F.col("c_custkey")
    provider = F.when(key % 4 != 0, key * 3)
    wanted = table(spark, d, "customer").select("c_custkey", F.when(key % 6 != 0, F.concat(F.lit("s"), F.floor(key / 5).cast("string"))).alias("login"), provider.alias("provider"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("login"), F.col("s_suppkey").alias("found"))
    return identity.first_match(wanted, [("provider", s.select("provider", "found")), ("login", s.select("login", "found"))]).select("c_custkey", "found", "found_by")


def _est(spark, d):
    truth = accuracy.consensus(ground_truth(spark, d)).withColumnRenamed("cents", "truth")
    return commits(spark, d).join(truth, "sha").select("model", "category", F.col("cents").cast("double").alias("estimate"), "truth", "sha")


def _r(c, digits=4):
    return F.floor(F.col(c) * 10**digits + 0.5) / 10**digits


def _author_stats(truth):
    given = F.count("cents")
    sums = truth.groupBy("author").agg(given.alias("n"), F.sum("cents").alias("total"), (F.sum("cents") / given).alias("mean_cents"))
    return accuracy.with_percentiles(sums, truth, ["author"], "cents", {"median_cents": 0.5}).withColumnRenamed("total", "cents")


def _errors(by):
    def run(spark, d):
        rows = accuracy.errors(_est(spark, d).where(F.col(by).isNotNull()), [by])
        return rows.select(by, "n", *[_r(c).alias(c) for c in ("mae", "r", "mape", "median_ape")])

    rnd = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
    ape = "abs(estimate - t) * 100.0 / nullif(t, 0)"
    sql = f"""SELECT {by}, count(*) AS n, {rnd('avg(abs(estimate - t))')} AS mae,
      {rnd('CASE WHEN count(*) >= 3 THEN covar_pop(estimate, t) / nullif(stddev_pop(estimate) * stddev_pop(t), 0) END')} AS r, {rnd(f'avg({ape})')} AS mape, {rnd(f'median({ape})')} AS median_ape
      FROM (SELECT c.*, CAST(c.cents AS DOUBLE) AS estimate, g.t FROM commits c JOIN (SELECT sha, median(cents) AS t FROM truth GROUP BY sha) g USING (sha)) WHERE {by} IS NOT NULL GROUP BY {by}"""
    return run, with_frames(sql, COMMITS, TRUTH)


def _percentiles(spark, d):
    events = job_events(spark, d)
    sums = events.groupBy("code").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return accuracy.with_percentiles(sums, events, ["code"], "value", shares).select("code", "n", "lo", "hi", *[_r(p).alias(p) for p in shares])


def _share_change(spark, d):
    """The stored metrics after some developers got half a share and others an automatic one; only their buckets are written again."""
    metrics = spread.developer_metrics(_base(spark, d)).select("email", "n_commits", "total_cents", "work_days", "fte_days", "share", "ratio_raw", "ratio_adjusted")
    path, schema = new_path(spark, "metrics"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in metrics.schema)
    incremental.write_metrics(metrics, path)
    key = F.col("s_suppkey")
    changes = table(spark, d, "supplier").where(key % 10 % 3 == 0).select(dev_email(key).alias("email"), F.when(key % 10 == 3, 0.5).alias("share"))
    incremental.change_shares(incremental.read_metrics(spark, path, schema), changes, path)
    return incremental.read_metrics(spark, path, schema).drop("bucket")


def _released(spark, d):
    """Events of users as they are shown: polls are hours apart."""
    tier = F.element_at(F.create_map(F.lit("purchase"), F.lit("milestone"), F.lit("signup"), F.lit("major"), F.lit("view"), F.lit("micro")), F.col("code"))
    events = job_events(spark, d).select(F.col("job_id").alias("session"), "event_id", (F.floor(F.col("second") / 3600) * 3_600_000).alias("poll_ms"), tier.alias("tier"))
    return pacing.released(pacing.delays(pacing.first_seen(events))).select("session", "event_id", "delay_us", "release_us")


_RELEASED = """q AS (SELECT job_id AS session, event_id, second // 3600 * 3600000 AS poll, CASE code WHEN 'purchase' THEN 4.0 WHEN 'view' THEN 0.5 ELSE 2.0 END::DOUBLE AS w,
    CASE code WHEN 'purchase' THEN 100 WHEN 'view' THEN 15 ELSE 40 END AS least_ms, CASE code WHEN 'purchase' THEN 800 WHEN 'view' THEN 80 ELSE 400 END AS most_ms FROM ev),
polls AS (SELECT session, poll, sum(w) AS weights, coalesce(poll - lag(poll) OVER (PARTITION BY session ORDER BY poll), 1000) * 1.2::DOUBLE AS budget FROM q GROUP BY session, poll),
d0 AS (SELECT q.session, event_id, q.poll, budget, CAST(floor(greatest(least_ms, least(most_ms, budget / weights * w)) * 1000 + 0.5) AS BIGINT) AS us FROM q JOIN polls ON polls.session = q.session AND polls.poll = q.poll),
d1 AS (SELECT *, sum(us) OVER (PARTITION BY session, poll) AS asked, floor(budget * 1000 + 0.5) AS most FROM d0),
d2 AS (SELECT session, event_id, poll, CAST(CASE WHEN asked > most THEN greatest(10000, floor(us * most / asked + 0.5)) ELSE us END AS BIGINT) AS delay_us, row_number() OVER (PARTITION BY session ORDER BY poll, event_id) AS i FROM d1),
rel AS (SELECT session, event_id, i, delay_us, poll * 1000 + delay_us AS release_us FROM d2 WHERE i = 1
  UNION ALL SELECT d2.session, d2.event_id, d2.i, d2.delay_us, greatest(rel.release_us, d2.poll * 1000) + d2.delay_us FROM rel JOIN d2 ON d2.session = rel.session AND d2.i = rel.i + 1)"""


def _calibrated(spark, d):
    """Estimates of each kind of method and what the first expert's truths make of them."""
    truth = ground_truth(spark, d).where("author = 'expert1' AND cents IS NOT NULL").select("sha", F.col("cents").alias("truth"))
    kind = F.when(F.col("method").contains("FD"), "fd").when(F.col("method") == "two_pass", "module").otherwise("none")
    rows = commits(spark, d).select("sha", kind.alias("scope"), F.col("cents").alias("estimate"))
    blocks = calibration.fit(rows.join(truth, "sha").select("scope", "estimate", "truth"))
    found = calibration.calibrated(rows.select("scope", "estimate").distinct(), blocks)
    return found.select("scope", "estimate", F.round("calibrated", 6).alias("calibrated"))


_CALIBRATED = """rows0 AS (SELECT sha, CASE WHEN contains(method, 'FD') THEN 'fd' WHEN method = 'two_pass' THEN 'module' ELSE 'none' END AS scope, cents AS estimate FROM commits),
sums AS (SELECT scope, estimate, sum(t.cents) AS total, count(*) AS n FROM rows0 JOIN (SELECT sha, cents FROM truth WHERE author = 'expert1' AND cents IS NOT NULL) t USING (sha) GROUP BY ALL),
upto AS (SELECT scope, estimate, row_number() OVER w AS i, sum(total) OVER w AS s, sum(n) OVER w AS c FROM sums WINDOW w AS (PARTITION BY scope ORDER BY estimate)),
spans AS (SELECT b.scope, coalesce(a.i, 0) + 1 AS j, b.i AS k, (b.s - coalesce(a.s, 0)) / CAST(b.c - coalesce(a.c, 0) AS DOUBLE) AS mean FROM upto b LEFT JOIN (SELECT scope, i, s, c FROM upto UNION ALL SELECT DISTINCT scope, 0, 0, 0 FROM upto) a ON a.scope = b.scope AND a.i < b.i),
lows AS (SELECT u.scope, u.i, s.j, min(s.mean) AS low FROM upto u JOIN spans s ON s.scope = u.scope AND s.j <= u.i AND s.k >= u.i GROUP BY ALL),
fitted AS (SELECT scope, i, max(low) AS v FROM lows GROUP BY scope, i),
steps AS (SELECT u.scope, u.estimate, v FROM upto u JOIN fitted USING (scope, i))"""


def _clustered(spark, d):
    """Files of commits (parts of the catalogue stand for commits), in folders and roles made of the keys of line items."""
    part = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))
    k, o, n = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    name = F.concat_ws("/", part(("src", "lib", "web", "packages"), o), F.concat(F.lit("d"), (k % 7).cast("string")), F.concat(F.lit("e"), (o % 5).cast("string")), F.concat(F.lit("f"), o.cast("string"), F.lit("_"), n.cast("string"), part((".py", ".service.ts", ".dto.ts", ".go"), n)))
    no = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    files = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sha"), no.alias("file_no"), name.alias("filename"), F.col("l_quantity").cast("long").alias("added"), (k % 9).cast("long").alias("deleted"))
    return clusters.clusters(files)


def _entropy(spark, d):
    files = commits(spark, d).select("repo", F.col("cents").alias("churn"))
    return accuracy.churn_entropy(files, "repo").select("repo", _r("entropy", 6).alias("entropy"), "n_files")


def _developer_metrics(spark, d):
    m = spread.developer_metrics(_base(spark, d))
    return m.withColumn("colour", scalars.colour(F.col("ratio_adjusted")))


_AS_OF = "DATE '2001-10-20'"
_as_of = lambda: F.to_date(F.lit("2001-10-20"))

QUERIES = {
    "developer_metrics": (
        _developer_metrics,
        with_recursive_frames(
            """SELECT *, CASE WHEN ratio_adjusted IS NULL THEN 'gray' WHEN ratio_adjusted >= 100 THEN 'green' WHEN ratio_adjusted >= 80 THEN 'yellow' ELSE 'red' END AS colour FROM (
              SELECT email, n_commits, total_cents, placed_cents, total_cents - placed_cents AS overhead_cents, work_days, fte_days, share,
                CASE WHEN work_days >= 1 THEN CAST(total_cents AS DOUBLE) * 100 / (work_days * 300) END AS ratio_raw,
                CASE WHEN fte_days >= 1 AND share > 0 THEN CAST(total_cents AS DOUBLE) * 100 / (fte_days * 300) / share END AS ratio_adjusted
              FROM (SELECT *, CASE WHEN part >= 1 THEN 1.0::DOUBLE ELSE part END AS share FROM pmetrics))""",
            COMMITS,
            PLACED,
        ),
    ),
    "daily_effort": (lambda spark, d: spread.daily_effort(_base(spark, d)), with_recursive_frames("SELECT email, day, sha, entry_day, cents FROM effort", COMMITS, PLACED)),
    "timeline_week": _timeline("week"),
    "timeline_month": _timeline("month"),
    "timeline_quarter": _timeline("quarter"),
    "timeline_year": _timeline("year"),
    "placed_grouping_sets": (
        lambda spark, d: timeline.four_grains(_placed(spark, d)),
        with_recursive_frames(
            """SELECT email, year(day) AS y, month(day) AS m, quarter(day) AS q, CAST(sum(cents) AS BIGINT) AS cents FROM pdays
            GROUP BY GROUPING SETS ((email), (email, year(day)), (email, year(day), month(day)), (email, year(day), quarter(day)))""",
            COMMITS,
            PLACED,
        ),
    ),
    "gap_fill": (
        lambda spark, d: timeline.chart_gaps(_placed(spark, d).select("email", "day").union(_base(spark, d).select("email", "day"))),
        with_recursive_frames(
            """SELECT email, CAST(unnest(gap) AS DATE) AS day FROM (SELECT email, generate_series(day + 1, nx - 1, INTERVAL 1 DAY) AS gap
            FROM (SELECT email, day, lead(day) OVER (PARTITION BY email ORDER BY day) AS nx FROM (SELECT email, day FROM pdays UNION SELECT email, day FROM base)) WHERE nx - day BETWEEN 2 AND 13)
            WHERE len(list_filter(gap, lambda x: isodow(x) < 6)) <= 3""",
            COMMITS,
            PLACED,
        ),
    ),
    "ghost_ratio": (
        _ratios,
        with_recursive_frames(
            """SELECT email, percent, CASE WHEN percent IS NULL THEN 'gray' WHEN percent >= 100 THEN 'green' WHEN percent >= 80 THEN 'yellow' ELSE 'red' END AS colour FROM
            (SELECT email, CASE WHEN work_days >= 1 THEN floor(CAST(total_cents AS DOUBLE) * 100 / (work_days * 300) * 100 + 0.5) / 100 END AS percent FROM pmetrics)""",
            COMMITS,
            PLACED,
        ),
    ),
    "repo_metrics": (lambda spark, d: spread.repo_metrics(commits(spark, d)), None),
    "period_fte": (
        lambda spark, d: spread.period_fte(_placed(spark, d), _base(spark, d)),
        with_recursive_frames(
            """SELECT email, period, "year", part, CAST(len(list_filter(generate_series(first, greatest(last, commit_day), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) + extra AS BIGINT) AS fte_days
            FROM ends WHERE first IS NOT NULL AND commit_day IS NOT NULL""",
            COMMITS,
            PLACED,
            "either AS (SELECT 'p' AS kind, email, day FROM pdays UNION ALL SELECT 'c', email, day FROM base)",
            """grown AS (SELECT kind, email, day, unnest(['ALL_TIME', 'YEAR', 'QUARTER', 'MONTH']) AS period, CAST(unnest([NULL, year(day), year(day), year(day)]) AS INT) AS "year",
              CAST(unnest([NULL, NULL, quarter(day), month(day)]) AS INT) AS part FROM either)""",
            """ends AS (SELECT email, period, "year", part, min(day) FILTER (kind = 'p') AS first, max(day) FILTER (kind = 'p') AS last, max(day) FILTER (kind = 'c') AS commit_day,
              count(*) FILTER (kind = 'p' AND isodow(day) > 5) AS extra FROM grown GROUP BY ALL)""",
        ),
    ),
    "scope_work_days": (
        _workdays,
        with_frames(
            f"SELECT email, len(list_filter(generate_series(min(day), max(day), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS weekdays FROM commits WHERE {_BASE} GROUP BY email",
            COMMITS,
        ),
    ),
    "fte_days": (lambda spark, d: spread.developer_metrics(_base(spark, d)).select("email", "fte_days"), with_recursive_frames("SELECT email, fte_days FROM pmetrics", COMMITS, PLACED)),
    "median_norm": (
        _median_norm,
        with_recursive_frames("SELECT floor(median(CAST(total_cents AS DOUBLE) / work_days) * 100 + 0.5) / 100 AS norm FROM pmetrics WHERE work_days > 0 AND total_cents > 0", COMMITS, PLACED),
    ),
    "dup_pairs": (lambda spark, d: identity.find_matches(_everyone(spark, d)), f"WITH {_PEOPLE}, {_MATCHES} SELECT a, b, confidence, reason FROM matches"),
    "dup_groups": (
        lambda spark, d: identity.match_groups(identity.match_links(_everyone(spark, d))).select(F.col("id"), F.col("group").alias("group_id")),
        f"""WITH RECURSIVE {_PEOPLE}, {_MATCHES}, e AS (SELECT a, b FROM matches UNION SELECT b, a FROM matches),
        reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r) SELECT id, min(r) AS group_id FROM reach GROUP BY id""",
    ),
    "share_change": (
        _share_change,
        with_recursive_frames(
            """SELECT email, n_commits, total_cents, work_days, fte_days, share, CASE WHEN work_days >= 1 THEN CAST(total_cents AS DOUBLE) * 100 / (work_days * 300) END AS ratio_raw,
              CASE WHEN fte_days >= 1 AND share > 0 THEN CAST(total_cents AS DOUBLE) * 100 / (fte_days * 300) / share END AS ratio_adjusted
            FROM (SELECT *, CASE WHEN k % 10 = 3 THEN 0.5::DOUBLE WHEN k % 10 % 3 = 0 THEN least(1, CAST(n_commits AS DOUBLE) / (SELECT sum(n_commits) FROM totals)) WHEN part >= 1 THEN 1 ELSE part END AS share
              FROM (SELECT *, CAST(regexp_extract(email, '[0-9]+') AS BIGINT) AS k FROM pmetrics))""",
            COMMITS,
            PLACED,
        ),
    ),
    "paced_events": (_released, with_recursive_frames("SELECT session, event_id, delay_us, release_us FROM rel", EVENTS, _RELEASED)),
    "isotonic_calibration": (
        _calibrated,
        with_frames(
            """SELECT r.scope, r.estimate, round(coalesce(e.v, CASE WHEN b.v IS NULL THEN a.v WHEN a.v IS NULL THEN b.v ELSE b.v + (r.estimate - b.estimate) / CAST(a.estimate - b.estimate AS DOUBLE) * (a.v - b.v) END), 6) AS calibrated
            FROM (SELECT DISTINCT scope, estimate FROM rows0) r LEFT JOIN steps e ON e.scope = r.scope AND e.estimate = r.estimate
            LEFT JOIN LATERAL (SELECT arg_max({'estimate': estimate, 'v': v}, estimate) AS x FROM steps WHERE steps.scope = r.scope AND steps.estimate < r.estimate) bx ON TRUE
            LEFT JOIN LATERAL (SELECT arg_min({'estimate': estimate, 'v': v}, estimate) AS x FROM steps WHERE steps.scope = r.scope AND steps.estimate > r.estimate) ax ON TRUE,
            LATERAL (SELECT bx.x.estimate AS estimate, bx.x.v AS v) b, LATERAL (SELECT ax.x.estimate AS estimate, ax.x.v AS v) a""",
            COMMITS, TRUTH, _CALIBRATED,
        ),
    ),
    "semantic_clusters": (_clustered, None),
    "match_chain": (
        _match_chain,
        """SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS found, CASE WHEN a.s_suppkey IS NOT NULL THEN 'provider' WHEN b.s_suppkey IS NOT NULL THEN 'login' END AS found_by
        FROM customer LEFT JOIN supplier a ON c_custkey % 4 <> 0 AND a.s_suppkey = c_custkey * 3 LEFT JOIN supplier b ON c_custkey % 6 <> 0 AND b.s_suppkey = c_custkey // 5""",
    ),
    "identity_health": (
        lambda spark, d: identity.health(aliases(spark, d).withColumn("team", F.length("email") * 3 + F.ascii(F.substring("email", 4, 1))), "team").drop("team").groupBy("health").agg(F.sum("resolved").alias("resolved"), F.sum("unresolved").alias("unresolved")),
        with_frames(
            """SELECT health, CAST(sum(resolved) AS BIGINT) AS resolved, CAST(sum(unresolved) AS BIGINT) AS unresolved FROM (
              SELECT count(contributor_id) AS resolved, count(*) - count(contributor_id) AS unresolved, CASE WHEN count(*) = count(contributor_id) THEN 'healthy' WHEN count(contributor_id) = 0 THEN 'unresolved' ELSE 'attention' END AS health
              FROM aliases GROUP BY length(email) * 3 + ascii(substring(email, 4, 1))) GROUP BY health""",
            ALIASES,
        ),
    ),
    "email_hash": (
        lambda spark, d: aliases(spark, d).select("email", scalars.email_hash(F.col("email")).alias("hash"), scalars.email_mask(F.col("email")).alias("mask")),
        with_frames("SELECT email, substring(sha256(lower(trim(email))), 1, 12) AS hash, regexp_replace(email, '^(.{1,2}).*(@.*)$', '\\1***\\2') AS mask FROM aliases", ALIASES),
    ),
    "freshness_summary": (
        lambda spark, d: _base(spark, d).groupBy("email").agg(F.max("day").alias("day")).groupBy(scalars.freshness(F.col("day"), _as_of()).alias("freshness")).agg(F.count("*").alias("n")),
        with_frames(
            f"SELECT CASE WHEN day >= {_AS_OF} - 30 THEN 'fresh' ELSE 'stale' END AS freshness, count(*) AS n FROM (SELECT max(day) AS day FROM commits WHERE {_BASE} GROUP BY email) GROUP BY 1",
            COMMITS,
        ),
    ),
    "billing_stats": (
        lambda spark, d: billing.billing_stats(jobs(spark, d)),
        with_frames(
            """SELECT CAST(sum(reserved) AS BIGINT) AS reserved, CAST(coalesce(sum(consumed) FILTER (status = 'COMPLETED'), 0) AS BIGINT) AS consumed_done,
            CAST(coalesce(sum(greatest(reserved - consumed - released, 0)) FILTER (status = 'RUNNING'), 0) AS BIGINT) AS held_running,
            count(*) FILTER (status = 'COMPLETED' AND reserved - consumed - released > 0) AS leaks,
            CAST(coalesce(sum(reserved - consumed - released) FILTER (status = 'COMPLETED' AND reserved - consumed - released > 0), 0) AS BIGINT) AS leaked FROM jobs""",
            JOBS,
        ),
    ),
    "reconciliation": (
        lambda spark, d: billing.violations(jobs(spark, d)),
        with_frames(
            """SELECT job_id, 'consumed_over_reserved' AS rule FROM jobs WHERE consumed > reserved UNION ALL SELECT job_id, 'settled_over_reserved' FROM jobs WHERE consumed + released > reserved
            UNION ALL SELECT job_id, 'terminal_with_remainder' FROM jobs WHERE status = 'COMPLETED' AND consumed + released < reserved""",
            JOBS,
        ),
    ),
    "ledger_running_balance": (
        lambda spark, d: billing.running_balance(jobs(spark, d)),
        with_frames("SELECT user_id, job_id, CAST(sum(reserved - consumed) OVER (PARTITION BY user_id ORDER BY created, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM jobs", JOBS),
    ),
    "debit_plan": (lambda spark, d: billing.debit(jobs(spark, d)), with_frames("SELECT job_id, greatest(0, reserved - released - consumed) AS debit FROM jobs", JOBS)),
    "watchdog_actions": (
        lambda spark, d: billing.watchdog(jobs(spark, d), _as_of()),
        with_frames(
            f"""SELECT job_id, CASE WHEN {_AS_OF} - created <= 365 THEN 'leave' WHEN status = 'PENDING' THEN 'requeue' WHEN retries >= 3 THEN 'fail' ELSE 'retry' END AS action
            FROM jobs WHERE status <> 'COMPLETED'""",
            JOBS,
        ),
    ),
    "status_histogram": (
        lambda spark, d: jobs(spark, d).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "RUNNING", "PENDING")]),
        with_frames("SELECT count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'PENDING') AS pending FROM jobs", JOBS),
    ),
    "latest_job_per_order": (
        lambda spark, d: billing.latest_per(jobs(spark, d), "order_id"),
        with_frames("SELECT order_id, arg_max(job_id, {'c': created, 'j': job_id}) AS job_id, max(created) AS created FROM jobs GROUP BY order_id", JOBS),
    ),
    "event_levels": (
        lambda spark, d: billing.event_profile(job_events(spark, d)),
        with_frames(
            """SELECT job_id, count(*) AS n_events, count(*) FILTER (code = 'error') AS errors, arg_max(code, event_id) AS last_code,
            CAST(sum(coalesce(TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_sum FROM ev GROUP BY job_id""",
            EVENTS,
        ),
    ),
    "events_top_n_per_job": (
        lambda spark, d: billing.newest_events(job_events(spark, d), 25),
        with_frames("SELECT job_id, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS r FROM ev) WHERE r <= 25", EVENTS),
    ),
    "event_cursor": (
        lambda spark, d: job_events(spark, d).where("event_id > 300").orderBy("event_id").limit(500).select("event_id", "job_id", "code"),
        with_frames("SELECT event_id, job_id, code FROM ev WHERE event_id > 300 ORDER BY event_id LIMIT 500", EVENTS),
    ),
    "atomic_steps": (
        lambda spark, d: billing.steps_done(job_events(spark, d), ["view", "click", "signup", "purchase"]),
        with_frames(
            """SELECT job_id, max(s) AS top, max(s) + 1 - count(DISTINCT s) AS missing FROM
            (SELECT job_id, CASE code WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS s FROM ev) WHERE s IS NOT NULL GROUP BY job_id""",
            EVENTS,
        ),
    ),
    "gt_author_stats": (
        lambda spark, d: _author_stats(ground_truth(spark, d)),
        with_frames("SELECT author, count(cents) AS n, CAST(sum(cents) AS BIGINT) AS cents, median(cents) AS median_cents, sum(cents) / count(cents) AS mean_cents FROM truth GROUP BY author", TRUTH),
    ),
    "gt_consensus": (lambda spark, d: accuracy.consensus(ground_truth(spark, d)), with_frames("SELECT sha, median(cents) AS cents FROM truth GROUP BY sha", TRUTH)),
    "run_mae_corr": _errors("model"),
    "accuracy_by_category": _errors("category"),
    "sample_percentiles": (
        _percentiles,
        with_frames(
            """SELECT code, count(value) AS n, min(value) AS lo, max(value) AS hi, floor(quantile_cont(value, 0.5) * 10000 + 0.5) / 10000 AS p50,
            floor(quantile_cont(value, 0.95) * 10000 + 0.5) / 10000 AS p95, floor(quantile_cont(value, 0.99) * 10000 + 0.5) / 10000 AS p99 FROM ev GROUP BY code""",
            EVENTS,
        ),
    ),
    "nearest_rank_percentiles": (
        lambda spark, d: accuracy.nearest_rank(commits(spark, d), ["repo"], "cents", {"p50": 0.5, "p90": 0.9}),
        with_frames(
            """SELECT repo, l[least(CAST(floor(len(l) * 0.5) AS BIGINT), len(l) - 1) + 1] AS p50, l[least(CAST(floor(len(l) * 0.9) AS BIGINT), len(l) - 1) + 1] AS p90
            FROM (SELECT repo, list_sort(list(cents)) AS l FROM commits GROUP BY repo)""",
            COMMITS,
        ),
    ),
    "entropy_features": (
        _entropy,
        with_frames(
            """SELECT repo, floor(sum(-(cents / t) * log2(cents / t)) * 1000000 + 0.5) / 1000000 AS entropy, count(*) AS n_files
            FROM commits JOIN (SELECT repo, sum(cents) AS t FROM commits GROUP BY repo) USING (repo) WHERE cents > 0 GROUP BY repo""",
            COMMITS,
        ),
    ),
}
