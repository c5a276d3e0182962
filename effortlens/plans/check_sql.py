"""The canonical frames in DuckDB SQL, put in front of the queries that check ours."""

COMMITS = """commits AS (SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS sha, md5(concat_ws(':', l_partkey, l_linenumber)) AS dup_sha,
  l_orderkey % 10 AS order_id, 'org/repo' || (l_partkey % 20) AS repo, 'dev' || l_suppkey || '@example.org' AS email, CAST(l_shipdate AS DATE) AS day,
  CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) AS cents, l_returnflag AS category, l_linestatus AS complexity,
  CASE CAST(floor(l_tax * 100 + 0.5) AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'FD_v3' WHEN 3 THEN 'root_commit' ELSE 'two_pass' END AS method,
  CASE WHEN l_orderkey % 7 = 0 THEN 'job' || (l_orderkey % 3) END AS job_id, CASE WHEN l_linenumber % 4 <> 0 THEN 'm' || (l_linenumber % 2) END AS model FROM lineitem)"""
ALIASES = """aliases AS (SELECT 'dev' || s_suppkey || '@example.org' AS email, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey // 2 END AS contributor_id FROM supplier)"""
MEMBERS = """members AS (SELECT s_nationkey % 5 AS team, 'dev' || s_suppkey || '@example.org' AS email, DATE '1996-01-01' + CAST(s_suppkey % 300 AS INT) AS starts,
  CASE WHEN s_suppkey % 4 <> 0 THEN DATE '1996-01-01' + CAST(s_suppkey % 300 + 200 + s_suppkey % 700 AS INT) END AS ends FROM supplier)"""
JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_orderkey % 97 AS order_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status,
  CAST(o_orderdate AS DATE) AS created, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS reserved, CAST(floor(o_totalprice) AS BIGINT) % 700 AS consumed,
  CAST(floor(o_totalprice) AS BIGINT) % 150 AS released, o_orderkey % 4 AS retries, o_custkey AS user_id FROM orders)"""
LEDGER = """entries AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS created, o_orderkey * 10 + k AS entry_id, ['PURCHASE', 'RENEWAL', 'RESERVE', 'DEBIT', 'RELEASE'][k + 1] AS kind,
  [p % 400, p % 600, p % 1000, least(p % 700, p % 1000), greatest(p % 1000 - least(p % 700, p % 1000) - p % 150, 0)][k + 1] AS amount,
  CASE WHEN k = 1 THEN CAST(o_orderdate AS DATE) + 365 END AS expires
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders), unnest([0, 1, 2, 3, 4]) AS u(k) WHERE (k <> 0 OR o_orderkey % 3 = 0) AND (k <> 1 OR o_orderkey % 5 = 0)),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created, entry_id) AS rn FROM entries),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS entry_id, CAST(NULL AS DATE) AS created, '' AS kind, CAST(0 AS BIGINT) AS amount, CAST(0 AS BIGINT) AS fs, CAST(0 AS BIGINT) AS fp,
    CAST(0 AS BIGINT) AS expired, CAST(0 AS BIGINT) AS sub, CAST(0 AS BIGINT) AS perm, CAST(0 AS BIGINT) AS res, CAST(NULL AS DATE) AS until FROM entries
  UNION ALL SELECT user_id, rn, entry_id, created, kind, amount, fs, fp, expired, CASE kind WHEN 'RENEWAL' THEN amount ELSE there - fs END,
    CASE kind WHEN 'PURCHASE' THEN perm + amount ELSE perm - fp END,
    CASE kind WHEN 'RESERVE' THEN res + amount WHEN 'RELEASE' THEN greatest(res - amount, 0) WHEN 'DEBIT' THEN greatest(res - fs - fp, 0) ELSE res END, coalesce(expires, until)
  FROM (SELECT *, CASE WHEN kind = 'DEBIT' THEN least(amount - fs, perm) ELSE 0 END AS fp, sub - there AS expired FROM (
    SELECT *, CASE WHEN kind = 'DEBIT' THEN least(amount, there) ELSE 0 END AS fs FROM (
      SELECT e.*, r.sub, r.perm, r.res, r.until, CASE WHEN e.kind = 'RENEWAL' OR r.until <= e.created THEN 0 ELSE r.sub END AS there FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))))"""
EVENTS = """ev AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second, user_id AS job_id, event_type AS code, value, props AS payload FROM events)"""
TRUTH = """truth AS (SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS sha, 'expert' || a AS author,
  CASE WHEN (l_partkey + l_linenumber + a) % 7 <> 0 THEN CAST(floor(l_quantity * 10 + 0.5) + (l_partkey * a) % 90 AS BIGINT) END AS cents FROM lineitem, unnest([1, 2, 3]) AS u(a))"""

#: Placed days by recursion over the days of a developer: ``held`` is what the days around the last one hold.
PLACED = """base AS (SELECT * FROM commits WHERE job_id IS NULL AND method <> 'error'),
pe AS (SELECT email, day, CAST(sum(cents) AS BIGINT) AS cents, row_number() OVER (PARTITION BY email ORDER BY day) AS i,
  [day] || list_filter([CAST(day - k AS DATE) for k in [1, 2, 3, 4, 5, 6]], lambda x: isodow(x) < 6)[1:4] AS around FROM base GROUP BY email, day),
pr AS (SELECT DISTINCT email, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS prev, CAST([] AS STRUCT(d DATE, c BIGINT)[]) AS held, CAST(NULL AS DATE) AS entry_day, CAST([] AS DATE[]) AS days, CAST([] AS BIGINT[]) AS amounts FROM base
  UNION ALL SELECT email, i, day, list_transform(range(1, len(days) + 1), lambda k: {'d': days[k], 'c': 500 - rooms[k] + amounts[k]}), day, days, amounts FROM (
    SELECT *, CASE WHEN cents <= 0 THEN [CAST(0 AS BIGINT) for d in days] WHEN cents <= n * 500 AND list_sum(rooms[1:n_fresh]) = 500 * n_fresh
      THEN [CAST(CASE WHEN k <= n THEN cents // n + CASE WHEN k <= cents % n THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) for k in range(1, len(days) + 1)]
      ELSE [CAST(greatest(0, least(rooms[k], cents - coalesce(list_sum(rooms[1:k - 1]), 0))) AS BIGINT) for k in range(1, len(days) + 1)] END AS amounts FROM (
      SELECT *, CAST(least(ceil(cents / 500.0), n_fresh) AS BIGINT) AS n, [500 - coalesce(list_sum([h.c for h in held if h.d = x]), 0) for x in days] AS rooms FROM (
        SELECT pe.*, pr.prev, pr.held, len(list_filter(around, lambda x: pr.prev IS NULL OR x > pr.prev)) AS n_fresh,
          list_filter(around, lambda x: pr.prev IS NULL OR x > pr.prev) || list_filter(around, lambda x: x <= pr.prev) AS days FROM pr JOIN pe ON pe.email = pr.email AND pe.i = pr.i + 1)))),
placed AS (SELECT email, entry_day, day, cents FROM (SELECT email, entry_day, unnest(days) AS day, unnest(amounts) AS cents FROM pr WHERE i > 0) WHERE cents > 0),
effort AS (SELECT email, day, sha, entry_day, CAST(part + CASE WHEN last THEN cents - sum(part) OVER (PARTITION BY email, entry_day, day) ELSE 0 END AS BIGINT) AS cents FROM (
  SELECT p.email, p.day, b.sha, p.entry_day, p.cents, CAST(p.cents * b.cents AS BIGINT) // CAST(sum(b.cents) OVER (PARTITION BY p.email, p.entry_day, p.day) AS BIGINT) AS part,
    row_number() OVER (PARTITION BY p.email, p.entry_day, p.day ORDER BY b.sha DESC) = 1 AS last FROM placed p JOIN base b ON b.email = p.email AND b.day = p.entry_day) QUALIFY part + CASE WHEN last THEN cents - sum(part) OVER (PARTITION BY email, entry_day, day) ELSE 0 END > 0),
pdays AS (SELECT email, day, CAST(sum(cents) AS BIGINT) AS cents FROM placed GROUP BY email, day),
totals AS (SELECT email, count(*) AS n_commits, CAST(sum(cents) AS BIGINT) AS total_cents, max(day) AS last_commit FROM base GROUP BY email),
pmetrics AS (SELECT t.*, coalesce(placed_cents, 0) AS placed_cents, coalesce(work_days, 0) AS work_days, coalesce(len(list_filter(generate_series(first_day, greatest(last_day, last_commit), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) + weekend_days, 0) AS fte_days,
    CAST(total_cents AS DOUBLE) / (SELECT sum(total_cents) FROM totals) AS part
  FROM totals t LEFT JOIN (SELECT email, CAST(sum(cents) AS BIGINT) AS placed_cents, count(*) AS work_days, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (isodow(day) > 5) AS weekend_days FROM pdays GROUP BY email) USING (email))"""


def with_frames(sql: str, *frames: str) -> str:
    return f"WITH {', '.join(frames)} {sql}"


def with_recursive_frames(sql: str, *frames: str) -> str:
    return f"WITH RECURSIVE {', '.join(frames)} {sql}"
