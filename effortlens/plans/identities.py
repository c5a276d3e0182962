"""Projection, merging and greedy grouping of identities: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from effortlens.operators import projection
from effortlens.plans import measures
from effortlens.sources.tables import table


def _s(text: str, key: Column) -> Column:
    return F.concat(F.lit(text), key.cast("string"))


def _orders(spark, d):
    """Each order with the developers of its odd line items, and of the even ones a group each: JSON, with fields left out, spaces and capitals."""
    k, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    dev = F.struct(
        F.when(p % 17 != 0, F.concat(_s(" Dev", k), F.lit("@Example.org"))).alias("email"),
        F.when(k % 4 != 0, _s("Dev ", k)).alias("name"),
        F.when(k % 6 != 0, _s("login", k)).alias("login"),
        F.when(k % 3 != 0, k).alias("id"),
    )
    group = F.struct(
        F.struct(F.concat(_s("dev", k + 1), F.lit("@example.org")).alias("email"), F.when(k % 4 != 0, _s("Lead ", k)).alias("name")).alias("primary"),
        F.array(F.struct(F.concat(_s("alt", p % 50), F.lit("@example.org")).alias("email"), F.when(p % 3 != 0, _s("login", p % 60)).alias("login"), F.when(p % 2 == 1, p % 50).alias("id"))).alias("merged_from"),
    )
    key = F.concat(F.lit("g"), F.concat_ws("_", n, k, p))
    odd = n % 2 == 1
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), (F.col("l_orderkey") % 3).alias("workspace"))
    rows = rows.agg(F.sort_array(F.collect_list(F.when(odd, F.struct(n, k, p, dev.alias("dev"))))).alias("devs"), F.array_sort(F.collect_set(F.when(~odd, F.struct(key.alias("key"), group.alias("group"))))).alias("groups"))
    return rows.select("order_id", "workspace", F.to_json(F.transform("devs", lambda x: x["dev"])).alias("developers"), F.to_json(F.map_from_entries("groups")).alias("mapping"))


def _aliases(spark, d):
    k = F.col("s_suppkey")
    j = F.floor(k / 2).cast("long")
    none = (k % 9 == 0) | (k % 7 == 2)
    rows = table(spark, d, "supplier")
    status = F.when(k % 7 == 0, "MANUAL").when(none & (k % 2 == 0), "UNRESOLVED").when(none, "SUGGESTED").otherwise("AUTO_MERGED")
    base = (j % 3).alias("workspace"), F.lit(projection.PROVIDER).alias("provider")
    own = rows.select(
        _s("a", k).alias("alias_id"), *base, F.when(k % 2 == 1, k.cast("string")).alias("provider_id"), F.concat(F.when(k % 5 == 0, _s("old", k)).otherwise(_s("dev", k)), F.lit("@example.org")).alias("email"),
        F.when(k % 4 != 0, _s("login", k)).alias("username"), F.when(~none, _s("c", j)).alias("contributor_id"), status.alias("status"),
    )
    held = k % 25 == 0
    orphans = rows.where(k % 5 == 0).select(
        _s("o", k).alias("alias_id"), *base, F.lit(None).cast("string").alias("provider_id"), F.concat(_s("dev", k), F.lit("@example.org")).alias("email"),
        F.lit(None).cast("string").alias("username"), F.when(held, _s("c", j)).alias("contributor_id"), F.when(held, "AUTO_MERGED").otherwise("UNRESOLVED").alias("status"),
    )
    return own.unionByName(orphans)


def _contributors(spark, d):
    j = F.floor(F.col("s_suppkey") / 2).cast("long")
    email = F.when(j % 2 == 0, _s("alt", j % 50)).otherwise(_s("dev", 2 * j))
    return table(spark, d, "supplier").select(_s("c", j).alias("contributor_id"), (j % 3).alias("workspace"), _s("C ", j).alias("name"), F.concat(email, F.lit("@example.org")).alias("email")).distinct()


def _pass(spark, d):
    return projection.project(projection.extract_aliases(_orders(spark, d)), _aliases(spark, d), _contributors(spark, d))


def _merge_requests(spark, d):
    """Long chains, a circle, other workspaces, contributors with themselves and some that are not there."""
    k = F.col("s_suppkey")
    j = F.floor(k / 2).cast("long")
    to = F.when(j % 30 == 27, j - 12).when(k % 11 == 0, j).when(k % 5 == 0, j + 1).otherwise(j + 3)
    return table(spark, d, "supplier").where(k % 3 != 1).select(_s("c", j).alias("source"), _s("c", to).alias("target"))


def _merges(spark, d):
    return projection.checked_merges(_merge_requests(spark, d), _contributors(spark, d))


def _unmerge_requests(spark, d):
    """A contributor's first alias, or all of its aliases, or one of another contributor."""
    k = F.col("s_suppkey")
    j = F.floor(k / 2).cast("long")
    ids = F.when(k % 3 == 0, F.array(_s("a", k))).when(k % 3 == 1, F.array(_s("a", 2 * j), _s("a", 2 * j + 1))).otherwise(F.array(_s("a", k + 2)))
    return table(spark, d, "supplier").where(k % 4 < 3).select(_s("c", j).alias("contributor_id"), ids.alias("alias_ids"))


def _people(spark, d):
    return measures._everyone(spark, d).withColumnRenamed("id", "rank")


_FRAMES = """rows0 AS (
  SELECT l_orderkey AS order_id, l_orderkey % 3 AS workspace, 0 AS kind, l_linenumber AS n, l_suppkey AS k, l_partkey AS p, '' AS gkey,
    CASE WHEN l_partkey % 17 <> 0 THEN 'dev' || l_suppkey || '@example.org' END AS email, CASE WHEN l_suppkey % 4 <> 0 THEN 'Dev ' || l_suppkey WHEN l_suppkey % 6 <> 0 THEN 'login' || l_suppkey END AS name,
    CASE WHEN l_suppkey % 6 <> 0 THEN 'login' || l_suppkey END AS username, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS provider_id, 'primary' AS source FROM lineitem WHERE l_linenumber % 2 = 1
  UNION ALL SELECT l_orderkey, l_orderkey % 3, 1, 0, 0, 0, 'g' || concat_ws('_', l_linenumber, l_suppkey, l_partkey) || '/0', 'dev' || (l_suppkey + 1) || '@example.org',
    CASE WHEN l_suppkey % 4 <> 0 THEN 'Lead ' || l_suppkey END, NULL, NULL, 'primary' FROM lineitem WHERE l_linenumber % 2 = 0
  UNION ALL SELECT l_orderkey, l_orderkey % 3, 1, 0, 0, 0, 'g' || concat_ws('_', l_linenumber, l_suppkey, l_partkey) || '/1', 'alt' || (l_partkey % 50) || '@example.org',
    CASE WHEN l_partkey % 3 <> 0 THEN 'login' || (l_partkey % 60) END, CASE WHEN l_partkey % 3 <> 0 THEN 'login' || (l_partkey % 60) END, CASE WHEN l_partkey % 2 = 1 THEN CAST(l_partkey % 50 AS VARCHAR) END, 'merged_from'
    FROM lineitem WHERE l_linenumber % 2 = 0),
extracted AS (SELECT order_id, workspace, email, coalesce(name, email) AS name, username, provider_id, source FROM rows0 WHERE email IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY order_id, email ORDER BY kind, n DESC, k DESC, p DESC, gkey) = 1),
al AS (
  SELECT 'a' || k AS alias_id, (k // 2) % 3 AS workspace, CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) END AS provider_id, CASE WHEN k % 5 = 0 THEN 'old' ELSE 'dev' END || k || '@example.org' AS email,
    CASE WHEN k % 4 <> 0 THEN 'login' || k END AS username, CASE WHEN NOT (k % 9 = 0 OR k % 7 = 2) THEN 'c' || (k // 2) END AS contributor_id,
    CASE WHEN k % 7 = 0 THEN 'MANUAL' WHEN (k % 9 = 0 OR k % 7 = 2) AND k % 2 = 0 THEN 'UNRESOLVED' WHEN k % 9 = 0 OR k % 7 = 2 THEN 'SUGGESTED' ELSE 'AUTO_MERGED' END AS status FROM (SELECT s_suppkey AS k FROM supplier)
  UNION ALL SELECT 'o' || k, (k // 2) % 3, NULL, 'dev' || k || '@example.org', NULL, CASE WHEN k % 25 = 0 THEN 'c' || (k // 2) END, CASE WHEN k % 25 = 0 THEN 'AUTO_MERGED' ELSE 'UNRESOLVED' END
    FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 = 0)),
co AS (SELECT DISTINCT 'c' || j AS contributor_id, j % 3 AS workspace, CASE WHEN j % 2 = 0 THEN 'alt' || (j % 50) ELSE 'dev' || (2 * j) END || '@example.org' AS email FROM (SELECT s_suppkey // 2 AS j FROM supplier)),
raw AS (SELECT workspace, email, arg_min({'name': name, 'username': username, 'provider_id': provider_id, 'source': source}, {'later': source <> 'primary', 'o': order_id}) AS r FROM extracted GROUP BY ALL),
m AS (SELECT raw.workspace, raw.email, r.name AS name, r.username AS username, r.provider_id AS provider_id, r.source AS source,
    (SELECT min(alias_id) FROM al WHERE al.workspace = raw.workspace AND al.provider_id = r.provider_id) AS by_id, (SELECT min(alias_id) FROM al WHERE al.workspace = raw.workspace AND al.email = raw.email) AS by_email,
    coalesce((SELECT min(contributor_id) FROM al WHERE al.workspace = raw.workspace AND al.provider_id = r.provider_id), (SELECT min(contributor_id) FROM co WHERE co.workspace = raw.workspace AND co.email = raw.email),
      (SELECT min(contributor_id) FROM al WHERE al.workspace = raw.workspace AND al.username = r.username)) AS found FROM raw),
w AS (SELECT m.*, al.alias_id, al.status AS st, al.contributor_id AS has, al.email AS old_email, al.provider_id AS pid, al.username AS old_user, b.status = 'UNRESOLVED' AND b.contributor_id IS NULL AS orphan,
    CASE WHEN al.alias_id IS NULL THEN CASE WHEN found IS NOT NULL THEN 'create' WHEN source = 'primary' THEN 'found' ELSE 'queue' END
      WHEN al.status = 'MANUAL' OR al.contributor_id IS NOT NULL OR found IS NULL THEN 'touch' ELSE 'attach' END AS action,
    al.alias_id IS NOT NULL AND m.email <> al.email AND by_email IS NOT NULL AND by_email <> al.alias_id AS clash
  FROM m LEFT JOIN al ON al.alias_id = coalesce(by_id, by_email) LEFT JOIN al b ON b.alias_id = by_email),
pass AS (SELECT workspace, 'github' AS provider, email, name, action, alias_id,
    CASE action WHEN 'touch' THEN has WHEN 'found' THEN sha256(concat_ws(chr(31), 'c', workspace, email)) WHEN 'queue' THEN NULL ELSE found END AS contributor_id,
    CASE action WHEN 'touch' THEN st WHEN 'queue' THEN 'UNRESOLVED' ELSE 'AUTO_MERGED' END AS status,
    CASE WHEN action = 'found' OR (action IN ('attach', 'create') AND provider_id IS NULL) THEN 'exact_email_match' WHEN action IN ('attach', 'create') THEN 'exact_provider_match' END AS reason,
    CASE WHEN clash AND NOT orphan THEN old_email ELSE email END AS alias_email, coalesce(username, old_user) AS username, CASE WHEN st = 'MANUAL' THEN pid ELSE coalesce(pid, provider_id) END AS provider_id,
    CASE WHEN clash AND orphan THEN by_email END AS absorbed FROM w),
kept AS (SELECT coalesce(alias_id, sha256(concat_ws(chr(31), 'a', workspace, provider, email))) AS alias_id, workspace, provider, provider_id, alias_email AS email, username, contributor_id, status FROM pass
  QUALIFY row_number() OVER (PARTITION BY coalesce(alias_id, sha256(concat_ws(chr(31), 'a', workspace, provider, email))) ORDER BY pass.email) = 1),
after AS (SELECT alias_id, workspace, 'github' AS provider, provider_id, email, username, contributor_id, status FROM al WHERE alias_id NOT IN (SELECT alias_id FROM kept) AND alias_id NOT IN (SELECT absorbed FROM pass WHERE absorbed IS NOT NULL)
  UNION ALL SELECT * FROM kept WHERE alias_id NOT IN (SELECT absorbed FROM pass WHERE absorbed IS NOT NULL))"""

_MERGES = """asked AS (SELECT DISTINCT 'c' || j AS source, 'c' || CASE WHEN j % 30 = 27 THEN j - 12 WHEN k % 11 = 0 THEN j WHEN k % 5 = 0 THEN j + 1 ELSE j + 3 END AS target
    FROM (SELECT s_suppkey AS k, s_suppkey // 2 AS j FROM supplier WHERE s_suppkey % 3 <> 1)),
judged AS (SELECT source, target, CASE WHEN source = target THEN 'same contributor' WHEN a.workspace IS NULL THEN 'no such source' WHEN b.workspace IS NULL THEN 'no such target' WHEN a.workspace <> b.workspace THEN 'other workspace'
    WHEN count(*) OVER (PARTITION BY source) > 1 THEN 'source is merged twice' END AS error FROM asked LEFT JOIN co a ON a.contributor_id = source LEFT JOIN co b ON b.contributor_id = target),
good AS (SELECT source, target FROM judged WHERE error IS NULL),
walk AS (SELECT source, target AS place, 1 AS steps FROM good UNION ALL SELECT walk.source, good.target, steps + 1 FROM walk JOIN good ON good.source = walk.place WHERE steps <= (SELECT count(*) FROM good)),
ended AS (SELECT source, place AS final FROM walk WHERE place NOT IN (SELECT source FROM good)),
merges AS (SELECT source, target, CASE WHEN error IS NOT NULL THEN error WHEN final IS NULL THEN 'merges end in a circle' END AS error, final FROM judged LEFT JOIN ended USING (source))"""

_GREEDY = r"""people AS (SELECT email, min(rank) AS rank, arg_min({'x': name}, rank).x AS name, arg_min({'x': login}, rank).x AS login FROM (SELECT c_custkey AS rank,
    ['ann', 'anne', 'ben', 'b.', 'cora', 'dora', 'finn'][c_custkey % 7 + 1] || ' ' || CASE WHEN c_custkey % 11 = 0 THEN substr(md5(CAST(c_custkey // 20 AS VARCHAR)), 1, 7) || 'z' ELSE substr(md5(CAST(c_custkey // 20 AS VARCHAR)), 1, 8) END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'u' || (c_custkey // 13) END AS login, 'p' || (c_custkey // 2) || '@' || CASE WHEN c_custkey % 3 = 0 THEN 'Gmail.com' ELSE 'Firm' || c_nationkey || '.example' END AS email FROM customer) GROUP BY email),
keyed AS (SELECT email, rank, row_number() OVER (ORDER BY rank) AS i, list_filter(['i:' || substr(name, 1, 1) || '|' || string_split(name, ' ')[-1], 'l:' || login], lambda x: x IS NOT NULL) AS keys FROM people),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS claimed, FALSE AS seed UNION ALL
  SELECT k.i, CASE WHEN list_has_any(g.claimed, k.keys) THEN g.claimed ELSE list_concat(g.claimed, k.keys) END, NOT list_has_any(g.claimed, k.keys) FROM g JOIN keyed k ON k.i = g.i + 1),
owners AS (SELECT unnest(k.keys) AS key, k.rank AS owner FROM keyed k JOIN g USING (i) WHERE g.seed),
owned AS (SELECT email, min(owner) AS seed FROM (SELECT email, rank, unnest(keys) AS key FROM keyed) JOIN owners USING (key) WHERE owner <= rank GROUP BY email)"""

_ALIAS = "alias_id, workspace, provider, provider_id, email, username, contributor_id, status"


QUERIES = {
    "extracted_aliases": (
        lambda spark, d: projection.extract_aliases(_orders(spark, d)).drop("rank", "provider"),
        f"WITH {_FRAMES} SELECT * FROM extracted",
    ),
    "alias_projection": (_pass, f"WITH {_FRAMES} SELECT * FROM pass"),
    "projected_contributors": (lambda spark, d: projection.new_contributors(_pass(spark, d)), f"WITH {_FRAMES} SELECT contributor_id, workspace, name, email FROM pass WHERE action = 'found'"),
    "projected_aliases": (lambda spark, d: projection.projected_aliases(_pass(spark, d), _aliases(spark, d)), f"WITH {_FRAMES} SELECT {_ALIAS} FROM after"),
    "unresolved_aliases": (
        lambda spark, d: projection.unresolved(projection.projected_aliases(_pass(spark, d), _aliases(spark, d))).drop("contributor_id"),
        f"WITH {_FRAMES} SELECT {_ALIAS.replace('contributor_id, ', '')} FROM after WHERE contributor_id IS NULL",
    ),
    "contributor_merges": (_merges, f"WITH RECURSIVE {_FRAMES}, {_MERGES} SELECT * FROM merges"),
    "merged_aliases": (
        lambda spark, d: projection.merge(_merges(spark, d), _aliases(spark, d), _contributors(spark, d))[0].select("alias_id", "contributor_id", "status"),
        f"""WITH RECURSIVE {_FRAMES}, {_MERGES} SELECT alias_id, coalesce(final, contributor_id) AS contributor_id, CASE WHEN final IS NOT NULL THEN 'MANUAL' ELSE status END AS status
        FROM al LEFT JOIN (SELECT source, final FROM merges WHERE error IS NULL) ON source = contributor_id""",
    ),
    "contributor_unmerges": (
        lambda spark, d: projection.checked_unmerges(_unmerge_requests(spark, d), _aliases(spark, d), _contributors(spark, d)).select("contributor_id", "error", "new_email", "new_name"),
        f"""WITH {_FRAMES}, asked AS (SELECT 'c' || j AS contributor_id, CASE k % 3 WHEN 0 THEN ['a' || k] WHEN 1 THEN ['a' || (2 * j), 'a' || (2 * j + 1)] ELSE ['a' || (k + 2)] END AS ids
            FROM (SELECT s_suppkey AS k, s_suppkey // 2 AS j FROM supplier WHERE s_suppkey % 4 < 3)),
          once AS (SELECT contributor_id, count(*) AS times, min(list_sort(ids)) AS ids FROM asked GROUP BY 1),
          met AS (SELECT o.contributor_id, times, count(*) FILTER (al.contributor_id IS DISTINCT FROM o.contributor_id) AS strange, count(*) AS n,
            min({{'a': u.id, 'e': al.email, 'u': al.username, 'w': al.workspace}}) AS f FROM once o, unnest(ids) AS u(id) LEFT JOIN al ON al.alias_id = u.id GROUP BY ALL),
          held AS (SELECT contributor_id, count(*) AS held FROM al GROUP BY 1)
        SELECT contributor_id, CASE WHEN times > 1 THEN 'contributor is unmerged twice' WHEN strange > 0 THEN 'alias of another contributor' WHEN n >= held THEN 'all aliases'
            WHEN EXISTS (SELECT 1 FROM co WHERE co.workspace = f.w AND co.email = f.e) THEN 'e-mail is taken' WHEN min(contributor_id) OVER (PARTITION BY f.w, f.e) <> contributor_id AND f.e IS NOT NULL THEN 'e-mail is asked for twice' END AS error,
          f.e AS new_email, coalesce(f.u, f.e) AS new_name FROM met LEFT JOIN held USING (contributor_id)""",
    ),
    "greedy_groups": (
        lambda spark, d: projection.greedy_groups(_people(spark, d)),
        f"WITH RECURSIVE {_GREEDY} SELECT email, seed, count(*) OVER (PARTITION BY seed) AS size FROM owned",
    ),
}
