"""Queries of repeated edits, moved code and developers: name -> (query, SQL to check it with). A commit here is an order, with three files a line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.operators import diffs, identity, patterns
from effortlens.plans import features, measures
from effortlens.plans.check_sql import with_frames
from effortlens.sources.tables import commits, table

_BY = ["sha"]
_LINES = ("l_linenumber", "l_partkey", "l_suppkey")
#: Line items a task makes texts of: some hundred bytes each, of keys of a few.
_AT_ONCE = 100_000


def _commits(spark, d, diff):
    """sha, diff: the diffs of an order's line items, one after another.

    Only keys are shuffled and gathered by order; texts are made of them afterwards, row by row. The keys are
    few bytes and the texts many, so tasks are counted by line items.
    """
    items = table(spark, d, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // _AT_ONCE)
    orders = items.select("l_orderkey", *_LINES).repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(*_LINES)).alias("items"))
    parts = F.sort_array(F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("number"), diff(lambda name: x[name]).alias("diff"))))
    return orders.select(F.col("l_orderkey").alias("sha"), F.array_join(F.transform(parts, lambda x: x["diff"]), "").alias("diff"))


def _files(spark, d):
    return diffs.file_features(diffs.split_files(_commits(spark, d, features._diff)))


RAW = f"""raw AS (SELECT l_orderkey AS sha, string_agg(diff, '' ORDER BY l_linenumber, diff) AS diff FROM (
    SELECT l_orderkey, l_linenumber, {" || ".join(features._duck_part(j) for j in range(3))} AS diff FROM lineitem) GROUP BY 1)"""


def _normal(x):
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\b(\w+\.){{2,}}\w+\b', '<CHAIN>', 'g'), '(import\s+)[\w.]+', '\1<IMPORT>', 'g'),
    '\b[A-Z][a-zA-Z0-9]{{2,}}\b', '<TYPE>', 'g'), '"[^"]*"', '"<STR>"', 'g'), '''[^'']*''', '''<STR>''', 'g'), '\b\d+\b', '<NUM>', 'g'))"""


_ADD, _DEL = "(starts_with(x, '+') AND NOT starts_with(x, '+++'))", "(starts_with(x, '-') AND NOT starts_with(x, '---'))"
_SIDE = lambda keep: f"list_transform(list_filter(string_split(run, chr(10)), lambda x: {keep}), lambda x: substr(x, 2))"
PAIRS = f"""runs AS (SELECT sha, file_no, unnest(string_split(array_to_string(list_transform(ls, lambda x: CASE WHEN {_ADD} OR {_DEL} THEN x ELSE '' END), chr(10)), chr(10) || chr(10))) AS run FROM counted),
  sides AS (SELECT sha, file_no, {_SIDE(_DEL)} AS dels, {_SIDE(_ADD)} AS adds FROM runs),
  met AS (SELECT sha, file_no, unnest(dels[1:least(len(dels), len(adds))]) AS d0, unnest(adds[1:least(len(dels), len(adds))]) AS a0 FROM sides),
  normal AS (SELECT sha, file_no, {_normal("d0")} AS d, {_normal("a0")} AS a FROM met WHERE trim(d0) <> trim(a0)),
  pairs AS (SELECT sha, file_no, d AS deleted, CASE WHEN d = a THEN '<SYSTEMATIC>' ELSE a END AS added, count(*) AS n FROM normal WHERE d <> '' OR a <> '' GROUP BY ALL),
  support AS (SELECT sha, deleted, added, count(*) AS n_files FROM pairs GROUP BY ALL HAVING count(*) >= 3)"""
COVERAGE = """shares AS (SELECT sha, file_no, sum(CASE WHEN n_files IS NULL THEN 0 ELSE n END)::DOUBLE / sum(n) AS share FROM pairs LEFT JOIN support USING (sha, deleted, added) GROUP BY ALL),
  coverage AS (SELECT sha, file_no, added, deleted, coalesce(share, 0.0) AS coverage, coalesce(share, 0.0) >= 0.5 AS patterned FROM counted LEFT JOIN shares USING (sha, file_no)),
  sums AS (SELECT sha, count(*) AS n_files, count(*) FILTER (patterned) AS n_found, count(*) FILTER (NOT patterned AND added + deleted <= 10) AS n_small FROM coverage GROUP BY sha),
  counts AS (SELECT sha, n_files, CASE WHEN n_files < 5 THEN 0 ELSE n_found + CASE WHEN n_files > 20 THEN n_small ELSE 0 END END AS n FROM sums)"""


def _moved_diff(of):
    """A line item takes 11 to 60 numbered lines of one of five texts out of one file and adds some of its own number in another."""
    part, supp, number = of("l_partkey"), of("l_suppkey"), of("l_linenumber")
    # the first n lines of one of five long texts
    long = lambda sign: F.array(*[F.lit("".join(f"{sign}line {i} of {k}\n" for i in range(1, 66))) for k in range(5)])
    numbered = lambda sign, n, text: F.concat(F.call_function("substring_index", F.get(long(sign), text.cast("int")), F.lit("\n"), n.cast("int")), F.lit("\n"))
    head = lambda folder: F.concat(F.lit(f"diff --git a/{folder}/f b/{folder}/"), number.cast("string"), F.lit(".py\n@@ -1 +1 @@\n"))
    return F.concat(head("old"), numbered("-", supp % 50 + 11, part % 5), head("new"), numbered("+", part % 60 + 6, (part + number) % 5))


def _moved_files(spark, d):
    return diffs.file_features(diffs.split_files(_commits(spark, d, _moved_diff)))


def _messages(spark, d):
    words = ("Move parser", "fix bug", "extract crate core", "split into two", "rename things", None)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), features._spark_pick(words, f"o_orderkey % {len(words)}").alias("message"))


_PART = lambda folder, sign, n, text: (
    f"'diff --git a/{folder}/f b/{folder}/' || l_linenumber || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || "
    f"array_to_string(list_transform(range(1, ({n}) + 1), lambda i: '{sign}line ' || i || ' of ' || ({text}) || chr(10)), '')"
)
MOVED = f"""raw AS (SELECT l_orderkey AS sha, string_agg(diff, '' ORDER BY l_linenumber, diff) AS diff FROM (SELECT l_orderkey, l_linenumber,
    {_PART("old", "-", "11 + l_suppkey % 50", "l_partkey % 5")} || {_PART("new", "+", "6 + l_partkey % 60", "(l_partkey + l_linenumber) % 5")} AS diff FROM lineitem) GROUP BY 1)"""
_CONTENT = lambda sign, n: f"SELECT DISTINCT sha, file_no, line FROM (SELECT sha, file_no, trim(substr(unnest(list_filter(ls, lambda x: starts_with(x, '{sign}') AND NOT starts_with(x, '{sign * 2}'))), 2)) AS line FROM counted WHERE {n} > 5) WHERE length(line) > 3"


def _developers(spark, d):
    return measures._everyone(spark, d).withColumn("commits", F.when(F.col("id") % 7 != 0, F.col("id") % 50))


def _saved(spark, d):
    """Every fortieth customer's e-mail is in the group of a customer twenty keys before."""
    rows = measures._everyone(spark, d).select("id", "email")
    heads = rows.select((F.col("id") + 20).alias("id"), F.upper("email").alias("primary_email"))
    return rows.where(F.col("id") % 40 == 0).join(heads, "id").select("email", "primary_email")


def _authors(spark, d):
    """Commits with names and logins: every third supplier has the login of two others as well, every fifth none."""
    key = F.regexp_extract("email", r"\d+", 0).cast("long")
    login = F.when(key % 3 == 0, F.concat(F.lit("u"), F.floor(key / 9).cast("string"))).when(key % 5 != 0, F.concat(F.lit("own"), key.cast("string")))
    mail = F.when(F.col("cents") % 97 != 0, F.when(F.col("cents") % 2 == 0, F.upper("email")).otherwise(F.col("email")))
    return commits(spark, d).select(mail.alias("email"), F.concat(F.lit("Dev "), (key % 40).cast("string")).alias("name"), login.alias("login"), "repo", "day")


QUERIES = {
    "edit_pairs": (lambda spark, d: patterns.edit_pairs(_files(spark, d), _BY), with_frames("SELECT * FROM pairs", RAW, features.FILES, PAIRS)),
    "pattern_coverage": (
        lambda spark, d: patterns.pattern_coverage(_files(spark, d), _BY).withColumn("coverage", F.round("coverage", 6)),
        with_frames("SELECT sha, file_no, added, deleted, round(coverage, 6) AS coverage, patterned FROM coverage", RAW, features.FILES, PAIRS, COVERAGE),
    ),
    "top_patterns": (
        lambda spark, d: patterns.top_patterns(_files(spark, d), _BY),
        with_frames("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sha ORDER BY n_files DESC, deleted, added) AS INT) AS rank FROM support) WHERE rank <= 5", RAW, features.FILES, PAIRS),
    ),
    "bulk_edits": (
        lambda spark, d: patterns.bulk_edits(_files(spark, d), _BY).withColumn("bulk_ratio", F.round("bulk_ratio", 6)),
        with_frames(
            """SELECT sha, n_files, CAST(CASE WHEN bulk THEN n ELSE 0 END AS BIGINT) AS n_patterned, round(n / n_files, 6) AS bulk_ratio, bulk AS is_bulk
            FROM (SELECT *, n_files >= 5 AND (n / n_files >= 0.3 OR n >= 10) AS bulk FROM counts)""",
            RAW, features.FILES, PAIRS, COVERAGE,
        ),
    ),
    "move_overlaps": (
        lambda spark, d: patterns.move_overlaps(_moved_files(spark, d), _BY).withColumn("overlap", F.round("overlap", 6)),
        with_frames(
            """SELECT sha, source, target, round(n / n_lines, 6) AS overlap FROM (SELECT g.sha, g.file_no AS source, c.file_no AS target, count(*)::DOUBLE AS n FROM gone g JOIN come c USING (sha, line)
            WHERE g.file_no <> c.file_no GROUP BY ALL) JOIN (SELECT sha, file_no AS source, count(*) AS n_lines FROM gone GROUP BY ALL) USING (sha, source) WHERE n > 10 AND n / n_lines > 0.4""",
            MOVED, features.FILES, f"gone AS ({_CONTENT('-', 'deleted')}), come AS ({_CONTENT('+', 'added')})",
        ),
    ),
    "moves": (lambda spark, d: patterns.moves(_moved_files(spark, d), _messages(spark, d), _BY).withColumn("overlap", F.round("overlap", 6)), None),
    "developer_groups_ranked": (lambda spark, d: identity.developer_groups(_developers(spark, d), _saved(spark, d)), None),
    "author_groups": (lambda spark, d: identity.author_groups(_authors(spark, d)), None),
}
