"""Diff, log, rule and benchmark queries: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.functions import scalars
from effortlens.operators import benchmarks, diffs, estimates
from effortlens.plans.check_sql import COMMITS, with_frames
from effortlens.sources.gitlog import parse_log
from effortlens.sources.tables import commits, table

NAMES = (
    "src/app.ts", "src/test/AppTest.java", "package-lock.json", "locales/fr.json", "Makefile", "docs/guide.md", "db/migrations/001.sql", "img/logo.SVG",
    "testdata/big.json", "lib/core/util_test.go", "src/ui/Icon.tsx", "README", "go.mod", "web/site/index.html",
)
ADDED = (
    "if (ready) { go(1) }", "func load(x) {", "CREATE TABLE t (id int);", "INSERT INTO t VALUES (1);", "                deep = a.b.c.d", ' "key": "value",',
    '<path d="M0"/>',
)
MESSAGES = (
    "Move parser to its own module", "bump edition", "run prettier", "remove lock file", "update locale files", "add test data", "fix bug",
    "initial commit setup", "Feat/dialer v1",
)
KINDS = ("config", "test", "feature", "chore", "test_only", None)
SUMMARIES = ("generator move to module", "upgrade of things", "new logic")

_sha = "md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


def _spark_pick(values, index):
    made = [F.lit(v) for v in values]
    return F.get(F.array(*made), (F.expr(index) if isinstance(index, str) else index).cast("int"))


def _duck_list(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _diff(of=F.col):
    """The diff of three files that a line item makes, of its keys; every fiftieth part has long ones."""
    part, supp, number = of("l_partkey"), of("l_suppkey"), of("l_linenumber")
    wide = F.when(part % 50 == 0, 60).otherwise(1)
    parts = []
    for j in range(3):
        name = _spark_pick(NAMES, (part * 7 + number + j * 5) % len(NAMES))
        line = _spark_pick(ADDED, (part + j) % len(ADDED))
        added, deleted = (supp + 3 * j) % 9 * wide, (part + j) % 6 * wide
        head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1 @@\n"))
        parts.append(F.concat(head, F.repeat(F.concat(F.lit("+"), line, F.lit("\n")), added.cast("int")), F.repeat(F.lit("-old value\n"), deleted.cast("int"))))
    return F.concat(*parts)


def _raw_diffs(t, *more):
    """Line items -> sha, their columns ``more``, diff of three files a commit."""
    return t.select(F.expr(_sha).alias("sha"), *more, _diff().alias("diff"))


def _duck_part(j):
    name = f"{_duck_list(NAMES)}[(l_partkey * 7 + l_linenumber + {j} * 5) % {len(NAMES)} + 1]"
    line = f"{_duck_list(ADDED)}[(l_partkey + {j}) % {len(ADDED)} + 1]"
    wide = "CASE WHEN l_partkey % 50 = 0 THEN 60 ELSE 1 END"
    head = f"'diff --git a/' || {name} || ' b/' || {name} || chr(10) || '--- a/' || {name} || chr(10) || '+++ b/' || {name} || chr(10) || '@@ -1 +1 @@' || chr(10)"
    return f"{head} || repeat('+' || {line} || chr(10), (l_suppkey + {3 * j}) % 9 * ({wide})) || repeat('-old value' || chr(10), (l_partkey + {j}) % 6 * ({wide}))"


RAW = f"raw AS (SELECT {_sha} AS sha, {' || '.join(_duck_part(j) for j in range(3))} AS diff FROM lineitem)"
FILES = """parts AS (SELECT sha, unnest((string_split(chr(10) || diff, chr(10) || 'diff --git '))[2:]) AS part,
    generate_subscripts((string_split(chr(10) || diff, chr(10) || 'diff --git '))[2:], 1) - 1 AS file_no FROM raw),
  plain AS (SELECT sha, file_no, string_split(string_split(part, chr(10))[1], ' b/')[-1] AS filename, 'diff --git ' || part AS diff, string_split(part, chr(10)) AS ls FROM parts),
  counted AS (SELECT *, CAST(len(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS INT) AS added,
    CAST(len(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS INT) AS deleted FROM plain)"""


def _matches(patterns):
    return "'" + diffs.any_of(patterns).replace("'", "''") + "'"


_BY_PATH = ", ".join(f"CASE WHEN regexp_matches(filename, {_matches(p)}) THEN '{name}' END" for name, p in diffs.PATHS.items())
_SET = lambda sign: f"list_distinct(list_transform(list_filter(ls, lambda x: starts_with(x, '{sign}') AND NOT starts_with(x, '{sign * 3}')), lambda x: trim(substr(x, 2))))"
TAGGED = f"""tagged AS (SELECT *, list_filter([{_BY_PATH},
    CASE WHEN deleted = 0 AND added > 200 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\\+\\s*["{{}}\\[\\],]'))) > added * 0.5 THEN 'imported_data' END,
    CASE WHEN added > 50 AND deleted > 50 AND least(added, deleted) / greatest(added, deleted) > 0.85 THEN 'likely_move' END,
    CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^[+-]([^-+]|$)'))) > 10 AND len(list_intersect({_SET("+")}, {_SET("-")})) > 5
      AND len(list_intersect({_SET("+")}, {_SET("-")})) > greatest(len({_SET("+")}), len({_SET("-")})) * 0.7 THEN 'formatting_only' END,
    CASE WHEN ends_with(filename, '.json') AND added > 500 THEN 'large_data_file' END,
    CASE WHEN regexp_matches(filename, '\\.(md|mdx|rst)$') THEN 'docs' END,
    CASE WHEN ends_with(filename, '.svg') THEN 'generated' END,
    CASE WHEN regexp_matches(filename, '\\.[tj]sx$') AND added > 100 AND len(list_filter(ls, lambda x: starts_with(x, '+<path '))) > added * 0.3 THEN 'svg_icon_component' END],
    lambda t: t IS NOT NULL) AS tags FROM counted)"""
_TEXT = "array_to_string(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), chr(10))"
_DDL = "len(regexp_extract_all({t}, '(?i)\\b(CREATE|ALTER|DROP)\\s+(TABLE|INDEX|VIEW|TYPE|SEQUENCE|FUNCTION|TRIGGER)\\b'))".format(t=_TEXT)
TIERED = f"""tiered AS (SELECT *, CASE WHEN list_has_any(tags, ['generated', 'locale', 'svg_icon_component']) THEN 'SKIP'
    WHEN list_contains({list(diffs.SKIPPED)}, lower(regexp_extract(filename, '[^/]\\.([^./]*)$', 1))) OR (added = 0 AND deleted = 0) THEN 'SKIP'
    WHEN list_has_any(tags, ['docs', 'config', 'test', 'test_data']) THEN 'HEURISTIC'
    WHEN (regexp_matches(lower(filename), 'migrations?/') OR ends_with(filename, '.sql')) AND NOT regexp_matches({_TEXT}, '(?i)\\b(SELECT|INSERT|UPDATE|DELETE)\\b') THEN 'HEURISTIC'
    ELSE 'LLM_REQUIRED' END AS tier, CAST({_DDL} AS INT) AS n_ddl FROM tagged),
  hours AS (SELECT *, CASE WHEN tier <> 'HEURISTIC' THEN 0.0::DOUBLE WHEN list_contains(tags, 'docs') THEN least(0.5::DOUBLE, added * 0.003::DOUBLE)
    WHEN list_contains(tags, 'config') THEN added * 0.01::DOUBLE WHEN list_has_any(tags, ['test', 'test_data']) THEN added * 0.002::DOUBLE
    WHEN n_ddl > 0 THEN n_ddl * 0.1::DOUBLE ELSE 0.1::DOUBLE END AS hours FROM tiered)"""


def _files(spark, d):
    return diffs.file_features(diffs.split_files(_raw_diffs(table(spark, d, "lineitem"))))


def _tiers(spark, d):
    f = _files(spark, d)
    t = diffs.tier(F.col("filename"), F.col("tags"), F.col("added"), F.col("deleted"), F.col("diff"))
    return f.withColumn("t", t).select("sha", "file_no", F.col("t.tier").alias("tier"), F.round("t.hours", 4).alias("hours"))


def _changes(spark, d):
    """Commits with what the rules read."""
    t = table(spark, d, "lineitem")
    n = {
        "fc": "l_partkey % 260", "la": "(l_orderkey * 7 + l_partkey) % 12000", "ld": "(l_partkey * 11 + l_linenumber) % 4000", "moved": "l_partkey % 101",
        "new_logic": "l_suppkey % 40", "boilerplate": "l_linenumber * 13 % 90", "score": "l_partkey * 3 % 80",
    }
    return t.select(
        F.expr(_sha).alias("sha"),
        _spark_pick(MESSAGES, f"l_partkey % {len(MESSAGES)}").alias("message"),
        _spark_pick(KINDS, f"(l_suppkey + l_linenumber) % {len(KINDS)}").alias("kind"),
        _spark_pick(SUMMARIES, f"l_orderkey % {len(SUMMARIES)}").alias("summary"),
        F.expr("CASE WHEN l_orderkey % 2 = 0 THEN 'module' ELSE 'none' END").alias("scope"),
        F.expr("l_quantity / 5").cast("double").alias("hours"),
        *[F.expr(e).cast("int").alias(c) for c, e in n.items()],
        F.array(*[_spark_pick(NAMES, f"(l_partkey + {j} * l_linenumber) % {len(NAMES)}") for j in range(3)]).alias("files"),
    )


CHANGES = f"""changes AS (SELECT {_sha} AS sha, {_duck_list(MESSAGES)}[l_partkey % {len(MESSAGES)} + 1] AS message, {_duck_list(KINDS)}[(l_suppkey + l_linenumber) % {len(KINDS)} + 1] AS kind,
    {_duck_list(SUMMARIES)}[l_orderkey % {len(SUMMARIES)} + 1] AS summary, CASE WHEN l_orderkey % 2 = 0 THEN 'module' ELSE 'none' END AS scope, CAST(l_quantity AS DOUBLE) / 5 AS hours,
    l_partkey % 260 AS fc, (l_orderkey * 7 + l_partkey) % 12000 AS la, (l_partkey * 11 + l_linenumber) % 4000 AS ld, l_partkey % 101 AS moved, l_suppkey % 40 AS new_logic,
    l_linenumber * 13 % 90 AS boilerplate, l_partkey * 3 % 80 AS score, [{", ".join(f"{_duck_list(NAMES)}[(l_partkey + {j} * l_linenumber) % {len(NAMES)} + 1]" for j in range(3))}] AS files FROM lineitem)"""


def _ruled(make):
    def run(spark, d):
        return _changes(spark, d).select("sha", make().alias("v")).select("sha", F.round("v.hours", 4).alias("hours"), F.col("v.rule").alias("rule"))

    return run


def _ruled_sql(cases, frame="changes"):
    """cases: (condition, hours, rule)."""
    hours = " ".join(f"WHEN {c} THEN {h}" for c, h, _ in cases)
    rule = " ".join(f"WHEN {c} THEN {r}" for c, _, r in cases)
    return with_frames(f"SELECT sha, round(CAST(CASE {hours} END AS DOUBLE), 4) AS hours, CASE {rule} END AS rule FROM {frame}", CHANGES)


def _words(column, words):
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_SMALL = "least(2.0::DOUBLE, greatest(0.5::DOUBLE, fc * 0.05::DOUBLE))"
_EVEN = "la + ld > 200 AND abs(la - ld) / (la + ld)::DOUBLE < 0.05"
_GEN, _TEST = diffs.any_of(estimates.GENERATED), diffs.any_of(estimates.TESTS)
_N = {
    "gen": f"len(list_filter(files, lambda f: regexp_matches(f, '{_GEN}')))",
    "test": f"len(list_filter(files, lambda f: NOT regexp_matches(f, '{_GEN}') AND regexp_matches(f, '{_TEST}')))",
    "config": f"len(list_filter(files, lambda f: list_contains({list(estimates.CONFIG_EXTENSIONS)}, lower(regexp_extract(f, '[^/]\\.([^./]*)$', 1)))))",
}
_UPKEEP = f"(kind IN ('config', 'chore', 'tooling', 'mechanical changes') OR {_words('summary', ('edition', 'upgrade', 'bump'))} OR contains(lower(message), 'edition'))"
_OWN = "((contains(lower(message), 'move') AND contains(lower(message), 'to its own module')) OR (contains(summary, 'generator') AND contains(summary, 'move') AND contains(summary, 'module')))"



def _logs(spark, d):
    """A log a repository and year of orders: one commit an order, two files each, one of them binary at times."""
    o = table(spark, d, "orders")
    sha = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40)
    who = F.concat(F.lit("Dev"), (F.col("o_custkey") % 5).cast("string"), F.lit("@x.org"))
    head = F.concat_ws("|", sha, who, F.lit("A Name"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("fix | part "), F.col("o_orderkey").cast("string")))
    first = F.when(F.col("o_orderkey") % 5 == 0, F.lit("-\t-\timg.png")).otherwise(F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit("\t3\tsrc/a.py")))
    entry = F.concat(head, F.lit("\n\n"), first, F.lit("\n7\t"), (F.col("o_custkey") % 9).cast("string"), F.lit("\tb c.md\n\n"))
    rows = o.select(F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("repo"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), entry.alias("e"), "o_orderkey")
    merged = rows.groupBy("repo", "y", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "e"))), lambda x: x["e"]), "").alias("log"))
    return merged.select("repo", "log")


def _estimates(spark, d):
    """Two variants of estimates against a range."""
    t = table(spark, d, "lineitem")
    e = {
        "model": "CASE WHEN l_linenumber % 4 <> 0 THEN concat('m', l_linenumber % 2) END", "n_files": "CAST(l_partkey % 31 AS INT)",
        "method": "CASE WHEN l_linenumber = 5 THEN 'error' WHEN l_linenumber = 6 THEN NULL ELSE 'x' END",
        "est_a": "CASE WHEN l_partkey % 13 <> 0 THEN CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) END", "est_b": "CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) + l_partkey % 60 - 20",
        "low": "CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) + l_suppkey % 50 - 30", "high": "CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) + l_suppkey % 50 + 20",
        "tokens": "l_partkey % 5000", "millis": "l_suppkey * 7 % 3000",
    }
    return t.selectExpr(f"{_sha} AS sha", *[f"{x} AS {c}" for c, x in e.items()])


EST = f"""est AS (SELECT {_sha} AS sha, CASE WHEN l_linenumber % 4 <> 0 THEN 'm' || (l_linenumber % 2) END AS model, l_partkey % 31 AS n_files,
    CASE WHEN l_linenumber = 5 THEN 'error' WHEN l_linenumber = 6 THEN NULL ELSE 'x' END AS method, CASE WHEN l_partkey % 13 <> 0 THEN q END AS est_a, q + l_partkey % 60 - 20 AS est_b,
    q + l_suppkey % 50 - 30 AS low, q + l_suppkey % 50 + 20 AS high, l_partkey % 5000 AS tokens, l_suppkey * 7 % 3000 AS millis FROM (SELECT *, CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) AS q FROM lineitem))"""
_mid = "((low + high) / 2.0::DOUBLE)"


def _summary_sql(key, group, estimate, where):
    share = f"CASE WHEN {_mid} > 0 THEN ({estimate} - {_mid}) / {_mid} ELSE 0.0 END"
    return f"""SELECT {key} count(*) AS n, round(avg(abs({share})) * 100, 6) AS mape, round(median(abs({share})) * 100, 6) AS median_ape, round(avg(abs({estimate} - {_mid})), 6) AS mae,
      count(*) FILTER ({estimate} BETWEEN low AND high) AS in_range, round(count(*) FILTER ({estimate} BETWEEN low AND high) / count(*) * 100, 6) AS in_range_percent,
      round(avg({share}) * 100, 6) AS bias FROM est WHERE {estimate} IS NOT NULL AND {where} {group}"""


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_MEASURES = ["mape", "median_ape", "mae", "in_range_percent", "bias"]


def _runs(spark, d):
    c = commits(spark, d).where("job_id IS NOT NULL")
    return c.select(F.col("dup_sha").alias("sha"), F.col("job_id").alias("run"), F.col("model").alias("config"), "cents", "category", "day", F.col("sha").alias("row_sha"))


def _base_and_bench(spark, d):
    c = commits(spark, d)
    order = [F.col("day"), F.col("row_sha")]
    cols = [F.col("dup_sha").alias("sha"), "cents", "category", "day", F.col("sha").alias("row_sha")]
    return benchmarks.last_per(c.where("job_id IS NULL").select(*cols), ["sha"], order), benchmarks.last_per(c.where("job_id = 'job1'").select(*cols), ["sha"], order)


_LAST = """base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dup_sha ORDER BY day DESC, sha DESC) AS r FROM commits WHERE job_id IS NULL) WHERE r = 1),
  bench AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dup_sha ORDER BY day DESC, sha DESC) AS r FROM commits WHERE job_id = 'job1') WHERE r = 1)"""

QUERIES = {
    "diff_files": (
        lambda spark, d: diffs.split_files(_raw_diffs(table(spark, d, "lineitem"))).select("sha", "file_no", "filename", F.md5("diff").alias("digest"), diffs.n_added(F.col("diff")).alias("added"), diffs.n_deleted(F.col("diff")).alias("deleted")),
        with_frames("SELECT sha, file_no, filename, md5(diff) AS digest, added, deleted FROM counted", RAW, FILES),
    ),
    "file_tags": (
        lambda spark, d: _files(spark, d).select("sha", "file_no", F.array_join("tags", ",").alias("tags")),
        with_frames("SELECT sha, file_no, coalesce(array_to_string(tags, ','), '') AS tags FROM tagged", RAW, FILES, TAGGED),
    ),
    "file_tier": (_tiers, with_frames("SELECT sha, file_no, tier, round(hours, 4) AS hours FROM hours", RAW, FILES, TAGGED, TIERED)),
    "tier_totals": (
        lambda spark, d: diffs.tier_totals(_files(spark, d), ["sha"]),
        with_frames(
            """SELECT sha, count(*) FILTER (tier = 'SKIP') AS n_skip, count(*) FILTER (tier = 'HEURISTIC') AS n_heuristic, count(*) FILTER (tier = 'LLM_REQUIRED') AS n_llm,
            round(sum(hours), 2) AS heuristic_hours, length(coalesce(string_agg(diff, chr(10)) FILTER (tier = 'LLM_REQUIRED'), '')) / 2.0::DOUBLE AS tokens FROM hours GROUP BY sha""",
            RAW, FILES, TAGGED, TIERED,
        ),
    ),
    "build_artefacts": (
        lambda spark, d: diffs.new_artefacts(_files(spark, d)).select("sha", "filename"),
        with_frames(f"SELECT sha, filename FROM counted WHERE added > 2 AND deleted < 3 AND regexp_matches(filename, {_matches(diffs.ARTEFACTS)})", RAW, FILES),
    ),
    "directory_groups": (
        lambda spark, d: diffs.split_files(_raw_diffs(table(spark, d, "lineitem"))).groupBy(diffs.top_directory(F.col("filename")).alias("directory")).agg(F.count("*").alias("n")),
        with_frames(
            """SELECT CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] WHEN len(p) = 2 THEN p[1] ELSE '(root)' END AS directory, count(*) AS n
            FROM (SELECT string_split(filename, '/') AS p FROM counted) GROUP BY 1""",
            RAW, FILES,
        ),
    ),
    "file_composition": (
        lambda spark, d: diffs.composition(_files(spark, d), ["sha"]),
        with_frames(
            """SELECT sha, count(*) AS n_files, count(*) FILTER (added > 0 AND deleted = 0) AS n_new, count(*) FILTER (deleted > 0) AS n_modified,
            count(*) FILTER (added > 0 AND deleted = 0) / count(*) AS new_share, CAST(coalesce(sum(added) FILTER (added > 0 AND deleted = 0), 0) AS BIGINT) AS new_lines FROM counted GROUP BY sha""",
            RAW, FILES,
        ),
    ),
    "top_extensions": (
        lambda spark, d: diffs.top_extensions(diffs.split_files(_raw_diffs(table(spark, d, "lineitem"))).join(commits(spark, d).select("sha", "repo"), "sha"), ["repo"]),
        with_frames(
            """SELECT repo, extension, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, extension) AS rank FROM (SELECT repo, extension, count(*) AS n
            FROM (SELECT sha, lower(regexp_extract(filename, '[^/]\\.([^./]*)$', 1)) AS extension FROM counted) JOIN commits USING (sha) WHERE extension <> '' GROUP BY repo, extension)) WHERE rank <= 5""",
            RAW, FILES, COMMITS,
        ),
    ),
    "complexity_scores": (
        lambda spark, d: _raw_diffs(table(spark, d, "lineitem")).select("sha", diffs.complexity(F.col("diff")).alias("score")),
        with_frames(
            f"""SELECT sha, len(list_filter(a, lambda x: regexp_matches(x, '{diffs.FUNCTION_LINE}'))) * 2 + len(list_filter(a, lambda x: regexp_matches(x, '{diffs.CONTROL_LINE}')))
            + len(list_filter(a, lambda x: regexp_matches(x, '^(\\t{{3,}}|\\s{{12,}})'))) * 0.5::DOUBLE AS score
            FROM (SELECT sha, list_transform(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: substr(x, 2)) AS a FROM raw)""",
            RAW,
        ),
    ),
    "normal_lines": (
        lambda spark, d: diffs.split_files(_raw_diffs(table(spark, d, "lineitem"))).select(F.explode(diffs.added_lines(F.col("diff"))).alias("line")).groupBy(diffs.normal_line(F.col("line")).alias("line")).agg(F.count("*").alias("n")),
        with_frames(
            r"""SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\b(\w+\.){2,}\w+\b', '<CHAIN>', 'g'), '(import\s+)[\w.]+', '\1<IMPORT>', 'g'),
            '\b[A-Z][a-zA-Z0-9]{2,}\b', '<TYPE>', 'g'), '"[^"]*"', '"<STR>"', 'g'), '''[^'']*''', '''<STR>''', 'g'), '\b\d+\b', '<NUM>', 'g')) AS line, count(*) AS n
            FROM (SELECT substr(unnest(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))), 2) AS x FROM counted) GROUP BY 1""",
            RAW, FILES,
        ),
    ),
    "cheap_signals": (
        _ruled(lambda: estimates.cheap_signal(F.col("message"), F.col("fc"), F.col("la"), F.col("ld"))),
        _ruled_sql(
            [
                ("la < 20 AND ld > 500", "0.5", "'cheap_bulk_deletion'"),
                (f"{_EVEN} AND {_words('message', estimates.REFORMAT_WORDS)}", _SMALL, "'cheap_reformat_keyword'"),
                (f"{_EVEN} AND abs(la - ld) / (la + ld)::DOUBLE < 0.02 AND la + ld > 500", _SMALL, "'cheap_reformat_symmetric'"),
                (_words("message", estimates.LOCK_WORDS), "0.5", "'cheap_lockfile'"),
                (_words("message", estimates.LOCALE_WORDS), "least(5.0::DOUBLE, greatest(1.0::DOUBLE, fc * 0.1::DOUBLE))", "'cheap_locale'"),
            ]
        ),
    ),
    "fallback_estimates": (
        _ruled(lambda: estimates.fallback(F.col("message"), F.col("fc"), F.col("la"), F.col("ld"))),
        _ruled_sql(
            [
                ("contains(lower(message), 'test') AND la + ld > 3000", "5.0", "'fd_test_heuristic'"),
                (_words("message", ("locale", "translation")), "5.0", "'fd_locale_heuristic'"),
                ("fc > 200", "8.0", "'fd_bulk_heuristic'"),
                ("true", "least(16.0::DOUBLE, greatest(4.0::DOUBLE, fc * 0.5::DOUBLE))", "'fd_size_heuristic'"),
            ]
        ),
    ),
    "complexity_guard": (
        _ruled(lambda: estimates.guarded(F.col("hours"), F.col("score"), F.col("kind"))),
        _ruled_sql(
            [
                ("score < 10 AND hours > 5", "5.0", "'complexity_cap'"),
                ("score > 50 AND hours < 5 AND coalesce(kind, '') NOT IN ('mechanical changes', 'test', 'test_only', 'chore', 'config', 'tooling')", "5.0", "'complexity_floor'"),
                ("true", "hours", "NULL"),
            ]
        ),
    ),
    "correction_rules": (
        _ruled(lambda: estimates.corrected(lambda c: F.col({"added": "la", "deleted": "ld"}.get(c, c)))),
        _ruled_sql(
            [
                ("kind IS NULL", "hours", "NULL"),
                (f"{_N['gen']} = 3 AND hours > 0.5", "0.5", "'rule5_deps_only'"),
                (f"scope = 'module' AND moved > 85 AND new_logic < 10 AND {_OWN} AND hours > 2.5", "2.5", "'rule1_pure_move'"),
                (f"{_UPKEEP} AND moved + boilerplate > 80 AND new_logic < 15 AND {_N['config']} / 3.0 >= 0.5 AND hours > 1.5", "1.5", "'rule2_config_bump'"),
                ("kind IN ('test', 'test_only') AND la > 1000 AND new_logic < 30", "hours * 0.6::DOUBLE", "'rule3_large_tests'"),
                ("scope = 'module' AND moved > 80 AND contains(summary, 'generator') AND hours > 2", "2.0", "'rule4_generator_move'"),
                (f"{_N['test']} / 3.0 > 0.6 AND 3 - {_N['gen']} - {_N['test']} > 0 AND hours > 2", "hours * 0.6::DOUBLE", "'rule6_test_heavy'"),
                ("la > 0 AND ld > la * 3 AND hours > 1", "least(hours, greatest(0.5::DOUBLE, hours * 0.5::DOUBLE))", "'rule7_net_deletion'"),
                ("true", "hours", "NULL"),
            ]
        ),
    ),
    "changed_file_classes": (
        lambda spark, d: _changes(spark, d).select("sha", estimates.file_classes(F.col("files")).alias("c")).select("sha", "c.*"),
        with_frames(f"SELECT sha, CAST({_N['gen']} AS INT) AS \"generated\", CAST({_N['test']} AS INT) AS test, CAST(3 - {_N['gen']} - {_N['test']} AS INT) AS other FROM changes", CHANGES),
    ),
    "combine_estimates": (
        lambda spark, d: _changes(spark, d).select("sha", F.round(estimates.combined(F.col("hours"), F.col("score") / 4.0, F.col("fc") * 0.01), 4).alias("hours")),
        with_frames(
            """SELECT sha, round(CASE WHEN greatest(hours, score / 4.0::DOUBLE) / greatest(least(hours, score / 4.0::DOUBLE), 0.1) > 2 THEN least(hours, score / 4.0::DOUBLE)
            ELSE (hours + score / 4.0::DOUBLE) / 2 END + fc * 0.01::DOUBLE, 4) AS hours FROM changes""",
            CHANGES,
        ),
    ),
    "scaffold_routes": (
        lambda spark, d: _changes(spark, d)
        .withColumns({
            "s": estimates.scaffold_hours(F.col("message"), F.lit(100), F.lit(80) + F.col("score") % 21, F.col("moved") % 81, F.col("fc"), F.col("la")),
            "c": estimates.cheap_signal(F.col("message"), F.col("fc"), F.col("la"), F.col("ld")),
        })
        .groupBy(estimates.route(F.col("c"), F.col("s"), F.col("new_logic") % 3).alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("hours")),
        with_frames(
            f"""SELECT CASE WHEN cheap THEN 'cheap' WHEN s IS NOT NULL THEN 'scaffold' WHEN new_logic % 3 = 0 THEN 'heuristic' ELSE 'model' END AS route, count(*) AS n, round(sum(s), 4) AS hours FROM (
            SELECT *, CASE WHEN n_new > 80 AND la > 10000 AND fc >= 50 AND (regexp_matches(message, '(?i)initial\\s+(commit|import|setup)') OR n_new > 95) THEN
              least(least(40.0, 16 + (n_new - low) * 0.02::DOUBLE), CASE WHEN low / n_new > 0.5 THEN 8 + (n_new - low) * 0.02::DOUBLE ELSE 1e9 END) END AS s,
              (la < 20 AND ld > 500) OR ({_EVEN} AND ({_words('message', estimates.REFORMAT_WORDS)} OR (abs(la - ld) / (la + ld)::DOUBLE < 0.02 AND la + ld > 500)))
              OR {_words('message', estimates.LOCK_WORDS)} OR {_words('message', estimates.LOCALE_WORDS)} AS cheap
            FROM (SELECT *, 80 + score % 21 AS n_new, moved % 81 AS low FROM changes)) GROUP BY 1""",
            CHANGES,
        ),
    ),
    "git_log_parse": (
        lambda spark, d: parse_log(_logs(spark, d), excluded_emails=("dev3@X.org",)),
        """SELECT 'r' || (o_custkey % 40) AS repo, substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS sha, 'Dev' || (o_custkey % 5) || '@x.org' AS email, 'A Name' AS name,
        strftime(o_orderdate, '%Y-%m-%d') AS date, 'fix | part ' || o_orderkey AS message, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END + 7 AS added,
        CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 3 END + o_custkey % 9 AS deleted, CAST(2 AS INT) AS n_files FROM orders WHERE o_custkey % 5 <> 3""",
    ),
    "accuracy_summary": (
        lambda spark, d: _rounded(benchmarks.accuracy_summary(_estimates(spark, d), ["model"], "est_a"), _MEASURES),
        with_frames(_summary_sql("model,", "GROUP BY model", "est_a", "true"), EST),
    ),
    "accuracy_by_size": (
        lambda spark, d: _rounded(benchmarks.accuracy_summary(_estimates(spark, d).withColumn("size", benchmarks.size_bucket(F.col("n_files"))), ["size"], "est_b"), _MEASURES),
        with_frames(_summary_sql("CASE WHEN n_files <= 7 THEN 'small' WHEN n_files <= 15 THEN 'medium' ELSE 'large' END AS size,", "GROUP BY 1", "est_b", "true"), EST),
    ),
    "head_to_head": (
        lambda spark, d: benchmarks.head_to_head(_estimates(spark, d)),
        with_frames(
            f"SELECT count(*) FILTER (a < b) AS a_wins, count(*) FILTER (b < a) AS b_wins, count(*) FILTER (a = b) AS ties FROM (SELECT abs(est_a - {_mid}) / {_mid} AS a, abs(est_b - {_mid}) / {_mid} AS b FROM est WHERE est_a IS NOT NULL)",
            EST,
        ),
    ),
    "model_rank": (
        lambda spark, d: _rounded(benchmarks.ranked_variants(_estimates(spark, d), ["est_a", "est_b"]), ["mape"]),
        with_frames(
            f"""SELECT variant, n, round(mape, 6) AS mape, CAST(row_number() OVER (ORDER BY mape, variant) AS INT) AS rank FROM (
            SELECT 'est_a' AS variant, count(*) AS n, avg(CASE WHEN {_mid} > 0 THEN abs(est_a - {_mid}) / {_mid} ELSE 0.0 END) * 100 AS mape FROM est WHERE est_a IS NOT NULL
            UNION ALL SELECT 'est_b', count(*), avg(CASE WHEN {_mid} > 0 THEN abs(est_b - {_mid}) / {_mid} ELSE 0.0 END) * 100 FROM est)""",
            EST,
        ),
    ),
    "model_summary": (
        lambda spark, d: _rounded(benchmarks.model_summary(_estimates(spark, d).withColumn("estimate", F.col("est_b"))), ["signed_error"]),
        with_frames(
            f"""SELECT model, count(*) AS n, count(*) FILTER (est_b <= 2 * high AND est_b >= 0.5 * low) AS within_2x, round(avg(est_b - {_mid}), 6) AS signed_error, count(*) FILTER (est_b > {_mid}) AS over,
            count(*) FILTER (est_b < {_mid}) AS under, CAST(trunc(avg(tokens)) AS INT) AS tokens, CAST(trunc(avg(millis)) AS INT) AS millis FROM est WHERE method IS NULL OR method <> 'error' GROUP BY model""",
            EST,
        ),
    ),
    "run_comparison": (
        lambda spark, d: _rounded(benchmarks.compare_runs(*_base_and_bench(spark, d)), ["mae", "r", "same_category_percent"]),
        with_frames(
            """SELECT count(*) AS matched, round(avg(abs(b.cents - a.cents)), 6) AS mae, CAST(sum(a.cents) AS BIGINT) AS total_base, CAST(sum(b.cents) AS BIGINT) AS total_bench,
            round(CASE WHEN count(*) >= 3 THEN coalesce(covar_pop(a.cents, b.cents) / nullif(stddev_pop(a.cents) * stddev_pop(b.cents), 0), 0) END, 6) AS r,
            round(count(*) FILTER (a.category IS NOT DISTINCT FROM b.category) * 100.0::DOUBLE / nullif(count(*), 0), 6) AS same_category_percent FROM base a JOIN bench b USING (dup_sha)""",
            COMMITS, _LAST,
        ),
    ),
    "run_outliers": (
        lambda spark, d: benchmarks.outliers(*_base_and_bench(spark, d), 50),
        with_frames("SELECT dup_sha AS sha, a.cents, b.cents AS b_cents, b.cents - a.cents AS delta FROM base a JOIN bench b USING (dup_sha) ORDER BY abs(b.cents - a.cents) DESC, dup_sha LIMIT 50", COMMITS, _LAST),
    ),
    "run_spread": (
        lambda spark, d: _rounded(benchmarks.run_spread(_runs(spark, d)), ["sigma"]),
        with_frames(
            """SELECT sha, round(avg(s), 6) AS sigma FROM (SELECT dup_sha AS sha, model, stddev_pop(cents) AS s FROM commits WHERE job_id IS NOT NULL AND model IS NOT NULL
            GROUP BY dup_sha, model HAVING count(*) >= 2) GROUP BY sha""",
            COMMITS,
        ),
    ),
    "estimate_matrix": (
        lambda spark, d: benchmarks.estimate_matrix(_runs(spark, d), [F.col("day"), F.col("row_sha")]).select("sha", F.array_join(F.transform(F.map_entries("estimates"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("cells")),
        with_frames(
            """SELECT sha, string_agg(run || '=' || cents, ';' ORDER BY run) AS cells FROM (SELECT dup_sha AS sha, job_id AS run, cents,
            row_number() OVER (PARTITION BY dup_sha, job_id ORDER BY day DESC, sha DESC) AS r FROM commits WHERE job_id IS NOT NULL) WHERE r = 1 GROUP BY sha""",
            COMMITS,
        ),
    ),
    "numbered_runs": (
        lambda spark, d: benchmarks.numbered_runs(_runs(spark, d).where("config IS NOT NULL").groupBy(F.col("config").alias("model"), "run").agg(F.min("day").alias("created"))),
        with_frames(
            """SELECT model, run, created, CAST(row_number() OVER w AS INT) AS number, row_number() OVER w = count(*) OVER (PARTITION BY model) AS is_latest FROM (
            SELECT model, job_id AS run, min(day) AS created FROM commits WHERE job_id IS NOT NULL AND model IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY created, run)""",
            COMMITS,
        ),
    ),
    "truth_validation": (
        lambda spark, d: benchmarks.truth_problems(
            commits(spark, d).select("sha", F.when(F.col("day") < "1993-01-01", "").otherwise(F.repeat(F.lit("a"), (F.col("cents") % 70 + 1).cast("int"))).alias("author"), (F.col("cents") / 5.0 - 20).alias("hours")),
            commits(spark, d).where("job_id IS NULL"),
        ).groupBy("problem", "warn").agg(F.count("*").alias("n")),
        with_frames(
            """SELECT CASE WHEN job_id IS NOT NULL THEN 'unknown_sha' WHEN day < DATE '1993-01-01' OR cents % 70 + 1 > 64 THEN 'bad_author' WHEN cents / 5.0 - 20 < 0 THEN 'bad_hours' END AS problem,
            cents / 5.0 - 20 > 48 AS warn, count(*) AS n FROM commits GROUP BY ALL""",
            COMMITS,
        ),
    ),
    "failure_classes": (
        lambda spark, d: table(spark, d, "orders").select(scalars.failure_class(_spark_pick(("Quota exceeded", "HTTP 503 from x", "port 5035 closed", "Invalid API key, 402", "Broken pipe", "code 429", None), "o_orderkey % 7")).alias("class")).groupBy("class").agg(F.count("*").alias("n")),
        """SELECT CASE o_orderkey % 7 WHEN 0 THEN 'EXTERNAL_QUOTA' WHEN 1 THEN 'TRANSIENT' WHEN 4 THEN 'TRANSIENT' WHEN 5 THEN 'EXTERNAL_QUOTA' ELSE 'CONFIG_FATAL' END AS class, count(*) AS n FROM orders GROUP BY 1""",
    ),
}
