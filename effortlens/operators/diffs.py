"""Features of diffs: files, line counts, tags, effort tiers, artefacts and complexity, all as column expressions.

A commit's diff is a text; ``split_files`` makes a row a file, and everything else is computed inside
that row. Only the totals of a commit need a shuffle, of small numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of paths by which files are tagged.
PATHS = {
    "test": (
        r"_test\.go$", r"Test\.java$", r"Test\.kt$", r"Tests\.java$", r"Tests\.kt$", r"Spec\.java$", r"Spec\.kt$", r"src/test/", r"src/testFixtures/",
        r"test_\w+\.py$", r"tests/", r"_test\.py$", r"\.test\.\w+$", r"\.spec\.\w+$", r"__tests__/", r"#\[cfg\(test\)\]",
    ),
    "generated": (
        r"package-lock\.json$", r"pnpm-lock\.yaml$", r"yarn\.lock$", r"\.generated\.\w+$", r"\.min\.\w+$", r"\.map$", r"dist/", r"build/", r"\.d\.ts$",
        r"_pb\.ts$", r"_pb\.js$", r"_pb2\.py$", r"\.pb\.go$", r"_grpc_pb\.ts$", r"_grpc\.pb\.go$", r"\.snap$", r"__snapshots__/", r"Cargo\.lock$",
        r"go\.sum$", r"\.gradle\.kts?$", r"gradlew", r"gradle/wrapper/", r"mvnw", r"\.mvn/", r"poetry\.lock$", r"Pipfile\.lock$", r"\.lock$",
    ),
    "test_data": (r"__fixtures__/", r"testdata/", r"test[_-]?data/", r"fixtures/", r"META-INF/"),
    "locale": (r"locale[s]?/", r"i18n/", r"l10n/", r"lang/", r"translations?/", r"messages/"),
    "config": (
        r"\.config\.\w+$", r"tsconfig.*\.json$", r"\.eslintrc", r"\.prettierrc", r"jest\.config", r"vitest\.config", r"\.github/", r"\.circleci/",
        r"\.gitlab-ci", r"pom\.xml$", r"build\.gradle", r"build\.rs$", r"Cargo\.toml$", r"go\.mod$", r"setup\.py$", r"setup\.cfg$", r"pyproject\.toml$",
        r"Makefile$", r"Dockerfile$", r"docker-compose",
    ),
}
# Files that a new build unit brings, files of no effort, statements, and what a line is made equal by.
ARTEFACTS = (
    r"Cargo\.toml$", r"build\.rs$", r"package\.json$", r"tsconfig\.json$", r"pom\.xml$", r"build\.gradle(\.kts)?$", r"go\.mod$", r"setup\.py$",
    r"pyproject\.toml$", r"CMakeLists\.txt$",
)
SKIPPED = ("svg", "png", "jpg", "jpeg", "gif", "ico", "bmp", "webp", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "wav")
DDL = r"(?i)\b(CREATE|ALTER|DROP)\s+(TABLE|INDEX|VIEW|TYPE|SEQUENCE|FUNCTION|TRIGGER)\b"
DML = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b"
JSON_LINE = r"^\+\s*[\"{}\[\],]"
SVG_LINE = r"^\+.*(?:<path\s|<svg\s|<circle\s|<rect\s|\bd=\"[A-Z])"
NORMAL = (
    (r"\b(\w+\.){2,}\w+\b", "<CHAIN>"),
    (r"(import\s+)[\w.]+", "$1<IMPORT>"),
    (r"\b[A-Z][a-zA-Z0-9]{2,}\b", "<TYPE>"),
    (r"\"[^\"]*\"", "\"<STR>\""),
    (r"'[^']*'", "'<STR>'"),
    (r"\b\d+\b", "<NUM>"),
)
FUNCTION_LINE = r"\b(func|def|fn|function|public\s+\w+\s+\w+\s*\(|private\s+\w+\s+\w+\s*\(|protected\s+\w+\s+\w+\s*\()\b"
CONTROL_LINE = r"\b(if|else|for|while|match|switch|case|try|catch|except)\b"
DEEP_LINE = r"^(\t{3,}|\s{12,})"


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def split_files(diffs: DataFrame, diff_col: str = "diff") -> DataFrame:
    """A row a file, in the order of the diff: the other columns, file_no (from 0), filename, diff (of the file).

    A file begins at a line ``diff --git``; what stands before the first is no file. The name is what
    follows the last `` b/`` of that line, or the line itself. A null diff has no files.
    """
    others = [F.col(f"`{c}`") for c in diffs.columns if c != diff_col]
    parts = F.split(F.concat(F.lit("\n"), F.col(diff_col)), "\ndiff --git ")
    rows = diffs.select(*others, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("file_no", "part"))
    header = F.substring_index("part", "\n", 1)
    name = F.when(F.instr(header, " b/") > 0, F.substring_index(header, " b/", -1)).otherwise(F.concat(F.lit("diff --git "), header))
    return rows.select(*others, "file_no", name.alias("filename"), F.concat(F.lit("diff --git "), F.col("part")).alias("diff"))


def _lines(diff: Column) -> Column:
    return F.split(diff, "\n")


def _is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def _is_deleted(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def added_lines(diff: Column) -> Column:
    """Texts of the added lines, without their sign."""
    return F.transform(F.filter(_lines(diff), _is_added), lambda x: F.substr(x, F.lit(2)))


def _begin_with(diff: Column, sign: str) -> Column:
    """Lines that begin with ``sign`` and not with three of it, counted without parting the text."""
    text = F.concat(F.lit("\n"), diff)
    n = lambda start: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(start), F.lit("")))) / len(start)
    return (n(f"\n{sign}") - n(f"\n{sign * 3}")).cast("int")


def n_added(diff: Column) -> Column:
    return _begin_with(diff, "+")


def n_deleted(diff: Column) -> Column:
    return _begin_with(diff, "-")


def _count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def _stripped(diff: Column, keep) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(diff), keep), lambda x: F.trim(F.substr(x, F.lit(2)))))


def _formatting_only(diff: Column, n_added: Column, n_deleted: Column) -> Column:
    """More than ten changed lines, most of which come back but for white space at their ends.

    All of them are added or deleted, and what comes back is both: most files are decided by these two numbers.
    """
    added, deleted = _stripped(diff, _is_added), _stripped(diff, _is_deleted)
    both = F.size(F.array_intersect(added, deleted))
    changed = _count(_lines(diff), r"^[+-](?![-+])")
    few = (n_added + n_deleted <= 10) | (n_added <= 5) | (n_deleted <= 5)
    return F.when(few, False).otherwise((changed > 10) & (both > F.greatest(F.size(added), F.size(deleted)) * 0.7) & (both > 5))


def tags(filename: Column, diff: Column, added: Column, deleted: Column) -> Column:
    """Tags of a file, by its path and then by what its diff looks like."""
    by_path = [F.when(filename.rlike(any_of(patterns)), name) for name, patterns in PATHS.items()]
    moved = (added > 50) & (deleted > 50) & (F.least(added, deleted) / F.greatest(added, deleted) > 0.85)
    by_content = [
        F.when((deleted == 0) & (added > 200) & (_count(_lines(diff), JSON_LINE) > added * 0.5), "imported_data"),
        F.when(moved, "likely_move"),
        F.when(_formatting_only(diff, added, deleted), "formatting_only"),
        F.when(filename.endswith(".json") & (added > 500), "large_data_file"),
        F.when(filename.rlike(r"\.(md|mdx|rst)$"), "docs"),
        F.when(filename.endswith(".svg"), "generated"),
        F.when(filename.rlike(r"\.[tj]sx$") & (added > 100) & (_count(_lines(diff), SVG_LINE) > added * 0.3), "svg_icon_component"),
    ]
    return F.array_compact(F.array(*by_path, *by_content))


def file_features(files: DataFrame) -> DataFrame:
    """Files with added, deleted and tags."""
    counted = files.withColumns({"added": n_added(F.col("diff")), "deleted": n_deleted(F.col("diff"))})
    return counted.withColumn("tags", tags(F.col("filename"), F.col("diff"), F.col("added"), F.col("deleted")))


def extension(filename: Column) -> Column:
    """Lower-cased letters after the last dot of the last path element; empty if there is none or it leads."""
    return F.lower(F.regexp_extract(filename, r"[^/]\.([^./]*)$", 1))


def tier(filename: Column, tags_: Column, added: Column, deleted: Column, diff: Column) -> Column:
    """struct(tier, hours): SKIP, HEURISTIC with hours, or LLM_REQUIRED."""

    def out(name: str, hours: Column | float) -> Column:
        return F.struct(F.lit(name).alias("tier"), (hours if isinstance(hours, Column) else F.lit(hours)).cast("double").alias("hours"))

    has = lambda *names: F.arrays_overlap(tags_, F.array(*[F.lit(n) for n in names]))
    text = F.array_join(F.filter(_lines(diff), _is_added), "\n")
    n_ddl = F.regexp_count(text, F.lit(DDL))
    migration = F.lower(filename).rlike(r"migrations?/") | filename.endswith(".sql")
    by_sql = F.when(text.rlike(DML), out("LLM_REQUIRED", 0.0)).when(n_ddl > 0, out("HEURISTIC", n_ddl * 0.1)).otherwise(out("HEURISTIC", 0.1))
    return (
        F.when(has("generated", "locale", "svg_icon_component"), out("SKIP", 0.0))
        .when(extension(filename).isin(*SKIPPED) | ((added == 0) & (deleted == 0)), out("SKIP", 0.0))
        .when(has("docs"), out("HEURISTIC", F.least(F.lit(0.5), added * 0.003)))
        .when(has("config"), out("HEURISTIC", added * 0.01))
        .when(has("test", "test_data"), out("HEURISTIC", added * 0.002))
        .when(migration, by_sql)
        .otherwise(out("LLM_REQUIRED", 0.0))
    )


def tier_totals(files: DataFrame, by: list[str]) -> DataFrame:
    """Per commit: files of each tier, heuristic hours (two decimals), tokens that a model would read (two characters each)."""
    t = files.withColumn("t", tier(F.col("filename"), F.col("tags"), F.col("added"), F.col("deleted"), F.col("diff")))
    needs = F.col("t.tier") == "LLM_REQUIRED"
    chars = F.sum(F.when(needs, F.char_length("diff")).otherwise(0)) + F.greatest(F.count_if(needs) - 1, F.lit(0))
    return t.groupBy(*by).agg(
        F.count_if(F.col("t.tier") == "SKIP").alias("n_skip"),
        F.count_if(F.col("t.tier") == "HEURISTIC").alias("n_heuristic"),
        F.count_if(needs).alias("n_llm"),
        F.round(F.sum("t.hours"), 2).alias("heuristic_hours"),
        (chars / 2.0).alias("tokens"),
    )


def new_artefacts(files: DataFrame) -> DataFrame:
    """Files that bring a new build unit: hardly anything deleted and a name of the list."""
    return files.where((F.col("added") > 2) & (F.col("deleted") < 3) & F.col("filename").rlike(any_of(ARTEFACTS)))


def normal_line(line: Column) -> Column:
    """A line with names, types, texts and numbers made equal, for mining of repeated edits."""
    for pattern, replacement in NORMAL:
        line = F.regexp_replace(line, pattern, replacement)
    return F.trim(line)


def top_directory(filename: Column) -> Column:
    """The first two directories, the one there is, or (root)."""
    parts = F.split(F.translate(filename, "\\", "/"), "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.slice(parts, 1, 2))).when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise("(root)")


def composition(files: DataFrame, by: list[str]) -> DataFrame:
    """Per commit: files, new, modified, share of new ones, lines of new ones."""
    new = (F.col("added") > 0) & (F.col("deleted") == 0)
    return files.groupBy(*by).agg(
        F.count("*").alias("n_files"),
        F.count_if(new).alias("n_new"),
        F.count_if(F.col("deleted") > 0).alias("n_modified"),
        (F.count_if(new) / F.count("*")).alias("new_share"),
        F.sum(F.when(new, F.col("added")).otherwise(0)).alias("new_lines"),
    )


def top_extensions(files: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The most frequent extensions of each group: rank, extension, n; ties by name."""
    from pyspark.sql import Window

    counted = files.select(*by, extension(F.col("filename")).alias("extension")).where("extension <> ''").groupBy(*by, "extension").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "extension"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def complexity(diff: Column) -> Column:
    """Two points a function, one a line of control flow, half a deeply nested line, over the added lines."""
    lines = added_lines(diff)
    return _count(lines, FUNCTION_LINE) * 2 + _count(lines, CONTROL_LINE) + _count(lines, DEEP_LINE) * 0.5
