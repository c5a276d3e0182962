"""Rules around a model's estimate that need no model: cheap signals, guards, corrections, fallbacks, combination.

Each rule list becomes one ``when`` chain over struct(hours, rule): the first rule that holds wins, and
its name says why. Nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from effortlens.operators.diffs import any_of

# Words in commit messages, file patterns and kinds of change that rules test.
REFORMAT_WORDS = ("prettier", "format", "lint", "eslint", "rustfmt", "gofmt", "rename", "whitespace", "indent")
LOCK_WORDS = ("remove lock", "delete lock", "pnpm-lock", "package-lock", "yarn.lock", "cargo.lock")
LOCALE_WORDS = ("locale", "translation", "i18n", "l10n")
LOW_EFFORT_KINDS = ("mechanical changes", "test", "test_only", "chore", "config", "tooling")
CONFIG_KINDS = ("config", "chore", "tooling", "mechanical changes")
CONFIG_EXTENSIONS = (
    "json", "toml", "yaml", "yml", "lock", "csproj", "sln", "xml", "props", "targets", "config", "ini", "cfg", "npmrc", "editorconfig", "prettierrc",
    "eslintrc",
)
GENERATED = (
    r"go\.sum$", r"go\.mod$", r"package-lock\.json$", r"pnpm-lock\.yaml$", r"yarn\.lock$", r"Cargo\.lock$", r"poetry\.lock$", r"Pipfile\.lock$",
    r"\.gradle\.lockfile$",
)
TESTS = (
    r"_test\.go$", r"Test\.java$", r"Test\.kt$", r"Tests\.java$", r"Spec\.java$", r"test_\w+\.py$", r"_test\.py$", r"\.test\.\w+$", r"\.spec\.\w+$",
    r"__tests__/", r"src/test/", r"testdata/", r"__fixtures__/",
)
SCAFFOLD = (
    r"(?i)\b(monorepo|mono[- ]?repo|scaffold|boilerplate|template|seed|vendor|copy\s+(from|into|over)|bootstrap|initial\s+(commit|import|setup))\b"
)
SCAFFOLD_SETUP = r"(?i)\b(wip|init)\b.*\b(setup|library|scaffold|skeleton)\b"


def _verdict(hours: Column | float, rule: str) -> Column:
    return F.struct((hours if isinstance(hours, Column) else F.lit(hours)).cast("double").alias("hours"), F.lit(rule).alias("rule"))


def _none() -> Column:
    return F.lit(None).cast("struct<hours: double, rule: string>")


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _within(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def cheap_signal(message: Column, n_files: Column, added: Column, deleted: Column) -> Column:
    """struct(hours, rule) of what can be told from a commit's message and size; null if nothing can."""
    text, churn = F.lower(message), added + deleted
    net = F.abs(added - deleted) / churn
    small = _within(n_files * 0.05, 0.5, 2.0)
    even = (churn > 200) & (net < 0.05)
    return (
        F.when((added < 20) & (deleted > 500), _verdict(0.5, "cheap_bulk_deletion"))
        .when(even & _has_any(text, REFORMAT_WORDS), _verdict(small, "cheap_reformat_keyword"))
        .when(even & (net < 0.02) & (churn > 500), _verdict(small, "cheap_reformat_symmetric"))
        .when(_has_any(text, LOCK_WORDS), _verdict(0.5, "cheap_lockfile"))
        .when(_has_any(text, LOCALE_WORDS), _verdict(_within(n_files * 0.1, 1.0, 5.0), "cheap_locale"))
        .otherwise(_none())
    )


def fallback(message: Column, n_files: Column, added: Column, deleted: Column) -> Column:
    """struct(hours, rule) by size alone, for where no model answers."""
    text = F.lower(message)
    return (
        F.when(text.contains("test") & (added + deleted > 3000), _verdict(5.0, "fd_test_heuristic"))
        .when(text.contains("locale") | text.contains("translation"), _verdict(5.0, "fd_locale_heuristic"))
        .when(n_files > 200, _verdict(8.0, "fd_bulk_heuristic"))
        .otherwise(_verdict(_within(n_files * 0.5, 4.0, 16.0), "fd_size_heuristic"))
    )


def guarded(hours: Column, score: Column, kind: Column) -> Column:
    """struct(hours, rule): simple diffs at most 5 hours, complex ones at least 5 unless of a kind of low effort."""
    low = F.coalesce(F.lower(kind), F.lit("")).isin(*LOW_EFFORT_KINDS)
    return (
        F.when((score < 10) & (hours > 5), _verdict(5.0, "complexity_cap"))
        .when((score > 50) & (hours < 5) & ~low, _verdict(5.0, "complexity_floor"))
        .otherwise(F.struct(hours.cast("double").alias("hours"), F.lit(None).cast("string").alias("rule")))
    )


def file_classes(files: Column) -> Column:
    """struct(generated, test, other): how many changed files are of each class; generated comes first."""
    generated = F.filter(files, lambda f: f.rlike(any_of(GENERATED)))
    rest = F.filter(files, lambda f: ~f.rlike(any_of(GENERATED)))
    tests = F.filter(rest, lambda f: f.rlike(any_of(TESTS)))
    return F.struct(F.size(generated).alias("generated"), F.size(tests).alias("test"), (F.size(rest) - F.size(tests)).alias("other"))


def corrected(get=F.col) -> Column:
    """struct(hours, rule) after the correction rules, in the order 5, 1, 2, 3, 4, 6, 7.

    ``get`` gives message, hours, kind (null: nothing is known and nothing is corrected), scope, moved,
    new_logic, boilerplate (percent), summary, added, deleted and files (array).
    """
    hours, kind, text, summary = get("hours"), F.lower(get("kind")), F.lower(get("message")), F.lower(F.coalesce(get("summary"), F.lit("")))
    files, moved, new, module = get("files"), get("moved"), get("new_logic"), get("scope") == "module"
    some, n = F.coalesce(F.size(files), F.lit(0)) > 0, F.size(files)
    classes = file_classes(files)
    own_module = (text.contains("move") & text.contains("to its own module")) | (summary.contains("generator") & summary.contains("move") & summary.contains("module"))
    n_config = F.size(F.filter(files, lambda f: F.lower(F.regexp_extract(f, r"[^/]\.([^./]*)$", 1)).isin(*CONFIG_EXTENSIONS)))
    upkeep = kind.isin(*CONFIG_KINDS) | _has_any(summary, ("edition", "upgrade", "bump")) | text.contains("edition")
    mostly_config = F.when(some, n_config / n >= 0.5).otherwise(True)
    kept = F.struct(hours.cast("double").alias("hours"), F.lit(None).cast("string").alias("rule"))
    return (
        F.when(kind.isNull(), kept)
        .when(some & (classes["other"] == 0) & (classes["test"] == 0) & (hours > 0.5), _verdict(0.5, "rule5_deps_only"))
        .when(module & (moved > 85) & (new < 10) & own_module & (hours > 2.5), _verdict(2.5, "rule1_pure_move"))
        .when(upkeep & (moved + get("boilerplate") > 80) & (new < 15) & mostly_config & (hours > 1.5), _verdict(1.5, "rule2_config_bump"))
        .when(kind.isin("test", "test_only") & (get("added") > 1000) & (new < 30), _verdict(hours * 0.6, "rule3_large_tests"))
        .when(module & (moved > 80) & summary.contains("generator") & (hours > 2.0), _verdict(2.0, "rule4_generator_move"))
        .when(some & (n > 1) & (classes["test"] / n > 0.6) & (classes["other"] > 0) & (hours > 2.0), _verdict(hours * 0.6, "rule6_test_heavy"))
        .when(
            (get("added") > 0) & (get("deleted") > get("added") * 3) & (hours > 1.0),
            _verdict(F.least(hours, F.greatest(F.lit(0.5), hours * 0.5)), "rule7_net_deletion"),
        )
        .otherwise(kept)
    )


def combined(branch: Column, holistic: Column, heuristic: Column) -> Column:
    """The mean of two estimates, or the smaller if they are more than a factor of 2 apart; heuristic hours are added."""
    low, high = F.least(branch, holistic), F.greatest(branch, holistic)
    return F.when(high / F.greatest(low, F.lit(0.1)) > 2, low).otherwise((branch + holistic) / 2) + heuristic


def scaffold_hours(message: Column, n_files: Column, n_new: Column, n_low_effort_new: Column, changed_files: Column, added: Column) -> Column:
    """Hours of a commit that copies or scaffolds in bulk, else null."""
    share = n_new / n_files
    bulk = (share > 0.8) & (added > 10_000) & (changed_files >= 50)
    signal = message.rlike(SCAFFOLD) | message.rlike(SCAFFOLD_SETUP) | (share > 0.95)
    real = n_new - n_low_effort_new
    hours = F.least(F.lit(40.0), 16.0 + real * 0.02)
    hours = F.when(n_low_effort_new / n_new > 0.5, F.least(hours, 8.0 + real * 0.02)).otherwise(hours)
    return F.when(bulk & signal, hours)


def route(cheap: Column, scaffold: Column, n_model_files: Column) -> Column:
    """Where an estimate comes from: a cheap signal, the scaffold rule, heuristics alone, or a model."""
    return F.when(cheap.isNotNull(), "cheap").when(scaffold.isNotNull(), "scaffold").when(n_model_files == 0, "heuristic").otherwise("model")


def root_or_failed(hours: Column, is_root: Column, failed: Column) -> Column:
    """Half an hour for a first commit; five hours where the estimate failed."""
    return F.when(is_root, F.lit(0.5)).when(failed, F.lit(5.0)).otherwise(hours)
