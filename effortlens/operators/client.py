"""What a client is shown of a job: none to four events out of each of its events, and who is ahead.

An event's payload is JSON. Its fields count only as what they should be: numbers that are finite,
texts that are not blank, trimmed. Codes that are not listed, internal ones among them, show nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens import params
from effortlens.functions.scalars import email_hash

_NUMBERS = ("commitCount", "estimatedHours", "filesCount", "additions", "deletions", "cachedCount", "cacheHitCount", "totalAnalyzed", "totalHours")
_TEXTS = ("subject", "authorEmail", "authorName", "category")
_PAYLOAD = ", ".join([*[f"{n} double" for n in _NUMBERS], *[f"{t} string" for t in _TEXTS]])
_SHOWN = "struct<tier: string, category: string, text: string, params: map<string, string>, developer_id: string, developer: string, hours: double>"


def _number(name: str) -> Column:
    x = F.col(f"p.{name}")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _text(name: str) -> Column:
    x = F.regexp_replace(F.col(f"p.{name}"), r"^\s+|\s+$", "")
    return F.when(x != "", x)


def _shown(value: Column) -> Column:
    """A number without a fraction where it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))


def _event(tier: str, category: str, text: str, **shown: Column) -> Column:
    pairs = [x for name, value in shown.items() for x in (F.lit(name), value.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string, string>")
    none = F.lit(None).cast("string")
    fields = {"tier": F.lit(tier), "category": F.lit(category), "text": F.lit(f"clientProgress.{text}"), "params": made, "developer_id": none, "developer": none, "hours": F.lit(None).cast("double")}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_SHOWN)


def _commit_events() -> list[Column]:
    """A commit: itself, and where they are known its files, lines and kind."""
    email = _text("authorEmail")
    who = F.when(email.isNotNull(), email_hash(email))
    name = F.when(email.isNotNull(), F.coalesce(_text("authorName"), F.substring_index(email, "@", 1)))
    shown = F.create_map(F.lit("subject"), F.coalesce(_text("subject"), F.lit("commit")), F.lit("developerName"), F.coalesce(name, F.lit("Developer")))
    parts = (F.lit("major"), F.lit("commit"), F.lit("clientProgress.commitAnalyzed"), shown, who, name, _number("estimatedHours"))
    commit = F.struct(*[c.alias(n) for c, n in zip(parts, ("tier", "category", "text", "params", "developer_id", "developer", "hours"), strict=True)]).cast(_SHOWN)
    files, changed = _number("filesCount"), F.coalesce(_number("additions"), F.lit(0.0)) + F.coalesce(_number("deletions"), F.lit(0.0))
    return [
        commit,
        F.when(files > 0, _event("micro", "stat", "filesChanged", fileCount=_shown(files))),
        F.when(changed > 0, _event("micro", "stat", "linesChanged", lineCount=_shown(changed))),
        F.when(_text("category").isNotNull(), _event("micro", "stat", "changeType", type=_text("category"))),
    ]


def client_events(events: DataFrame) -> DataFrame:
    """events (job_id, event_id, code, repo, payload) -> job_id, event_id, seq (from 0), tier, category, text, params, developer_id, developer, hours."""
    repo = F.coalesce("repo", F.lit(""))
    count = lambda *names: _shown(F.coalesce(*[_number(n) for n in names], F.lit(0.0)))
    # The codes that are shown, and as what.
    by_code = {
        "REPO_CLONE_START": [_event("milestone", "repo", "repoConnecting", repo=repo)],
        "REPO_EXTRACT_START": [_event("major", "phase", "extractingHistory", repo=repo)],
        "REPO_EXTRACT_DONE": [_event("major", "stat", "historyExtracted", commitCount=count("commitCount"))],
        "LLM_EVAL_START": [_event("milestone", "phase", "aiAnalysisStarted", commitCount=count("commitCount"))],
        "LLM_COMMIT_RESULT": _commit_events(),
        "REPO_FULLY_CACHED": [_event("major", "stat", "cachedResultsFound", count=count("cachedCount", "commitCount"))],
        "CACHE_REUSED": [_event("micro", "stat", "cacheReused", count=count("cacheHitCount"))],
        "REPO_PROCESS_DONE": [_event("milestone", "repo", "repoCompleted", repo=repo, commitCount=count("totalAnalyzed"), totalHours=count("totalHours"))],
        "LLM_EVAL_DONE": [_event("major", "phase", "aiAnalysisDone")],
        "REPO_EMPTY_SCOPE": [_event("major", "repo", "repoEmptyScope", repo=repo)],
    }
    rows = events.where(F.col("code").isin(*by_code)).withColumn("p", F.from_json("payload", _PAYLOAD))
    made = F.lit(None).cast(f"array<{_SHOWN}>")
    for code, shown in by_code.items():
        made = F.when(F.col("code") == code, F.array_compact(F.array(*shown))).otherwise(made)
    return rows.select("job_id", "event_id", F.posexplode(made).alias("seq", "e")).select("job_id", "event_id", "seq", "e.*")


def leaderboard(shown: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job and developer: last name, hours, commits, and the hours that one working to the norm would have by now.

    ``shown`` are client events, jobs has job_id, work_days and progress in percent.
    """
    known = shown.where("developer_id IS NOT NULL AND hours IS NOT NULL")
    sums = known.groupBy("job_id", "developer_id").agg(F.sum(F.floor(F.col("hours") * 10_000 + 0.5)).alias("parts"), F.count("*").alias("commits"))
    names = shown.where("developer_id IS NOT NULL").groupBy("job_id", "developer_id").agg(F.max_by("developer", F.struct("event_id", "seq", "developer")).alias("name"))
    expected = F.floor(params.NORM_CENTS_PER_DAY / 100 * F.col("work_days") * F.col("progress") / 100 + 0.5).cast("long")
    rows = sums.join(names, ["job_id", "developer_id"]).join(jobs, "job_id")
    return rows.select("job_id", "developer_id", "name", (F.floor(F.col("parts") / 100 + 0.5) / 100).alias("hours"), "commits", expected.alias("expected"))
