"""Scalar expressions of the domain; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from effortlens import params


def ratio(cents: Column, days: Column, share: Column | None = None) -> Column:
    """Percent of the norm of productive hours; null without a work day or with a share of 0 or less."""
    value = cents * 100.0 / (days * params.NORM_CENTS_PER_DAY)
    enough = days >= params.MIN_WORK_DAYS
    return F.when(enough, value) if share is None else F.when(enough & (share > 0), value / share)


def colour(percent: Column) -> Column:
    return (
        F.when(percent.isNull(), "gray").when(percent >= params.GREEN_FROM, "green").when(percent >= params.YELLOW_FROM, "yellow").otherwise("red")
    )


def ratio_label(percent: Column) -> Column:
    return F.coalesce(F.concat(F.floor(percent + 0.5).cast("string"), F.lit("%")), F.lit("N/A"))


def auto_share(part: Column, total: Column) -> Column:
    return F.when((total == 0) | (part >= total), F.lit(1.0)).otherwise(part / total)


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def weekdays_between(first: Column, last: Column) -> Column:
    """Monday to Friday days in [first, last], in closed form; 0 if the range is empty."""
    n = F.greatest(F.datediff(last, first) + 1, F.lit(0))
    rest, start = n % 7, F.weekday(first)
    # of the days beyond whole weeks, those that fall on Saturday (5) or Sunday (6)
    weekend = F.greatest(F.lit(0), F.least(start + rest, F.lit(7)) - F.greatest(start, F.lit(5))) + F.greatest(F.lit(0), start + rest - 12)
    return ((n - rest) / 7 * 5 + rest - weekend).cast("long")


def period_key(day: Column, unit: str) -> Column:
    """Label of the bucket of a day: day, week (ISO), month, quarter, year or all."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if unit == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    if unit == "all":
        return F.lit("all")
    return F.date_format(day, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def email_hash(email: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(email)), 256), 1, 12)


def email_mask(email: Column) -> Column:
    return F.regexp_replace(email, r"^(.{1,2}).*(@.*)$", "$1***$2")


def email_domain(email: Column) -> Column:
    return F.element_at(F.split(F.lower(email), "@"), 2)


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def freshness(day: Column, as_of: Column, days: int = params.FRESH_DAYS) -> Column:
    return F.when(day.isNull(), "never").when(day >= F.date_sub(as_of, days), "fresh").otherwise("stale")


# Words and status codes that tell why a call failed.
FATAL_WORDS = (
    "fatal_llm:", "llm_snapshot_invalid", "missing llmconfigsnapshot", "all providers have been ignored", "authentication", "invalid token",
    "schema mismatch", "unknown column", "relation does not exist", "invalid api key", "unauthorized",
)
QUOTA_WORDS = (
    "quota", "rate limit", "rate_limit", "ratelimit", "billing", "credits exhausted", "credit limit", "budget", "insufficient funds",
    "payment required", "too many requests", "quota exceeded", "limit exceeded", "credits exceeded",
)
TRANSIENT_WORDS = (
    "timeout", "timed out", "timedout", "connection reset", "connection refused", "connection aborted", "connectionerror", "connecttimeout",
    "temporary failure", "temporarily unavailable", "econnreset", "econnrefused", "epipe", "broken pipe", "network error", "network unreachable",
    "bad gateway", "service unavailable", "gateway timeout", "retryable",
)
QUOTA_CODES, TRANSIENT_CODES = r"\b(402|429)\b", r"\b(502|503|504)\b"


def words_pattern(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words; none of them holds a sign with a meaning in patterns."""
    return "|".join(words)


def failure_class(message: Column) -> Column:
    """CONFIG_FATAL before EXTERNAL_QUOTA before TRANSIENT; what is none of them is CONFIG_FATAL, as blind retries cost."""
    m = F.lower(message)
    quota = m.rlike(words_pattern(QUOTA_WORDS)) | m.rlike(QUOTA_CODES)
    transient = m.rlike(words_pattern(TRANSIENT_WORDS)) | m.rlike(TRANSIENT_CODES)
    return (
        F.when(m.rlike(words_pattern(FATAL_WORDS)), "CONFIG_FATAL").when(quota, "EXTERNAL_QUOTA").when(transient, "TRANSIENT").otherwise("CONFIG_FATAL")
    )


def utc_day(at: Column) -> Column:
    """Day of a timestamp as yyyy-MM-dd, in the session's zone (UTC)."""
    return F.date_format(at, "yyyy-MM-dd")


def day_start(day: Column) -> Column:
    return F.to_timestamp(day)


def day_end(day: Column) -> Column:
    """The last millisecond of a day."""
    return F.timestamp_millis(F.unix_millis(F.to_timestamp(F.date_add(day, 1))) - 1)


def name_parts(name: Column) -> Column:
    """Words of a normalised name; none for a blank one."""
    return F.array_remove(F.split(normal_name(name), " "), "")


def first_name(name: Column) -> Column:
    return F.coalesce(F.get(name_parts(name), F.lit(0)), F.lit(""))


def last_name(name: Column) -> Column:
    return F.coalesce(F.try_element_at(name_parts(name), F.lit(-1)), F.lit(""))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(name_parts(name), lambda w: F.substring(w, 1, 1)), "")


def is_initial_match(a: Column, b: Column) -> Column:
    """Equal last names, and one first name is the initial (a dot may follow) of the other, different one."""

    def stands_for(short: Column, long: Column) -> Column:
        return short.rlike(r"^[^.]\.?$") & (F.substring(short, 1, 1) == F.substring(long, 1, 1))

    fa, fb = first_name(a), first_name(b)
    return (last_name(a) == last_name(b)) & (last_name(a) != "") & (fa != fb) & (stands_for(fa, fb) | stands_for(fb, fa))


def names_similar(a: Column, b: Column) -> Column:
    """Looser: equal names, or two or more words each with equal last words and equal first letters."""
    several = (F.size(name_parts(a)) > 1) & (F.size(name_parts(b)) > 1)
    close = several & (last_name(a) == last_name(b)) & (F.substring(first_name(a), 1, 1) == F.substring(first_name(b), 1, 1))
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | close


def string_hash(text: Column) -> Column:
    """31 h + code over the characters in 32 signed bits, then the absolute value."""
    codes = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.when(F.char_length(text) > 0, F.abs(signed)).otherwise(F.lit(0).cast("long"))


def seeded_random(seed: Column) -> Column:
    """A fixed number in [0, 1) for a seed."""
    x = F.sin(seed * 9301 + 49297) * 49297
    return x - F.floor(x)


def bubble_radius(effort: Column, most: Column, is_large: Column) -> Column:
    """5 in large sets, 8 without a maximum, else 6 to 40 by the square root of the share."""
    return F.when(is_large, F.lit(5.0)).when(most <= 0, F.lit(8.0)).otherwise(6 + F.sqrt(effort / most) * 34)


def heat_intensity(percent: Column) -> Column:
    """Opacity of the heat colour: green, yellow or red by ``colour``."""
    green = 0.2 + F.least((percent - 100) / 100, F.lit(1.0)) * 0.6
    yellow = 0.2 + F.least((100 - percent) / 20, F.lit(1.0)) * 0.4
    return F.when(percent >= 100, green).when(percent >= 80, yellow).otherwise(0.2 + F.least((80 - percent) / 80, F.lit(1.0)) * 0.6)


def rate_status(rate: Column, pass_max: float, warn_max: float) -> Column:
    """na, pass, warn or fail of a rate that should be low."""
    return F.when(rate.isNull(), "na").when(rate <= pass_max, "pass").when(rate <= warn_max, "warn").otherwise("fail")


def worst_status(*statuses: Column) -> Column:
    rank = {"fail": 3, "warn": 2, "pass": 1}
    worst = F.greatest(*[sum((F.when(c == k, v).otherwise(0) for k, v in rank.items()), F.lit(0)) for c in statuses])
    return F.when(worst == 3, "fail").when(worst == 2, "warn").when(worst == 1, "pass").otherwise("na")


def confidence(method: Column) -> Column:
    return F.when(method.startswith("FD"), 0.6).when(method == "error", 0.1).when(method == "root_commit_skip", 0.5).otherwise(0.8)


def attributed_model(method: Column, result: Column, default: Column) -> Column:
    """The model that made an estimate: none for skips and errors, its own for FD methods, else the job's."""
    return F.when(method.isin("root_commit_skip", "error"), F.lit(None)).when(method.startswith("FD"), F.nullif(result, F.lit(""))).otherwise(default)


def seconds_since(at: Column, now: Column) -> Column:
    return F.when(at.isNotNull(), F.greatest(F.lit(0), F.floor(now - at)))


def workspace_stage(teams: Column, repos: Column, people: Column) -> Column:
    return F.when(teams > 0, "operational").when((repos > 0) & (people > 0), "first_data").otherwise("empty")


def activity_level(score: Column) -> Column:
    return F.when(score >= 10, "high").when(score >= 3, "medium").otherwise("low")


def order_label(names: Column) -> Column:
    """Up to three names, then how many more there are."""
    more = F.when(F.size(names) > 3, F.concat(F.lit(" +"), (F.size(names) - 3).cast("string"))).otherwise("")
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), more)


def positive_number(value: Column) -> Column:
    """A number above 0 from text, else null."""
    number = value.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def usable_context(tokens: Column, routed: Column, least: int = 4096, most: int = 262144) -> Column:
    """A model's context, three quarters of it behind a router, clamped."""
    adjusted = F.when(routed, F.floor(tokens * 0.75)).otherwise(tokens)
    return F.greatest(F.lit(least), F.least(F.lit(most), adjusted)).cast("long")


def finite(value: Column) -> Column:
    """0 for what is not a finite number."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


# Names of secret settings, and folders that tell who ran something.
SECRET_NAME = r"(?i)(key|secret|token|password|credential|auth)"
LOCAL_FOLDERS = (
    r"[A-Za-z]:\\Users\\[^\\]+\\AppData\\Local\\Temp\\[^\\]*",
    r"[A-Za-z]:\\Users\\[^\\]+",
    r"/tmp/[^/]*",
    r"/var/folders/[^/]+/[^/]+/[^/]+/[^/]*",
    r"/home/[^/]+",
)


def scrubbed(name: Column, text: Column) -> Column:
    """The value of a setting without credentials in URLs and local folders; a secret one is withheld."""
    out = F.regexp_replace(text, r"(https?://)([^@]+)@", "$1***@")
    for folder in LOCAL_FOLDERS:
        out = F.regexp_replace(out, folder, "<tmpdir>")
    return F.when(name.rlike(SECRET_NAME), "***REDACTED***").otherwise(out)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def size_label(kb: Column) -> Column:
    """KB as they are, MB with one and GB with two decimals."""
    mb, gb = kb / 1024.0, kb / 1048576.0
    return F.when(kb < 1024, F.concat(kb.cast("string"), F.lit(" KB"))).when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.2f GB", gb))


def since_label(seconds: Column) -> Column:
    """How long ago, in the largest whole unit."""
    units = [(60, 60, "m"), (3600, 24, "h"), (86400, 7, "d"), (604800, 4, "w"), (2592000, 12, "mo")]
    out = F.when(seconds < 60, "just now")
    for size, most, name in units:
        n = F.floor(seconds / size)
        out = out.when(n < most, F.concat(n.cast("string"), F.lit(f"{name} ago")))
    return out.otherwise(F.concat(F.floor(seconds / 31536000).cast("string"), F.lit("y ago")))


def range_is_eligible(first: Column, last: Column, least_days: int = 30) -> Column:
    return F.datediff(last, first) >= least_days


def promo_is_open(active: Column, expires: Column, used: Column, most: Column, now: Column) -> Column:
    """Active, unexpired, and below its maximum if it has one."""
    return active & (expires > now) & (most.isNull() | (used < most))


def candidate_repo(people: Column, recent: Column, least: int, most: int, score: float) -> Column:
    """Wide tolerance around the wanted number of people and recent commits; null counts fail."""
    enough = recent >= max(1, int(score * 13 * 0.5))
    return F.coalesce(people.between(max(1, least - 1), most * 3) & enough, F.lit(False))
