"""Which commits count: scope modes, cache modes, searches, pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """ALL_TIME, DATE_RANGE (first, last inclusive), SELECTED_YEARS (none: no rows) or LAST_N."""

    mode: str = "ALL_TIME"
    first: str | None = None
    last: str | None = None
    years: tuple[int, ...] = field(default_factory=tuple)
    n: int | None = None


def base(order_id: int | None = None) -> Column:
    """Rows of the base analysis. A null method is neither equal nor unequal to 'error', so such rows go."""
    kept = F.col("job_id").isNull() & (F.col("method") != "error")
    return kept if order_id is None else kept & (F.col("order_id") == order_id)


def predicate(scope: Scope) -> Column:
    if scope.mode == "DATE_RANGE" and scope.first and scope.last:
        return F.col("day").between(F.to_date(F.lit(scope.first)), F.to_date(F.lit(scope.last)))
    if scope.mode == "SELECTED_YEARS":
        years = F.lit(False)
        for y in scope.years:
            years = years | ((F.col("day") >= F.make_date(F.lit(y), F.lit(1), F.lit(1))) & (F.col("day") < F.make_date(F.lit(y + 1), F.lit(1), F.lit(1))))
        return years
    return F.lit(True)


def scoped(commits: DataFrame, scope: Scope, order_id: int | None = None, take: int | None = None) -> DataFrame:
    """Commits in scope; an explicit ``take`` replaces the N of LAST_N. Ties of a day are broken by sha."""
    rows = commits.where(base(order_id) & predicate(scope))
    n = take if take is not None else scope.n if scope.mode == "LAST_N" else None
    return rows if n is None else rows.orderBy(F.col("day").desc(), "sha").limit(n)


def scoped_count(commits: DataFrame, scope: Scope, order_id: int | None = None) -> DataFrame:
    counted = commits.where(base(order_id) & predicate(scope)).agg(F.count("*").alias("n"))
    return counted.select(F.least("n", F.lit(scope.n)).alias("n")) if scope.mode == "LAST_N" and scope.n else counted


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ are ordinary characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.col(c)).contains(text.lower())
    return found


SORTABLE = {"day": "day", "cents": "cents", "repo": "repo", "email": "email"}


def page(rows: DataFrame, sort: str, descending: bool, number: int, size: int, most: int = 100) -> DataFrame:
    """One page; unknown sort fields fall back to the day, sizes are clamped."""
    size = max(1, min(size, most))
    key = F.col(SORTABLE.get(sort, "day"))
    return rows.orderBy(key.desc() if descending else key.asc(), "sha").offset((max(1, number) - 1) * size).limit(size)


def newest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, by a map-side combined aggregate: no window over hot keys.

    ``order`` columns ascending; negate numbers and days for newest first.
    """
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *rest)
    best = rows.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def reusable_estimates(wanted: DataFrame, all_rows: DataFrame, order_id: int, cache: str = "any", model: str | None = None) -> DataFrame:
    """Newest earlier estimate of the same repo and commit in another order; cache: any, model (exact) or off."""
    if cache == "off":
        return all_rows.where(F.lit(False)).select("repo", "dup_sha", "cents", "sha")
    rows = all_rows.where(base() & (F.col("order_id") != order_id))
    if cache == "model":
        rows = rows.where(F.col("model") == model)
    rows = rows.join(wanted.select("repo", "dup_sha").distinct(), ["repo", "dup_sha"], "left_semi")
    return newest_per(rows.select("repo", "dup_sha", "day", "cents", "sha"), ["repo", "dup_sha"], [-F.unix_date("day"), F.col("sha")]).select(
        "repo", "dup_sha", "cents", "sha"
    )


def reusable_by_user(wanted: DataFrame, all_rows: DataFrame, users: DataFrame, model: str | None = None) -> DataFrame:
    """Per commit of each order the newest estimate that a completed other order of the same user has: order_id, repo, dup_sha, cents, sha, from_order.

    ``users`` has order_id, user_id and status; with ``model`` only estimates of that model count.
    Estimates are cut to the newest of each order before they meet the orders that want them.
    """
    rows = all_rows.where(base())
    if model is not None:
        rows = rows.where(F.col("model") == model)
    newest = newest_per(rows.select("order_id", "repo", "dup_sha", "day", "cents", "sha"), ["order_id", "repo", "dup_sha"], [-F.unix_date("day"), F.col("sha")])
    done = users.where("status = 'COMPLETED'").select("order_id", "user_id")
    held = newest.join(done, "order_id").withColumnRenamed("order_id", "from_order")
    asked = wanted.select("order_id", "repo", "dup_sha").distinct().join(users.select("order_id", "user_id"), "order_id")
    met = asked.join(held, ["user_id", "repo", "dup_sha"]).where("from_order <> order_id").drop("user_id")
    return newest_per(met, ["order_id", "repo", "dup_sha"], [-F.unix_date("day"), F.col("sha"), F.col("from_order")]).select("order_id", "repo", "dup_sha", "cents", "sha", "from_order")
