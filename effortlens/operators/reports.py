"""Roll-ups of orders, people, teams, usage and health, and the listings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortlens.functions import scalars


def total_pages(n_rows: Column, size: int, most: int = 100) -> Column:
    return F.ceil(n_rows / min(max(size, 1), most)).cast("long")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Groups are cut before the shuffle: Spark limits ranks inside each partition first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children, 0 if there are none."""
    counted = children.groupBy(key).agg(F.count("*").alias("n_children"))
    return parents.join(counted, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def within(rows: DataFrame, key: str, allowed: DataFrame | None) -> DataFrame:
    """Rows whose key is allowed; None allows all, an empty frame none."""
    return rows if allowed is None else rows.join(allowed.select(key).distinct(), key, "left_semi")


def preview_totals(wanted: DataFrame, hits: DataFrame, keys: list[str], most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """total, cached and billable commits, in all or for each ``by``; ``most`` caps the total."""
    by = by or []
    marked = wanted.select(*by, *keys).distinct().join(hits.select(*by, *keys).distinct().withColumn("hit", F.lit(1)), [*by, *keys], "left")
    total = F.count("*") if most is None else F.least(F.count("*"), F.lit(most))
    counted = marked.groupBy(*by).agg(total.alias("total"), F.count("hit").alias("cached"))
    return counted.withColumn("billable", F.greatest(F.lit(0), F.col("total") - F.col("cached")))


def weekly_activity(rows: DataFrame, by: list[str], as_of: Column, weeks: int = 12) -> DataFrame:
    """Per group: score (mean commits a week over the last ``weeks``), active weeks, commits, full_time (60 % of the weeks and 20 commits)."""
    age = F.floor(F.datediff(as_of, "day") / 7)
    recent = rows.where((F.datediff(as_of, "day") >= 0) & (age < weeks)).withColumn("week", age)
    counted = recent.groupBy(*by).agg(F.count("*").alias("commits"), F.countDistinct("week").alias("active_weeks"))
    full = (F.col("active_weeks") / weeks >= 0.6) & (F.col("commits") >= 20)
    return counted.withColumns({"score": F.col("commits") / weeks, "full_time": full})


def usage(calls: DataFrame, by: list[str], price_per_million: float) -> DataFrame:
    """calls (provider, tokens, millis) -> calls, tokens, millis and cost; an absent provider is ``unknown``."""
    named = calls.withColumn("provider", F.coalesce("provider", F.lit("unknown")))
    sums = named.groupBy(*by).agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("millis"), F.lit(0)).alias("millis"))
    return sums.withColumn("cost", F.col("tokens") / 1e6 * price_per_million)


def steps_of_jobs(events: DataFrame, steps: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """events (job_id, event_id, code) -> job_id and for each step pass, warn or null: by a code that passes it, else by one that warns."""
    came = lambda codes: F.max(F.col("code").isin(*codes)) if codes else F.lit(False)
    return events.groupBy("job_id").agg(*[F.when(came(ok), "pass").when(came(warn), "warn").alias(name) for name, (ok, warn) in steps.items()])


def missing_steps(steps: list[str], age: Column, old_after: int = 180) -> Column:
    """Of a job that is ``old_after`` seconds old, the steps up to the one after the furthest that are not done."""
    done = F.array(*[F.col(s).isNotNull() for s in steps])
    furthest = F.coalesce(F.array_max(F.transform(done, lambda x, i: F.when(x, i))), F.lit(-1))
    found = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("i"), F.col(s).isNull().alias("gone")) for i, s in enumerate(steps)]), lambda x: x["gone"] & (x["i"] <= furthest + 1))
    return F.when(age >= old_after, F.transform(found, lambda x: x["s"])).otherwise(F.array().cast("array<string>"))


def stuck_jobs(jobs: DataFrame, last_events: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Jobs that hang, with why: jobs (job_id, status, updated, heartbeat, created in seconds), last_events (job_id, level), states of ``steps_of_jobs``.

    The first two steps are the trigger that was accepted and the worker that took the job. A job that
    was never updated counts from its creation.
    """
    steps = [c for c in states.columns if c != "job_id"]
    joined = jobs.join(last_events, "job_id", "left").join(states, "job_id", "left")
    age = now - F.col("created")
    idle = F.coalesce(now - F.col("updated"), age)
    reasons = F.array_compact(
        F.array(
            F.when((F.col("status") == "PENDING") & (idle > 120), "pending_too_long"),
            F.when(F.col(steps[0]).isNotNull() & F.col(steps[1]).isNull() & (idle > 120), "accepted_without_worker"),
            F.when((F.col("status") == "RUNNING") & (F.coalesce(now - F.col("heartbeat"), age) > 600), "heartbeat_stale"),
            F.when((F.col("status") == "LLM_COMPLETE") & (idle > 300), "post_processing_stale"),
            F.when(F.col("level") == "error", "error_event"),
            F.when(F.size(missing_steps(steps, age)) > 0, "missing_step"),
        )
    )
    return joined.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("job_id", "reasons")


def stacked(points: DataFrame, bin_col: str, order: list[str]) -> DataFrame:
    """Points of one bin side by side: offset 0, 1, -1, 2, -2 and so on, in the order given."""
    k = F.row_number().over(Window.partitionBy(bin_col).orderBy(*order)) - 1
    half = F.ceil(k / 2)
    return points.withColumn("offset", F.when(k % 2 == 1, half).otherwise(-half).cast("long"))


def step_states(steps: tuple[str, ...], events: DataFrame, now: Column, patience: int = 180) -> DataFrame:
    """job_id, step, index, state: done, pending (not yet due) or missing.

    ``steps`` are named in order; events are (job_id, step, second), a row an event. A step that has not
    come is pending if it lies beyond the furthest one that has or the job is young, else missing.
    """
    came = events.groupBy("job_id").agg(F.min("second").alias("began"), F.collect_set("step").alias("done"))
    reached = F.array_max(F.transform("done", lambda s: F.array_position(F.array(*[F.lit(x) for x in steps]), s) - 1))
    rows = came.select("job_id", "began", "done", reached.alias("reached"), F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("index", "step"))
    young = now - F.col("began") < patience
    state = F.when(F.array_contains("done", F.col("step")), "done").when(young | (F.col("index") > F.col("reached")), "pending").otherwise("missing")
    return rows.select("job_id", "step", "index", state.alias("state"))


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target and those rows whose key it has not, one a key: an insert that skips duplicates."""
    matches = [rows[k].eqNullSafe(target[k]) for k in keys]
    return target.unionByName(rows.dropDuplicates(keys).join(target, matches, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str, forward: tuple[str, ...] = ()) -> DataFrame:
    """Target with rows inserted or put in place of those of equal key (nulls are equal), the latest by ``order`` if several.

    Columns in ``forward`` never go back: the larger of old and new is kept.
    """
    others = [c for c in target.columns if c not in keys]
    kept = [F.max(c).alias(c) for c in forward]
    last = F.max_by(F.struct(*[c for c in others if c not in forward]), F.struct("_new", order)).alias("_row")
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(last, *kept).select(*keys, "_row.*", *forward).select(*target.columns)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Target without the rows that meet the condition; rows where it is null stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def copied(rows: DataFrame, **values) -> DataFrame:
    """Rows with some columns set anew, to be appended under another owner."""
    return rows.withColumns({c: F.lit(v) for c, v in values.items()})


def first_wins(rows: DataFrame, name: str, position: str) -> DataFrame:
    """One row a name, ignoring case: the first by position."""
    others = [c for c in rows.columns]
    return rows.groupBy(F.lower(name).alias("_key")).agg(F.min_by(F.struct(*others), position).alias("_row")).select("_row.*")
