"""Estimates of runs against truth and against each other: summaries, wins, ranks, matrices, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortlens.operators.accuracy import pearson, with_percentiles
from effortlens.storage import checkpointed

SIZES = ("small", "medium", "large")


def size_bucket(n_files: Column) -> Column:
    return F.when(n_files <= 7, SIZES[0]).when(n_files <= 15, SIZES[1]).otherwise(SIZES[2])


def accuracy_summary(rows: DataFrame, by: list[str], estimate: str = "estimate") -> DataFrame:
    """rows (estimate, low, high) -> per group: n, mape, median_ape, mae, in_range, in_range_percent, bias, of rows with an estimate.

    Errors are taken from the middle of the range; a middle of 0 counts as no error in percent.
    """
    e, mid = F.col("e"), (F.col("low") + F.col("high")) / 2
    share = F.when(mid > 0, (e - mid) / mid).otherwise(0.0)
    inside = e.between(F.col("low"), F.col("high"))
    rows = rows.select(*by, F.col(estimate).alias("e"), "low", "high").where(e.isNotNull())
    rows = checkpointed(rows.select(*by, share.alias("share"), F.abs(e - mid).alias("off"), inside.alias("inside")).withColumn("ape", F.abs("share") * 100))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("ape").alias("mape"),
        F.avg("off").alias("mae"),
        F.count_if("inside").alias("in_range"),
        (F.count_if("inside") / F.count("*") * 100).alias("in_range_percent"),
        (F.avg("share") * 100).alias("bias"),
    )
    return with_percentiles(sums, rows, by, "ape", {"median_ape": 0.5})


def head_to_head(rows: DataFrame, a: str = "est_a", b: str = "est_b") -> DataFrame:
    """Wins of two variants by percent error, and ties, over rows that have both."""
    mid = (F.col("low") + F.col("high")) / 2
    x, y = F.abs(F.col(a) - mid) / mid, F.abs(F.col(b) - mid) / mid
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count_if(x < y).alias("a_wins"), F.count_if(y < x).alias("b_wins"), F.count_if(x == y).alias("ties"))


def ranked_variants(rows: DataFrame, variants: list[str]) -> DataFrame:
    """Variants (columns of estimates) by mean percent error: rank, variant, n, mape."""
    long = rows.unpivot(["low", "high"], variants, "variant", "estimate")
    found = accuracy_summary(long, ["variant"]).select("variant", "n", "mape")
    return found.withColumn("rank", F.row_number().over(Window.orderBy("mape", "variant")))  # a row a variant


def model_summary(rows: DataFrame) -> DataFrame:
    """Per model, errors left out: n, within_2x, mean signed error, over, under, whole means of tokens and milliseconds."""
    e, mid = F.col("estimate"), (F.col("low") + F.col("high")) / 2
    return rows.where("method IS NULL OR method <> 'error'").groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if((e <= 2 * F.col("high")) & (e >= 0.5 * F.col("low"))).alias("within_2x"),
        F.avg(e - mid).alias("signed_error"),
        F.count_if(e > mid).alias("over"),
        F.count_if(e < mid).alias("under"),
        F.avg("tokens").cast("int").alias("tokens"),
        F.avg("millis").cast("int").alias("millis"),
    )


def last_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is last by ``order``, as an aggregate with map-side combining."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*")


def compare_runs(base: DataFrame, bench: DataFrame) -> DataFrame:
    """base and bench (sha, cents, category; one row a sha) -> matched, mae, totals, correlation, percent of equal categories.

    The correlation is null below three rows and 0 where one side does not vary; null categories are equal.
    """
    other = bench.select("sha", F.col("cents").alias("b_cents"), F.col("category").alias("b_category"))
    both = base.join(other, "sha")
    x, y = F.col("cents").cast("double"), F.col("b_cents").cast("double")
    same = F.count_if(F.col("category").eqNullSafe(F.col("b_category")))
    return both.agg(
        F.count("*").alias("matched"),
        F.avg(F.abs(y - x)).alias("mae"),
        F.sum("cents").alias("total_base"),
        F.sum("b_cents").alias("total_bench"),
        F.when(F.count("*") >= 3, F.coalesce(pearson(x, y), F.lit(0.0))).alias("r"),
        F.try_divide(same * 100.0, F.count("*")).alias("same_category_percent"),
    )


def outliers(base: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """The rows of two runs that differ most."""
    other = bench.select("sha", F.col("cents").alias("b_cents"))
    rows = base.join(other, "sha").select("sha", "cents", "b_cents", (F.col("b_cents") - F.col("cents")).alias("delta"))
    return rows.orderBy(F.abs("delta").desc(), "sha").limit(n)


def run_spread(estimates: DataFrame) -> DataFrame:
    """estimates (sha, config, run, cents) -> sha, sigma: population deviation over runs of one configuration, averaged over those that ran twice or more."""
    groups = estimates.where("config IS NOT NULL AND cents IS NOT NULL").groupBy("sha", "config").agg(F.stddev_pop("cents").alias("s"), F.count("*").alias("n"))
    return groups.where("n >= 2").groupBy("sha").agg(F.avg("s").alias("sigma"))


def estimate_matrix(estimates: DataFrame, order: list[Column]) -> DataFrame:
    """sha, estimates (map of run to cents); of several rows of one run the last by ``order`` counts."""
    cells = last_per(estimates, ["sha", "run"], order)
    entries = F.array_sort(F.collect_list(F.struct("run", "cents")))
    return cells.groupBy("sha").agg(F.map_from_entries(entries).alias("estimates"))


def numbered_runs(runs: DataFrame) -> DataFrame:
    """runs (model, run, created) with their number among those of their model, from 1, and whether they are its latest."""
    w = Window.partitionBy("model")
    number = F.row_number().over(w.orderBy("created", "run"))
    return runs.withColumns({"number": number, "is_latest": number == F.count("*").over(w)})


def truth_problems(truth: DataFrame, known: DataFrame) -> DataFrame:
    """truth (sha, author, hours) with problem: unknown_sha, bad_author, bad_hours, or null; and warn over 48 hours."""
    seen = known.select("sha").distinct().withColumn("known", F.lit(True))
    name = F.trim(F.coalesce("author", F.lit("")))
    problem = (
        F.when(F.col("known").isNull(), "unknown_sha")
        .when((F.char_length(name) == 0) | (F.char_length(name) > 64), "bad_author")
        .when(F.col("hours").isNull() | (F.col("hours") < 0), "bad_hours")
    )
    rows = truth.join(seen, "sha", "left").withColumns({"problem": problem, "warn": F.coalesce(F.col("hours") > 48, F.lit(False))})
    return rows.drop("known")


def metric_gate(samples: DataFrame, required: DataFrame, least: int) -> DataFrame:
    """required (metric) with n samples and whether there are enough: the gate of a valid baseline."""
    counted = samples.groupBy("metric").agg(F.count("value").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return required.join(counted, "metric", "left").select("metric", n.alias("n"), (n >= least).alias("enough"))


def report_metrics(samples: DataFrame) -> DataFrame:
    """samples (report, metric, value) -> per metric: n, n_reports (that name it), lo, hi, mean, per_report (samples a report)."""
    sums = samples.groupBy("metric").agg(
        F.count("value").alias("n"), F.count_distinct("report").alias("n_reports"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")
    )
    return sums.withColumn("per_report", F.col("n") / F.col("n_reports"))
