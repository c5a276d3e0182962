"""How good estimates are: consensus, errors, correlation, percentiles, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.storage import checkpointed


def consensus(truth: DataFrame) -> DataFrame:
    """sha, cents: the median over authors, the mean of the middle two if there are two."""
    return truth.groupBy("sha").agg(F.median("cents").alias("cents"))


#: Up to so many whole numbers have a median that follows from their number, sum, least and largest.
_FEW = 4


def estimates(truth: DataFrame) -> DataFrame:
    """sha, n, total, lo, hi of its estimates: what ``with_consensus`` takes medians from, in sums of fixed size."""
    c = F.col("cents")
    return truth.groupBy("sha").agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("lo"), F.max(c).alias("hi"))


def with_consensus(rows: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    """``rows``, stored, with the columns of ``estimates``: ``name``, the consensus of whole cents, in their place.

    The estimates themselves are read again for shas only that have more than four.
    """
    n, middle = F.col("n"), F.col("total") - F.col("lo") - F.col("hi")
    few = F.when(n == 1, F.col("total").cast("double")).when(n == 2, F.col("total") / 2).when(n == 3, middle.cast("double")).when(n == _FEW, middle / 2)
    many = rows.where(n > _FEW)
    if many.isEmpty():
        found = rows.withColumn(name, few)
    else:
        medians = consensus(truth.join(many.select("sha").distinct(), "sha", "left_semi")).withColumnRenamed("cents", "_median")
        found = rows.join(medians, "sha", "left").withColumn(name, F.coalesce(few, "_median")).drop("_median")
    return found.drop("n", "total", "lo", "hi")


def pearson(x: Column, y: Column) -> Column:
    """Null on zero variance, where corr raises."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Error of rank of the sketches, as a share of a group, and twice that and more to both sides of a wanted rank.
_ACCURACY, _MARGIN = 10_000, 0.0005
#: Groups up to this size are ranked as they are; above it a rank is far below the margin.
_SMALL = 20_000
#: Up to so many groups their brackets go to every task; values of more groups spread by themselves.
_FEW_GROUPS = 2_000


def percentiles(values: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by and a column a share: the exact interpolated percentile of each group, nulls and NaN left out.

    A sketch of bounded size brackets each percentile; values below a bracket are only counted, and
    the values inside, a thousandth of a group, are ranked as (value, count). So no task holds a group.
    Groups without values are absent (without ``by``: one row of nulls). ``values`` is read three times.
    """
    from pyspark.sql import Window

    rows = values.select(*by, F.col(column).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    ends = [min(max(p + side, 0.0), 1.0) for p in shares.values() for side in (-_MARGIN, _MARGIN)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile_approx("value", ends, _ACCURACY).alias("cuts"))
    few = F.col("n") <= _SMALL
    bracket = lambda i, p: F.struct(
        F.when(few, F.col("lo")).otherwise(F.get("cuts", F.lit(2 * i))).alias("lo"),
        F.when(few, F.col("hi")).otherwise(F.get("cuts", F.lit(2 * i + 1))).alias("hi"),
        ((F.col("n") - 1) * p).alias("at"),
    )
    # Kept, so that counts below and ranks inside are of the same brackets if a task runs again.
    brackets = checkpointed(sketch.select(*by, F.array(*[bracket(i, p) for i, p in enumerate(shares.values())]).alias("brackets")))
    # A group of few may be most of the rows: there its values stay where they are and meet its bracket without a shuffle.
    if by and brackets.limit(_FEW_GROUPS + 1).count() <= _FEW_GROUPS:
        brackets = F.broadcast(brackets)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        if not by:
            return left.crossJoin(F.broadcast(right))  # one row
        named = right.withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        return left.join(named, same).drop(*[f"_{c}" for c in by])

    n = range(len(shares))
    seen = met(rows, brackets)
    below = seen.groupBy(*by).agg(F.array(*[F.count_if(F.col("value") < F.col("brackets")[i]["lo"]) for i in n]).alias("below"))
    inside = seen.where(F.exists("brackets", lambda b: F.col("value").between(b["lo"], b["hi"]))).groupBy(*by, "value").agg(F.count("*").alias("c"))
    ranked = met(met(inside, brackets), below).select(*by, "value", "c", "below", F.posexplode("brackets").alias("share", "b")).where(F.col("value").between(F.col("b.lo"), F.col("b.hi")))
    upto = F.get("below", F.col("share")) + F.sum("c").over(Window.partitionBy(*by, "share").orderBy("value"))
    ranked = ranked.withColumn("upto", upto)
    found = []
    for i, name in enumerate(shares):
        at = F.max(F.when(F.col("share") == i, F.col("b.at")))
        lower = F.min(F.when((F.col("share") == i) & (F.col("upto") > F.floor("b.at")), F.col("value")))
        upper = F.min(F.when((F.col("share") == i) & (F.col("upto") > F.ceil("b.at")), F.col("value")))
        found.append((lower + (upper - lower) * (at - F.floor(at))).alias(name))
    return ranked.groupBy(*by).agg(*found)


def errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (estimate, truth) -> n, mean absolute error, Pearson r (from three rows on), mean and median percent error.

    Groups may be few and large, so the median is that of ``percentiles``; the pairs are stored for it.
    """
    ape = F.try_divide(F.abs(F.col("estimate") - F.col("truth")) * 100.0, F.col("truth"))
    pairs = checkpointed(pairs.select(*by, "estimate", "truth", ape.alias("ape")))
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("estimate") - F.col("truth"))).alias("mae"),
        F.when(F.count("*") >= 3, pearson(F.col("estimate"), F.col("truth"))).alias("r"),
        F.avg("ape").alias("mape"),
    )
    return with_percentiles(sums, pairs, by, "ape", {"median_ape": 0.5})


def with_percentiles(sums: DataFrame, values: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """sums with the ``percentiles`` of its groups, null where a group has no values."""
    found = percentiles(values, by, column, shares)
    if not by:
        return sums.crossJoin(F.broadcast(found))  # one row
    found = found.withColumnsRenamed({c: f"_{c}" for c in by})
    return sums.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def nearest_rank(values: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Value at index floor(n * p) of the sorted values, not interpolated.

    Ranks are taken over (value, count) pairs, so a group's rows never meet in one array.
    """
    from pyspark.sql import Window

    counted = values.groupBy(*by, column).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(column))
    total = F.sum("c").over(Window.partitionBy(*by))
    ranked = counted.withColumns({"upto": upto, "n": total})
    return ranked.groupBy(*by).agg(
        *[F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(column))).alias(name) for name, p in shares.items()]
    )


def churn_entropy(files: DataFrame, by: str) -> DataFrame:
    """files (by, churn) -> Shannon entropy of churn in bits and the number of files."""
    sums = files.groupBy(by).agg(F.sum("churn").alias("total"))
    p = F.col("churn") / F.col("total")
    return files.where("churn > 0").join(sums, by).groupBy(by).agg(F.sum(-p * F.log2(p)).alias("entropy"), F.count("*").alias("n_files"))
