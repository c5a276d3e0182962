"""Buckets of a day series: timelines, grouping sets, filled gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens.functions.scalars import is_weekday, period_key


def buckets(days: DataFrame, unit: str) -> DataFrame:
    """days (email, day, cents) -> period, cents, developer days, distinct days."""
    return (
        days.groupBy(period_key(F.col("day"), unit).alias("period"), "email", "day")
        .agg(F.sum("cents").alias("cents"))
        .groupBy("period")
        .agg(F.sum("cents").alias("cents"), F.count("*").alias("developer_days"), F.countDistinct("day").alias("days"))
    )


def effort_buckets(rows: DataFrame, everyone: DataFrame, unit: str) -> DataFrame:
    """rows (email, day, placed, overhead), everyone (email) -> per period placed, overhead and total cents, averages a day by the active and by all.

    By the active: over developer-days; by all: over distinct days times everyone. Whole cents, halves up.
    """
    days = rows.groupBy(period_key(F.col("day"), unit).alias("period"), "email", "day").agg(F.sum("placed").alias("placed"), F.sum("overhead").alias("overhead"))
    sums = days.groupBy("period").agg(
        F.sum("placed").alias("placed_cents"),
        F.sum("overhead").alias("overhead_cents"),
        F.count("*").alias("developer_days"),
        F.countDistinct("day").alias("days"),
        F.countDistinct("email").alias("active"),
    )
    sums = sums.crossJoin(F.broadcast(everyone.agg(F.countDistinct("email").alias("selected"))))  # one row
    total, active = F.col("placed_cents") + F.col("overhead_cents"), F.col("developer_days")
    whole = lambda x, n: F.floor(x / n + 0.5).cast("long")
    return sums.withColumns(
        {
            "total_cents": total,
            "avg_placed_by_active": whole(F.col("placed_cents"), active),
            "avg_overhead_by_active": whole(F.col("overhead_cents"), active),
            "avg_by_active": whole(total, active),
            "avg_by_all": whole(total, F.col("days") * F.col("selected")),
        }
    )


def four_grains(days: DataFrame) -> DataFrame:
    """email, y, m, q, cents: all time, year, month and quarter sums of one pass (grouping sets)."""
    rows = days.select("email", F.year("day").alias("y"), F.month("day").alias("m"), F.quarter("day").alias("q"), "cents")
    e, y, m, q = (F.col(c) for c in ("email", "y", "m", "q"))
    return rows.groupingSets([[e], [e, y], [e, y, m], [e, y, q]], e, y, m, q).agg(F.sum("cents").alias("cents"))


def filled_gaps(days: DataFrame, most: int = 3) -> DataFrame:
    """email, day: the weekdays between two active days that are at most ``most`` weekdays apart."""
    active = days.select("email", "day").distinct()
    rows = active.withColumn("next", F.lead("day").over(Window.partitionBy("email").orderBy("day")))
    between = F.filter(F.sequence(F.date_add("day", 1), F.date_sub("next", 1)), lambda d: is_weekday(d))
    rows = rows.where(F.datediff("next", "day").between(2, 2 * most + 7)).withColumn("gap", between)
    return rows.where((F.size("gap") > 0) & (F.size("gap") <= most)).select("email", F.explode("gap").alias("day"))


def chart_gaps(days: DataFrame, most: int = 3) -> DataFrame:
    """email, day: every day, weekends too, between two active days that have at most ``most`` weekdays between them."""
    active = days.select("email", "day").distinct()
    rows = active.withColumn("next", F.lead("day").over(Window.partitionBy("email").orderBy("day")))
    rows = rows.where(F.datediff("next", "day").between(2, 2 * most + 7)).withColumn("gap", F.sequence(F.date_add("day", 1), F.date_sub("next", 1)))
    return rows.where(F.size(F.filter("gap", is_weekday)) <= most).select("email", F.explode("gap").alias("day"))
