"""Isotonic calibration per scope: pool adjacent violators, in ranges that are merged.

Estimates are summed up by (scope, estimate) first, so a scope has as many rows as different
estimates. The rows are cut into ranges; each range pools its own violators, and only the blocks that
are left travel on. Pooling gives one result in whatever order violators are pooled, so neighbouring
ranges are then put together in pairs, and pooled again, until no edge between ranges violates the
order. Blocks are pooled exactly, on sums of whole cents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens.storage import checkpointed

_FIELDS = ["low", "high", "total", "weight"]
_BLOCK = ", ".join(f"{c} long" for c in _FIELDS)


def pool(blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(low, high, total, weight) in order of low -> the same with means that never fall."""
    out: list[tuple[int, int, int, int]] = []
    for low, high, total, weight in blocks:
        while out and out[-1][2] * weight >= total * out[-1][3]:
            a = out.pop()
            low, total, weight = a[0], a[2] + total, a[3] + weight
        out.append((low, high, total, weight))
    return out


def _pooled(*keys: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of a partition, in order of keys and low -> pooled within each key; batches may end anywhere."""
        rows: dict[tuple, list] = {}
        for part in parts:
            for row in part[[*keys, *_FIELDS]].itertuples(index=False, name=None):
                found = rows.setdefault(row[: len(keys)], [])
                found.append(tuple(map(int, row[len(keys) :])))
                if len(found) % 4096 == 0:
                    found[:] = pool(found)
        for key, found in rows.items():
            yield pd.DataFrame([(*key, *b) for b in pool(found)], columns=[*keys, *_FIELDS])

    return run


def fit(rows: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """rows (scope, estimate, truth, whole cents; nulls are left out) -> blocks scope, low, high, total, weight.

    The calibrated value of an estimate from low to high is total / weight.
    """
    sums = rows.where("scope IS NOT NULL AND estimate IS NOT NULL AND truth IS NOT NULL").groupBy("scope", F.col("estimate").alias("low"))
    sums = sums.agg(F.col("low").alias("high"), F.sum("truth").alias("total"), F.count("*").alias("weight"))
    spread = sums.repartitionByRange("scope", "low") if n_ranges is None else sums.repartitionByRange(n_ranges, "scope", "low")
    blocks = checkpointed(spread.sortWithinPartitions("scope", "low").mapInPandas(_pooled("scope"), f"scope string, {_BLOCK}").withColumn("part", F.spark_partition_id()))
    while True:
        # one row a range and scope
        ends = blocks.groupBy("scope", "part").agg(F.min(F.struct("low", "total", "weight")).alias("a"), F.max(F.struct("low", "total", "weight")).alias("b"))
        before = F.lag("b").over(Window.partitionBy("scope").orderBy("part"))
        edges = ends.withColumn("e", before).where("e IS NOT NULL AND e.total * a.weight >= a.total * e.weight")
        if edges.isEmpty():
            return blocks.drop("part")
        halved = blocks.withColumn("part", F.floor(F.col("part") / 2).cast("int"))
        again = halved.repartition("scope", "part").sortWithinPartitions("scope", "part", "low")
        blocks = checkpointed(again.mapInPandas(_pooled("scope", "part"), f"scope string, part int, {_BLOCK}"))


def calibrated(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (scope, estimate, ...) with ``calibrated``: the value of the estimate's block; between blocks in proportion, beyond them the nearest.

    Different estimates and blocks of a scope are put in one order, and each estimate takes the last
    block that begins at or below it; a null estimate and one of a scope without blocks get null.
    """
    steps = Window.partitionBy("scope").orderBy("low")
    value = F.col("total") / F.col("weight")
    table = blocks.select("scope", "low", "high", value.alias("value"), F.lead("low").over(steps).alias("next_low"), F.lead(value).over(steps).alias("next_value"))
    # rows and blocks in one order: a row takes the last block before it, or the first after it
    wanted = rows.select("scope", "estimate").where("estimate IS NOT NULL").distinct()
    both = wanted.select("scope", F.col("estimate").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<low: long, high: long, value: double, next_low: long, next_value: double>").alias("b"))
    both = both.unionByName(table.select("scope", F.col("low").alias("at"), F.lit(0).alias("kind"), F.struct("low", "high", "value", "next_low", "next_value").alias("b")))
    order = Window.partitionBy("scope").orderBy("at", "kind")
    found = both.withColumn("before", F.last("b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("after", F.first("b", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("kind = 1")
    x, b = F.col("at"), F.col("before")
    between = b["value"] + (x - b["high"]) / (b["next_low"] - b["high"]) * (b["next_value"] - b["value"])
    inside = F.when(b.isNull(), F.col("after.value")).when((x <= b["high"]) | b["next_low"].isNull(), b["value"]).otherwise(between)
    values = found.select(F.col("scope").alias("_scope"), F.col("at").alias("_at"), inside.alias("calibrated"))
    met = rows.join(values, F.col("scope").eqNullSafe(F.col("_scope")) & F.col("estimate").eqNullSafe(F.col("_at")), "left")
    return met.drop("_scope", "_at")
