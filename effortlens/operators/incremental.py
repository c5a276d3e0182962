"""A table of developer metrics kept in buckets of developers, of which a change rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.functions.scalars import auto_share, ratio
from effortlens.storage import checkpointed

BUCKETS = 64


def bucket_of(email: Column, n: int = BUCKETS) -> Column:
    return (F.crc32(email) % n).cast("int")


def write_metrics(metrics: DataFrame, path: str, n: int = BUCKETS) -> None:
    """Metrics (email, ...) as a table partitioned by bucket."""
    metrics.withColumn("bucket", bucket_of(F.col("email"), n)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, with the columns of ``schema``; a table without a row has no file to learn them from."""
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def replace_rows(stored: DataFrame, changed: DataFrame, path: str, n: int = BUCKETS) -> None:
    """Put ``changed`` (whole rows) in place of the stored rows of their e-mails; buckets without a changed row are not written.

    New rows are written to the shared folder first, as the table is read while they are made.
    """
    rows = changed.withColumn("bucket", bucket_of(F.col("email"), n))
    touched = rows.select("bucket").distinct()  # at most n rows
    kept = stored.join(F.broadcast(touched), "bucket", "left_semi").join(rows.select("email"), "email", "left_anti")
    made = checkpointed(kept.select(stored.columns).unionByName(rows.select(stored.columns)).repartition("bucket"))
    made.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def change_shares(stored: DataFrame, changes: DataFrame, path: str, n: int = BUCKETS) -> None:
    """changes (email, share; null: automatic) applied to the stored metrics of those developers alone.

    An automatic share is the developer's part of all commits; ratios that rest on the share are made
    anew, all else is kept. E-mails without metrics change nothing.
    """
    asked = changes.groupBy("email").agg(F.max("share").alias("_share"))
    # the buckets of the changes are read, not the others
    numbers = [r[0] for r in asked.select(bucket_of(F.col("email"), n)).distinct().collect()]  # at most n
    total = stored.agg(F.sum("n_commits").alias("_all"))  # one row, one column read
    rows = stored.where(F.col("bucket").isin(numbers)).join(asked, "email").crossJoin(F.broadcast(total))
    share = F.coalesce("_share", auto_share(F.col("n_commits"), F.col("_all")))
    changed = rows.withColumns({"share": share, "ratio_adjusted": ratio(F.col("total_cents"), F.col("fte_days"), share)})
    replace_rows(stored, changed.select([c for c in stored.columns if c != "bucket"]), path, n)


def without(commits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Commits but for those of flagged developers."""
    return commits.join(excluded.select("email").distinct(), "email", "left_anti")
