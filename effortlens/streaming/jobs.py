"""Job events as a stream: incremental reading, live totals, step states, liveness, windows.

The product this engine follows polls tables; these are the same answers kept up to date by Structured
Streaming. Windowed counts and deduplication with a watermark are extensions of ours. Everything runs
with ``availableNow``, so that a scheduled run takes what is new since the last and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.storage import new_path


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """event_id, ts, job_id, code, value of a folder or file of Parquet, read as it grows."""
    schema = spark.read.parquet(path).schema
    # the source takes folders or patterns, so a last letter in brackets stands for itself
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), F.col("event_type").alias("code"), "value")


def appended(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """What the stream has appended to a table in the shared folder, after all that is there has been read."""
    folder = folder or new_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest(stream: DataFrame, name: str) -> DataFrame:
    """The whole result of an aggregate after all that is there has been read.

    Each batch writes its result to a folder of its own, so a repeated batch after a failure replaces itself.
    """
    folder = new_path(stream.sparkSession, name)
    last = [0]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        last[0] = number

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch-{last[0]}")


def newer_than(stream: DataFrame, cursor: int) -> DataFrame:
    """Events after a cursor: the incremental poll."""
    return stream.where(F.col("event_id") > cursor)


def leaderboard(stream: DataFrame) -> DataFrame:
    """Per job: events, total of their values in whole cents, last event."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return stream.groupBy("job_id").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max("event_id").alias("last_event"))


def furthest_step(stream: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Per job: the index of the furthest step that has come, and how many of the steps have."""
    index = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("code")) - 1
    came = [F.max(F.when(F.col("code") == s, 1).otherwise(0)) for s in steps]
    return stream.where(F.col("code").isin(*steps)).groupBy("job_id").agg(F.max(index).alias("furthest"), sum(came[1:], came[0]).alias("n_steps"))


def liveness(stream: DataFrame, now: Column, stale_after: int) -> DataFrame:
    """Per job: its last heartbeat (seconds), and whether it is too old."""
    beats = stream.groupBy("job_id").agg(F.max(F.unix_seconds("ts")).alias("heartbeat"))
    return beats.withColumn("stale", now - F.col("heartbeat") > stale_after)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by code in tumbling windows; a window's state may go once it is older than the watermark. In complete mode, as ``latest`` runs it, every window is kept and late events count."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "code").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "code", "n")


def seen_once(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without those whose id has been seen within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
