"""Canonical frames of the engine, built from the star-schema tables; columns are pruned to what a query reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, dup_sha (the sha that copies of a commit share), order_id, repo, email, day, cents, category, complexity, method, job_id, model."""
    t = F.floor(F.col("l_tax") * 100 + 0.5).cast("int")
    method = F.when(t == 1, "error").when(t == 2, "FD_v3").when(t == 3, "root_commit").when(t >= 4, "two_pass")
    return table(spark, sf_dir, "lineitem").select(
        F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("sha"),
        F.md5(F.concat_ws(":", "l_partkey", "l_linenumber")).alias("dup_sha"),
        (F.col("l_orderkey") % 10).alias("order_id"),
        F.concat(F.lit("org/repo"), (F.col("l_partkey") % 20).cast("string")).alias("repo"),
        dev_email(F.col("l_suppkey")).alias("email"),
        F.to_date("l_shipdate").alias("day"),
        F.floor(F.col("l_quantity") * 10 + 0.5).cast("long").alias("cents"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("complexity"),
        method.alias("method"),  # null where the tax is 0
        F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("job"), (F.col("l_orderkey") % 3).cast("string"))).alias("job_id"),
        F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string"))).alias("model"),
    )


def dev_email(key: Column) -> Column:
    return F.concat(F.lit("dev"), key.cast("string"), F.lit("@example.org"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """email, contributor_id (null: unresolved): every supplier; two neighbouring ones are one contributor, every ninth is unresolved."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        dev_email(key).alias("email"), F.when(key % 9 != 0, F.floor(key / 2).cast("long")).alias("contributor_id")
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team, email, starts, ends (exclusive, null: open)."""
    key = F.col("s_suppkey")
    start = F.date_add(F.to_date(F.lit("1996-01-01")), (key % 300).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).cast("long").alias("team"),
        dev_email(key).alias("email"),
        start.alias("starts"),
        F.when(key % 4 != 0, F.date_add(start, (200 + key % 700).cast("int"))).alias("ends"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, order_id, status, created, reserved, consumed, released, retries."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        (key % 97).alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING").alias("status"),
        F.to_date("o_orderdate").alias("created"),
        (price % 1000).alias("reserved"),
        (price % 700).alias("consumed"),
        (price % 150).alias("released"),
        (key % 4).alias("retries"),
        F.col("o_custkey").alias("user_id"),
    )


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, entry_id, created, kind, amount, expires: what every order does to the wallets of its customer."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    created, reserved = F.to_date("o_orderdate"), price % 1000
    consumed = F.least(price % 700, reserved)

    def entry(number: int, kind: str, amount: Column, given: Column, expires: Column = F.lit(None)) -> Column:
        fields = (key * 10 + number).alias("entry_id"), F.lit(kind).alias("kind"), amount.alias("amount"), expires.cast("date").alias("expires")
        return F.when(given, F.struct(*fields))

    entries = F.array_compact(
        F.array(
            entry(0, "PURCHASE", price % 400, key % 3 == 0),
            entry(1, "RENEWAL", price % 600, key % 5 == 0, F.date_add(created, 365)),
            entry(2, "RESERVE", reserved, F.lit(True)),
            entry(3, "DEBIT", consumed, F.lit(True)),
            entry(4, "RELEASE", F.greatest(reserved - consumed - price % 150, F.lit(0)), F.lit(True)),
        )
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), created.alias("created"), F.explode(entries).alias("e"))
    return rows.select("user_id", "created", "e.*")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, second (from the epoch), job_id, code, value, payload."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("second"),
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("code"),
        "value",
        F.col("props").alias("payload"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, author, cents of every commit by three experts; cents are null where one of them gave no estimate."""
    sha = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    authors = F.explode(F.array(*[F.lit(a) for a in (1, 2, 3)])).alias("a")
    rows = table(spark, sf_dir, "lineitem").select(sha.alias("sha"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), authors)
    cents = (F.floor(F.col("q") * 10 + 0.5) + (F.col("p") * F.col("a")) % 90).cast("long")
    given = (F.col("p") + F.col("n") + F.col("a")) % 7 != 0
    return rows.select("sha", F.concat(F.lit("expert"), F.col("a").cast("string")).alias("author"), F.when(given, cents).alias("cents"))
