"""Two wallets replayed from their ledger: reservations, debits, releases, grants and expiry, in order of entry.

A debit takes from the subscription first and from the permanent wallet what is left, a renewal
replaces the subscription, an expired subscription is emptied before the next entry, and nothing
falls below zero. So a balance is no running sum: each entry maps x to max(x + a, 0), or to
max(a, 0) where the wallet is emptied first. Such maps compose to maps of the form max(x + a, l) or
to constants, and a run of them has a closed form: with running sums S from the last emptying on,
x = S + max(x0, max(-S)). Entries are therefore cut into ranges by (user, time); each range is
solved by two window functions, ranges are composed, one row each, and the balance at the start of
each range is put in. A user with a third of all entries is spread over many tasks.

User and range are a key of columns that are never null: windows, sums and joins by it need one shuffle
of the entries, and a missing user is a user too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortlens.storage import checkpointed

#: What the entries of one user are ordered by.
ORDER = ["created", "entry_id"]


def in_ranges(entries: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``entries`` with range_no, the number of their range by (user, time); as many ranges as their size asks for, or ``n_ranges``."""
    keys = ["user_id", *ORDER]
    spread = entries.repartitionByRange(*keys) if n_ranges is None else entries.repartitionByRange(n_ranges, *keys)
    return checkpointed(spread.withColumn("range_no", F.spark_partition_id()))


#: User and range of an entry, which every window over entries is of.
USER = ["_user", "_none"]
KEY = [*USER, "range_no"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of KEY in place of user_id, a number or a string."""
    user = F.col("user_id")
    return rows.withColumns({"_user": F.coalesce(user, F.lit("0").cast(rows.schema["user_id"].dataType)), "_none": user.isNull()}).drop("user_id")


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


def last_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value that is not null of the user's entries before each."""
    before = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.withColumn("_value", value).groupBy(*KEY).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*ORDER))).alias("_last"))
    earlier = Window.partitionBy(*USER).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*KEY, F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"))
    within = rows.withColumn("_within", F.last(value, ignorenulls=True).over(before))
    return within.join(ranges, KEY).withColumn(name, F.coalesce("_within", "_earlier")).drop("_within", "_earlier")


def balances(rows: DataFrame, add: Column, empty: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the balance after each entry, and ``name``_before.

    An entry adds ``add``, after the wallet is emptied if ``empty``; the balance never falls below
    zero and starts with zero.
    """
    rows = rows.withColumns({"_add": add, "_empty": F.coalesce(empty, F.lit(False))})
    rows = rows.withColumn("_run", F.sum(F.col("_empty").cast("long")).over(_upto(*KEY)))
    run = _upto(*KEY, "_run")
    rows = rows.withColumn("_sum", F.sum("_add").over(run))
    rows = rows.withColumn("_low", F.max(-F.col("_sum")).over(run))

    ends = rows.groupBy(*KEY).agg(F.max_by(F.struct("_run", "_sum", "_low"), F.struct(*ORDER)).alias("e"))
    emptied, total, low = F.col("e._run") > 0, F.col("e._sum"), F.col("e._low")
    # a range in which the wallet is emptied ends with a balance of its own, whatever came before
    settled = total + F.greatest(low, F.lit(0))
    ends = ends.select(*KEY, emptied.alias("emptied"), F.when(emptied, settled).otherwise(total).alias("a"), F.when(emptied, settled).otherwise(total + low).alias("l"))
    by_user = Window.partitionBy(*USER).orderBy("range_no")
    ends = ends.withColumn("_run", F.sum(F.col("emptied").cast("long")).over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy(*USER, "_run").orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("s", F.sum("a").over(same))
    ends = ends.withColumn("x", F.col("s") + F.greatest(F.lit(0), F.max(F.col("l") - F.col("s")).over(same)))
    starts = ends.select(*KEY, F.lag("x", 1, 0).over(by_user).alias("_start"))

    joined = rows.join(starts, KEY)
    first = F.when(F.col("_run") > 0, F.lit(0)).otherwise(F.col("_start"))
    after = joined.withColumn(name, F.col("_sum") + F.greatest(first, F.col("_low")))
    before = F.lag(name).over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return after.withColumn(f"{name}_before", F.coalesce(before, "_start")).drop("_add", "_empty", "_run", "_sum", "_low", "_start")


def replay(entries: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Each entry with both wallets, what is reserved and what is available after it.

    ``entries`` has user_id, entry_id, created, kind, amount and expires (of a RENEWAL). Kinds:
    PURCHASE adds to the permanent wallet; RENEWAL replaces the subscription until ``expires``;
    RESERVE and RELEASE change what is reserved; DEBIT takes credits and as much of the reservation.
    ``expired`` is what an emptied subscription held, ``uncovered`` what a debit found in no wallet.
    """
    kind, amount = F.col("kind"), F.col("amount")
    rows = last_before(_keyed(in_ranges(entries, n_ranges)), F.when(kind == "RENEWAL", F.col("expires")), "until")
    ends = (kind == "RENEWAL") | (F.col("until") <= F.col("created"))
    wanted = F.when(kind == "DEBIT", amount).otherwise(0)
    rows = balances(rows, F.when(kind == "RENEWAL", amount).otherwise(-wanted), ends, "subscription")
    there = F.when(F.coalesce(ends, F.lit(False)), F.lit(0)).otherwise(F.col("subscription_before"))
    rows = rows.withColumns({"from_subscription": F.least(wanted, there), "expired": F.col("subscription_before") - there})
    # the next wallet is replayed on what this one has left over
    rows = checkpointed(rows.drop("until"))
    left = wanted - F.col("from_subscription")
    rows = balances(rows, F.when(kind == "PURCHASE", amount).otherwise(-left), F.lit(False), "permanent")
    rows = checkpointed(rows.withColumn("from_permanent", F.least(left, F.col("permanent_before"))))
    taken = F.col("from_subscription") + F.col("from_permanent")
    held = F.when(kind == "RESERVE", amount).when(kind == "RELEASE", -amount).when(kind == "DEBIT", -taken).otherwise(0)
    rows = balances(rows, held, F.lit(False), "reserved")
    return rows.select(
        F.when(~F.col("_none"), F.col("_user")).alias("user_id"),
        "entry_id",
        "created",
        "kind",
        "amount",
        "from_subscription",
        "from_permanent",
        (wanted - taken).alias("uncovered"),
        "expired",
        "subscription",
        "permanent",
        "reserved",
        (F.col("permanent") + F.col("subscription") - F.col("reserved")).alias("available"),
    )


def current_balances(replayed: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Per user: both wallets, what is reserved and available at ``as_of``, and what has expired since the last entry."""
    last = replayed.groupBy("user_id").agg(F.max_by(F.struct("subscription", "permanent", "reserved"), F.struct(*ORDER)).alias("b"))
    renewed = F.when(F.col("kind") == "RENEWAL", F.struct(*ORDER))
    until = entries.groupBy("user_id").agg(F.max_by("expires", renewed).alias("until")).withColumnRenamed("user_id", "_user")
    rows = last.join(until, F.col("user_id").eqNullSafe(F.col("_user")))
    expired = F.when(F.col("until") <= as_of, F.col("b.subscription")).otherwise(0)
    subscription = F.col("b.subscription") - expired
    return rows.select(
        "user_id",
        "b.permanent",
        subscription.alias("subscription"),
        "b.reserved",
        expired.alias("expired"),
        (F.col("b.permanent") + subscription - F.col("b.reserved")).alias("available"),
    )


def totals(replayed: DataFrame) -> DataFrame:
    """One row over the ledger: credits bought, granted, taken from each wallet, expired, refused, and reservations released."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0)).alias(kind.lower())
    return replayed.agg(*[of(k) for k in ("PURCHASE", "RENEWAL", "RESERVE", "RELEASE")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("from_subscription", "from_permanent", "uncovered", "expired")])
