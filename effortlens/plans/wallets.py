"""Queries over the wallets: name -> (query, SQL to check it with)."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortlens.operators import ledger
from effortlens.plans.check_sql import LEDGER, with_recursive_frames
from effortlens.sources.tables import ledger_entries

_AS_OF = "DATE '1998-09-01'"


def _replayed(spark, d):
    return ledger.replay(ledger_entries(spark, d))


def _balances(spark, d):
    return ledger.current_balances(_replayed(spark, d), ledger_entries(spark, d), F.expr(_AS_OF))


QUERIES = {
    "wallet_replay": (
        _replayed,
        with_recursive_frames(
            """SELECT user_id, entry_id, created, kind, amount, fs AS from_subscription, fp AS from_permanent, CASE WHEN kind = 'DEBIT' THEN amount - fs - fp ELSE 0 END AS uncovered,
            expired, sub AS subscription, perm AS permanent, res AS reserved, perm + sub - res AS available FROM r WHERE rn > 0""",
            LEDGER,
        ),
    ),
    "wallet_balances": (
        _balances,
        with_recursive_frames(
            f"""SELECT user_id, perm AS permanent, sub - gone AS subscription, res AS reserved, gone AS expired, perm + sub - gone - res AS available
            FROM (SELECT *, CASE WHEN until <= {_AS_OF} THEN sub ELSE 0 END AS gone FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)""",
            LEDGER,
        ),
    ),
    "wallet_totals": (
        lambda spark, d: ledger.totals(_replayed(spark, d)),
        with_recursive_frames(
            """SELECT CAST(sum(amount) FILTER (kind = 'PURCHASE') AS BIGINT) AS purchase, CAST(sum(amount) FILTER (kind = 'RENEWAL') AS BIGINT) AS renewal, CAST(sum(amount) FILTER (kind = 'RESERVE') AS BIGINT) AS reserve,
            CAST(sum(amount) FILTER (kind = 'RELEASE') AS BIGINT) AS release, CAST(sum(fs) AS BIGINT) AS from_subscription, CAST(sum(fp) AS BIGINT) AS from_permanent,
            CAST(sum(amount - fs - fp) FILTER (kind = 'DEBIT') AS BIGINT) AS uncovered, CAST(sum(expired) AS BIGINT) AS expired FROM r WHERE rn > 0""",
            LEDGER,
        ),
    ),
}
