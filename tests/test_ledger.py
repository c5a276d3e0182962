"""Wallets against a plain replay, with a hot user whose entries fall into many ranges."""

import datetime
import random

from effortlens.operators import ledger

SCHEMA = "user_id long, entry_id long, created date, kind string, amount long, expires date"


def by_loop(rows):
    state, out = {}, {}
    for user, entry, created, kind, amount, expires in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1])):
        sub, perm, held, until = state.get(user, (0, 0, 0, None))
        expired = 0
        if kind == "RENEWAL" or (until and until <= created):
            expired, sub = sub, 0
        fs = fp = 0
        if kind == "PURCHASE":
            perm += amount
        elif kind == "RENEWAL":
            sub, until = amount, expires
        elif kind == "RESERVE":
            held += amount
        elif kind == "RELEASE":
            held = max(held - amount, 0)
        else:
            fs = min(amount, sub)
            fp = min(amount - fs, perm)
            sub, perm, held = sub - fs, perm - fp, max(held - fs - fp, 0)
        state[user] = sub, perm, held, until
        out[user, entry] = (fs, fp, (amount if kind == "DEBIT" else 0) - fs - fp, expired, sub, perm, held, perm + sub - held)
    return out, state


def entries(n, seed, hot):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randrange(500))
        kind = r.choice(["PURCHASE", "RENEWAL", "RESERVE", "DEBIT", "DEBIT", "DEBIT", "RELEASE"])
        until = day + datetime.timedelta(days=r.randrange(1, 90)) if kind == "RENEWAL" else None
        rows.append((1 if r.random() < hot else r.choice([2, 3, 4, 5, 6, None]), k, day, kind, r.randrange(30), until))
    return rows


def replayed(spark, rows, n_ranges):
    found = ledger.replay(spark.createDataFrame(rows, SCHEMA).repartition(5), n_ranges).collect()
    assert len(found) == len(rows)
    fields = ("from_subscription", "from_permanent", "uncovered", "expired", "subscription", "permanent", "reserved", "available")
    return {(r["user_id"], r["entry_id"]): tuple(r[c] for c in fields) for r in found}


def test_replay_against_a_loop(spark):
    for seed, hot, n_ranges in ((1, 0.0, None), (2, 0.8, 9)):
        rows = entries(1500, seed, hot)
        assert replayed(spark, rows, n_ranges) == by_loop(rows)[0]


def test_a_hot_user_is_spread_over_ranges(spark):
    frame = spark.createDataFrame(entries(3000, 3, 0.9), SCHEMA)
    parts = ledger.in_ranges(frame.repartition(8), 6).where("user_id = 1").select("range_no").distinct().count()
    assert parts > 1


def test_entries_are_shuffled_once_for_a_wallet(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = ledger.replay(spark.createDataFrame(entries(300, 4, 0.5), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # of the entries, of their sums and of the sums of ranges: by user and range, or by user alone
    assert plan.count("Exchange hashpartitioning") <= 4


def test_empty_ledger_and_balances(spark):
    assert ledger.replay(spark.createDataFrame([], SCHEMA)).collect() == []
    day = datetime.date(2024, 5, 1)
    rows = [(1, 1, day, "PURCHASE", 5, None), (1, 2, day, "RENEWAL", 10, datetime.date(2024, 6, 1)), (1, 3, day, "RESERVE", 8, None), (1, 4, day, "DEBIT", 12, None), (2, 5, day, "DEBIT", 3, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    now = {r["user_id"]: r.asDict() for r in ledger.current_balances(ledger.replay(frame), frame, F.to_date(F.lit("2024-05-20"))).collect()}
    assert now[1] == {"user_id": 1, "permanent": 3, "subscription": 0, "reserved": 0, "expired": 0, "available": 3}
    assert now[2]["available"] == 0
    rows[3] = (1, 4, day, "DEBIT", 4, None)
    frame = spark.createDataFrame(rows, SCHEMA)
    later = {r["user_id"]: r.asDict() for r in ledger.current_balances(ledger.replay(frame), frame, F.to_date(F.lit("2024-07-01"))).collect()}
    assert later[1] == {"user_id": 1, "permanent": 5, "subscription": 0, "reserved": 4, "expired": 6, "available": 1}
