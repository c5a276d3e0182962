"""Validity intervals: half-open, a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(day: Column, starts: Column, ends: Column) -> Column:
    return (day >= starts) & (ends.isNull() | (day < ends))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a1.isNull() | (a1 > b0)) & (b1.isNull() | (b1 > a0))


def attributed(commits: DataFrame, members: DataFrame) -> DataFrame:
    """Commits with the teams their author belonged to on their day: an equi-join on email with the interval as residual."""
    on = (commits["email"] == members["email"]) & holds(commits["day"], members["starts"], members["ends"])
    return commits.join(members, on).select("team", *[commits[c] for c in commits.columns]).distinct()
