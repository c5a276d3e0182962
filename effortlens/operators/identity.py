"""Who is who: match rules, components, lookup chains, alias health."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.functions.scalars import email_domain, normal_name
from effortlens.storage import checkpointed


PUBLIC_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "mail.ru", "yandex.ru", "users.noreply.github.com", "noreply.github.com")
#: Names up to this length meet by deletion variants, longer ones by an unedited piece.
_SHORT = 15
#: Names whose keys are made at once: up to about 1000 keys each.
_AT_ONCE = 1000
#: People whose links a task holds at once.
_HELD = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers of small ones."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=64)
def _kept(n: int, edits: int) -> list[np.ndarray]:
    """For each number of lost characters up to ``edits``: the places that are left, a row a choice."""
    return [np.array(list(combinations(range(n), n - k)), dtype=np.int64).reshape(comb(n, k), n - k) for k in range(min(edits, n) + 1)]


def _variants(codes: np.ndarray, edits: int) -> np.ndarray:
    """Code points, a row a name of one length -> hashes of what is left of each when it loses at most ``edits`` characters, ascending, repeats included."""
    values = _mixed(codes.astype(np.uint64))
    out = []
    for places in _kept(codes.shape[1], edits):
        weights = _mixed(np.arange(places.shape[1], dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
        sums = np.full((len(codes), len(places)), places.shape[1], dtype=np.uint64)
        for i, w in enumerate(weights):
            sums += values[:, places[:, i]] * w
        out.append(_mixed(sums))
    found = np.concatenate(out, axis=1)
    found.sort(axis=1)
    return found.view(np.int64)


def _codes(names: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32).reshape(len(names), n)


def _piece_keys(name: str, edits: int) -> tuple[set[int], set[int]]:
    own, wanted, n = set(), set(), len(name)
    pieces = lambda size: [(i, i * size // (edits + 1), (i + 1) * size // (edits + 1)) for i in range(edits + 1)]
    if n > _SHORT:
        own |= {f"p{n}:{i}:{name[x:y]}" for i, x, y in pieces(n)}
        for size in range(max(n - edits, _SHORT + 1), n + edits + 1):
            for i, x, y in pieces(size):
                wanted |= {f"p{size}:{i}:{name[x + s : y + s]}" for s in range(-edits, edits + 1) if x + s >= 0 and y + s <= n}
    hashed = lambda keys: {int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "little", signed=True) for k in keys}
    return hashed(own), hashed(wanted)


def name_keys(name: str, edits: int) -> tuple[set[int], set[int]]:
    """(own keys, keys to look for), hashes: two names within ``edits`` edits have an own key of the one among the looked-for keys of the other.

    Both leave an equal text if each loses at most ``edits`` characters. For long names that are too
    many texts; there one of ``edits`` + 1 pieces is unedited and stands at most ``edits`` places off.
    """
    own, wanted = _piece_keys(name, edits)
    both = set(_variants(_codes([name], len(name)), edits)[0].tolist()) if len(name) <= _SHORT + edits else set()
    return own | both, wanted | both


def _keyed(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """scope, name -> the same, keys and their side: 0 both, 1 own, 2 to look for."""
        for batch in batches:
            names = batch.column("name").to_pylist()
            by_length: dict[int, list[int]] = {}
            for k, name in enumerate(names):
                by_length.setdefault(len(name), []).append(k)
            for n, rows in by_length.items():
                if n > _SHORT:
                    of, keys, sides = [], [], []
                    for k in rows:
                        for side, some in enumerate(_piece_keys(names[k], edits), 1):
                            of.append(k)
                            keys.append(sorted(some))
                            sides.append(side)
                    yield made(batch, of, pa.array(keys, pa.list_(pa.int64())), sides)
                for at in range(0, len(rows) if n <= _SHORT + edits else 0, _AT_ONCE):
                    some = rows[at : at + _AT_ONCE]
                    found = _variants(_codes([names[k] for k in some], n), edits)
                    new = np.ones(found.shape, dtype=bool)
                    new[:, 1:] = found[:, 1:] != found[:, :-1]
                    ends = np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)
                    yield made(batch, some, pa.ListArray.from_arrays(pa.array(ends), pa.array(found[new])), [0] * len(some))

    def made(batch: pa.RecordBatch, rows: list[int], keys: pa.Array, sides: list[int]) -> pa.RecordBatch:
        taken = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([taken.column("scope"), taken.column("name"), keys, pa.array(sides, pa.int32())], names=["scope", "name", "keys", "side"])

    return run


def near_names(names: DataFrame, edits: int) -> DataFrame:
    """names (scope, name) -> scope, x, y: the pairs x < y of one scope that are 1 to ``edits`` edits apart.

    The names are few bytes but much work, so they are dealt to as many tasks as shuffles have.
    """
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(names.select("scope", "name").dropna().repartition(tasks, "scope", "name").distinct())
    keyed = rows.repartition(tasks).mapInArrow(_keyed(edits), "scope string, name string, keys array<long>, side int").select("scope", "name", "side", F.explode("keys").alias("key"))
    # joined and sorted by one number, into which the scope is mixed; the scopes are compared after it
    keyed = keyed.withColumn("key", F.xxhash64("scope", "key"))
    x, y = (keyed.select("key", F.col("scope").alias(f"{n}_scope"), F.col("name").alias(n), F.col("side").alias(f"{n}_side")) for n in "xy")
    sides = F.col("x_side") + F.col("y_side")
    fit = ((sides == 0) & (F.col("x") < F.col("y"))) | ((sides == 3) & (F.col("x_side") < F.col("y_side")) & (F.col("x") != F.col("y")))
    met = x.join(y.hint("merge"), "key").where(fit & (F.col("x_scope") <= F.col("y_scope")) & (F.col("x_scope") >= F.col("y_scope"))).withColumnRenamed("x_scope", "scope")
    met = met.select("scope", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return met.where(F.levenshtein("x", "y", edits).between(1, edits))


def _developers(people: DataFrame) -> DataFrame:
    email = F.coalesce(F.lower("email"), F.lit(""))
    rows = people.select("id", "login", email.alias("email"), F.coalesce(normal_name(F.col("name")), F.lit("")).alias("name"), F.get(F.split(email, "@"), 1).alias("domain"))
    words = F.split("name", " ")
    first = F.get(words, 0)
    rows = rows.withColumns({"first": first, "last": F.get(words, F.size(words) - 1), "letter": F.substring(first, 1, 1)})
    return rows.withColumn("initial", (F.length("first") <= 2) & (F.length(F.replace(F.col("first"), F.lit("."), F.lit(""))) == 1))


def _side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.select(F.col("id").alias(name), F.col("email").alias(f"{name}_email"), *columns)


def _met(rows: DataFrame, rank: int) -> DataFrame:
    rows = rows.where("a <> b AND a_email <> b_email")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(rank).alias("rank"))


def _loose_pairs(rows: DataFrame) -> DataFrame:
    """a, b, rank of the rules that are no equality: initial and last name (3), same domain (2), spelling (1)."""
    shorts = _side(rows.where("initial AND last <> ''"), "a", "last", F.substring("first", 1, 1).alias("letter"), F.col("first").alias("own"))
    initials = shorts.join(_side(rows, "b", "last", "letter", "first"), ["last", "letter"]).where("own <> first")
    private = rows.where((F.col("domain") != "") & ~F.col("domain").isin(*PUBLIC_DOMAINS))
    found = _met(initials, 3)
    for scoped, edits, rank in ((private.withColumn("scope", F.col("domain")), 3, 2), (rows.withColumn("scope", F.lit("")), 2, 1)):
        near = near_names(scoped.select("scope", "name"), edits)
        near = near.join(_side(scoped, "a", "scope", F.col("name").alias("x")), ["scope", "x"]).join(_side(scoped, "b", "scope", F.col("name").alias("y")), ["scope", "y"])
        found = found.unionByName(_met(near, rank))
    return found


def find_matches(people: DataFrame) -> DataFrame:
    """people (id, name, login, email) -> a < b, confidence, reason of each pair that a rule links; the first rule that does counts.

    HIGH name (equal), HIGH login, MEDIUM initial (and equal last word), MEDIUM domain (not a public
    one, names within 3 edits), LOW spelling (names within 2 edits). Equal e-mails never match.
    """
    rows = _developers(people)
    found = _loose_pairs(rows)
    for column, part, rank in (("name", rows, 5), ("login", rows.where("login <> ''"), 4)):
        found = found.unionByName(_met(_side(part, "a", column).join(_side(part, "b", column), column), rank))
    best = found.groupBy("a", "b").agg(F.max("rank").alias("rank"))
    at = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), F.col("rank"))
    return best.select("a", "b", at("LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH").alias("confidence"), at("spelling", "domain", "initial", "login", "name").alias("reason"))


def _links(people: DataFrame) -> DataFrame:
    """a, b, rank with the components of ``find_matches``, and in each of them its best rank: see ``match_links``."""
    rows = _developers(people)
    found = _loose_pairs(rows)
    for column, part, rank in (("name", rows, 5), ("login", rows.where("login <> ''"), 4)):
        least = part.groupBy(column).agg(F.min("id").alias("a"), F.min("email").alias("x"), F.max("email").alias("y")).where("x <> y")
        found = found.unionByName(least.join(part, column).where("a <> id").select("a", F.col("id").alias("b"), F.lit(rank).alias("rank")))
    return found


def match_links(people: DataFrame) -> DataFrame:
    """a, b with the components of ``find_matches``: people of one name or login are linked to its smallest id, not each to each.

    Where a name or login has two e-mails, each of its people has another e-mail than some other one, so all are one component.
    """
    return _links(people).select("a", "b").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b -> a, b with the same components: everyone of these rows with the smallest one that they lead to, a bounded number of people at a time."""
    over: dict = {}

    def top(x):
        path = []
        while over.setdefault(x, x) != x:
            path.append(x)
            x = over[x]
        for y in path:
            over[y] = x
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            over[max(x, y)] = min(x, y)
        if len(over) > _HELD:
            yield pa.RecordBatch.from_arrays([pa.array([top(x) for x in over], kind), pa.array(list(over), kind)], names=["a", "b"])
            over.clear()
    if over:
        yield pa.RecordBatch.from_arrays([pa.array([top(x) for x in over], kind), pa.array(list(over), kind)], names=["a", "b"])


def match_groups(pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, group (smallest id that matches lead to) of everyone in a pair.

    Pairs of neighbouring ids meet in one task, which puts their whole chain together; what is left between tasks takes rounds.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    stars = pairs.select("a", "b").dropna().repartitionByRange("a").mapInArrow(_stars, f"a {kind}, b {kind}")
    both = checkpointed(stars.union(stars.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("group")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = labels.join(near.hint("merge"), "id").select("id", F.least("group", "near").alias("to"), F.col("group").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("group").alias("far"))
        moved = checkpointed(step.join(jump.hint("merge"), "to").select("id", F.col("far").alias("group"), "was"))
        labels = moved.select("id", "group")
        if moved.where("group <> was").isEmpty():
            return labels
    raise RuntimeError(f"groups did not settle in {max_rounds} rounds")


def developer_groups(people: DataFrame, saved: DataFrame) -> DataFrame:
    """Everyone's group: id, group_id (its smallest id), primary_id, confidence (its best match), auto_merged (HIGH), is_saved.

    people (id, name, login, email, commits); saved (email, primary_email) are groups that a user has
    made: whoever's e-mail, in any case, is in one is not matched, and its primary is the smallest id
    of the primary e-mail (null if nobody has it). Elsewhere the primary has the most commits, ties and
    null commits by the smallest id. Who matches nobody is alone, without a confidence. An e-mail in
    two saved groups belongs to the one of the smaller primary e-mail.
    """
    both = saved.select(F.lower("primary_email").alias("primary_email"), F.explode(F.array(F.lower("email"), F.lower("primary_email"))).alias("key"))
    kept = both.groupBy("key").agg(F.min("primary_email").alias("primary_email"))
    rows = people.select("id", "name", "login", "email", F.coalesce("commits", F.lit(0)).alias("commits"), F.lower("email").alias("key")).join(kept, "key", "left")
    free = rows.where("primary_email IS NULL").drop("primary_email")
    links = checkpointed(_links(free).groupBy("a", "b").agg(F.max("rank").alias("rank")))
    groups = match_groups(links).withColumnRenamed("group", "group_id")
    best = links.join(groups.withColumnRenamed("id", "a"), "a").groupBy("group_id").agg(F.max("rank").alias("rank"))
    alone = free.join(groups, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    first = alone.groupBy("group_id").agg(F.min(F.struct(-F.col("commits"), F.col("id"))).getField("id").alias("primary_id"))
    confidence = F.when(F.col("rank") >= 4, "HIGH").when(F.col("rank") >= 2, "MEDIUM").when(F.col("rank") == 1, "LOW")
    matched = alone.select("id", "group_id").join(first, "group_id").join(best, "group_id", "left")
    matched = matched.select("id", "group_id", "primary_id", confidence.alias("confidence"), F.coalesce(F.col("rank") >= 4, F.lit(False)).alias("auto_merged"), F.lit(False).alias("is_saved"))
    mine = rows.where("primary_email IS NOT NULL")
    heads = mine.groupBy("primary_email").agg(F.min("id").alias("group_id"), F.min(F.when(F.col("key") == F.col("primary_email"), F.col("id"))).alias("primary_id"))
    made = mine.join(heads, "primary_email").select("id", "group_id", "primary_id", F.lit(None).cast("string").alias("confidence"), F.lit(False).alias("auto_merged"), F.lit(True).alias("is_saved"))
    return matched.unionByName(made)


def author_groups(authors: DataFrame) -> DataFrame:
    """authors (email, name, login, repo, day) of commits -> a row a developer: email (the smallest), emails, name, login, commits, repos, first_day, last_day.

    E-mails, in lower case, are one developer if a login links them; equal names link nobody. Commits
    without an e-mail are left out. Name and login are those of the earliest commit that has them, ties by
    text. A login that is seen only after both of its e-mails merges them too, so the result does not hang on the order of rows.
    """
    filled = lambda x: F.when(F.col(x) != "", F.col(x))
    rows = authors.select(F.lower("email").alias("address"), filled("name").alias("name"), filled("login").alias("login"), "repo", "day").where("address <> ''")
    known = rows.where("login IS NOT NULL").select("login", "address").distinct()
    links = known.join(known.groupBy("login").agg(F.min("address").alias("a")), "login").where("a <> address").select("a", F.col("address").alias("b"))
    groups = match_groups(links).select(F.col("id").alias("address"), "group")
    # Commits are summed up per e-mail and repository first; only these sums meet the groups.
    early = lambda x: F.min(F.when(F.col(x).isNotNull(), F.struct("day", x))).alias(x)
    sums = rows.groupBy("address", "repo").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), early("name"), early("login"))
    whole = sums.join(groups, "address", "left").withColumn("email", F.coalesce("group", "address"))
    return whole.groupBy("email").agg(
        F.count_distinct("address").alias("emails"), F.min("name").getField("name").alias("name"), F.min("login").getField("login").alias("login"),
        F.sum("n").alias("commits"), F.count_distinct("repo").alias("repos"), F.min("first").alias("first_day"), F.max("last").alias("last_day"),
    )


def first_match(wanted: DataFrame, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """wanted with ``found`` and ``found_by``: the first lookup (column, frame of that column and found) that has the row's value."""
    rows, values, names = wanted, [], []
    for i, (column, frame) in enumerate(lookups):
        side = frame.groupBy(column).agg(F.min("found").alias(f"_f{i}"))  # nulls match nothing
        rows = rows.join(side, column, "left")
        values.append(F.col(f"_f{i}"))
        names.append(F.when(F.col(f"_f{i}").isNotNull(), column))
    return rows.select(*wanted.columns, F.coalesce(*values).alias("found"), F.coalesce(*names).alias("found_by"))


def health(aliases: DataFrame, by: str) -> DataFrame:
    """Per ``by``: resolved and unresolved aliases and healthy, attention or unresolved."""
    counted = aliases.groupBy(by).agg(
        F.count("contributor_id").alias("resolved"), F.count_if(F.col("contributor_id").isNull()).alias("unresolved")
    )
    status = F.when(F.col("unresolved") == 0, "healthy").when(F.col("resolved") == 0, "unresolved").otherwise("attention")
    return counted.withColumn("health", status)
