"""Contributors and aliases: extraction from orders, projection, merging and unmerging.

All of it works on whole frames. ``aliases`` has alias_id, workspace, provider, provider_id, email,
username, contributor_id and status (MANUAL, AUTO_MERGED, UNRESOLVED, SUGGESTED), ``contributors``
contributor_id, workspace, name and email. A pass over any number of orders looks at what was stored
before it: of the aliases of one e-mail in it the strongest counts, and what it creates is seen by the
next pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.storage import checkpointed

PROVIDER = "github"
#: Rounds in which chains of merges are followed, each twice as far as the one before.
MAX_ROUNDS = 64


def _filled(*names: str) -> Column:
    """The first of the columns that is there and not empty."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def extract_aliases(orders: DataFrame) -> DataFrame:
    """orders (order_id, workspace, developers, mapping) -> order_id, workspace, email, name, username, provider_id, provider, source, rank.

    ``developers`` is a JSON array of the chosen developers, ``mapping`` an object of groups, each with
    a primary and an array merged_from. An e-mail, trimmed and in lower case, counts once an order: as
    chosen developer (the last of equal ones), else as it first comes in the groups, primary before
    merged. Elements without an e-mail and texts that are no such JSON are left out.
    """
    # all elements of an order come out of its row in one pass, and each is parsed once
    item = lambda element, source, *rank: F.struct(element.alias("element"), F.lit(source).alias("source"), F.array(*rank).alias("rank"))
    zero, one = F.lit(0), F.lit(1)
    chosen = F.transform(F.from_json("developers", "array<string>"), lambda x, i: item(x, "primary", zero, -i, zero))
    groups = F.map_entries(F.from_json("mapping", "map<string, struct<primary: string, merged_from: array<string>>>"))

    def members(group: Column, i: Column) -> Column:
        merged = F.transform(F.coalesce(group["value"]["merged_from"], F.array().cast("array<string>")), lambda x, k: item(x, "merged_from", one, i, k + 1))
        return F.concat(F.array(item(group["value"]["primary"], "primary", one, i, zero)), merged)

    none = F.array().cast("array<struct<element: string, source: string, rank: array<int>>>")
    items = F.concat(F.coalesce(chosen, none), F.coalesce(F.flatten(F.transform(groups, members)), none))
    rows = orders.select("order_id", "workspace", F.explode(items).alias("item")).select("order_id", "workspace", "item.*")
    fields = ("email", "name", "login", "username", "id")
    rows = rows.select("order_id", "workspace", "source", "rank", F.json_tuple("element", *fields).alias(*[f"_{x}" for x in fields]))
    rows = rows.withColumn("email", F.lower(F.trim(_filled("_email")))).where("email <> ''")
    # a group's primary has no login for its name
    in_group = (F.col("source") == "primary") & (F.get("rank", F.lit(0)) == 1)
    made = rows.select(
        "order_id",
        "workspace",
        "email",
        F.coalesce(_filled("_name"), F.when(~in_group, _filled("_login")), F.col("email")).alias("name"),
        _filled("_login", "_username").alias("username"),
        _filled("_id").alias("provider_id"),
        F.lit(PROVIDER).alias("provider"),
        "source",
        "rank",
    )
    whole = F.struct(*[c for c in made.columns if c not in ("order_id", "email")])
    return made.groupBy("order_id", "email").agg(F.min_by(whole, "rank").alias("_row")).select("order_id", "email", "_row.*")


def _looked_up(rows: DataFrame, side: DataFrame, keys: list[str], found: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the smallest ``found`` of ``side`` with equal keys; nulls match nothing."""
    some = side.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(found).alias(name))
    met = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(some, met, "left").drop(*[f"_{k}" for k in keys])


def project(raw: DataFrame, aliases: DataFrame, contributors: DataFrame) -> DataFrame:
    """What a pass does: a row per workspace, provider and e-mail of ``raw``, stored once; the frames are cut out of it below.

    ``raw`` is what ``extract_aliases`` gives. An alias is found by provider id, else by e-mail; a
    contributor by the provider id of an alias that has one, else by primary e-mail, else by the
    user name of an alias that has one. ``action``: touch (the alias keeps its contributor: it is
    MANUAL, or has one, or none is found), attach (it gets one), create (a new alias of a known
    contributor), found (a new alias and a new contributor: a primary that nothing matches) or
    queue (a new unresolved alias: a merged one that nothing matches). Where the alias found by
    provider id has another e-mail it takes the new one, unless another alias has that; an
    unresolved one without contributor is absorbed instead (``absorbed``).
    """
    whole = F.struct("name", "username", "provider_id", "source")
    order = F.struct((F.col("source") != "primary").alias("later"), "order_id", "rank")
    rows = raw.groupBy("workspace", "provider", "email").agg(F.min_by(whole, order).alias("r")).select("workspace", "provider", "email", "r.*")
    owned = aliases.where("contributor_id IS NOT NULL")
    rows = _looked_up(rows, aliases, ["workspace", "provider", "provider_id"], F.col("alias_id"), "_by_id")
    same_email = F.struct("alias_id", ((F.col("status") == "UNRESOLVED") & F.col("contributor_id").isNull()).alias("orphan"))
    rows = _looked_up(rows, aliases, ["workspace", "provider", "email"], same_email, "_by_email")
    rows = _looked_up(rows, owned, ["workspace", "provider", "provider_id"], F.col("contributor_id"), "_c_id")
    rows = _looked_up(rows, contributors, ["workspace", "email"], F.col("contributor_id"), "_c_email")
    rows = _looked_up(rows, owned, ["workspace", "provider", "username"], F.col("contributor_id"), "_c_name")
    rows = rows.withColumn("alias_id", F.coalesce("_by_id", "_by_email.alias_id"))
    stored = aliases.select(F.col("alias_id").alias("_id"), F.col("status").alias("_status"), F.col("contributor_id").alias("_has"), F.col("email").alias("_email"), F.col("provider_id").alias("_pid"), F.col("username").alias("_user"))
    rows = rows.join(stored, F.col("alias_id") == F.col("_id"), "left")

    known, match = F.col("alias_id").isNotNull(), F.coalesce("_c_id", "_c_email", "_c_name")
    kept = (F.col("_status") == "MANUAL") | F.col("_has").isNotNull() | match.isNull()
    action = (
        F.when(known & kept, "touch").when(known, "attach").when(match.isNotNull(), "create").when(F.col("source") == "primary", "found").otherwise("queue")
    )
    moved = known & (F.col("email") != F.col("_email"))
    other = F.col("_by_email.alias_id").isNotNull() & (F.col("_by_email.alias_id") != F.col("alias_id"))
    absorbed = moved & other & F.col("_by_email.orphan")
    new_id = F.sha2(F.concat_ws("\x1f", F.lit("c"), "workspace", "email"), 256)
    action_is = lambda *names: F.col("action").isin(*names)
    rows = rows.withColumn("action", action)
    return checkpointed(
        rows.select(
            "workspace",
            "provider",
            "email",
            "name",
            "action",
            "alias_id",
            F.when(action_is("touch"), F.col("_has")).when(action_is("attach", "create"), match).when(action_is("found"), new_id).alias("contributor_id"),
            F.when(action_is("touch"), F.col("_status")).when(action_is("queue"), "UNRESOLVED").otherwise("AUTO_MERGED").alias("status"),
            F.when(action_is("attach", "create"), F.when(F.col("provider_id").isNotNull(), "exact_provider_match").otherwise("exact_email_match"))
            .when(action_is("found"), "exact_email_match")
            .alias("reason"),
            F.when(known & moved & other & ~F.coalesce(absorbed, F.lit(False)), F.col("_email")).otherwise(F.col("email")).alias("alias_email"),
            F.coalesce("username", "_user").alias("username"),
            F.when(F.col("_status") == "MANUAL", F.col("_pid")).otherwise(F.coalesce("_pid", "provider_id")).alias("provider_id"),
            F.when(absorbed, F.col("_by_email.alias_id")).alias("absorbed"),
        )
    )


def new_contributors(pass_: DataFrame) -> DataFrame:
    return pass_.where("action = 'found'").select("contributor_id", "workspace", "name", "email")


def projected_aliases(pass_: DataFrame, aliases: DataFrame) -> DataFrame:
    """All aliases after the pass. Of two e-mails that reach one alias by provider id the smaller is kept."""
    columns = ["alias_id", "workspace", "provider", "provider_id", "email", "username", "contributor_id", "status"]
    made = F.coalesce("alias_id", F.sha2(F.concat_ws("\x1f", F.lit("a"), "workspace", "provider", "email"), 256))
    rows = pass_.withColumn("alias_id", made).groupBy("alias_id").agg(
        F.min_by(F.struct("workspace", "provider", "provider_id", F.col("alias_email").alias("email"), "username", "contributor_id", "status"), "email").alias("r")
    )
    rows = rows.select("alias_id", "r.*").select(columns)
    gone = rows.select("alias_id").union(pass_.where("absorbed IS NOT NULL").select("absorbed"))
    absorbed = pass_.where("absorbed IS NOT NULL").select(F.col("absorbed").alias("alias_id"))
    return aliases.select(columns).join(gone, "alias_id", "left_anti").unionByName(rows.join(absorbed, "alias_id", "left_anti"))


def unresolved(aliases: DataFrame) -> DataFrame:
    """The identity queue: aliases without a contributor."""
    return aliases.where("contributor_id IS NULL")


def checked_merges(requests: DataFrame, contributors: DataFrame) -> DataFrame:
    """requests (source, target) -> the same with ``error``, null where a merge may be made, and ``final``, the contributor that its chain ends in.

    Invalid: a contributor with itself, one that is not there, one of another workspace, one that is a
    source twice, and chains that end in a circle.
    """
    of = lambda side: contributors.select(F.col("contributor_id").alias(side), F.col("workspace").alias(f"{side}_workspace"))
    rows = requests.select("source", "target").distinct().join(of("source"), "source", "left").join(of("target"), "target", "left")
    times = requests.select("source", "target").distinct().groupBy("source").agg(F.count("*").alias("times"))
    rows = rows.join(times, "source", "left")
    error = (
        F.when(F.col("source").eqNullSafe(F.col("target")), "same contributor")
        .when(F.col("source_workspace").isNull(), "no such source")
        .when(F.col("target_workspace").isNull(), "no such target")
        .when(F.col("source_workspace") != F.col("target_workspace"), "other workspace")
        .when(F.col("times") > 1, "source is merged twice")
    )
    rows = checkpointed(rows.select("source", "target", error.alias("error")))
    reached = rows.where("error IS NULL").select("source", F.col("target").alias("final"))
    n = reached.count()
    for k in range(MAX_ROUNDS):
        onward = reached.select(F.col("source").alias("final"), F.col("final").alias("next"))
        step = checkpointed(reached.join(onward, "final", "left").select("source", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moved")))
        reached = step.select("source", "final")
        # after k rounds 2^k merges have been followed; who still moves after more than there are goes round
        if step.where("moved").isEmpty() or 1 << k > n:
            break
    circle = reached.join(rows.where("error IS NULL").select(F.col("source").alias("final")), "final", "left_semi").select("source", F.lit(True).alias("circle"))
    out = rows.join(reached, "source", "left").join(circle, "source", "left")
    error = F.coalesce("error", F.when(F.col("circle"), "merges end in a circle"))
    return out.select("source", "target", error.alias("error"), F.when(error.isNull(), F.col("final")).alias("final"))


def merge(checked: DataFrame, aliases: DataFrame, contributors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, contributors) after the valid merges: aliases of a source point to its target, by hand from now on; the source goes."""
    valid = checked.where("error IS NULL").select(F.col("source").alias("_source"), "final")
    rows = aliases.join(valid, F.col("contributor_id") == F.col("_source"), "left")
    moved = F.col("final").isNotNull()
    changed = rows.withColumns({"contributor_id": F.coalesce("final", "contributor_id"), "status": F.when(moved, "MANUAL").otherwise(F.col("status"))})
    left = contributors.join(valid, F.col("contributor_id") == F.col("_source"), "left_anti")
    return changed.select(aliases.columns), left


def checked_unmerges(requests: DataFrame, aliases: DataFrame, contributors: DataFrame) -> DataFrame:
    """requests (contributor_id, alias_ids) -> request (number), contributor_id, alias_ids, error, new_email, new_name, workspace.

    A contributor is unmerged once a pass. Invalid: no aliases, an alias that is not the contributor's,
    all of its aliases, a contributor named twice, and a first alias whose e-mail is that of a
    contributor already or of another request of the pass. The first alias is the smallest id.
    """
    rows = requests.select("contributor_id", F.array_sort(F.array_distinct("alias_ids")).alias("alias_ids"))
    rows = rows.groupBy("contributor_id").agg(F.count("*").alias("times"), F.min("alias_ids").alias("alias_ids"))
    wanted = rows.select("contributor_id", F.explode("alias_ids").alias("alias_id"))
    own = aliases.select("alias_id", F.col("contributor_id").alias("owner"), "email", "username", "workspace")
    met = wanted.join(own, "alias_id", "left").groupBy("contributor_id").agg(
        F.count_if(~F.col("owner").eqNullSafe(F.col("contributor_id"))).alias("foreign"),
        F.count("*").alias("n"),
        F.min(F.struct("alias_id", "email", "username", "workspace")).alias("first"),
    )
    held = aliases.where("contributor_id IS NOT NULL").groupBy("contributor_id").agg(F.count("*").alias("held"))
    rows = rows.join(met, "contributor_id", "left").join(held, "contributor_id", "left")
    email = contributors.select(F.col("workspace").alias("_workspace"), F.col("email").alias("_email")).distinct()
    rows = rows.join(email, (F.col("first.workspace") == F.col("_workspace")) & (F.col("first.email") == F.col("_email")), "left")
    rivals = rows.groupBy(F.col("first.workspace").alias("w"), F.col("first.email").alias("e")).agg(F.min("contributor_id").alias("_first_to_ask"))
    rows = rows.join(rivals, (F.col("first.workspace") == F.col("w")) & (F.col("first.email") == F.col("e")), "left")
    error = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no aliases")
        .when(F.col("times") > 1, "contributor is unmerged twice")
        .when(F.col("foreign") > 0, "alias of another contributor")
        .when(F.col("n") >= F.col("held"), "all aliases")
        .when(F.col("_email").isNotNull(), "e-mail is taken")
        .when(F.col("_first_to_ask") != F.col("contributor_id"), "e-mail is asked for twice")
    )
    name = F.coalesce(F.when(F.col("first.username") != "", F.col("first.username")), F.col("first.email"))
    return rows.select(
        "contributor_id", "alias_ids", error.alias("error"), F.col("first.workspace").alias("workspace"), F.col("first.email").alias("new_email"), name.alias("new_name")
    )


def unmerge(checked: DataFrame, aliases: DataFrame, contributors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, contributors) after the valid requests: the named aliases get a contributor of their own."""
    new_id = F.sha2(F.concat_ws("\x1f", F.lit("c"), "workspace", "new_email"), 256)
    valid = checked.where("error IS NULL").withColumn("new_id", new_id)
    moved = valid.select(F.explode("alias_ids").alias("_alias"), "new_id")
    rows = aliases.join(moved, F.col("alias_id") == F.col("_alias"), "left")
    out = F.col("new_id").isNotNull()
    kind = contributors.schema["contributor_id"].dataType
    changed = rows.withColumns({"contributor_id": F.coalesce(F.col("new_id").cast(kind), "contributor_id"), "status": F.when(out, "MANUAL").otherwise(F.col("status"))})
    made = valid.select(F.col("new_id").cast(kind).alias("contributor_id"), "workspace", F.col("new_name").alias("name"), F.col("new_email").alias("email"))
    return changed.select(aliases.columns), contributors.select("contributor_id", "workspace", "name", "email").unionByName(made)


def similarity_keys(people: DataFrame) -> DataFrame:
    """people (rank, name, login) -> rank, key: two people are similar if they share a key.

    A login; first letter and last word of a name of several words; a name of one word.
    """
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    words = F.split(name, r"\s+")
    by_name = F.when(F.size(words) > 1, F.concat(F.lit("i:"), F.substring(name, 1, 1), F.lit("|"), F.element_at(words, -1))).otherwise(F.concat(F.lit("n:"), name))
    by_login = F.when(F.col("login") != "", F.concat(F.lit("l:"), "login"))
    return people.select("rank", F.explode(F.array_compact(F.array(by_name, by_login))).alias("key"))


def greedy_groups(people: DataFrame) -> DataFrame:
    """people (rank, email, name, login) -> email, seed (rank of the first of its group), size.

    In order of rank, whoever is in no group yet starts one and takes all similar people who are in
    none. Similarity is not followed further, so groups hang on the order. Who starts a group is the
    lexicographically first independent set of the similarity graph, found in rounds: all who come
    first under each of their keys start a group at once, and all who share a key with them are
    taken. Pairs are never formed. Rows of an e-mail that came before are left out; ranks are distinct.
    """
    first = people.groupBy("email").agg(F.min_by(F.struct("rank", "name", "login"), "rank").alias("p")).select("email", "p.*")
    people = checkpointed(first)
    keys = checkpointed(similarity_keys(people))
    left, seeds = keys, None
    while True:
        mins = left.groupBy("key").agg(F.min("rank").alias("least"))
        firsts = left.join(mins, "key").groupBy("rank").agg(F.min(F.col("rank") == F.col("least")).alias("first"))
        new = checkpointed(firsts.where("first").select("rank"))
        if new.isEmpty():
            break
        seeds = new if seeds is None else seeds.union(new)
        claimed = left.join(new, "rank", "left_semi").select("key")
        taken = left.join(claimed, "key", "left_semi").select("rank").distinct()
        left = checkpointed(left.join(taken, "rank", "left_anti"))
    if seeds is None:
        return people.select("email", F.col("rank").alias("seed"), F.lit(0).cast("long").alias("size")).limit(0)
    owners = keys.join(seeds, "rank", "left_semi").select("key", F.col("rank").alias("owner"))
    owned = keys.join(owners, "key").where("owner <= rank").groupBy("rank").agg(F.min("owner").alias("seed"))
    sizes = owned.groupBy("seed").agg(F.count("*").alias("size"))
    return people.join(owned, "rank").join(sizes, "seed").select("email", "seed", "size")
