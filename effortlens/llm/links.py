"""Components of sets that share rare grams, without comparing all pairs of a group.

Each set (a node) comes with the first grams of an order that all sets share. Two sets of similarity
t or more have a gram in common among the first n - ceil(t n) + 1 of both orders, and when the first
gram they share stands at place p of n and q of m, at most min(n - p, m - q) grams are common.

Nodes are first compared with one centre per gram and merged into components; the centre is the node
with the fewest rare grams in front, the one nearest to what its group was copied from. Grams all of
whose nodes are in one component are then done. What is left is joined by gram and by size: of two
sets the smaller is found by the larger, so a node can only be found by a gram that stands among its
first n - ceil(2 t / (1 + t) n) + 1, and only looks for sizes from t * n to what its own place of the
gram leaves possible. A gram that any number of sets share, but which stands too late in all of them
for any two to be similar (one template filled in differently each time), thus makes no pair at all.
Pairs inside a component cannot change it, so components are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.llm.components import connected_components
from effortlens.llm.storage import stored

#: Rounds of one centre per gram before the pairs that are left are joined.
STAR_ROUNDS = 1
#: Sizes of a partition are within this factor.
SIZE_STEP = 1.1


def _may_be_similar(n: str, pos: str, m: str, at: str, percent: int) -> Column:
    """Length and positional filters for the first gram that two nodes share."""
    length = (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
    return length & ((100 + percent) * rest >= percent * (F.col(n) + F.col(m)))


def _ordered_pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def relabelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def star_pairs(now: DataFrame, number: int, percent: int) -> DataFrame:
    """Each node with the centre of its gram; further rounds break ties in another order."""
    order = F.struct("lead", -F.col("n_shared"), F.xxhash64(F.lit(number), "node"))
    centre = now.groupBy("gram").agg(F.min(F.struct(order.alias("o"), "node", "n", "pos", "label")).alias("c"))
    centre = centre.select("gram", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "n", "pos", "label")])
    met = now.join(centre, "gram").where((F.col("label") != F.col("c_label")) & _may_be_similar("n", "pos", "c_n", "c_pos", percent))
    return met.select(*_ordered_pair("node", "c_node"))


def size_partition(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP))).cast("int")


def remaining_pairs(now: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a gram and pass the filters; the larger set looks for the smaller."""
    n, rest = F.col("n"), F.col("n") - F.col("pos")
    found = now.where((100 + percent) * rest >= 2 * percent * n).withColumn("sizes", size_partition(n))
    least = F.ceil(percent * n / 100)
    most = F.least(n, F.floor(((100 + percent) * rest - percent * n) / percent))
    sizes = F.explode(F.sequence(size_partition(least), size_partition(most)))
    looking = now.where(least <= most).select("gram", sizes.alias("sizes"), *[F.col(x).alias(f"c_{x}") for x in ("node", "n", "pos", "label")])
    smaller = (n < F.col("c_n")) | ((n == F.col("c_n")) & (F.col("node") < F.col("c_node")))
    met = found.join(looking, ["gram", "sizes"]).where(smaller & (F.col("label") != F.col("c_label")) & _may_be_similar("n", "pos", "c_n", "c_pos", percent))
    return met.select(*_ordered_pair("node", "c_node"))


def _lifted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between nodes as links between the components they are in so far."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    up = links.join(a, "a", "left").join(b, "b", "left")
    return up.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))


def _merged(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after components have been merged; nodes that were alone so far may come in."""
    up = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return moved.union(fresh.select("node", "label"))


def linked(shared: DataFrame, similar: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """node, label of the nodes that are linked; nodes not listed are alone.

    ``shared`` has gram, node, n (size of the set), pos (place of the gram from 0), lead and n_shared
    (of the node: grams before the first that is shared, and how many are). ``similar`` takes pairs
    a, b and returns those that are similar.
    """
    kind = shared.schema["node"].dataType.simpleString()
    labels = None
    for number in range(STAR_ROUNDS + 1):
        now = shared.withColumn("label", F.col("node")) if labels is None else relabelled(shared, labels)
        open_grams = now.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("gram")
        now = stored(now.join(open_grams, "gram", "left_semi"), "open")
        if now.isEmpty():
            break
        pairs = star_pairs(now, number, percent) if number < STAR_ROUNDS else remaining_pairs(now, percent)
        links = similar(pairs.distinct())
        if labels is not None:
            links = _lifted(links, labels)
        merged = connected_components(links)
        labels = merged if labels is None else stored(_merged(labels, merged), "labels")
    if labels is None:
        return shared.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    return labels
