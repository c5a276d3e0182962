"""SpotSigs: a text's fingerprint is the set of its spots, chains of content words after common words.

Every common word (an anchor) makes one signature with the ``chain`` content words that follow it;
common words among them are passed over. Where ``RUN`` content words stand in a row the last of them
is an anchor as well, so that texts in other languages and lists have signatures too. Two texts are
as like as their sets of signatures (Jaccard). All of it is done in columns of Spark SQL: a text is
scanned once for content words, and only the gaps between them are looked at for anchors.

``near_copies`` compares all texts: equal sets are one node, each set is put in order of the rarity
of its signatures, and sets meet by the rarest of each within partitions by set length, where a pair
is dropped as soon as lengths and places bound its similarity below the threshold (see ``links``).

Defined cases: a null text is empty; a text without a spot is fingerprinted by chains of its
consecutive words, one of fewer words than a chain has by its whole sequence, and one without words
has an empty fingerprint. Two empty fingerprints are alike (1), an empty one and another are not (0).
In ``edited`` documents follow each other by descending id, nulls last, then by a hash of the text,
equal rows one after another; a single document follows itself; an empty table gives an empty result. Texts have any length. Columns are renamed
before they are joined, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effortlens.llm.links import linked, relabelled
from effortlens.llm.storage import checkpointed, stored
from effortlens.llm.words import ITEM_BREAK, let, split_words

#: Common words of the languages of the corpus; any other set may be given.
ENGLISH = "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you"
FRENCH = "au aux avec ce ces dans de des du elle en est et il je la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous"
GERMAN = "als am an auch auf aus bei bis das dem den der des die ein eine einem einen einer er es für im in ist mit nach nicht sich sie so und von war wie zu zum zur"
SPANISH = "al como con de del el ella en es este esta la las le lo los más no o para pero por que se sin sobre su sus un una y"
ANCHORS = frozenset(" ".join([ENGLISH, FRENCH, GERMAN, SPANISH]).split())
CHAIN = 2
#: So many content words in a row, and the last of them is an anchor as well.
RUN = 8
#: Ranges of ids at most, and how many of their ends are looked through at once: a row is placed by 2 * GROUP comparisons.
MAX_RANGES, GROUP = 1 << 16, 1 << 8
#: Hex digits of a signature: 48 bits.
DIGITS = 12


def _signature(*words: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(" ", *words)), 1, DIGITS)


def spots(text: Column, anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as array<string>."""
    common = sorted(anchors)

    def of_words(words: Column) -> Column:
        content = F.array_compact(F.transform(words, lambda w, i: F.when(~w.isin(common), i)))
        return let(content, lambda at: found(words, at))

    def found(words: Column, at: Column) -> Column:
        """``at``: places of the content words, from 0."""
        last = F.size(at) - chain

        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1))
        bare = lambda k: (k >= RUN) & (F.get(at, k) - F.get(at, k - RUN) == RUN)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        anchored = F.filter(places, lambda k: (F.get(at, k) - before(k) > 1) | bare(k))

        def after_gap(k: Column) -> Column:
            gap = F.slice(words, before(k) + 2, F.get(at, k) - before(k) - 1)
            gap = F.when(F.size(gap) == 0, F.array(F.get(words, F.get(at, k) - 1))).otherwise(gap)
            tail = [F.get(words, F.get(at, k + c)) for c in range(chain)]
            return let(F.concat_ws(" ", *tail), lambda t: F.transform(gap, lambda a: _signature(a, t)))

        chains = F.flatten(F.transform(anchored, after_gap))
        return let(F.sort_array(F.array_distinct(chains)), lambda s: F.when(F.size(s) > 0, s).otherwise(plain(words)))

    def plain(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - chain - 1, F.lit(0)))
        windows = F.transform(starts, lambda i: _signature(F.concat_ws(" ", F.slice(words, i + 1, F.lit(chain + 1)))))
        return F.when(F.size(words) > 0, F.sort_array(F.array_distinct(windows))).otherwise(F.array().cast("array<string>"))

    return let(split_words(F.lower(text), ITEM_BREAK), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b)
    return F.when(either == 0, F.lit(1.0)).otherwise(let(shared, lambda s: s / (either - s)))


def _range_ends(rows: DataFrame, n: int) -> DataFrame:
    """One row, ``ends``: the last keys of ``n`` ranges of about as many rows, in groups of at most ``GROUP``."""
    parts = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("end"))
    ends = parts.agg(F.sort_array(F.collect_list("end")).alias("e"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("e"), F.lit(1)), F.lit(GROUP))
    return checkpointed(ends.select(F.transform(starts, lambda i: F.slice("e", i, GROUP)).alias("ends")))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """id, text, spots, next_text, next_spots per row: each document with the next by descending id, the last with the first.

    Texts are shuffled once, to ranges of ids; the first row of each range is sent to the range above
    as well, where it follows the last. Where ranges end is found on ids and hashes alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("id", F.xxhash64("text").alias("h")))
    n = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = rows.crossJoin(F.broadcast(_range_ends(rows, n)))  # one row
    group = F.size(F.filter("ends", lambda g: F.element_at(g, -1) < F.col("key")))
    within = let(group, lambda g: F.struct(g.alias("g"), F.size(F.filter(F.get("ends", g), lambda e: e < F.col("key"))).alias("i")))
    place = known.withColumn("at", within)
    number = F.col("at.g") * GROUP + F.col("at.i")
    heads = F.get(F.get("ends", F.col("at.g")), F.col("at.i")) == F.col("key")
    n_ranges = (F.size("ends") - 1) * GROUP + F.size(F.element_at("ends", -1))
    own = F.struct(number.alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(((number + 1) % n_ranges).alias("range"), F.lit(True).alias("guest"))
    sent = place.select("id", "text", "key", F.inline(F.when(heads, F.array(own, guest)).otherwise(F.array(own))))
    met = sent.repartition("range").withColumn("spots", spots(F.col("text"), anchors, chain))
    down = Window.partitionBy("range").orderBy("guest", F.col("key").desc())
    following = met.withColumns({"next_text": F.lead("text").over(down), "next_spots": F.lead("spots").over(down)})
    return following.where(~F.col("guest")).select("id", "text", "spots", "next_text", "next_spots")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: frozenset[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """id, text, edited_text, spots, edited_spots, next_spots per row.

    In the edited text the last third of the code points is replaced by the first of the next document.
    """
    rows = beside_next(docs, id_col, text_col, anchors, chain)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    text = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = rows.withColumn("edited_text", text)
    return rows.select("id", "text", "edited_text", "spots", spots(F.col("edited_text"), anchors, chain).alias("edited_spots"), "next_spots")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are similar; lengths alone rule some out before sets are intersected."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("spots").alias(f"s{x}"))
    n, m = F.size("sa"), F.size("sb")
    alike = let(F.size(F.array_intersect("sa", "sb")), lambda s: 100 * s >= percent * (n + m - s))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(F.when(100 * F.least(n, m) >= percent * F.greatest(n, m), alike)).select("a", "b")


def near_copies(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", anchors: frozenset[str] = ANCHORS, chain: int = CHAIN
) -> DataFrame:
    """Per document row: id, n_spots, class_id (smallest id reachable by links of that similarity, itself included)."""
    found = docs.select(F.col(id_col).alias("id"), spots(F.col(text_col), anchors, chain).alias("spots"))
    rows = stored(found.select("id", "spots", F.size("spots").alias("n"), F.sha2(F.array_join("spots", ""), 256).alias("node")), "spots")
    sets = stored(rows.where("n > 0").select("node", "n", "spots").dropDuplicates(["node"]), "sets")
    each = sets.select("node", "n", F.explode("spots").alias("gram"))
    counts = each.groupBy("gram").count()
    by_rarity = Window.partitionBy("node").orderBy("count", "gram")
    placed = each.join(counts, "gram").withColumn("pos", F.row_number().over(by_rarity) - 1)
    front = stored(placed.where((F.col("count") > 1) & (100 * (F.col("n") - F.col("pos")) >= percent * F.col("n"))).drop("count"), "front")
    nodes = front.groupBy("node").agg(F.min("pos").alias("lead"), F.count("*").alias("n_shared"))
    labels = linked(stored(front.join(nodes, "node"), "led"), lambda pairs: _similar(pairs, sets, percent), percent)
    marked = relabelled(rows.select("id", "n", "node"), labels)
    least = marked.where("n > 0").groupBy("label").agg(F.min("id").alias("class_id"))
    out = marked.join(least.withColumnRenamed("label", "of"), (F.col("label") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_spots"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
