"""Vector codes, SpotSigs and spelling variants against plain reckonings, and template texts in the n-gram join."""

import random

import pytest
from pyspark.sql import functions as F

from effortlens.llm import jaccard, links, mixing, quality, spelling, spotsigs, vectorcodes
from tests.llm import plain
from tests.llm.test_edges import frame, prose

VECTORS = "vec_id long, embedding array<double>, label int"
INF, NAN = float("inf"), float("nan")


def coded(spark, rows, **kw):
    docs = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ["id", "vector", "code", "error", "_label", "part", "entry", "at", "n", "a.b"]})
    found, books = vectorcodes.encode(docs.repartition(3), **kw)
    out = [(r["id"], [int.from_bytes(r["code"][k : k + 2], "big") for k in range(0, len(r["code"]), 2)], r["error"]) for r in found.collect()]
    return sorted(out, key=lambda r: (r[0] is None, r[0])), [b.tolist() for b in books]


@pytest.mark.parametrize(("entries", "parts", "low", "high"), [(7, 4, -1, 1), (20, 2, -3, 3), (5, 3, -(2**20), 2**20), (9, 4, -(2**45), 2**45), (300, 1, -1, 1)])
def test_codes_against_every_entry(spark, entries, parts, low, high):
    r = random.Random(entries)
    rows = [(i, [r.uniform(low, high) for _ in range(8)], i % 3) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1], None) for i in range(40)]  # ties of all kinds
    found, books = coded(spark, rows, entries=entries, parts=parts)
    want, want_books = plain.vector_codes([x[:2] for x in rows], parts, entries)
    assert books == want_books
    assert [x[:2] for x in found] == [(i, want[i][0]) for i, _, _ in found]
    assert [e for *_, e in found] == [want[i][1] if want[i][1] < 2**63 else None for i, _, _ in found]


def test_codes_of_odd_vectors(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [NAN], 1), (4, [INF, 1.0], None), (5, [], None), (6, [-0.0001], None), (7, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (8, [2.0**60], 2)]
    rows += [(None, [0.5, 0.25], None), (9, [0.5, 0.25], 3), (9, [0.5, 0.25], 3), (9, [0.25, 0.5], 3)]
    found, books = coded(spark, rows)
    assert [i for i, *_ in found] == [5, 6, 7, 9, 9, 9, None] and all(e == 0 for *_, e in found)
    assert [len(b) for b in books] == [7] * 4 and [len(b[0]) for b in books] == [2] * 4
    assert books[0][1] == [-1, 0]  # floor, not rounding towards zero
    assert coded(spark, rows[:4]) == ([], [[]] * 4) and coded(spark, []) == ([], [[]] * 4)
    sums = vectorcodes.label_errors(spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 1, 7), (4, 1, None)], "id long, label int, error long"))
    assert {r["id"]: r["label_error"] for r in sums.collect()} == {1: 11, 2: 11, 3: 7, 4: 7}


def spots_by_hand(text):
    """The chains of a text as word tuples, by a loop over its words."""
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split() if w]
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found, bare = set(), 0
    for k, i in enumerate(content):
        gap = words[content[k - 1] + 1 if k else 0 : i]
        bare = 0 if gap or not k else bare + 1
        if bare >= spotsigs.RUN:
            gap = [words[i - 1]]
        if k + 1 < len(content):
            found |= {(a, words[i], words[content[k + 1]]) for a in gap}
    if not found and words:
        found = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return found


TEXTS = [None, "", "  ", "!!", "one", "the", "the the of", "The cat of Rome", "a b c d e f g h i j k l m n o p q r s t", "La maison de l'Éte est à nous", "x" * 5000, "of " * 3000 + "end word"]


def test_spots_against_a_loop(spark):
    r = random.Random(1)
    vocabulary = ["the", "of", "and", "de", *[f"w{i}" for i in range(30)]]
    texts = TEXTS + [" ".join(r.choices(vocabulary, k=r.randrange(60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    digest = spark.createDataFrame([(" ".join(s),) for s in {s for t in texts for s in spots_by_hand(t)}], "s string").select("s", F.substring(F.md5("s"), 1, spotsigs.DIGITS).alias("h"))
    named = {x["s"]: x["h"] for x in digest.collect()}
    for x in rows.select("doc_id", spotsigs.spots(F.col("text")).alias("spots")).collect():
        assert x["spots"] == sorted({named[" ".join(s)] for s in spots_by_hand(texts[x["doc_id"]])}), texts[x["doc_id"]]


def test_edited_texts_follow_the_order_of_ids(spark):
    rows = [(i, t, "s") for i, t in zip([3, 9, 1, 7, 5, 20, 21, 22, 23, 24, 25, 26], TEXTS, strict=True)] + [(100 + i, prose(i, 3 * i), "s") for i in range(30)] + [(None, "no id at all", "s")]
    found = {x["id"]: x for x in spotsigs.edited(frame(spark, rows).repartition(7)).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    assert len(found) == len(rows)
    for (i, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after, third = text or "", after or "", len(text or "") // 3
        assert (found[i]["text"], found[i]["edited_text"]) == (text, text[: len(text) - third] + after[:third])
    twice = spotsigs.edited(frame(spark, [(1, "some text here", "a"), (1, "some text here", "a"), (2, "other", "a")])).collect()
    assert sorted((x["id"], x["edited_text"]) for x in twice) == [(1, "some text othe"), (1, "some text some"), (2, "othes")]
    assert spotsigs.edited(frame(spark, [])).collect() == []
    assert [x["edited_text"] for x in spotsigs.edited(frame(spark, [(4, "abcdef", "a")])).collect()] == ["abcdab"]


def test_likeness(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [x[0] for x in rows.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0, 1.0]


def test_near_copies_against_all_pairs(spark):
    r = random.Random(6)
    common = ["the", "of", "and", "to"]
    rows = [(2000, None, "s"), (2001, "", "s"), (2002, "!", "s")]
    for g in range(5):
        base = [x for k in range(60) for x in (r.choice(common), f"w{g}x{k}", f"v{g}x{k}")]
        for k in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = f"edit{r.randrange(100_000)}"
            rows.append((g * 100 + k, " ".join(w), "s"))
    sets = {i: spots_by_hand(t) for i, t, _ in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    found = {x["doc_id"]: (x["n_spots"], x["class_id"]) for x in spotsigs.near_copies(frame(spark, rows)).collect()}
    assert found == {i: (len(s), find(i)) for i, s in sets.items()}
    assert spotsigs.near_copies(frame(spark, [])).collect() == []


def template(n, words=29):
    """Texts that differ in one word in the middle: they share grams, and no two are similar."""
    frame_ = [f"t{k}" for k in range(words)]
    return [(i, " ".join([*frame_[: words // 2], f"own{i}", *frame_[words // 2 + 1 :]]), "s") for i in range(n)]


def test_texts_of_one_template_make_no_pairs(spark, monkeypatch):
    made = []
    pairs = links.remaining_pairs
    monkeypatch.setattr(links, "remaining_pairs", lambda now, percent: made.append((now.count(), pairs(now, percent).count())) or pairs(now, percent))
    rows = template(20_000) + [(50_000, prose(1, 200), "s"), (50_001, prose(1, 200) + " end", "s")]
    found = jaccard.components(frame(spark, rows)).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == {i: 50_000 if i == 50_001 else i for i, _, _ in rows}
    assert made and made[0][0] >= 20_000 and made[0][1] == 0


def test_templates_of_many_sizes_lose_no_link(spark):
    r, rows = random.Random(9), []
    for words in (12, 29, 45, 60, 90, 140):
        rows += [(words * 1000 + i, t, s) for i, t, s in template(12, words)]
        rows += [(words * 1000 + 100 + i, " ".join(t.split()[: words - r.randrange(words // 4)]), s) for i, t, s in template(8, words)]
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.components(frame(spark, rows)).collect()}
    assert found == plain.components([x[:2] for x in rows])


def near_by_hand(words):
    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]

    return {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


@pytest.mark.parametrize("crowded", [2, 5, 1000])
def test_near_words_against_all_pairs(spark, crowded):
    r = random.Random(crowded)
    words = {"".join(r.choices("abé", k=r.randrange(5, 8))) for _ in range(150)} | {"straße", "strasse", "straßen", "xxxxxxxxxx", "xxxxxxxxxy", "×÷×÷×", "×÷×÷"}
    found = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowded).collect()
    assert {tuple(sorted((x["a"], x["b"]))) for x in found} == near_by_hand(words) and len(found) == len(near_by_hand(words))


def test_forms_follow_the_commonest(spark):
    counts = {"colour": 100, "color": 40, "colours": 50, "colors": 12, "colorss": 3, "colosr": 12, "lonely": 7, "aaaaa": 4, "aaaab": 8, "aaaac": 8}
    found = {x["word"]: x for x in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    pairs = near_by_hand(counts)
    near = {w: {x for p in pairs if w in p for x in p if x != w} for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * n else None
        x = found[w]
        assert (x["n"], x["n_near"], x["form"], x["form_n"]) == (n, len(near[w]), form, counts.get(form))
        assert x["root"] == (w if form is None else found[form]["root"])
    assert found["colorss"]["root"] == "colour" and found["aaaaa"]["form"] == "aaaab"


def test_words_of_odd_texts(spark, monkeypatch):
    rows = [(1, None, "s"), (2, "", "s"), (3, "Straße STRASSE straße, naïve-naïve; ÀÉÎÕÜ abcd", "s"), (3, "Straße STRASSE straße, naïve-naïve; ÀÉÎÕÜ abcd", "s"), (4, "longer " * 1000, "s"), (None, "longer longer", "s")]
    want = {"straße": 4, "naïve": 4, "ÀÉÎÕÜ": 2, "strasse": 2, "longer": 1002}
    for piece in (7, 1 << 20):
        monkeypatch.setattr(spelling, "PIECE", piece)
        runs = [w for _, t, _ in rows for part in spelling._runs(t or "") for w in part]
        assert sum(w == "longer" for w in runs) == 1002 and sum(w == "naïve" for w in runs) == 4
    found = spelling.vocabulary(frame(spark, rows), min_count=1).collect()
    assert {x["word"]: x["n"] for x in found} == want
    assert {x["word"] for x in spelling.vocabulary(frame(spark, rows)).collect()} == {"straße", "naïve", "longer"}
    assert spelling.spelling_variants(frame(spark, []), 97).collect() == []
    assert spelling.spelling_variants(frame(spark, rows), 1).count() >= 0


def test_columns_with_dots_and_backquoted_names(spark):
    docs = frame(spark, [(i, prose(i, 40), f"s{i % 2}") for i in range(6)]).withColumn("a.b", F.lit(1)).withColumn("order by", F.lit(2))
    for kept in (mixing.mix(docs, n_chars_col="n_chars"), quality.keep_good(docs, []), jaccard.keep_first(docs)):
        assert kept.columns == docs.columns and kept.count() >= 1
        assert {(r["a.b"], r["order by"]) for r in kept.collect()} == {(1, 2)}
