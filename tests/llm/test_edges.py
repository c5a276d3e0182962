"""Defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from effortlens.llm import decontaminate, jaccard, lines, markup, mixing, pages, passages, quality, substrings, tokencount, tokenfile
from effortlens.llm.queries import tokenizer_file
from effortlens.llm.storage import new_folder
from effortlens.llm.tokentree import TokenTree, all_levels, leaf_ends, leaf_texts
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, label string, words string"
#: Names that operators use for columns of their own.
CLASH = ["removed", "_gone", "n_words", "_doc", "_text", "_id", "_own", "_tie", "part", "kept", "size", "key", "node", "gram", "n", "doc", "tree", "whole", "_found", "_stats", "hits", "h", "digest"]
BENCH = "item_id long, text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(40)) for _ in range(n))


def frame(spark, rows):
    docs = spark.createDataFrame([(i, t, None, s, None, "x", 1, "y", "z") for i, t, s in rows], SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def odd(spark):
    shared = prose(1, 80)
    rows = [
        (1, shared, "a"),
        (2, prose(2, 30) + "\n" + shared + " " + prose(3, 30), "a"),
        (3, shared, "a"),
        (3, shared, "a"),
        (4, None, None),
        (5, "", "b"),
        (6, " \t\n\x0b ", "b"),
        (7, "two words", "b"),
        (8, prose(4, 6000), "c"),
        (9, "x" * 50_000, "c"),
        (None, shared, "c"),
        (10, prose(5, 60), None),
        (10, prose(6, 60), None),
        (11, "word " * 300, "a"),
    ]
    return rows, frame(spark, rows)


OPERATORS = {
    "decontaminate": lambda d, b: decontaminate.contamination(d, b),
    "decontaminate_by_shuffle": lambda d, b: decontaminate.contamination(d, b, max_broadcast_bytes=0),
    "remove_contaminated": lambda d, b: decontaminate.remove_contaminated(d, b),
    "remove_spans": lambda d, b: decontaminate.remove_spans(d, b),
    "lines": lambda d, b: lines.line_report(d),
    "remove_lines": lambda d, b: lines.remove_lines(d),
    "passages": lambda d, b: passages.remove_passages(d),
    "quality": lambda d, b: quality.assess(d, []),
    "substrings": lambda d, b: substrings.remove_repeats(d),
    "jaccard": lambda d, b: jaccard.components(d),
    "mixing": lambda d, b: mixing.apportion(d),
    "token_files": lambda d, b: tokenfile.tokenised(d, tokenizer_file()),
    "token_counts": lambda d, b: tokencount.count_tokens(tokencount.build_trees(d, tokenizer_file())),
    "apply_edits": lambda d, b: tokencount.apply_edits(tokencount.build_trees(d, tokenizer_file()), tokencount.revision(F.col("text")), tokenizer_file()),
    "mix": lambda d, b: mixing.mix(d, n_chars_col="n_chars").dropDuplicates(["doc_id", "text"]),
    "keep_first": lambda d, b: jaccard.keep_first(d),
    "keep_good": lambda d, b: quality.keep_good(d, []),
}
FEWER = {"remove_contaminated", "mix", "keep_first", "keep_good"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_do_not_crash_and_none_is_lost(spark, odd, name):
    rows, docs = odd
    bench = spark.createDataFrame([(1, prose(1, 20)), (None, prose(9, 20)), (2, None), (3, ""), (4, "two words")], BENCH)
    n = OPERATORS[name](docs, bench).count()
    assert n <= len(rows) if name in FEWER else n == len(rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](frame(spark, []), spark.createDataFrame([], BENCH)).collect() == []


@pytest.mark.parametrize("operator", [passages.remove_passages, substrings.remove_repeats])
def test_repeats_against_plain(spark, odd, operator):
    rows = [r for r in odd[0] if r[0] not in (3, 10)] + [(12, prose(7, 49), "a"), (13, prose(7, 49) + " end", "a"), (14, prose(7, 50), "a"), (15, "pre " + prose(7, 50), "a")]
    found = operator(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == plain.repeats_removed([r[:2] for r in rows])


@pytest.mark.parametrize("operator", [passages.remove_passages, substrings.remove_repeats])
def test_many_overlapping_passages(spark, operator):
    r = random.Random(5)
    base = prose(11, 400).split()
    rows = []
    for i in range(40):
        a, n = r.randrange(300), r.randrange(20, 120)
        rows.append((i * 3 % 41, " ".join(prose(100 + i, r.randrange(40)).split() + base[a : a + n] + prose(200 + i, 10).split()), "s"))
    found = operator(frame(spark, rows).repartition(5)).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found} == plain.repeats_removed([x[:2] for x in rows])


def test_jaccard_groups_against_plain(spark):
    r = random.Random(3)
    rows = []
    for g in range(6):
        base = prose(50 + g, 90).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            rows.append((g * 100 + k, " ".join(w), "s"))
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.components(frame(spark, rows)).collect()}
    assert found == plain.components([x[:2] for x in rows])


def test_near_lines(spark):
    rows = [(1, "a line of some length\nanother one here", "s"), (2, "A line of some length\nanother one here\nshort", "s"), (3, "a line of some lengths\nshort\nnothing alike at all", "s")]
    found = {x["doc_id"]: x["removed"] for x in lines.line_report(frame(spark, rows)).collect()}
    assert found == {1: [], 2: [0, 1], 3: [0, 1]}


def test_mix_keeps_within_caps(spark):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 5}") for i in range(400)] + [(1000 + i, prose(i, 3), None) for i in range(20)]
    found = mixing.apportion(frame(spark, rows)).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert sum(t for _, t in {(r["source_size"], r["target"]) for r in found}) == pytest.approx(sum(r["size"] for r in found))
    assert sum(r["taken"] for r in found) == pytest.approx(sum(r["size"] for r in found), abs=6)
    docs = mixing.mix(frame(spark, rows), n_chars_col="n_chars")
    assert docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in found)


def test_pages_drop_the_template(spark):
    page = "<html><body><div class='top'>Site name</div><ul><li>Home</li></ul><p>{}</p><p>Second&nbsp;part &amp; more</p><footer>Imprint</footer></body></html>"
    rows = [(i, f"https://h.example/a/{i}", page.format(f"Body of page {i}").replace("Second", f"Second {i}")) for i in range(4)]
    rows += [(9, None, None), (10, "https://x.example/", ""), (11, "https://x.example/q", "<article><h1>T</h1><p>Text</p></article><nav>menu</nav>")]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == "Body of page 2\n\nSecond 2 part & more"
    assert (found[9], found[10], found[11]) == ("", "", "T\n\nText")


def test_differencing_decides_beside_an_article(spark):
    page = "<body><div>Site name</div><article><p>Teaser {0}</p><p>Quoted by all</p></article><p>Body of page {0}</p><p>Imprint</p><nav>menu {0}</nav></body>"
    rows = [(i, f"https://h.example/a/{i}", page.format(i)) for i in range(4)]
    rows += [(4, "https://h.example/a/3b", page.format(3))]  # a copy of its neighbour 3
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert found[i] == f"Teaser {i}\n\nQuoted by all\n\nBody of page {i}"
    assert {"Teaser 3", "Body of page 3"} <= set(found[4].split("\n\n"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><meta charset='utf-8'><title>T</title><body><p>Text</p></body></html>", ["Text"]),
        ("<html><head><title>a <div> b</title><style>p{}</style><p>Text<p>More", ["Text", "More"]),
        ("<head><script>x</script><noscript>off<body><p>Text", ["Text"]),
        ("<head><title>T</title></head><body><header>Top</header><p>Text</p>", ["Text"]),
        ("<body><div><select><option>a</div><p>Text</p>", ["Text"]),
        ("<body><div><svg><text>x</div><p>Text</p><svg><text>y</text></div>", ["Text"]),
        ("<body><ul><li><object data=x>old</ul><p>Text</p><script>p(1)", ["Text"]),
        ("<body><p>Text <svg><text>x</text></svg>more</p>", ["Text more"]),
        ("<head>Text", ["Text"]),
    ],
)
def test_markup_without_end_tags_keeps_the_text(page, text):
    assert [line for line, kind in markup.lines(page) if kind != markup.DROP] == text


def test_orc_files_prune_by_id(spark, odd):
    folder = new_folder(spark, "tokens")
    tokenfile.write_tokens(odd[1].where("doc_id IS NOT NULL"), folder, tokenizer_file())
    found = tokenfile.read_tokens(spark, folder, [7])
    assert [r["doc_id"] for r in found.collect()] == [7]
    assert "doc_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_tree_edits_against_encoding_anew():
    from effortlens.llm.encoder import Encoder

    encoder, r = Encoder(tokenizer_file()), random.Random(8)
    text = prose(3, 120) + "\n\n  It's  odd… <|endoftext|> ünïcode 　x " + prose(4, 60)
    ends = leaf_ends(text, 40)
    tree = TokenTree(text, all_levels(np.diff(ends, prepend=0)), all_levels(encoder.count(pa.array(leaf_texts(text, ends)))), 40)
    assert tree.n_tokens == len(encoder.encode_whole(text))
    for _ in range(250):
        a = r.randrange(len(tree.text) + 1)
        b = min(len(tree.text), a + r.choice([0, 1, 3, 30, 90]))
        tree.edit(a, b, r.choice(["", " ", "  ", "x", " new words ", "\n", "'s", "<|endo", " 12 34", "漢字。かな", prose(9, 30)]), encoder.count_few)
        assert tree.n_tokens == len(encoder.encode_whole(tree.text))
        assert tree.chars[: tree.sizes[0]].sum() == len(tree.text) == (tree.chars[-1] if len(tree.chars) else 0)
        assert (tree.tokens == all_levels(tree.tokens[: tree.sizes[0]])).all()


def test_texts_without_spaces_have_many_leaves_and_an_edit_touches_few():
    from effortlens.llm.encoder import Encoder

    encoder, text = Encoder(tokenizer_file()), "漢字と12。かな," * 2000
    ends = leaf_ends(text)
    assert len(ends) > 100
    tree = TokenTree(text, all_levels(np.diff(ends, prepend=0)), all_levels(encoder.count(pa.array(leaf_texts(text, ends)))))
    tree.edit(9000, 9003, "neu", encoder.count_few)
    assert tree.n_tokens == len(encoder.encode_whole(tree.text)) and tree.encoded_chars < 600


def test_encoder_that_forgets_still_agrees():
    from effortlens.llm.encoder import Encoder

    encoder = Encoder(tokenizer_file(), max_cached=200, max_bytes=2000)
    texts = [prose(k, 40) + t for k, t in enumerate(["", " ", "\n", "\n\n", " .", "  two", " <|endoftext|> x", "\u3000", " é\n"] * 4)]
    for k in range(0, len(texts), 3):
        lengths, ids = encoder.encode(pa.array(texts[k : k + 3]))
        whole = [encoder.encode_whole(t) for t in texts[k : k + 3]]
        assert lengths.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])


def test_a_word_is_encoded_once_whatever_sign_follows():
    from effortlens.llm.encoder import Encoder

    encoder, words = Encoder(tokenizer_file()), ["maison", "été", "Straße", "year", "x×y", "½"]
    texts = ["".join(f" {w}{s}" for w in words for s in ["", ".", ",", "!?", "'s", "-bar", "\nThe", "<|endoftext|>", ">.", "é.\n\nÀ,", "7.", "\u0301,"]) + end for end in ["", ".", "\n", " "]]
    lengths, ids = encoder.encode(pa.array(texts))
    whole = [encoder.encode_whole(t) for t in texts]
    assert lengths.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])
    few = Encoder(tokenizer_file())
    few.encode(pa.array([" word word. word, word! word\nword word; word"]))
    assert set(few._known) == {" word", ".", ",", "!", ";", "\nword"}


def test_edits_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, prose(2, 200)), (4, prose(2, 200)), (5, "x" * 3000)]
    trees = tokencount.build_trees(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file())
    edits = F.expr("array(struct(3 as start, 900 as end, 'two' as inserted), struct(1 as start, 2 as end, cast(null as string) as inserted), struct(5000 as start, 1 as end, ' end' as inserted))")
    from effortlens.llm.encoder import Encoder

    encoder = Encoder(tokenizer_file())
    for r in tokencount.apply_edits(trees, edits, tokenizer_file()).collect():
        text = dict(rows)[r["doc"]["doc_id"]] or ""
        n = len(text)
        want = text[: min(1, n)] + text[min(2, n) : min(3, n)] + "two" + text[min(900, n) :] + " end"
        assert (r["text"], r["n_before"], r["n_tokens"]) == (want, len(encoder.encode_whole(text)), len(encoder.encode_whole(want)))
        assert r["tree"]["tokens"][-1] == r["n_tokens"]


def test_token_starts_do_not_depend_on_files(spark):
    docs = frame(spark, [(i % 150, prose(i, 1 + i % 50), "s") for i in range(200)])
    want = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in tokenfile.tokenised(docs, tokenizer_file()).collect()}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        found = tokenfile.tokenised(docs, tokenizer_file()).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in found} == want
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("sizes", [{"a": [20], "b": [30], "c": [25, 26]}, {"a": [20], "b": [30], "c": [25, 27]}, {"a": [7, 7], "b": [1], "c": [40], "d": [3]}])
def test_every_source_comes_near_its_target(spark, sizes):
    rows = [(100 * k + i, " ".join(["w"] * n), s) for k, (s, docs) in enumerate(sizes.items()) for i, n in enumerate(docs)]
    docs = frame(spark, rows)
    source = {i: s for i, _, s in rows}
    taken, target = {}, {}
    for r in mixing.apportion(docs).collect():
        s = source[r["doc_id"]]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes), (taken, target)
    mixed = {r["source"]: r["n"] for r in mixing.mix(docs).select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert {s: n for s, n in taken.items() if n} == mixed


def test_rules_reject_what_they_learn():
    rows = [({"a": float(i % 10), "b": float(i % 7)}, i % 10 >= 8) for i in range(300)]
    found = quality.learn_rules(rows, ["a", "b"])
    assert len(found) == 1 and found[0].conditions[0].statistic == "a" and found[0].conditions[0].at_least
    assert quality.learn_rules([], ["a"]) == []


def test_components_of_chains_stars_and_loops(spark):
    from effortlens.llm.components import connected_components

    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (900, 800), (800, 850)]
    edges += [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(50)]
    r.shuffle(edges)
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["label"] for x in found} == {i: find(i) for i in list(top)}


def test_large_and_small_benchmarks_take_either_way(spark, odd):
    """10^5 windows go the same way as a few; the shuffle beyond the bound finds the same."""
    bench = spark.createDataFrame([(k, prose(k, 260)) for k in range(420)] + [(9999, "two words"), (9998, None)], BENCH)
    assert decontaminate.benchmark_windows(bench).count() > 100_000
    docs = odd[1].where("doc_id IS NULL OR doc_id <> 3")
    found = decontaminate.contamination(docs, bench)
    assert "ScalarSubquery" in found._jdf.queryExecution().toString() or "scalar-subquery" in found._jdf.queryExecution().toString()
    rows = {tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.concat_ws(",", "items"), "contaminated").collect()}
    other = decontaminate.contamination(docs, bench, max_broadcast_bytes=0)
    assert rows == {tuple(r) for r in other.select("doc_id", "n_words", "n_hit", F.concat_ws(",", "items"), "contaminated").collect()}
    assert sum(r[4] for r in rows) == 6


def test_common_lines_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([bytes([r.randrange(5)]) for _ in range(r.randrange(14))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        found = pages.common_lines(a, b)
        assert len(found) == length[-1][-1] and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)
    assert len(pages.common_lines([b"x"] * 20_000, [b"y"] + [b"x"] * 19_000 + [b"z"])) == 19_000


def test_pages_of_odd_rows_and_their_gold_texts(spark):
    """Template in <main> as well as around it: what neighbours share outside the article goes, the rest stays."""
    page = (
        "<html><head><title>t</title></head><body><div>Site {0[0]}</div><ul><li>Home</li><li>News</li></ul><div><h2>{1}</h2>"
        "<p>Body &eacute; of\n  {1}</p><p>More on {1}</p></div><p>All rights reserved</p><div class=comments>me too {1}</div></body></html>"
    )
    rows = [(i, f"https://h.example/{'abc'[i % 3]}/{i:02d}", page.format("X", f"story {i}")) for i in range(9)]
    gold = {i: f"story {i}\n\nBody é of story {i}\n\nMore on story {i}" for i in range(9)}
    rows += [(20, rows[3][1], rows[3][2]), (21, None, "<p>alone"), (22, "", None), (23, "https://long.example/", "<p>" + "word " * 200_000)]
    rows += [(24, "https://long.example/x", "".join(f"<p>line {k % 7}" for k in range(5000)))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ["key", "sig", "z", "gone", "text", "host", "part", "edge"]})
    found = {r["page_id"]: r["text"] for r in pages.extract(docs).collect()}
    assert {i: found[i] for i in gold} == gold
    assert found[20] == found[3] and found[21] == "alone" and found[22] == "" and found[23] == ("word " * 200_000).strip()
    assert len(found[24].split("\n\n")) == 5000
    assert pages.extract(docs.limit(0)).count() == 0
    without = [text for text, kind in markup.lines(rows[0][2]) if kind != markup.DROP]
    assert "\n\n".join(without) != gold[0]  # markup alone does not get there


def test_near_lines_against_all_pairs(spark):
    r = random.Random(12)
    base = [prose(k, r.randrange(1, 6)) for k in range(12)]

    def spoilt(line):
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(line) + 1)
            line = r.choice([line[:k] + line[k + 1 :], line[:k] + "é" + line[k:], line[:k] + "q" + line[k + 1 :]])
        return line

    rows = [(i * 7 % 31, "\n".join(r.choice(["", " ", ""]) + spoilt(r.choice(base)) for _ in range(6)), "s") for i in range(31)]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < lines.MIN_CHARS or abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]

    want, before = {}, []
    for i, text, _ in sorted(rows):
        want[i] = []
        for no, line in enumerate(x.strip(" \t\r\x0b\x0c") for x in text.split("\n")):
            if line:
                if any(near(line, x) for x in before):
                    want[i].append(no)
                before.append(line)
    assert {x["doc_id"]: x["removed"] for x in lines.line_report(frame(spark, rows)).collect()} == want
