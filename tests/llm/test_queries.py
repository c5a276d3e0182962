"""The opN_ queries and the pipeline on the smallest tables, against SQL or a plain reckoning."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from effortlens.llm import quality
from effortlens.llm.oracle import ORACLE
from effortlens.llm.queries import QUERIES
from tests.compare import SF, duck_rows, spark_rows
from tests.llm import plain


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLE[name])


def test_jaccard_against_all_pairs(spark, docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_ngram_jaccard"](spark, SF).collect()}
    assert found == plain.components(list(zip(docs.doc_id, docs.text, strict=True)))


def test_quality_statistics_and_verdicts(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs.itertuples():
        r = rows[d.doc_id]
        assert tuple(r[c] for c in quality.BASE) == plain.base_statistics(d.text)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rejected_by"] is None)


def _encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs):
    encode, rows = _encode(), {r["doc_id"]: r for r in QUERIES["op6_token_ids"](spark, SF).collect()}
    start = 0
    for d in docs.sort_values("doc_id").itertuples():
        ids = np.array([*encode(d.text or ""), 0], dtype="<u4")
        r = rows[d.doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_counts_before_and_after_edits(spark, docs):
    encode, rows = _encode(), {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    for d in docs.itertuples():
        text = d.text or ""
        n, half, revised = len(text), len(text) // 2, text
        if n >= 64:
            revised = text[:half] + "s and, later  on, the rest" + text[half + 20 : n - 9]
        r = rows[d.doc_id]
        assert (r["n_tokens"], r["n_tokens_revised"]) == (len(encode(text)), len(encode("Revised text.\n" + revised)))


def test_extraction_leaves_no_markup(spark):
    rows = QUERIES["op5_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pd.read_parquet(f"{SF}/pages.parquet"))
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        assert "<script" not in r["text"] and "</" not in r["text"]


def test_pipeline_stages(spark, docs):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "token_files":
            assert out.columns == list(docs.columns)
            out = out.cache()
        seen.append((name, {r["doc_id"] for r in out.collect()}))
        kept = out
    by_name = dict(seen)
    good = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert by_name["quality_rules"] == good
    firsts = plain.components([(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if i in good])
    assert by_name["ngram_jaccard"] == {i for i, (_, c) in firsts.items() if i == c}
    dirty = {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, SF).where("contaminated").collect()}
    assert by_name["decontamination"] == by_name["ngram_jaccard"] - dirty
    assert by_name["token_files"] == by_name["mixing"] <= by_name["decontamination"]
