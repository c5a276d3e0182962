"""The opN_ queries: each applies its operator to the whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.llm import decontaminate, jaccard, lines, mixing, pages, passages, quality, spelling, spotsigs, substrings, tokencount, tokenfile, vectorcodes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(_read(spark, sf_dir, "documents")).drop("kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, _read(spark, sf_dir, "labels"))
    return quality.assess(docs.select("doc_id", "text"), rules, keep=["doc_id"])


def tokenizer_file() -> str:
    """The public byte-level vocabulary, where it is installed; it is never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.tokenised(_read(spark, sf_dir, "documents"), tokenizer_file())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a revision that touches three places."""
    path = tokenizer_file()
    trees = tokencount.build_trees(_read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    revised = tokencount.apply_edits(trees, tokencount.revision(F.col("text")), path)
    return revised.select("doc.doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_revised"), "n_encoded")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.apportion(_read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.encode(_read(spark, sf_dir, "embeddings"))
    return vectorcodes.label_errors(coded).select(
        F.col("id").alias("vec_id"),
        vectorcodes.hex_code(F.col("code")).alias("code"),
        "error",
        "label_error",
        F.sha2(F.lit(vectorcodes.book_digits(books)), 256).alias("codebooks_sha256"),
    )


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edited(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("spots", ",").alias("fingerprint"),
        F.array_join("edited_spots", ",").alias("edited_fingerprint"),
        spotsigs.likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        spotsigs.likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"), spelling.DROP_EVERY)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_ids": op6_token_ids,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_spot_signatures": op12_spot_signatures,
    "op13_spelling_variants": op13_spelling_variants,
}
