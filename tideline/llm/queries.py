"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bitplanes, byte_bpe, decontamination, exact_dedup, langid, lexical_search, licenses, line_dedup, order_minhash, packing, quality, spelling, tokens, toxicity
from tideline.session import read_table


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokens.read_tokenizer(_tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(read_table(spark, sf_dir, "documents"), spec, end_id=1).drop("ids", "source")


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokens.read_tokenizer(_tokenizer_path("word_bpe_49k.json"))
    return bitplanes.read_token_files(bitplanes.write_token_files(read_table(spark, sf_dir, "documents"), spec, end_id=2))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = byte_bpe.model_from_ranks(byte_bpe.read_ranks(_tokenizer_path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), spec)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_bit_planes": op2_bit_planes,
        "op3_language_mixture": op3_language_mixture,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_order_minhash": op6_order_minhash,
        "op7_license_scan": op7_license_scan,
        "op8_toxicity": op8_toxicity,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_line_dedup": op10_line_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_decontamination": op12_decontamination,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    from tideline.llm import oracles

    return oracles.oracle_sql()
