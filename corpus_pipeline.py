"""Corpus pipeline: language ID, toxicity, exact dedup, near-duplicate removal, packing.

Every stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents and only drop rows.

Defined results, for every stage: an empty table gives an empty table; null ids, languages, sources and counts pass through;
columns beyond those of documents are dropped, whatever their names. Null texts and texts without letters go in the first
stage. Rows that repeat as a whole stay until exact dedup keeps one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, langid, order_minhash, packing, tokens, toxicity
from tideline.session import checkpoint_root, read_table

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.4
MOST_TOXIC_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no known language, and those whose best language holds less than LEAST_LANGUAGE_SCORE of them.

    Null, empty and letterless texts are in no language. Of tied languages the first that sorts is the best one.
    """
    scored = langid.predict(docs.select(DOCUMENT_COLUMNS), langid.fit(docs))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return scored.filter(known).select(DOCUMENT_COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score as toxic, those at exactly MOST_TOXIC_SCORE included; equal texts share one decision."""
    scored = toxicity.predict(docs.select(DOCUMENT_COLUMNS), toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") < MOST_TOXIC_SCORE).select(DOCUMENT_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that of the largest id, a null id being smallest; of rows that repeat both, one."""
    return exact_dedup.keep_first_copies(docs).select(DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the least id, a null id being largest, then of the least
    hash of the text."""
    return order_minhash.keep_one_of_each_class(docs).select(DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens that hold the sources in proportion: pieces with their token ids,
    which stand in a sequence at their offset.

    A null source is a source of its own; pieces of rows with a null id have a null doc_id.
    """
    import public_tokenizers

    return packing.pack(docs, tokens.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the fitted models nor the sketches; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below the shared folder and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{checkpoint_root(spark)}/tideline/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
