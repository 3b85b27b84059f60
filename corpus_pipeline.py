"""A corpus pipeline over documents: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read back before the
next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from quarry.llm.common import row_key, table, with_text_key, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document isn't predicted toxic; a null doc_id goes with the scores of its own text.

    Repeated rows go or stay together; null and empty texts have the prior for a score; an empty table stays empty; all
    columns come back as they were, whatever their names.
    """
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), with_text_id=True)
    gone = scored.where("predicted = 1").select(row_key().alias("rid"), F.col("text_id").alias("sha")).distinct()
    return with_text_key(docs).join(gone, ["rid", "sha"], "left_anti").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, nulls last; null and empty texts are equal, repeated rows leave one."""
    return exact_dedup.keep_unique(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the row with the smallest doc_id, nulls last; texts without words are one group."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with the secrets in their texts masked; null texts stay null and n_chars follows the text."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of power-of-two lengths; a null or empty text has its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Toxicity scores and token ids can't be had in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
