"""From raw documents to training sequences: five stages, each one operator of lexiloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that can be written and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, near_dedup, pieces, pii, quality
from lexiloom.llm.common import cut, table

WORDS = 5
MODEL = "piece_bpe_32k.model"


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates, five-word shingles at 0.8."""
    return near_dedup.keep_one(docs, k=WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``pieces``, the piece ids of each text, ``n_pieces``, and ``lossless``, whether decoding them gives the text back; columns of these names are replaced."""
    return pieces.round_trip(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality", good_only),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_pii),
    ("pieces", encoded),
]

#: A fitted classifier, MinHash grouping and subword merges are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
