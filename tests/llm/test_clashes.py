"""Columns that are named like an operator's working columns keep their values."""

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, near_dedup, pii, quality

NAMES = ["_rid", "_h", "_kept", "_id", "_hit", "_hit_text", "_quality_score", "_pii_text", "_PII_Email", "_pii_runs", "_pii_spans", "pii_spans", "h", "kept", "a.b"]
LONG = "one two three four five six seven eight nine ten"
ROWS = [(1, LONG), (2, LONG + " "), (3, "write to a@b.org or c@d.com now"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    return plain.select("*", *[F.concat(F.lit(n + "/"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def kept(docs, done, ids):
    assert done.columns == docs.columns
    rows = sorted(done.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == ids
    assert all(r[n] == f"{n}/{r.doc_id}" for r in rows for n in NAMES)
    return rows


def test_keep_one(docs):
    kept(docs, near_dedup.keep_one(docs), [1, 3, 4, 5])


def test_clean(spark, docs):
    items = spark.createDataFrame([(7, LONG, "x")], "item_id long, text string, h string")
    kept(docs, decontaminate.clean(docs, items), [3, 4, 5])


def test_redact(docs):
    rows = kept(docs, pii.redact(docs), [1, 2, 3, 4, 5])
    assert rows[2].text == "write to <EMAIL> or <EMAIL> now" and rows[3].text is None


def test_redact_another_column(docs):
    named = docs.withColumnRenamed("text", "body").withColumn("text", F.lit("e@f.org"))
    rows = kept(named, pii.redact(named, "body"), [1, 2, 3, 4, 5])
    assert rows[2].body == "write to <EMAIL> or <EMAIL> now" and {r.text for r in rows} == {"e@f.org"}


def test_keep_good(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept(docs, quality.keep_good(docs, labels), [1, 2, 3, 4, 5])  # one label only: every score is 0.5
