"""Sizes, ratios and counts of what was packed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def original_bytes(files: DataFrame) -> DataFrame:
    """One row: bytes of images as stored, of texts after newlines were made LF."""
    size = F.when(F.col("file_type") == "g", F.col("n_bytes")).otherwise(F.octet_length("text").cast("long"))
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("orig_bytes"))


def by_type(files: DataFrame) -> DataFrame:
    """(file_type, files, exts): how many of each type, and their extensions in order."""
    return files.groupBy("file_type").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"))


def ratio(orig, packed):
    """(percent, ratio) columns; null where a size is 0."""
    return (100 * packed / F.nullif(orig, F.lit(0))).alias("percent"), (orig / F.nullif(packed, F.lit(0))).alias("ratio")
