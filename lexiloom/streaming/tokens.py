"""Token counts of files that keep arriving. Tokenizing is a narrow plan and the same for a stream; ranks change with every
file, so they are read from the counts when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens


def read_texts(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """A stream of (file_ord, text, arrived): each new file below a directory, whole. The ordinal is a hash of the path."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(directory)
    source = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"))
    return source.select(F.abs(F.xxhash64("path")).alias("file_ord"), F.col("value").alias("text"), "arrived")


def token_counts(texts: DataFrame) -> DataFrame:
    """(ttype, tstr, n) of a stream or a table of texts."""
    return tokens.tokens(texts).groupBy("ttype", "tstr").agg(F.count("*").alias("n"))


def windowed_counts(texts: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, ttype, n): tokens by window of arrival; what comes later than ``late`` isn't counted, and its state is dropped."""
    timed = texts.withWatermark("arrived", late)
    per_file = tokens.lines(timed.withColumn("file_ord", F.unix_micros("arrived")))
    found = per_file.select(F.timestamp_micros("file_ord").alias("arrived"), F.explode(F.regexp_extract_all("line", F.lit(tokens.TOKEN), F.lit(0))).alias("tstr"))
    typed = found.withColumn("ttype", tokens.token_type(F.col("tstr"))).where("ttype is not null")
    return typed.groupBy(F.window("arrived", every).alias("w"), "ttype").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "ttype", "n")


def write_counts(counts: DataFrame, name: str, checkpoint: str):
    """Starts a query that keeps the counts in a table in memory, for looking at."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
