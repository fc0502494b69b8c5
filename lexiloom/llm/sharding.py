"""Sharding by sampled splitters, with shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts lie side by side and yet any
group can be cut. Keys are drawn with a chance in proportion to their bytes; quantiles of the sample
cut the key space into many ranges, and a range that turns out overfull is cut again by a denser sample
of its own. Exact sizes of the ranges (a few hundred numbers) give each range its offset in the whole,
a running sum inside the range gives each row its own, and the offset in bytes decides the shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .ranges import packed

SAMPLE_PER_RANGE = 32
RANGES_PER_SHARD = 24
OVERFULL = 3.0
ROUNDS = 3
RECORD_BYTES = 8


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; shards differ by a record's size at most. ``slot``
    counts a shard's rows from 0 without gaps, in key order. A null text has size 8 and the
    checksum of the empty text; null ids and repeated rows are rows like others, so each has a slot of its
    own. An empty table gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    # Fixed once written: the row number can then cut even a group of equal rows.
    base = cut(base.withColumn("d", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))).withColumn("n", F.monotonically_increasing_id()))
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = shards * RANGES_PER_SHARD
    chance = F.abs(F.xxhash64("h", "d", "n") % F.lit(1 << 40)) / F.lit(float(1 << 40))

    def drawn(df: DataFrame, rate: float) -> np.ndarray:
        got = df.where(chance < F.col("size") * F.lit(rate)).select("h", "d", "n").toPandas()
        return np.sort(packed(got["h"], got["d"], got["n"]))

    def ranged(cuts: np.ndarray) -> DataFrame:
        @F.pandas_udf("int")
        def range_of(h: pd.Series, d: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, packed(h, d, n), side="right").astype(np.int32))

        return base.withColumn("part", range_of("h", "d", "n"))

    rate = ranges * SAMPLE_PER_RANGE / max(total, 1)
    keys = drawn(base, rate)
    cuts = np.unique(keys[[len(keys) * i // ranges for i in range(1, ranges)]]) if len(keys) else keys
    for again in range(ROUNDS + 1):
        parted = ranged(cuts)
        sizes = parted.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).toPandas().sort_values("part")
        wide = sizes[(sizes["bytes"] > OVERFULL * total / ranges) & (sizes["bytes"] > 2 * sizes["most"])]
        if wide.empty or again == ROUNDS:
            break
        rate *= 8
        more = drawn(parted.where(F.col("part").isin([int(x) for x in wide["part"]])), rate)
        cuts = np.unique(np.concatenate([cuts, more[:: SAMPLE_PER_RANGE // 2]]))
    offsets = [(int(p), int(b), int(r)) for p, b, r in zip(sizes["part"], sizes["bytes"].cumsum() - sizes["bytes"], sizes["rows"].cumsum() - sizes["rows"])]
    # One row for each range: at most a few thousand, whatever the table's size.
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long"))
    inside = Window.partitionBy("part").orderBy("h", "d", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parted.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside)).join(offset, "part")
    before = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = placed.select("id", "size", "crc", F.floor(before.cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("rank"))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
