"""Ranges of documents in order of their ids, each with the first document of the range that follows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, shuffle_parts

SAMPLE_PER_RANGE = 32
RANGES_PER_TASK = 4


def packed(*columns: np.ndarray) -> np.ndarray:
    """Signed 64-bit columns as one byte string each row, which sorts as the tuple does."""
    flipped = np.stack([np.asarray(c).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(flipped.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def descending_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ghost, down, h, id, text), sorted by the first four inside each partition; a part never spans partitions.

    Parts are ranges of (id descending, hash of the text), cut by splitters from a sample weighted by bytes.
    The last row of a part is a ghost: the first document of the next part (after the last part: of the first), so
    that every document can be read together with its successor. Null ids come last, null texts are empty. Only the ghosts, one
    or a few equal rows for each part, are moved twice.
    """
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("down", F.bitwise_not(F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))).withColumn("h", F.xxhash64("text"))
    keys = cut(own.select("down", "h", (F.octet_length("text") + 16).cast("long").alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = RANGES_PER_TASK * shuffle_parts(spark)
    chance = F.abs(F.xxhash64("h", "down") % F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(chance < F.col("size") * F.lit(ranges * SAMPLE_PER_RANGE / max(total, 1))).select("down", "h").distinct().toPandas()
    drawn = np.sort(packed(drawn["down"], drawn["h"]))
    cuts = np.unique(drawn[[len(drawn) * i // ranges for i in range(1, ranges)]]) if len(drawn) else drawn

    @F.pandas_udf("int")
    def part_of(down: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, packed(down, h), side="right").astype(np.int32))

    firsts = keys.groupBy(part_of("down", "h").alias("part")).agg(F.min(F.struct("down", "h")).alias("first")).orderBy("part").collect()  # one row a part
    parts = [r["part"] for r in firsts]
    ghost_of = {bytes(packed(np.array([r["first"]["down"]]), np.array([r["first"]["h"]])).tobytes()): parts[i - 1] for i, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def parts_of(down: pd.Series, h: pd.Series) -> pd.Series:
        at = packed(down, h)
        own_part = np.searchsorted(cuts, at, side="right")
        ghosts = [ghost_of.get(at[i : i + 1].tobytes()) for i in range(len(at))]
        return pd.Series([[int(p)] if g is None else [int(p), g] for p, g in zip(own_part, ghosts)])

    out = own.select("id", "text", "down", "h", F.posexplode(parts_of("down", "h")).alias("ghost", "part"))
    return out.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", "ghost", "down", "h").select("part", "ghost", "down", "h", "id", "text")
