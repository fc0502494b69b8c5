"""What the corpus operators share: tables, shared storage, words and 64-bit mixing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go when a session on one machine names no folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/lexiloom"
#: Rows and bytes in an Arrow batch. Texts may be long, so batches are kept short; within a batch the
#: operators also work by bytes (see ``slices``).
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Bytes of text that an operator works on at once.
SLICE_BYTES = 1 << 20

#: Bytes up to which a side of a join is broadcast, after they were summed; beyond it the same join is shuffled.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast relation takes beside its values: headers, pointers, its place in the hash map.
ROW_BYTES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, and a checkpoint folder that driver and executors share; without one, an error unless all runs on one machine."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = LOCAL_CHECKPOINTS
        context.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared folder: a lost executor costs one re-read, not a re-run."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, size: Column | int) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``size`` bytes of values and ROW_BYTES each, are within BROADCAST_BYTES together."""
    total = df.agg(F.sum((F.lit(size) if isinstance(size, int) else size) + F.lit(ROW_BYTES))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case of letters, for working columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, limit: int = SLICE_BYTES):
    """Yields (start, end) of runs of texts with about ``limit`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers to doubles strictly between 0 and 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
