"""Benchmark decontamination: size-partitioned MinHash containment search, column functions only.

Test items are short and documents long, so a signature of a whole document would hardly ever meet one of an
item. The sketch is therefore made on the item's side: items are partitioned by the size of their shingle set, and
an item's sketch is its bottom-k MinHash, the k smallest hashes, with k set by its partition so that no k shingles
can all be missing from a document that holds the least share of the item. A document that shares one hash with a sketch is
a candidate, a narrow pass with one broadcast join; none that must be found is lost. Candidates are verified by the exact
share of the item's shingles, compared as text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, unused

WORDS = 5
LEAST = 0.8
#: Size partitions are [2^p, 2^(p+1)).
PARTITIONS = 31
#: About how many items are compared with one copy of a document's shingles.
ITEMS_AT_ONCE = 256


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null or empty text."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _windows(w: Column, k: int, make) -> Column:
    """``make(i)`` for each start i (from 0) of k words; once, for i = 0, in shorter texts; never in empty ones."""
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), make))


def shingle_hashes(w: Column, k: int = WORDS) -> Column:
    return _windows(w, k, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def shingle_texts(w: Column, k: int = WORDS) -> Column:
    return F.array_distinct(_windows(w, k, lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " ")))


def sketch_size(n: Column, least: float = LEAST) -> Column:
    """More shingles than any item of the partition can lack while the least share of it is present."""
    bound = F.lit(0)
    for p in reversed(range(PARTITIONS)):
        top = 2 ** (p + 1) - 1
        bound = F.when(n.between(2**p, top), F.lit(top - math.ceil(least * top) + 1)).otherwise(bound)
    return F.least(bound, n)


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each (document, item) with at least ``least`` of the item's distinct five-word shingles in the document.

    Words are lower-cased runs of letters and digits. A text of one to four words has one shingle, all its
    words; an empty or null text has none and matches nothing. Repeated rows of a document or an item count once, by their
    ids together with their texts; a null id is an id like others. No documents or no items give no rows. Other columns are not read.
    """
    return _matches(docs, items, least, id_col, text_col, item_col).drop("h")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _matches(docs: DataFrame, items: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``matches`` with the hash ``h`` of the document's text, which tells rows apart that share an id."""
    doc = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("h"))
    item = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).distinct()
    item = item.withColumn("shingles", shingle_texts(F.col("w"))).withColumn("hashes", F.array_distinct(shingle_hashes(F.col("w")))).where(F.size("shingles") > 0)
    item = cut(item.select("item", "shingles", F.slice(F.array_sort("hashes"), F.lit(1), sketch_size(F.size("hashes"), least)).alias("sketch"), F.xxhash64("shingles").alias("ih")))
    sketch = item.select("item", "ih", F.explode("sketch").alias("hash"))
    hashed = doc.withColumn("w", words(F.col("text"))).select("doc", "h", F.explode(shingle_hashes(F.col("w"))).alias("hash"))
    pairs = cut(hashed.join(small(sketch, 24), "hash").select("doc", "h", "item", "ih").distinct())
    # The text is read again, for candidates only; their ids alone are broadcast, if they are few.
    wanted = pairs.select(F.col("doc").alias("cdoc"), F.col("h").alias("ch")).distinct()
    found = doc.join(small(wanted, 16), doc["doc"].eqNullSafe(F.col("cdoc")) & (F.col("h") == F.col("ch"))).dropDuplicates(["doc", "h"])
    # Words get a column of their own: inside the window expression they would be cut again for every window.
    found = found.withColumn("w", words(F.col("text"))).select("doc", "h", shingle_texts(F.col("w")).alias("own"))
    of = item.select(F.col("item").alias("iitem"), F.col("ih").alias("iih"), "shingles")
    of = small(of, F.octet_length(F.array_join("shingles", "|")) + 8 * F.size("shingles"))
    # Items ride in groups, dealt by hash, so a document's shingles are copied once for each group and not for each item.
    groups = -(-item.count() // ITEMS_AT_ONCE) or 1
    held = pairs.join(of, F.col("item").eqNullSafe(F.col("iitem")) & (F.col("ih") == F.col("iih")))
    held = held.groupBy(F.col("doc").alias("cdoc"), F.col("h").alias("ch"), F.pmod("ih", F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("item", "shingles")).alias("items"))
    compared = F.transform("items", lambda i: F.struct(i["item"].alias("item"), F.size(i["shingles"]).cast("long").alias("n"), F.size(F.array_intersect("own", i["shingles"])).cast("long").alias("shared")))
    found = found.join(held, found["doc"].eqNullSafe(F.col("cdoc")) & (F.col("h") == F.col("ch"))).select("h", "doc", F.explode(compared).alias("c"))
    shared = found.select("h", F.col("doc").alias(id_col), F.col("c.item").alias(item_col), F.col("c.n").alias("n_shingles"), F.col("c.shared").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.lit(least) * F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns, whatever their names, and all other rows stay, those under the same or no id too."""
    id_, text = unused(docs, "_hit", "_hit_text")
    hit = cut(_matches(docs, items, least).select(F.col("doc_id").alias(id_), F.col("h").alias(text)).distinct())
    return docs.join(small(hit, 16), docs["doc_id"].eqNullSafe(F.col(id_)) & (text_hash(docs["text"]) == F.col(text)), "left_anti")
