"""Exact substring dedup over all documents with sharded suffix arrays.

Every window of SPAN bytes contains GRAMS grams; the leftmost one with the least hash is the window's anchor. Equal windows have equal
anchors at equal offsets, so repeats are found by comparing windows of the same anchor hash only. Consecutive windows with
one anchor share a segment, from the first window's start to the last one's end.

A hash that occurs once has no repeat. Of equal segments of one hash all but the earliest are repeats throughout. What is left are hashes with
different segments, mostly at the ends of repeated passages and at edits: their earliest segments are cut from the texts, gathered in shards by
hash, and each shard's suffix array and permuted common prefixes tell which windows an earlier place has too. A hash with more than SHARD_SEGMENTS
different segments is not gathered; its windows are compared by their digests in a grouped aggregation.

Copies of whole documents are set aside first: all but the earliest are removed throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, prepare, shuffle_parts, small
from .suffixes import permuted_prefixes, suffix_array

SPAN = 100
GRAM = 32
BLOCK = (1 << 20) - 256
SHARD_BYTES = 1 << 20
SHARD_SEGMENTS = 4000
LAST = 2**63 - 1  # stands for a null id, after all others
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
POSITION = np.uint64((1 << 20) - 1)


def anchors(raw: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) for the stretches of consecutive windows that have one anchor."""
    grams = span - GRAM + 1
    found = []
    # Blocks of windows, so that a place fits the low bits of a key and ties go to the left everywhere.
    for begin in range(0, len(raw) - span + 1, BLOCK):
        part = raw[begin : begin + BLOCK + span - 1]
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        n = len(part) - GRAM + 1
        h = words[:n] * ODD[0]
        for i in (1, 2, 3):
            h += words[8 * i : 8 * i + n] * ODD[i]
        h = mix64(h)
        least, width = (h & ~POSITION) | np.arange(n, dtype=np.uint64), 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        found.append((h[(least[first] & POSITION).astype(np.int64)], first + begin, last + begin))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchored(docs: DataFrame) -> DataFrame:
    """(h, s, d, t, at, more) for (d, t, text): anchor hash, segment digest, place (first window and, in the low 8 bits, how many follow).

    Of equal segments of one document there is one row, for the first; ``more`` has the places of the others.
    """

    def run(batches):
        for b in batches:
            found, size = [], 0
            for d, t, text in zip(b["d"], b["t"], b["text"]):
                raw = text.encode()
                h, first, last = anchors(raw)
                digest = xxhash.xxh3_64_intdigest
                s = np.fromiter((digest(raw[i:j]) for i, j in zip(first.tolist(), (last + SPAN).tolist())), np.uint64, len(first))
                at, more = first << 8 | (last - first), [None] * len(h)
                kinds, where, of = np.unique(s, return_index=True, return_inverse=True)
                if len(kinds) < len(s):
                    others: dict[int, list[int]] = {}
                    for i in np.flatnonzero(np.arange(len(s)) != where[of]).tolist():
                        others.setdefault(int(where[of[i]]), []).append(int(at[i]))
                    where.sort()
                    h, s, at, more = h[where], s[where], at[where], [others.get(i) for i in where.tolist()]
                found.append((h, s, np.full(len(h), d), np.full(len(h), t), at, more))
                size += len(raw)
                if size > 1 << 21:
                    yield frame(found)
                    found, size = [], 0
            if found:
                yield frame(found)

    def frame(found):
        h, s, d, t, at = (np.concatenate([f[i] for f in found]) for i in range(5))
        return pd.DataFrame({"h": h.view(np.int64), "s": s.view(np.int64), "d": d, "t": t, "at": at, "more": [m for f in found for m in f[5]]})

    return docs.mapInPandas(run, "h long, s long, d long, t long, at long, more array<long>")


def shard_repeats(segments: list[tuple[int, int, int, bytes]], span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """(d, t, start, end) of the stretches covered by windows that an earlier place, by (d, t, start), has too.

    ``segments`` are (d, t, start of the segment in its document, bytes).
    """
    sizes = np.array([len(s[3]) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(segments) + 1, np.int64)
    ends = np.cumsum(sizes + 1)
    text[:-1] = 1
    of = np.repeat(np.arange(len(segments)), sizes)
    place = np.arange(len(of)) + of
    text[place] = np.frombuffer(b"".join(s[3] for s in segments), np.uint8).astype(np.int64) + 2
    order = suffix_array(text)
    shared = permuted_prefixes(text, order, 1)
    segment = np.searchsorted(ends, order, side="right")
    inside = segment < len(segments)
    order, segment = order[inside], segment[inside]
    kind = np.cumsum(shared[order] < span)
    room = ends[segment] - 1 - order >= span
    order, segment, kind = order[room], segment[room], kind[room]
    several = np.bincount(kind, minlength=1)[kind] > 1
    order, segment, kind = order[several], segment[several], kind[several]
    if not len(order):
        return []
    d, t, at = (np.array([s[i] for s in segments], dtype=np.int64)[segment] for i in range(3))
    start = at + order - (ends - 1 - sizes)[segment]
    # The earliest place of each kind; a place that is there twice, in two segments, is one place.
    by = np.lexsort((start, t, d, kind))
    kind, d, t, start = kind[by], d[by], t[by], start[by]
    head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    first = np.repeat(head, np.diff(np.append(head, len(kind))))
    later = (d != d[first]) | (t != t[first]) | (start != start[first])
    d, t, start = d[later], t[later], start[later]
    by = np.lexsort((start, t, d))
    d, t, start = d[by], t[by], start[by]
    if not len(d):
        return []
    new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + span))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    return list(zip(d[head].tolist(), t[head].tolist(), start[head].tolist(), (start[tail] + span).tolist()))


def _with(docs: DataFrame, more: DataFrame) -> DataFrame:
    """The documents that ``more`` has rows for, with them. Their ids alone are broadcast, if they are few, to leave the other texts where they are."""
    return docs.join(small(more.select("d", "t"), 16), ["d", "t"], "left_semi").join(more, ["d", "t"])


def repeated(docs: DataFrame) -> DataFrame:
    """(d, t, start, end): stretches of repeats in (d, t, text), whose rows are distinct. Stretches may overlap."""
    spark = docs.sparkSession
    every = _anchored(docs.where(F.octet_length("text") >= SPAN))
    # One exchange serves counting and keeping; a document has a hash and segment once, so no text can crowd it.
    same = Window.partitionBy("h")
    counted = every.withColumn("n", F.count("*").over(same)).withColumn("mixed", F.min("s").over(same) != F.max("s").over(same))
    twice = cut(counted.where("n > 1 or more is not null").drop("n"))
    first = twice.groupBy("h", "s", "mixed").agg(F.min(F.struct("d", "t", "at")).alias("first"))
    later = twice.join(first.select("h", "s", "first"), ["h", "s"]).withColumn("is_later", F.struct("d", "t", "at") > F.col("first"))
    again = F.coalesce("more", F.array().cast("array<long>"))
    gone = later.where("is_later or more is not null").select("d", "t", F.explode(F.when(F.col("is_later"), F.array_append(again, F.col("at"))).otherwise(again)).alias("at"))
    start = F.shiftright("at", 8)
    end = start + F.col("at").bitwiseAND(F.lit(255)) + SPAN
    whole = gone.select("d", "t", start.alias("start"), end.alias("end"))

    # The earliest of each segment, where a hash has several.
    some = cut(first.where("mixed").select("h", "first.*"))
    crowded = some.groupBy("h").agg(F.count("*").alias("n")).select("h", (F.col("n") > SHARD_SEGMENTS).alias("crowd"))
    places = some.join(crowded, "h").groupBy("d", "t").agg(F.collect_list(F.struct("h", "at", "crowd")).alias("p"))  # as many as a text has
    places = cut(places.select("d", "t", "p.h", "p.at", "p.crowd"))
    texts = _with(docs, places)

    def segments(batches):
        columns = ["h", "crowd", "d", "t", "start", "raw"]
        for b in batches:
            out, size = [[] for _ in columns], 0
            for d, t, text, h, at, crowd in zip(b["d"], b["t"], b["text"], b["h"], b["at"], b["crowd"]):
                raw, starts = text.encode(), at >> 8
                own = [raw[i:j] for i, j in zip(starts.tolist(), (starts + (at & 255) + SPAN).tolist())]
                for kept, new in zip(out, (h.tolist(), crowd.tolist(), [d] * len(h), [t] * len(h), starts.tolist(), own)):
                    kept.extend(new)
                size += len(own)
                if size > 20_000:
                    yield pd.DataFrame(dict(zip(columns, out)))
                    out, size = [[] for _ in columns], 0
            yield pd.DataFrame(dict(zip(columns, out)))

    pieces = cut(texts.mapInPandas(segments, "h long, crowd boolean, d long, t long, start long, raw binary"))

    def shards(batches):
        held, size, last = [], 0, None
        for b in batches:
            for h, d, t, begin, raw in zip(b["h"], b["d"], b["t"], b["start"], b["raw"]):
                if size > SHARD_BYTES and h != last:
                    yield pd.DataFrame(shard_repeats(held), columns=["d", "t", "start", "end"])
                    held, size = [], 0
                held.append((d, t, begin, raw))
                size += len(raw)
                last = h
        if held:
            yield pd.DataFrame(shard_repeats(held), columns=["d", "t", "start", "end"])

    def windows(batches):
        for b in batches:
            for d, t, begin, raw in zip(b["d"], b["t"], b["start"], b["raw"]):
                n = len(raw) - SPAN + 1
                yield pd.DataFrame({"w": [xxhash.xxh3_128_digest(raw[i : i + SPAN]) for i in range(n)], "d": d, "t": t, "start": np.arange(n) + begin})

    shape = "d long, t long, start long, end long"
    calm = pieces.where("not crowd").drop("crowd").repartition(shuffle_parts(spark), "h").sortWithinPartitions("h", "d", "t", "start").mapInPandas(shards, shape)
    each = pieces.where("crowd").select("d", "t", "start", "raw").mapInPandas(windows, "w binary, d long, t long, start long")
    least = each.groupBy("w").agg(F.min(F.struct("d", "t", "start")).alias("first"))
    crowd = each.join(least, "w").where(F.struct("d", "t", "start") > F.col("first")).select("d", "t", "start", (F.col("start") + SPAN).alias("end"))
    return whole.unionByName(calm).unionByName(crowd)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as disjoint ones that don't touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as (id, d, t, text), and what is removed of them as (d, t, copy, starts, ends)."""
    own = docs.select("id", F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("t", F.xxhash64("text")).withColumn("u", F.xxhash64(F.lit(9), "text"))
    keys = cut(own.where(F.octet_length("text") >= SPAN).select("d", "t", "u"))
    firsts = keys.groupBy("t", "u").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1").select("t", "u", "first")
    copies = keys.join(firsts, ["t", "u"])
    later = cut(copies.where("d > first").select("d", "t").distinct())
    # A row that repeats id and text is the same document; one row of it is enough.
    again = copies.where("d = first").groupBy("d", "t").agg(F.count("*").alias("n")).where("n > 1").select("d", "t")
    again = cut(again)
    rest = own.select("d", "t", "text").join(small(later, 16), ["d", "t"], "left_anti")
    single = rest.join(small(again, 16), ["d", "t"], "left_anti").unionByName(rest.join(small(again, 16), ["d", "t"], "left_semi").dropDuplicates(["d", "t"]))
    spans = repeated(single).groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # as many as a text has

    @F.pandas_udf("struct<starts:array<long>,ends:array<long>>")
    def merged(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        joined = [_merged(a, b) for a, b in zip(starts, ends)]
        return pd.DataFrame({"starts": [a for a, _ in joined], "ends": [b for _, b in joined]})

    parts = spans.select("d", "t", merged("spans.start", "spans.end").alias("m")).select("d", "t", F.lit(False).alias("copy"), "m.starts", "m.ends")
    none = F.array().cast("array<long>")
    gone = later.select("d", "t", F.lit(True).alias("copy"), none.alias("starts"), none.alias("ends"))
    return own.drop("u"), cut(parts.unionByName(gone))


def _kept(text: str, copy: bool, starts, ends) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    raw = text.encode()
    if copy:
        return b"", len(raw), 1
    stay, at = [], 0
    for a, b in zip(starts, ends):
        stay.append(raw[at:a])
        at = b
    kept = b"".join([*stay, raw[at:]])
    return kept, len(raw) - len(kept), len(starts)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if it is covered by a string of SPAN bytes, inside its document, that also starts earlier: in a document with a smaller id, or
    earlier in the same one. Null texts are empty; texts shorter than SPAN bytes stay whole. Rows that repeat id and text are one document and have one
    result; of different texts under one id, the one with the smaller hash comes first. Null ids come last. An empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    own, removed = _removed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    @F.pandas_udf("struct<n_removed:long,n_spans:long,kept_sha256:string>")
    def without(text: pd.Series, copy: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(text, copy, starts, ends):
            kept, gone, runs = _kept(*row)
            out.append((gone, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = own.join(small(removed.select("d", "t"), 16), ["d", "t"], "left_anti").select("id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    cleaned = _with(own, removed).select("id", size, without("text", "copy", "starts", "ends").alias("w")).select("id", "n_bytes", "w.*")
    return whole.unionByName(cleaned).withColumnRenamed("id", id_col)
