"""Document fingerprints by consistent weighted sampling.

A document is a set of words weighted by their counts. For each of K slots a word's hash seeds r and c, drawn from
Gamma(2, 1), and b, uniform: with t = floor(ln w / r + b), the sample of the slot is the (word, t) with the least
ln a = ln c - r (t - b) - r. Two documents agree in a slot with a chance equal to their generalised Jaccard similarity, the sum of
least weights over the sum of greatest weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix64, prepare
from .ranges import descending_with_next

SLOTS = 64
#: Words with a weight whose slots are kept between texts; beyond it they are forgotten and made again.
CACHE_ROWS = 180_000
BLOCK_ROWS = 8192
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sampler:
    def __init__(self, slots: int = SLOTS, cache_rows: int = CACHE_ROWS):
        self.slots, self.limit = slots, cache_rows
        self.once: dict[str, int] = {}
        self.rows: dict[tuple[str, int], int] = {}
        self.steps = (np.arange(3 * slots, dtype=np.uint64) + np.uint64(1)) * GOLDEN
        self.forget()

    def forget(self) -> None:
        self.once.clear()
        self.rows.clear()
        self.used = 0
        self.keys = np.empty((4096, self.slots), np.uint64)

    def samples(self, pairs: list[tuple[str, int]]) -> np.ndarray:
        """For each pair of a word and its weight, by slot: ln a, as bits that sort alike, before the code of (word, t)."""
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in pairs), np.uint64, len(pairs))
        weights = np.fromiter((n for _, n in pairs), np.float32, len(pairs))
        k = self.slots
        drawn = mix64(seeds[:, None] + self.steps)
        u, v = ((x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24) for x in (drawn >> np.uint64(40), drawn >> np.uint64(16) & np.uint64(0xFFFFFF)))
        r = -np.log(u[:, :k] * v[:, :k])
        log_c = np.log(-np.log(u[:, k : 2 * k] * v[:, k : 2 * k]))
        b = u[:, 2 * k :]
        t = np.floor(np.log(weights)[:, None] / r + b)
        bits = (log_c - r * (t - b) - r).view(np.int32)
        bits = np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32)
        code = mix64(seeds[:, None] + (t.astype(np.int64).view(np.uint64) + np.uint64(1)) * GOLDEN) >> np.uint64(33)
        return bits.astype(np.uint64) << np.uint64(32) | code

    def fingerprint(self, text: str) -> np.ndarray:
        """One code for each slot; NOTHING throughout for a text without words."""
        counts = Counter(text.split())
        once = [w for w, n in counts.items() if n == 1]
        best = np.full(self.slots, NOTHING)
        # Most words occur once in a text; a word alone is looked up faster than a pair.
        for rows, keys, weighted in ((self.once, once, False), (self.rows, [p for p in counts.items() if p[1] > 1], True)):
            for i in range(0, len(keys), BLOCK_ROWS):
                block = keys[i : i + BLOCK_ROWS]
                at = list(map(rows.get, block))
                if None in at:
                    new = [x for x, row in zip(block, at) if row is None]
                    if self.used + len(new) > self.limit:
                        self.forget()
                        new = block
                    if self.used + len(new) > len(self.keys):
                        self.keys = np.concatenate([self.keys, np.empty((max(len(new), self.used), self.slots), np.uint64)])
                    self.keys[self.used : self.used + len(new)] = self.samples(new if weighted else [(w, 1) for w in new])
                    rows.update(zip(new, range(self.used, self.used + len(new))))
                    self.used += len(new)
                    at = list(map(rows.get, block))
                np.minimum(best, self.keys.take(at, axis=0).min(0), out=best)
        return best.astype(np.uint32)


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as many (or all) first code points of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per document row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow one another by descending id, then by the hash of the text; after the last comes the first. Null texts
    are empty; null ids come last; repeated rows follow one another. Texts without words have one
    fingerprint of their own, alike among themselves and unlike all others. An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = descending_with_next(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("id", F.col("id").cast("string"))  # beside nulls pandas would make numbers floats

    def sweep(batches):
        sampler = Sampler(slots)
        held = None  # (part, id, text, fingerprint)
        out, size = [], 0
        columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for b in batches:
            for part, ghost, id_, text in zip(b["part"], b["ghost"], b["id"], b["text"]):
                if held is not None and held[4] and held[0] == part:
                    continue  # a second copy of the ghost
                own = sampler.fingerprint(text)
                if held is not None and held[0] == part:
                    changed = edited(held[2], text)
                    other = sampler.fingerprint(changed)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3].tobytes().hex(), other.tobytes().hex(), float((held[3] == other).mean()), float((held[3] == own).mean())))
                    size += len(changed)
                    if size > SLICE_BYTES or len(out) >= 512:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                held = (part, id_, text, own, ghost > 0)
        yield pd.DataFrame(out, columns=columns)

    done = rows.mapInPandas(sweep, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.select(F.col("id").cast(id_type).alias(id_col), *done.columns[1:])
