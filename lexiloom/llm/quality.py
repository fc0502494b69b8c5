"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a document labelled good and one labelled bad. The chance that the first is preferred is
the logistic function of the difference of their scores, scores are linear in the features of the text, and
the weights minimise the logistic loss over feature differences, of a bounded sample. The score below which a share of the
labelled documents lies that equals the share of bad labels is the threshold, an exact quantile over all labelled documents that
aren't held out; scores are shifted so that it maps to THRESHOLD.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, small, unused

#: Most labelled documents of each label that the fit reads; drawn by hash of the id.
SAMPLE_PER_LABEL = 4000
PAIRS_PER_DOCUMENT = 20
THRESHOLD = 0.3
RIDGE = 1e-3
STEPS = 40
SEED = 17
#: Intervals that a range of scores is cut into, again and again, until the one with the quantile holds a single score.
BINS = 1024

#: Byte classes: other, letter, capital, digit, blank, sentence mark, other mark, part of a non-ASCII character.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7
FEATURES = ["capitals", "digits", "marks", "odd_marks", "non_ascii", "word_length", "distinct", "repeats", "bare_marks", "line_repeats", "length"]


def features(text: str | None) -> np.ndarray:
    """A vector for a whole text; zeros for a null or empty one."""
    raw = (text or "").encode()
    if not raw:
        return np.zeros(len(FEATURES))
    count = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=8).astype(float)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w = len(raw) - count[4], len(words)
    n, m = max(n, 1.0), max(w, 1)
    letters = max(count[1] + count[2], 1.0)
    repeats = sum(map(eq, words, words[1:])) / m
    bare = sum(len(x) == 1 and not x.isalnum() for x in words) / m
    line_repeats = 1 - len(set(lines)) / max(len(lines), 1)
    # Word types grow with about the square root of the length, so the ratio is taken to a standard length.
    distinct = len(set(words)) / m ** 0.85 if w else 0.0
    out = [count[2] / letters, count[3] / n, count[5] / n, count[6] / n, count[7] / n, min(n / m, 40.0), distinct, repeats, bare, line_repeats, np.log1p(w)]
    return np.array(out)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed row by row, so that a row's value doesn't depend on its batch."""
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.margin(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float) -> Model:
    """Weights by Newton's method on the logistic loss of feature differences, and the threshold among these rows; a flat model if a side is empty."""
    k = len(FEATURES)
    if not len(good) or not len(bad):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-9
    g, b = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    rng = np.random.default_rng(SEED)
    n = PAIRS_PER_DOCUMENT * max(len(g), len(b))
    diff = g[rng.integers(len(g), size=n)] - b[rng.integers(len(b), size=n)]
    w = np.zeros(k)

    def loss(w):
        return np.logaddexp(0, -(diff @ w)).mean() + RIDGE / 2 * w @ w

    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        slope = RIDGE * w - (diff * p[:, None]).mean(0)
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(k)
        step, size, now = np.linalg.solve(curve, slope), 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - bad_share) / len(g)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(scores, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share - 1e-9)), len(order) - 2)
    return Model(mean, scale, w, _shift((scores[order[at]] + scores[order[at + 1]]) / 2))


def _shift(threshold: float) -> float:
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - threshold)


def threshold(margins: DataFrame, bad_share: float) -> float | None:
    """The weighted quantile of all rows (good, z) at ``bad_share``, the good ones weighing 1 - bad_share together and the bad ones bad_share.

    Midway to the next row's score, as in ``fit_pairs``. Exact: counts by intervals come to the driver, BINS rows at a time. None if a label has no rows.
    """
    margins = cut(margins)
    ends = margins.agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"), F.count_if("good").alias("n_good")).first()
    if not 0 < ends["n_good"] < ends["n"]:
        return None
    of_good, of_bad = (1 - bad_share) / ends["n_good"], bad_share / (ends["n"] - ends["n_good"])
    low, high, n, n_good = ends["low"], ends["high"], ends["n"], ends["n_good"]
    good = bad = 0  # rows below the interval
    before = after = None  # the nearest scores beside it
    while low < high:
        bin_ = F.least(F.floor((F.col("z") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        parts = margins.where(F.col("z").between(low, high)).groupBy(bin_).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"), F.count_if("good").alias("n_good"))
        parts = sorted(parts.collect(), key=lambda r: r["bin"])
        for i, r in enumerate(parts):
            if i + 1 == len(parts) or (good + r["n_good"]) * of_good + (bad + r["n"] - r["n_good"]) * of_bad >= bad_share - 1e-9:
                break
            good, bad = good + r["n_good"], bad + r["n"] - r["n_good"]
        before = parts[i - 1]["high"] if i else before
        after = parts[i + 1]["low"] if i + 1 < len(parts) else after
        low, high, n, n_good = r["low"], r["high"], r["n"], r["n_good"]
    last = of_bad if n > n_good else of_good
    if (good + n_good) * of_good + (bad + n - n_good) * of_bad - last >= bad_share - 1e-9:
        return low  # reached within rows of the same score
    if after is None:
        return low if n > 1 or before is None else (before + low) / 2
    return (low + after) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled documents that aren't held out. The weights come from a bounded sample, whose features come to the driver; the threshold from all."""
    prepare(docs.sparkSession)
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good")).where("good is not null")
    share = {r.good: r.n for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}  # two rows
    drawn = [known.where(F.col("good") == side).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_LABEL) for side in (True, False)]
    some = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * SAMPLE_PER_LABEL ids at most

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in text])

    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(some, "id").select("good", "id", F.xxhash64("id").alias("at"), vector("text").alias("x"))
    # One row for each id and label, the same in every order, so that the bound holds however often an id repeats.
    seen = seen.groupBy("good", "id", "at").agg(F.min("x").alias("x"))
    rows = sorted(seen.collect(), key=lambda r: (r["at"], r["id"], r["x"]))
    side = lambda good: np.array([r["x"] for r in rows if r["good"] is good]).reshape(-1, len(FEATURES))
    bad_share = share.get(False, 0) / max(sum(share.values()), 1)
    model = fit_pairs(side(True), side(False), bad_share)
    if not model.weights.any():
        return model

    @F.pandas_udf("double")
    def margin(text: pd.Series) -> pd.Series:
        return pd.Series(model.margin(np.array([features(x) for x in text]).reshape(-1, len(FEATURES))))

    # Labels may be too many to broadcast; then ids and margins are shuffled, not texts.
    margins = docs.select(F.col(id_col).alias("id"), margin(F.col(text_col).cast("string")).alias("z")).join(small(known.distinct(), 17), "id").select("good", "z")
    found = threshold(margins, bad_share)
    return model if found is None else model._replace(shift=_shift(found))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1. Null and empty texts score as a text without any features."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(x) for x in text]).reshape(-1, len(FEATURES))))

    return docs.withColumn(into, of(F.col(text_col).cast("string")))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, held_out, score, predicted (1 if the score is THRESHOLD or more).

    Without both kinds of labels every score is 0.5. An empty table gives no rows; other columns are not read; a null id is
    not held out.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = score(own, fit(docs, labels, id_col, text_col))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose predicted label is 0; all columns stay, whatever their names."""
    (into,) = unused(docs, "_quality_score")
    scored = score(docs, fit(docs, labels), into=into)
    return scored.where(F.col(into) >= THRESHOLD).drop(into)
