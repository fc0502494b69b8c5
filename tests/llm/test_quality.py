import random
import zlib

import numpy as np

from lexiloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.rate(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [r for q, r in kept if q == 1], [r for q, r in kept if q == 0]
    assert np.mean([r.predicted == q for q, r in kept]) > 0.95
    assert np.mean([g.score > b.score for g in good for b in bad]) > 0.97


def test_edges(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("abcdef") * rng.randint(1, 8) for _ in range(30)), i) for i in range(40)]
    texts += [(100 + i, "SPAM!! " * 20, i) for i in range(40)] + [(200, None, 0), (201, "", 0), (202, "x" * 300_000, 0), (None, "a b", 0), (203, "dup", 0), (203, "dup", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.rate(docs, labels).collect()
    assert len(rows) == len(texts) and all(r.predicted == (r.doc_id < 100) for r in rows if r.doc_id is not None and r.doc_id < 200)
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= set(range(40))
    flat = quality.rate(docs, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5} and quality.rate(docs.limit(0), labels).collect() == []


def test_weights_follow_the_differences():
    good, bad = np.zeros((5, len(quality.FEATURES))), np.ones((5, len(quality.FEATURES)))
    model = quality.fit_pairs(good, bad, 0.5)
    assert model.score(good).min() >= quality.THRESHOLD > model.score(bad).max()


def test_threshold_covers_all_labelled_rows(spark, monkeypatch):
    """The quantile is over every labelled row that isn't held out, however few the fit reads."""
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 8)
    rng = random.Random(2)
    texts = [(i, " ".join("A!b" if rng.random() < (0.6 if i % 4 == 0 else 0.3) else rng.choice(["word", "other", "thing"]) for _ in range(40))) for i in range(800)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in texts], "doc_id long, quality int")
    rows = [r for r in quality.rate(docs, labels).collect() if not r.held_out]
    bad = sum(r.doc_id % 4 == 0 for r in rows)
    scores = sorted(r.score for r in rows)
    assert scores[bad - 1] <= quality.THRESHOLD <= scores[bad]


def test_threshold_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 5)
    rng = random.Random(3)
    for n_good, n_bad, step in ((300, 100, 0), (300, 100, 0.5), (1, 1, 0), (1, 9, 0), (40, 1, 1)):
        z = [(g, float(rng.gauss(g, 1) if not step else round(rng.gauss(g, 1) / step) * step)) for g in [True] * n_good + [False] * n_bad]
        share = 0.25
        weight = {True: (1 - share) / n_good, False: share / n_bad}
        rows = sorted(z, key=lambda r: (r[1], not r[0]))
        at = min(int(np.searchsorted(np.cumsum([weight[g] for g, _ in rows]), share - 1e-9)), len(rows) - 2)
        assert quality.threshold(spark.createDataFrame(z, "good boolean, z double"), share) == (rows[at][1] + rows[at + 1][1]) / 2
    assert quality.threshold(spark.createDataFrame([(True, 1.0)], "good boolean, z double"), 0.5) is None


def test_repeated_ids_crowd_nobody_out(spark, monkeypatch):
    """One id with many rows before all others leaves the fit as it is."""
    monkeypatch.setattr(quality, "SAMPLE_PER_LABEL", 20)
    texts = [(1, "good words here")] * 300 + [(2 + i, "good words here" if i % 2 else "SPAM!! SPAM!!") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1)] + [(2 + i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    once = quality.fit(docs.dropDuplicates(["doc_id"]), labels)
    assert model.weights.any() and np.array_equal(model.weights, once.weights)
