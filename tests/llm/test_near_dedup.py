import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lexiloom.llm import common, components, near_dedup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(docs, k):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    name = defaultdict(lambda: float("inf"))
    for x, (i, _) in enumerate(sets):
        name[root(x)] = min(name[root(x)], i)
    return sorted((i, len(s), name[root(x)], i == name[root(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"Word{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, base = [], []
    for _ in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, max(len(w) // 7, 1))):  # on both sides of the threshold
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], "x"]])
        else:
            w = say(rng.choice([1, 2, 3, 8, 20, 60, 150]))
        base.append(w or ["x"])
        docs.append(rng.choice([" ", "\n", "\t "]).join(base[-1]))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, docs))


@pytest.mark.parametrize("k,seed", [(2, 1), (5, 2), (2, 3)])
def test_groups_against_brute_force(spark, k, seed):
    docs = corpus(seed, 400) + [(90_000, ""), (90_001, " \n"), (90_002, "É é"), (90_003, "é é"), (90_004, "One"), (90_005, "one")]
    got = near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(docs, k)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 2)
    monkeypatch.setattr(near_dedup, "COLUMNS", 3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    docs = corpus(9, 120)
    got = near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(docs, 2)


def test_chains_around_a_centre(spark):
    """Members that link with each other but not with the least one: one component by way of a chain."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs, w = [(0, " ".join(base))], list(base)
    for i in range(1, 60):
        w = list(base) if i % 20 == 0 else list(w)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    rng.shuffle(docs)
    got = near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(docs, 2)


def test_edges(spark):
    rows = [(5, "same words here now", 1), (3, "same words here now", 2), (3, "same words here now", 2), (None, "same words here now", 3), (None, "alone", 4), (7, None, 5), (8, None, 6), (9, "long " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = near_dedup.groups(docs, 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True), (8, 8, True), (9, 9, True)]
    left = near_dedup.keep_one(docs.where("doc_id is not null"))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 7, 8, 9]
    assert near_dedup.groups(docs.limit(0), 2).collect() == [] and near_dedup.keep_one(docs.limit(0)).collect() == []


def test_keep_one_tells_rows_apart(spark):
    """Rows without an id, and texts under one id, stay unless a row of their own group does."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " more", "another text of quite different words"
    rows = [(None, "first text that has no id", 1), (None, "second text without one either", 2), (None, "second text without one either", 3), (None, None, 4), (None, "", 5)]
    rows += [(4, base, 6), (9, near, 7), (9, other, 8), (9, other, 9), (None, base, 10)]
    left = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    kept = sorted(r.row for r in left)
    assert [x for x in kept if x not in (2, 3, 8, 9)] == [1, 4, 5, 6]
    assert len({2, 3} & set(kept)) == 1 and len({8, 9} & set(kept)) == 1


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**64, 900, dtype=np.uint64)
    for a, b in ((pool[:600], pool[200:800]), (pool[:20], pool[3:20]), (pool[:1], pool[:1])):
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = np.mean([np.mean(np.equal(*near_dedup.superminhash([near_dedup.mix64(a + s), near_dedup.mix64(b + s)], 128))) for s in np.arange(40, dtype=np.uint64)])
        assert abs(got - want) < 0.02


def test_early_stop_changes_nothing():
    """The definition, element by element, over all ranks."""
    rng = np.random.default_rng(1)
    slots, g = 32, int(near_dedup.GOLDEN)
    mix = lambda x: int(near_dedup.mix64(np.array([x % 2**64], np.uint64))[0])
    for n in (1, 3, 40):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        best = [float("inf")] * slots
        for x in map(int, h):
            order = list(range(slots))
            for j in range(slots):
                drawn = mix(x + (2 * j + 1) * g)
                k = j + ((mix(drawn ^ g) >> 32) * (slots - j) >> 32)
                order[j], order[k] = order[k], order[j]
                best[order[j]] = min(best[order[j]], j + (drawn >> 11) * 2.0**-53)
        assert near_dedup.superminhash([h], slots)[0].tolist() == best


@pytest.mark.parametrize("each", [200_000, 100])
def test_components(spark, monkeypatch, each):
    monkeypatch.setattr(components, "EDGES_PER_TASK", each)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, 5000 + i) for i in range(1, 400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "child long, parent long").repartition(7)
    got = {r.node: r.component for r in components.components(frame).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in loops}
