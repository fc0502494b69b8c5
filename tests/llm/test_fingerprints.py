import hashlib
import random
from collections import Counter

import numpy as np

from lexiloom.llm import fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_rows_against_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(n))
    docs = [(i, say(rng.randint(0, 80))) for i in rng.sample(range(5000), 300)] + [(9000, None), (9001, ""), (9002, "é😀 " * 5001), (-5, " \n")]
    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    assert len(got) == len(docs)
    sampler, off = fingerprints.Sampler(cache_rows=500), []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other, following = (sampler.fingerprint(x) for x in (text, changed, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert (r.near_edited, r.near_next) == ((own == other).mean(), (own == following).mean())
        off.append(r.near_edited - (jaccard(text, changed) if text.split() or changed.split() else 1))
    # All texts share words, hence draws, so their errors are not independent.
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.07


def test_collision_rate_is_weighted_jaccard():
    sampler = fingerprints.Sampler(slots=4096)
    a, b = "x " * 9 + "y " * 3 + "z q", "x " * 4 + "y " * 5 + "z p p"
    assert abs((sampler.fingerprint(a) == sampler.fingerprint(b)).mean() - jaccard(a, b)) < 0.03


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, part int, h int")
    assert fingerprints.compare(make([])).collect() == []
    one = fingerprints.compare(make([(1, "a b c", 0, 0)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = fingerprints.compare(make([(3, "same", 0, 0)] * 4 + [(None, "last", 0, 0), (None, None, 0, 0)])).collect()
    assert len(rows) == 6 and len({r.fingerprint for r in rows if r.doc_id == 3}) == 1
