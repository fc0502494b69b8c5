import hashlib
import random

import pytest

from lexiloom.llm import common, suffix_dedup


def brute(docs):
    """docs: (id, text), ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(w)
        runs = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "é", "ñandú", "x", "the", "of", "日本"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, docs = [say(rng.randint(10, 90)) for _ in range(8)] + ["ab" * 90, "z" * 260], []
    for _ in range(n):
        r = rng.random()
        if docs and r < 0.15:
            text = rng.choice(docs)
        elif docs and r < 0.4:
            text = rng.choice(docs)
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "Q", say(2)]) + text[at + rng.randint(0, 3) :]
        else:
            text = " ".join(rng.choice([say(rng.randint(0, 40)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 40) :]]) for _ in range(rng.randint(0, 4)))
        docs.append(text)
    return list(zip(rng.sample(range(10 * n), n), docs))


@pytest.mark.parametrize("crowd,shard", [(4000, 1 << 20), (2, 1 << 20), (4000, 500)])
def test_against_brute_force(spark, monkeypatch, crowd, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    docs = [*corpus(crowd + shard, 150), (99_000, None), (99_001, ""), (99_002, "q" * 99), (99_003, "q" * 99), (99_004, "w" * 100), (99_005, "w" * 100)]
    want = brute(docs)
    got = suffix_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(docs)
    assert sum(x[1] > 0 for x in want.values()) > 40


def test_edges(spark, monkeypatch):
    text = " ".join(str(i) for i in range(100))
    rows = [(3, text, 1), (3, text, 1), (5, text + " and more", 1), (None, text, 2), (7, "u" * 150_000, 3), (8, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = sorted(((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_dedup.report(docs).collect()))
    assert got == [(0, len(text), 1), (3, 0, 0), (3, 0, 0), (5, len(text), 1), (7, 149_999, 1), (8, 0, 0)]
    assert suffix_dedup.report(docs.limit(0)).collect() == []


def test_anchors_agree_across_blocks(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) + b"a" * 700
    whole = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    spread = lambda found: [h for h, a, b in zip(*(x.tolist() for x in found)) for _ in range(a, b + 1)]
    assert spread(whole) == spread(suffix_dedup.anchors(text))
