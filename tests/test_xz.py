"""Packing small values gives what the library gives at preset 9, without its cost for each value."""

import lzma
import random
import time

import pyarrow.parquet as pq

from lexiloom.functions import xz


def samples():
    rng = random.Random(5)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:40]
    yield from (b"", b"a", b"abc", b"abcd", b"ab" * 3000, bytes(range(256)) * 40, "größer".encode() * 99)
    yield from (t.encode() for t in texts if t is not None)
    yield "".join(texts).encode()
    # Few four-byte strings, each often and in any order: searches end by their depth.
    yield b"".join(rng.choice([b"the ", b"then", b"they", b"thet"]) + bytes([rng.randrange(97, 123)]) for _ in range(30_000))
    yield bytes(rng.randrange(4) for _ in range(20_000))
    yield rng.randbytes(150_000)


def test_same_bytes_as_the_preset():
    for data in samples():
        assert xz.compress(data) == lzma.compress(data, preset=9)


def test_clashing_slots_are_noticed():
    """Two four-byte strings of one slot in the small table, both beyond the depth: the small table is refused."""
    table = xz._slots
    seen: dict = {}
    rng = random.Random(1)
    while True:
        word = rng.randbytes(4)
        slot = int(table(word)[0])
        other = seen.setdefault(slot & 0xFFFF, (slot, word))
        if other[0] != slot:
            break
    data = b"".join(word + other[1] + rng.randbytes(2) for _ in range(60))
    assert not xz._same_matches(table(data), 16)
    assert xz._same_matches(table(data), 24)
    assert xz.compress(data) == lzma.compress(data, preset=9)


def test_cost_of_a_short_value():
    """At preset 9 each value sets up 64 MiB; 100 short ones must take far less than that."""
    values = [f"value {i} of a few words, and again a few words".encode() * 20 for i in range(100)]

    def seconds(f):
        start = time.process_time()
        for v in values:
            f(v)
        return time.process_time() - start

    assert seconds(xz.compress) < 0.5 * seconds(lambda v: lzma.compress(v, preset=9))
