import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Machine(open(PATH, "rb").read())


def want(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_random_texts_and_chunks(library, machine):
    rng = random.Random(4)
    pieces = ["the", "ing", "'s", "'", "'re", "'r", "'ll", "'l", "'v", "'VE", "''", " ", "  ", "\n", "\t", "12", "3", "!!", "###", "...", "é", "é", "ß", "ñ", "Σ", "ΑΣ ", "İ", "中文", "😀", " ", "　", "\u0085", "\x1c", "\x00", "½", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "tion", "zq", "Q", "ᾳ", "ﬁ", " ", "﻿"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        n = want(library, text)
        assert machine.count(text) == n, text
        assert machine.count(text, chunk=rng.randint(1, 7)) == n, text


def test_letters_by_chance(library, machine):
    rng = random.Random(6)
    for size in (1, 2, 5, 12, 40, 300):
        for _ in range(300):
            text = "".join(rng.choice("etaoinshrdlucm" + "bfgjkpqvwxyz'"[: rng.randint(0, 13)]) for _ in range(size))
            assert machine.count(text) == want(library, text), text


def test_characters(library, machine):
    for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xFB00, 0x10000, 3), *range(0x10000, 0x20000, 11)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}{chr(c)}'"
            assert machine.count(text) == want(library, text), hex(c)


def test_query_on_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, None), (-2, ""), (-3, "x" * 100_000), (-4, "ab " * 100_000), (-5, "twice"), (-5, "twice"), (None, "n")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.count(frame, PATH).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        n = want(library, text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.count(frame.limit(0), PATH).collect() == []


def test_states_are_bounded_within_a_text(library, monkeypatch):
    """All states are forgotten again and again in the midst of words, and the counts stay the library's."""
    monkeypatch.setattr(token_counts, "STATES_KEPT", 300)
    few, rng = token_counts.Machine(open(PATH, "rb").read()), random.Random(9)
    for size in (50, 2000, 60_000):
        for parts in ("etaoinshrdlucmbfgjkpqvwxyz", "ab'12!é", "etaoin   's"):
            text = "".join(rng.choice(parts) for _ in range(size))
            for chunk in (7, 1000, token_counts.CHUNK):
                assert few.count(text, chunk=chunk) == want(library, text), (parts, size, chunk)
                # Only what the words of one chunk make comes on top.
                assert len(few.states) + len(few.merge_states) <= 300 + 4 * chunk + 64


def test_states_of_a_very_long_word(library):
    """Letters by chance make a new state almost each time; the default bound holds within the text."""
    rng = random.Random(10)
    machine = token_counts.Machine(open(PATH, "rb").read())
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))
    assert machine.count(text) == want(library, text)
    assert len(machine.states) + len(machine.merge_states) <= token_counts.STATES_KEPT + 64
