import hashlib
import random
import re

import pytest

from lexiloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    """Base spans by the plain patterns."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def check(spark, texts, extra=""):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (text, base, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[2] == k for x in want) for k in pii.BASE_KINDS]
    return got


def test_random_texts_match_the_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "@x.yy", "..", ".", "-", "+", "1", "12", "255", "256", "1.2.3.4", " ", "  ", "(", ")", "_", "%", "\n", "é", "😀", "4539578763621486", "4539 5787-6362 1486", "+1 (234) 555-7890", "\x01", "\x02", "0012.", "mail"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    check(spark, texts)


def test_edges(spark):
    got = check(spark, [
        None, "", "x" * 5000, "1" * 20000, "1 " * 20000, "1.2.3.4." * 5000, "a@" + "b." * 20000 + "c", "a." * 20000 + "@b.cc", "a@b.co_x@d.com", "a@b.c@d.e", "+1" * 3000,
        "x😀 a@b.cc 4539578763621486", "pay DE89 3704 0044 0532 0130 00 now", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "then 123-45-6789", "card 4539578763621486" * 400,
    ])
    assert got[0].spans == "" and got[0].top_score is None
    assert "iban:4:31" in got[12].spans and got[13].spans == ""
    assert got[14].spans == "ssn:4:15" and got[15].spans == ""


def test_redact_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cc, or 1.2.3.4!", "k"), (1, "write to a@b.cc, or 1.2.3.4!", "k"), (2, None, "s"), (3, "clean", None), (4, "+14539578763621 a@b.cc", "q")], "doc_id long, text string, pii_kind string")
    rows = sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == ["write to <EMAIL>, or <IP>!"] * 2 + [None, "clean", "<PHONE> <EMAIL>"]
    assert rows[0].asDict().keys() == {"doc_id", "text", "pii_kind"}
    assert pii.redact(docs.limit(0)).collect() == []


def test_context_after_the_span(spark):
    texts = ["123-45-6789 (SSN)", "123-45-6789 " + "x" * 60 + " ssn", "no label: 123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in sorted(pii.report(docs).collect(), key=lambda r: r.doc_id)] == ["ssn:0:11", "", ""]
    assert pii.redact(docs.where("doc_id = 0")).first().text == "<SSN> (SSN)"


@pytest.mark.parametrize("number,good", [("4539578763621486", True), ("4539578763621487", False)])
def test_luhn(spark, number, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(number)).alias("x")).first().x is good
