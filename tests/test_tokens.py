import pytest
from pyspark.sql import functions as F

from lexiloom.functions import lexicon, scalars
from lexiloom.operators import codec, dictionary, respace, tokens


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_ord long, text string")


def scanned(spark, text):
    rows = tokens.tokens(files(spark, [text])).orderBy("line_no", "tok_no").collect()
    return [(r.ttype, r.tstr) for r in rows]


def test_lexicon_sizes():
    sizes = {"js": 60, "ts": 68, "c": 53, "cpp": 85, "java": 56, "csharp": 105, "go": 25, "rust": 54, "swift": 71, "kotlin": 75, "php": 73, "ruby": 43, "sql": 88, "bash": 52, "python": 35}
    assert {k: len(v) for k, v in lexicon.KEYWORDS.items()} == sizes and len(lexicon.BUILTINS["js"]) == 62 and len(lexicon.CODE_EXTENSIONS) == 29


def test_detect_language():
    assert lexicon.detect_language("a/b.TS")[0] == ".ts" and "keyof" in lexicon.detect_language("x.ts")[1] and "console" in lexicon.detect_language("x.ts")[2]
    assert lexicon.detect_language("x.go")[2] == frozenset() and lexicon.detect_language("x.txt") == lexicon.detect_language(".c") == (None, None, None)


@pytest.mark.parametrize("text,want", [
    ("a->b", ["a", "-", ">", "b"]), ("x>>>=1", ["x", ">>>=", "1"]), ("0..10", ["0.", ".10"]), ("10n", ["10", "n"]), ("1_000", ["1", "_000"]), ("0x1F 0b01 0o7 1.5e-3f .5", ["0x1F", "0b01", "0o7", "1.5e-3f", ".5"]),
    ("a ** b", ["a", "*", "*", "b"]), ("$x = 'a\\'b' + \"c\"", ["$", "x", "=", "'a\\'b'", "+", '"c"']), ("é...x", ["é", "...", "x"]), ("f(`a${b}`)", ["f", "(", "`a${b}`", ")"]), ("`a${b", ["`a${", "b"]),
])
def test_grammar(spark, text, want):
    assert [t for _, t in scanned(spark, text)] == want


def test_types_and_lines(spark):
    rows = tokens.tokens(files(spark, ["if (x) {\n\t y = 'it // is'; // don't\n\n/* a\n b */ z`\n}"])).orderBy("line_no", "tok_no").collect()
    got = [(r.line_no, r.indent, r.ttype, r.tstr) for r in rows]
    assert got[:4] == [(1, 0, "NAME", "if"), (1, 0, "OP", "("), (1, 0, "NAME", "x"), (1, 0, "OP", ")")]
    assert [g for g in got if g[0] == 2] == [(2, 2, "NAME", "y"), (2, 2, "OP", "="), (2, 2, "STRING", "'it // is'"), (2, 2, "OP", ";")]
    assert [g[2:] for g in got if g[0] == 4] == [("NAME", "z"), ("NAME", "`")] and got[-1][2:] == ("OP", "}")


def test_long_tokens_need_no_recursion(spark):
    text = '"' + "a\\n" * 20_000 + '" /*' + "* " * 20_000 + "*/ x"
    assert [t[0] for t in scanned(spark, text)] == ["STRING", "NAME"]


def test_python_tokens(spark):
    rows = tokens.python_tokens(files(spark, ["def f(a,\n      b):\n\tx = f'{a}b{{' # c\n\n\treturn x\n", "x = (", "class A: pass"])).orderBy("file_ord", "line_no", "tok_no").collect()
    first = [(r.line_no, r.indent, r.ttype, r.tstr) for r in rows if r.file_ord == 0]
    assert [f[3] for f in first if f[0] == 1] == ["def", "f", "(", "a", ","] and [f[3] for f in first if f[0] == 2] == ["b", ")", ":"]
    assert [f for f in first if f[0] == 3] == [(3, 1, "NAME", "x"), (3, 1, "OP", "="), (3, 1, "STRING", "f'{a}b{{'")]
    assert first[-1] == (4, 1, "NAME", "x")
    assert [r.error is not None for r in rows if r.file_ord == 1] == [True] and [r.tstr for r in rows if r.file_ord == 2] == ["class", "A", ":", "pass"]


@pytest.mark.parametrize("text,want", [
    ("a->b", "a - >b"), ("$x", "$ x"), ("x := 1", "x: = 1"), ("(-1)", "(- 1)"), ("a ** b", "a * * b"), ("0..10", "0. .10"), ("10n", "10 n"), ("1_000", "1 _000"), ("else {", "else{"),
    ('import { a } from "m"', 'import {a} from "m"'), ("#include <x>", "#include<x>"), ("a ? b : c", "a?b: c"), ("a < b", "a<b"), ("#!/bin/sh", "#! / bin / sh"),
])
def test_generic_spaces(spark, text, want):
    assert [r.text for r in respace.texts(tokens.tokens(files(spark, [text])), respace.generic_space()).collect()] == [want + "\n"]


def test_python_spaces(spark):
    source = "def f(a,b=1,*c):\n  return [a[1:2],{'k':b}]if a==b else-1\n@x.y\nclass A(B):pass\n"
    got = respace.texts(tokens.python_tokens(files(spark, [source])), respace.python_space()).collect()[0].text
    assert got == "def f(a, b = 1, *c):\n  return[a[1: 2], {'k': b}] if a == b else-1\n@x.y\nclass A(B): pass\n"


def built(spark, texts, lang="js"):
    found = dictionary.classify(tokens.tokens(files(spark, texts)).withColumn("lang", F.lit(lang)), lexicon.lexicon(spark))
    return found, dictionary.build(found)


def test_dictionary_order(spark):
    _, entries = built(spark, ["let b = a; b(1.5, 22, 'x', 'y'); _z", "var a = console; a('x', 3, 'y', \"once\")"])
    got = {}
    for r in entries.orderBy("cls", "idx").collect():
        got.setdefault(r.cls, []).append(r.token)
    assert got["kw"] == ["let", "var"] and got["bi"] == ["console"] and got["op"] == sorted(got["op"]) and got["nu"] == ["3", "22", "1.5"]
    assert got["id"] == ["a", "b"] and got["st"] == ["'x'", "'y'"]  # a is seen first later than b, but three times


def test_streams_round_trip(spark):
    texts = ["let x = 1;\n  if (x) {\n  y('s', 's', 't');\n}", "", "_q\n" + " " * 126 + "deep"]
    found, entries = built(spark, texts)
    coded = codec.encode_tokens(found.drop("cls"), entries)
    block = dictionary.serialize(entries).first().block
    parsed = codec.parse_dictionary(bytes(block))
    assert parsed["kw"] == ["if", "let"] and parsed["st"] == ["'s'"]
    for r in codec.streams(coded).collect():
        back = [(a, c, e) for a, _, c, _, e in codec.parse_stream(bytes.fromhex(r.stream_hex), parsed)]
        own = found.where(F.col("file_ord") == r.file_ord).orderBy("line_no", "tok_no").collect()
        assert [(i, t) for _, i, t in back] == [(x.indent, x.tstr) for x in own]
    decoded = codec.decode_codes(coded, entries).where("decoded is null or decoded != tstr")
    assert decoded.count() == 0


def test_stream_bytes(spark):
    found, entries = built(spark, ["let a;\n\n  a $"])
    (stream,) = codec.streams(codec.encode_tokens(found.drop("cls"), entries)).collect()
    # Same indent, k0 i0 o0; indent 2, i0, raw $.
    assert stream.stream_hex == "FF" + "6B00" + "6900" + "6F00" + "82" + "6900" + "72000124"
    assert bytes(dictionary.serialize(entries).first().block) == b"k\0\1\0\3letb\0\0o\0\1\0\1;n\0\0i\0\1\0\1as\0\0"


def test_limits(spark):
    found, entries = built(spark, [" " * 127 + "x"])
    with pytest.raises(Exception, match="deeper than 126"):
        codec.streams(codec.encode_tokens(found.drop("cls"), entries)).collect()
    wide = spark.range(65_536).select(F.lit("id").alias("cls"), F.col("id").alias("idx"), F.col("id").cast("string").alias("token"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="65535"):
        dictionary.serialize(wide).collect()
    with pytest.raises(ValueError, match="bi expected"):
        codec.parse_dictionary(b"k\0\0x")


def test_merge(spark):
    make = lambda rows: spark.createDataFrame(rows, "cls string, idx long, token string, n long")
    a, b = make([("kw", 0, "if", 1), ("kw", 1, "in", 1), ("id", 0, "x", 5)]), make([("kw", 0, "for", 1), ("kw", 1, "if", 2), ("id", 0, "y", 9), ("id", 1, "x", 2)])
    got = [(r.cls, r.idx, r.token) for r in dictionary.merge(a, b).orderBy("cls", "idx").collect()]
    assert got == [("id", 0, "x"), ("id", 1, "y"), ("id", 2, "x"), ("kw", 0, "if"), ("kw", 1, "in"), ("kw", 2, "for")]
    assert {r.token: r.idx for r in dictionary.lookup(dictionary.merge(a, b)).collect()}["x"] == 2


def test_names_and_paths(spark):
    names = [r.n for r in spark.range(scalars.NAMES + 1).select(scalars.short_name(F.col("id")).alias("n")).collect()]
    assert names[:2] == ["a", "b"] and names[52:54] == ["_", "aa"] and names[scalars.NAMES - 1] == "___" and names[-1] is None and len(set(names)) == scalars.NAMES + 1
    rows = spark.createDataFrame([("x/y.tar.gz",), (".bashrc",), ("n",), ("a.PY",)], "p string").select(scalars.suffix(scalars.basename(F.col("p"))).alias("s"), scalars.stem(scalars.basename(F.col("p"))).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(".gz", "y.tar"), ("", ".bashrc"), ("", "n"), (".PY", "a")]
