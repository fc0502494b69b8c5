"""Spaces between tokens, as chains of rules; the first that holds decides.

Columns: ttype, tstr and, from the token before on the line, ptype and pstr (null on a line's first token, which gets no space).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lexicon import KEYWORDS

# The token sets of the rules.
WORDS = ["NAME", "NUMBER", "STRING"]
PY_ASSIGN = ["=", "+=", "-=", "*=", "/=", "//=", "%=", "**=", ":="]
PY_COMPARE = ["==", "!=", "<=", ">=", "<", ">"]
CLOSING = [")", "]", "}"]
BINARY = ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>", "+", "-", "*", "/", "%", "&&", "||", "&", "|", "^", "<<", ">>", "==", "!=", "===", "!==", "<=", ">=", "=>", "->"]
BRACE_WORDS = ["as", "export", "from", "import"]
SPACED_WORDS = """abstract alias as assert async await break case catch class const continue declare def defer delete do elif else elsif ensure
enum except export extends final finally fn for from fun func function goto guard if implements import in instanceof interface lambda lazy let
match module mutable namespace new of override package private protected public raise rescue return static struct switch template throw throws
try type typedef typeof union unless until using var virtual void volatile where while with yield""".split()
NOT_AFTER_WORD = [".", "::", "<", ">", "[", "]", "(", ")", ";", ",", "{"]

Rule = tuple[Column, Column | bool]


def _columns() -> tuple:
    t, s, pt, ps = F.col("ttype"), F.col("tstr"), F.col("ptype"), F.col("pstr")
    here = lambda xs: (t == "OP") & s.isin(*xs)
    before = lambda xs: (pt == "OP") & ps.isin(*xs)
    return t, s, pt, ps, here, before


def _first(rules: list[Rule]) -> Column:
    value = lambda v: F.lit(v) if isinstance(v, bool) else v
    head, *rest = rules
    chain = reduce(lambda acc, r: acc.when(r[0], value(r[1])), rest, F.when(head[0], value(head[1])))
    return F.coalesce(chain, F.lit(False))


def python_space() -> Column:
    """Whether a space stands before a token of Python."""
    t, s, pt, ps, here, before = _columns()
    return _first([
        (pt.isNull(), False),
        (before(CLOSING) & t.isin(*WORDS), True),
        (before([":"]) & ~here([*CLOSING, ","]), True),
        (before([","]) & ~here(CLOSING), True),
        (here(PY_COMPARE) | before(PY_COMPARE), True),
        (here(PY_ASSIGN) | before(PY_ASSIGN), True),
        ((pt == "NAME") & ps.isin(*sorted(KEYWORDS["python"])) & (t != "OP"), True),
        (pt.isin(*WORDS) & t.isin(*WORDS), True),
    ])


def generic_space() -> Column:
    """Whether a space stands before a token of a C-like language."""
    t, s, pt, ps, here, before = _columns()
    after_word = (pt == "NAME") & ps.isin(*SPACED_WORDS)
    return _first([
        (pt.isNull(), False),
        (here(["<", ">"]) & (ps.contains("include") | ps.contains("pragma")), False),
        (here([">"]) & (pt == "NAME"), False),
        ((t == "NAME") & before(["#"]), False),
        (here(["@"]), True),
        (here(["("]) & (pt == "NAME") & ~ps.isin(*SPACED_WORDS), False),
        (here(["(", "."]) & before([")", "]"]), False),
        (here([".", "::"]) | before([".", "::"]), False),
        (before(CLOSING) & t.isin(*WORDS), True),
        (before([";"]), True),
        (before([":"]), ~here([*CLOSING, ","])),
        (before([","]), ~here(CLOSING)),
        (before(BINARY), ~here([".", "::", *CLOSING, ",", ";", ":"])),
        (here(BINARY), ~before([".", "::", "(", "[", "{", "@"])),
        (after_word & here(["("]), False),
        (after_word & here(["{"]), ps.isin(*BRACE_WORDS)),
        (after_word & ~here(NOT_AFTER_WORD), True),
        (pt.isin(*WORDS) & t.isin(*WORDS), True),
    ])


def lines(tokens: DataFrame, space: Column, by: tuple[str, ...] = ("file_ord",)) -> DataFrame:
    """(by..., line_no, line): each line's indent and tokens."""
    w = Window.partitionBy(*by, "line_no").orderBy("tok_no")
    spaced = tokens.withColumn("ptype", F.lag("ttype").over(w)).withColumn("pstr", F.lag("tstr").over(w))
    piece = F.concat(F.when(space, " ").otherwise(""), F.col("tstr"))
    joined = spaced.withColumn("piece", piece).groupBy(*by, "line_no").agg(F.first("indent").alias("indent"), scalars.ordered_join(F.col("tok_no"), F.col("piece")).alias("body"))
    return joined.select(*by, "line_no", F.concat(F.repeat(F.lit(" "), F.col("indent")), F.col("body")).alias("line"))


def texts(tokens: DataFrame, space: Column, by: tuple[str, ...] = ("file_ord",)) -> DataFrame:
    """(by..., text): the source of each file, each line ended by a newline."""
    return lines(tokens, space, by).groupBy(*by).agg(scalars.ordered_join(F.col("line_no"), F.concat("line", F.lit("\n"))).alias("text"))
