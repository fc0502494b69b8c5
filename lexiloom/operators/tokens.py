"""Texts to lines to tokens.

A token row is (file_ord, line_no, tok_no, indent, ttype, tstr); ttype is NAME, OP, STRING or NUMBER. Lines count from 1 as in the text, with
comments gone; lines without tokens give no rows.
"""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lexical grammar, tried in this order. Loops are possessive: matching a long token needs neither recursion nor memory.
DOUBLE = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
SINGLE = r"'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'"
BACKTICK = r"`[^`\\]*+(?:\\[^\n][^`\\]*+)*+`"
#: Up to the last ${ of a template that the line doesn't close.
TEMPLATE_HEAD = r"`(?:(?:[^`\\$\n]++|\\[^\n]|\$(?!\{))*+\$\{)++"
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
NUMBER = r"0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?[fFlLiJuUzZ]*"
OPERATOR = r"\+\+|--|::|<<=?|>>>=?|>>=?|===|!==|=>|\.\.\.|&&|\|\||[-+*/%&|^!=<>]=?|[?~,.:;\[\](){}@#]"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
WHITESPACE = r"[ \t\r\f\v]+"
TOKEN = "|".join([DOUBLE, SINGLE, BACKTICK, TEMPLATE_HEAD, LINE_COMMENT, BLOCK_COMMENT, NUMBER, OPERATOR, IDENTIFIER, WHITESPACE, r"[^\n]"])
#: A string or a comment, whichever starts first; a string is kept, a comment is not.
STRING_OR_COMMENT = f"({DOUBLE}|{SINGLE}|{BACKTICK})|{BLOCK_COMMENT}|{LINE_COMMENT}"
#: The same matches sooner: what no other alternative starts like stands first, and a string or comment is sought at its first characters only.
QUICK_TOKEN = "|".join([IDENTIFIER, r"\x20++(?![\t\r\f\v])", r"[\p{L}\p{M}&&[^\x00-\x7F]]", TOKEN])
QUICK_STRING_OR_COMMENT = f"(?=[\"'`/])(?:{STRING_OR_COMMENT})"
OPERATOR_CHARS = "+-:<>=!.&|*/%^?~,;[](){}@#"

TOKEN_SCHEMA = "file_ord long, line_no int, tok_no int, indent int, ttype string, tstr string"


def strip_comments(text: Column) -> Column:
    """Without block and line comments; strings and template literals, which may hold comment marks, stay as they are."""
    return F.regexp_replace(text, STRING_OR_COMMENT, "$1")


def token_type(token: Column) -> Column:
    """The type of a whole token of the grammar; null for blanks and comments."""
    first = F.substr(token, F.lit(1), F.lit(1))
    return (
        F.when(token.rlike(r"^(?:[ \t\r\f\v]+$|//|/\*)"), F.lit(None).cast("string"))
        .when((F.length(token) > 1) & first.isin('"', "'", "`"), "STRING")
        .when(token.rlike(r"^\.?[0-9]"), "NUMBER")
        .when(first.isin(*OPERATOR_CHARS), "OP")
        .otherwise("NAME")
    )


def lines(files: DataFrame, text_col: str = "text", id_col: str = "file_ord") -> DataFrame:
    """(file_ord, line_no, indent, line) of texts without comments; the indent counts leading blanks and tabs. Blank lines are dropped."""
    split = files.select(F.col(id_col).cast("long").alias("file_ord"), F.posexplode(F.split(strip_comments(F.col(text_col)), "\n")).alias("line_no", "line"))
    body = F.regexp_replace("line", r"^[ \t]+", "")
    return split.select("file_ord", (F.col("line_no") + 1).alias("line_no"), (F.length("line") - F.length(body)).alias("indent"), body.alias("line")).where("line != ''")


def tokens(files: DataFrame, text_col: str = "text", id_col: str = "file_ord") -> DataFrame:
    """Token rows of texts in C-like and other languages, by the grammar above; a narrow plan of column functions."""
    found = lines(files, text_col, id_col).select("file_ord", "line_no", "indent", F.posexplode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("tok_no", "tstr"))
    typed = found.withColumn("ttype", token_type(F.col("tstr"))).where("ttype is not null")
    return typed.select("file_ord", "line_no", "tok_no", "indent", "ttype", "tstr")


def occurrences(files: DataFrame, *keep: str) -> DataFrame:
    """(file_ord, pos, tstr, ...) of texts: the tokens of ``tokens`` and other blanks than single ones, numbered through each text; a narrow plan, without types."""
    each = F.transform(F.split(F.regexp_replace("text", QUICK_STRING_OR_COMMENT, "$1"), "\n"), lambda line: F.regexp_extract_all(line, F.lit(QUICK_TOKEN), F.lit(0)))
    found = files.select(F.col("file_ord").cast("long").alias("file_ord"), *keep, F.flatten(each).alias("_all"))
    # The outer form: else the optimizer adds a filter on the array, before any exchange, which tokenizes once more.
    return found.select("file_ord", *keep, F.posexplode_outer("_all").alias("pos", "tstr")).where("tstr != ' '")


def _python_rows(text: str):
    """(line_no, tok_no, indent, ttype, tstr): a line ends at each NEWLINE or NL token and has the indent of its block."""
    kinds = {tokenize.NAME: "NAME", tokenize.OP: "OP", tokenize.STRING: "STRING", tokenize.NUMBER: "NUMBER"}
    source = text.splitlines(keepends=True)
    begins, ends = getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_END", -1)
    indents, line_no, tok_no, depth, opened = [0], 1, 0, 0, None
    for tok in tokenize.generate_tokens(io.StringIO(text).readline):
        if tok.type == begins:
            depth += 1
            opened = opened or tok.start
        elif tok.type == ends:
            depth -= 1
            if not depth:  # the whole literal, as it stands in the source, is one string
                (a, i), (b, j) = opened, tok.end
                literal = source[a - 1][i:j] if a == b else source[a - 1][i:] + "".join(source[a : b - 1]) + source[b - 1][:j]
                yield line_no, tok_no, indents[-1], "STRING", literal
                tok_no, opened = tok_no + 1, None
        elif depth:
            continue
        elif tok.type in (tokenize.NEWLINE, tokenize.NL):
            line_no, tok_no = line_no + (tok_no > 0), 0
        elif tok.type == tokenize.INDENT:
            indents.append(len(tok.string))
        elif tok.type == tokenize.DEDENT:
            indents.pop()
        elif tok.type in kinds:
            yield line_no, tok_no, indents[-1], kinds[tok.type], tok.string
            tok_no += 1


def python_tokens(files: DataFrame, text_col: str = "text", id_col: str = "file_ord") -> DataFrame:
    """Token rows of Python sources, with ``error`` null; a source that can't be tokenized gives one row with its error and no token.

    Line numbers count the lines that have tokens. Formatted strings are one STRING, on every Python version.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b["file_ord"], b["text"]):
                try:
                    rows += [(i, *r, None) for r in _python_rows(text or "")]
                except (tokenize.TokenError, SyntaxError) as e:
                    rows.append((i, 0, 0, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_ord", "line_no", "tok_no", "indent", "ttype", "tstr", "error"])

    own = files.select(F.col(id_col).cast("long").alias("file_ord"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, TOKEN_SCHEMA + ", error string")
