"""Rewriting of SVG text, step by step in a fixed order. One way and lossy."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the steps look for and put in its place.
_DROPPED = [
    r'(?s)<style class="style-fonts">.*?</style>',
    r"<defs>\s*</defs>",
    r"<mask>\s*</mask>",
    r"<metadata>\s*</metadata>",
    r"(?s)<!--.*?-->",
]
_LITERAL = [
    (' standalone="no"', ""),
    (' direction="ltr"', ""),
    (' dominant-baseline="alphabetic"', ""),
    (' style="white-space: pre;"', ""),
    ('font-family="Comic Shanns, monospace, Segoe UI Emoji"', 'font-family="monospace"'),
    ("#ffffff", "#fff"),
]
_REDUNDANT = [
    (r'\s+stroke="none"\s+stroke-width="0"', ""),
    (r'fill="none"\s+(stroke="[^"]+")', "$1"),
    (r'(stroke="[^"]+")\s+fill="none"', "$1"),
]
_BLANKS = [(r">\s+<", "><"), (r"  +", " "), (r"^\s+|\s+$", "")]
DECIMAL = re.compile(r"-?\d+\.\d+")
DECLARATION = re.compile(r"<\?xml[^?]*\?>")
GROUP = re.compile(r'<g stroke-linecap="round" transform="([^"]+)">(.*?)</g>', re.DOTALL)
CENTRE = re.compile(r"rotate\(0\s+([\d.]+)\s+([\d.]+)\)")
FILL = re.compile(r'fill="(#[^"]+)"')
STROKES = [
    re.compile(r'<path[^>]*fill="none"[^>]*stroke="(#[^"]+)"[^>]*stroke-width="([^"]+)"'),
    re.compile(r'<path[^>]*stroke="(#[^"]+)"[^>]*stroke-width="([^"]+)"[^>]*fill="none"'),
]
DEFAULT_FILL, DEFAULT_STROKE = "#e7f5ff", ("#1971c2", "2")


def clean(svg: Column) -> Column:
    """Without embedded fonts, empty elements, comments and default attributes; white shortened."""
    for pattern in _DROPPED:
        svg = F.regexp_replace(svg, pattern, "")
    for old, new in _LITERAL:
        svg = F.replace(svg, F.lit(old), F.lit(new))
    return svg


def drop_redundant(svg: Column) -> Column:
    for pattern, new in _REDUNDANT:
        svg = F.regexp_replace(svg, pattern, new)
    return svg


def squeeze(svg: Column) -> Column:
    for pattern, new in _BLANKS:
        svg = F.regexp_replace(svg, pattern, new)
    return svg


def rewrite_plain(svg: Column) -> Column:
    """All steps that column functions express; numbers and drawn rectangles stay."""
    return squeeze(drop_redundant(clean(svg)))


def _plain(number: float) -> str:
    return str(int(number)) if number == int(number) else str(number)


def round_numbers(svg: str) -> str:
    """Decimals after an XML declaration at one place; whole ones without the point."""
    declared = DECLARATION.search(svg)
    cut = declared.end() if declared else 0
    return svg[:cut] + DECIMAL.sub(lambda m: _plain(round(float(m.group()), 1)), svg[cut:])


def _rectangle(match: re.Match) -> str:
    transform, inner = match.groups()
    centre = CENTRE.search(transform)
    if not centre:
        return match.group()
    cx, cy = map(float, centre.groups())
    fill = FILL.search(inner)
    stroke, width = next((m.groups() for m in (p.search(inner) for p in STROKES) if m), DEFAULT_STROKE)
    corner = _plain(round(cy / 2, 1) if cy / 2 != int(cy / 2) else cy / 2)
    shape = f'<rect x="0" y="0" width="{_plain(2 * cx)}" height="{_plain(2 * cy)}" rx="{corner}" ry="{corner}"'
    paint = f'fill="{fill.group(1) if fill else DEFAULT_FILL}" stroke="{stroke}" stroke-width="{width}"'
    return f'<g transform="{transform}">{shape} {paint}></rect></g>'


def rectangles(svg: str) -> str:
    """Hand-drawn groups turned round their centre as rectangles."""
    return GROUP.sub(_rectangle, svg)


@F.pandas_udf(StringType())
def rounded(svg: pd.Series) -> pd.Series:
    return svg.map(round_numbers, na_action="ignore")


@F.pandas_udf(StringType())
def with_rectangles(svg: pd.Series) -> pd.Series:
    return svg.map(rectangles, na_action="ignore")


def rewrite(files: DataFrame, col: str = "text", into: str = "text") -> DataFrame:
    """``files`` with the column rewritten by all steps in order."""
    out = files.withColumn(into, rounded(clean(F.col(col))))
    out = out.withColumn(into, with_rectangles(drop_redundant(F.col(into))))
    return out.withColumn(into, squeeze(F.col(into)))
