"""Scalar column functions: names, index widths, byte packing, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the letters of short names, in order.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"
NAMES = 53 + 53**2 + 53**3
#: Entries of a dictionary class from which an index takes two bytes; the most a compatible archive holds.
WIDE_FROM, MOST_ENTRIES = 128, 65_535


def short_name(i: Column) -> Column:
    """The i-th name, from 0: all of one letter, then of two, then of three; null beyond."""
    letter = lambda n: F.substr(F.lit(ALPHABET), (n % 53 + 1).cast("int"), F.lit(1))
    two, three = i - 53, i - 53 - 53**2
    tens = lambda n, unit: letter(F.floor(n / unit))
    return (
        F.when((i >= 0) & (i < 53), letter(i))
        .when((two >= 0) & (three < 0), F.concat(tens(two, 53), letter(two)))
        .when((three >= 0) & (i < NAMES), F.concat(tens(three, 53**2), tens(three, 53), letter(three)))
    )


def index_width(entries: Column) -> Column:
    """Bytes of an index into a class: 1 below 128 entries, else 2; 4 beyond what compatible archives hold."""
    return F.when(entries < WIDE_FROM, 1).when(entries <= MOST_ENTRIES, 2).otherwise(4)


def hex_be(value: Column, width: Column | int) -> Column:
    """A non-negative integer as upper-case hex, big-endian, in ``width`` bytes."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(F.hex(value), (2 * width).cast("int"), F.lit("0"))


def hex_le16(value: Column) -> Column:
    """As upper-case hex, little-endian, in two bytes."""
    return F.concat(hex_be(value % 256, 1), hex_be(F.floor(value / 256), 1))


def hex_le32(value: Column) -> Column:
    return F.concat(hex_le16(value % 65536), hex_le16(F.floor(value / 65536)))


def pack_index(value: Column, width: Column | int) -> Column:
    return F.unhex(hex_be(value, width))


def read_index(data: Column, pos: Column, width: Column) -> Column:
    """The index at ``pos`` (from 0) of binary ``data``."""
    return F.conv(F.hex(F.substr(data, (pos + 1).cast("int"), width.cast("int"))), 16, 10).cast("long")


def hex_text(s: Column) -> Column:
    """A two-byte big-endian length, then the UTF-8 bytes, as hex."""
    return F.concat(hex_be(F.octet_length(s), 2), F.hex(F.encode(s, "UTF-8")))


def hex_raw_token(s: Column) -> Column:
    """A token that no dictionary class holds."""
    return F.concat(F.lit("72"), hex_text(s))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last extension with its dot, as written; empty if there is none or the only dot comes first or last."""
    return F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def ordered_join(order: Column, value: Column, sep: str = "") -> Column:
    """An aggregate: the values joined in the order of ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / mse))
