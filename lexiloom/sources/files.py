"""Scans: text files, explicit lists, images, archives and bundles as DataFrames."""

from __future__ import annotations

import base64
import json
import lzma
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lexicon import CODE_EXTENSIONS, SUPPORTED

KINDS = {"py": "p", "code": "c", "svg": "s", "png": "g"}


def supported(name: Column) -> Column:
    return F.lower(scalars.suffix(name)).isin(*sorted(SUPPORTED))


def file_type(name: Column) -> Column:
    """The type tag of a file name: p, c, s or g, in this order; ? for others. Extensions count in any case."""
    ext = F.lower(scalars.suffix(name))
    return F.when(ext == ".py", "p").when(ext.isin(*sorted(CODE_EXTENSIONS)), "c").when(ext == ".svg", "s").when(ext == ".png", "g").otherwise("?")


def newlines(text: Column) -> Column:
    """Universal newlines: CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def _described(raw: DataFrame, root: str | None) -> DataFrame:
    path = F.regexp_replace("path", r"^file:/+", "/")
    described = raw.select(path.alias("path"), F.col("length").alias("n_bytes"), "content").withColumn("fname", scalars.basename(F.col("path")))
    relative = F.col("path") if root is None else F.regexp_replace("path", "^" + _quoted(root.rstrip("/") + "/"), "")
    described = described.withColumn("rel_path", relative).withColumn("ext", F.lower(scalars.suffix(F.col("fname")))).withColumn("file_type", file_type(F.col("fname")))
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when((F.col("file_type") != "g") & readable, newlines(F.decode("content", "UTF-8")))
    error = F.when((F.col("file_type") != "g") & ~readable, "not UTF-8")
    return described.withColumn("text", text).withColumn("error", error)


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


def _numbered(files: DataFrame) -> DataFrame:
    """With file_ord by path, part by part. The listing is numbered without the contents, which stay where they were read."""
    order = files.select("path").withColumn("file_ord", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("long") - 1)
    return files.join(F.broadcast(order), "path")


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Every supported file below a directory, in path order: file_ord, path, rel_path, fname, ext, file_type, n_bytes, text, content, error.

    ``text`` has LF newlines and is null for images and for files that aren't UTF-8, which have an ``error``.
    """
    exts = ",".join(sorted(f"*{''.join(f'[{c.lower()}{c.upper()}]' if c.isalpha() else c for c in e)}" for e in SUPPORTED))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{exts}}}").load(directory)
    found = _described(raw, directory)
    return _numbered(found.where(supported(F.col("fname"))))


def scan_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, rejected): the listed files that exist and are supported, as ``scan_directory`` gives them, and the others with a reason."""
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "ord long, asked string")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in dict.fromkeys(paths) if (fs := hadoop(p).getFileSystem(conf)).exists(hadoop(p)) and fs.getFileStatus(hadoop(p)).isFile()]
    exists = F.col("asked").isin(there) if there else F.lit(False)
    good = exists & supported(scalars.basename(F.col("asked")))
    rejected = asked.where(~good).select("asked", F.when(~exists, "no such file").otherwise("unsupported type").alias("reason"))
    wanted = [p for p in there if "." + p.rsplit(".", 1)[-1].lower() in SUPPORTED and "." in p.rsplit("/", 1)[-1][1:]]
    if not wanted:
        empty = spark.createDataFrame([], "path string, length long, content binary, modificationTime timestamp")
        return _numbered(_described(empty, None)), rejected
    order = asked.groupBy(F.regexp_replace("asked", r"^file:/+", "/").alias("path")).agg(F.min("ord").alias("file_ord"))
    return _described(spark.read.format("binaryFile").load(wanted), None).join(F.broadcast(order), "path"), rejected


def last_of_name(files: DataFrame) -> DataFrame:
    """One file for each base name: the last in order, at the place where the name was first seen."""
    w = Window.partitionBy("fname")
    return files.withColumn("first_ord", F.min("file_ord").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("file_ord")))).where("_n = 1").drop("_n")


def scan_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(img, width, height, pixels): images as RGB bytes, row by row, alpha dropped. The image source has BGR."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for d, n in zip(data, channels):
            a = np.frombuffer(d, np.uint8).reshape(-1, n)
            out.append((a[:, [0, 0, 0]] if n == 1 else a[:, [2, 1, 0]]).tobytes())
        return pd.Series(out)

    return image.select(scalars.basename(F.col("origin")).alias("img"), "width", "height", rgb("data", "nChannels").alias("pixels"))


def pixels(images: DataFrame) -> DataFrame:
    """(img, y, x, r, g, b) of ``scan_images``."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    value = lambda k: F.conv(F.hex(F.substr("pixels", (F.col("i") * 3 + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    every = images.where("width * height > 0").select("img", "width", "pixels", at)
    return every.select("img", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), value(0).alias("r"), value(1).alias("g"), value(2).alias("b"))


def file_info(files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(fname, n_bytes, width, height, colors), the last three for images."""
    info = files.select("fname", "n_bytes")
    if images is None:
        return info.select("*", *[F.lit(None).cast("long").alias(c) for c in ("width", "height", "colors")])
    colors = pixels(images).groupBy("img").agg(F.countDistinct(F.struct("r", "g", "b")).alias("colors"))
    sizes = images.select(F.col("img").alias("fname"), F.col("width").cast("long"), F.col("height").cast("long")).join(colors.withColumnRenamed("img", "fname"), "fname", "left")
    return info.join(sizes, "fname", "left")


def parse_container(blob: bytes) -> tuple[bytes, list[tuple[str, str, bytes]]]:
    """(dictionary block, [(name, type, stream)]) of an archive's bytes."""
    data = lzma.decompress(blob)
    (size,) = struct.unpack_from(">I", data)
    block, pos = data[4 : 4 + size], 4 + size
    (count,) = struct.unpack_from(">H", data, pos)
    pos, heads = pos + 2, []
    for _ in range(count):
        (n,) = struct.unpack_from(">H", data, pos)
        name = data[pos + 2 : pos + 2 + n].decode()
        kind, length = struct.unpack_from(">cI", data, pos + 2 + n)
        heads.append((name, kind.decode("latin-1"), length))
        pos += 7 + n
    out = []
    for name, kind, length in heads:
        if kind not in KINDS.values():
            raise ValueError(f"{name}: unknown file type {kind!r}")
        out.append((name, kind, data[pos : pos + length]))
        pos += length
    return block, out


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, file_ord, fname, file_type, stream_off, stream_len, stream, dictionary) of the archives at a path."""

    def run(batches):
        for b in batches:
            for archive, blob in zip(b["path"], b["content"]):
                block, files = parse_container(blob)
                rows, off = [], 0
                for i, (name, kind, stream) in enumerate(files):
                    rows.append((archive, i, name, kind, off, len(stream), stream, block))
                    off += len(stream)
                yield pd.DataFrame(rows, columns=["archive_id", "file_ord", "fname", "file_type", "stream_off", "stream_len", "stream", "dictionary"])

    schema = "archive_id string, file_ord long, fname string, file_type string, stream_off long, stream_len long, stream binary, dictionary binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_bundle(literal: str) -> dict[str, str]:
    """The files of a self-extracting bundle: base64 of zlib of JSON, name to content."""
    return json.loads(zlib.decompress(base64.b64decode(literal)))


def scan_bundles(bundles: DataFrame, col: str = "literal") -> DataFrame:
    """(fname, text) of bundles; the JSON is taken apart by column functions."""

    @F.pandas_udf("string")
    def inflated(data: pd.Series) -> pd.Series:
        return data.map(lambda x: zlib.decompress(x).decode(), na_action="ignore")

    files = F.from_json(inflated(F.unbase64(col)), "map<string,string>")
    return bundles.select(F.explode(files).alias("fname", "text"))
