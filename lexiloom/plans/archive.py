"""Packing files into an archive and taking one apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ext_lang, lexicon
from ..operators import codec, dictionary, image, respace, svg, tokens
from ..sources import files as sources
from ..sources import sinks


def token_rows(files: DataFrame, kind: str) -> DataFrame:
    """Tokens of the files of a type, with the language of each."""
    spark = files.sparkSession
    own = files.where((F.col("file_type") == kind) & F.col("text").isNotNull())
    found = tokens.python_tokens(own).where("error is null").drop("error") if kind == "p" else tokens.tokens(own)
    langs = own.join(F.broadcast(ext_lang(spark)), "ext").select("file_ord", "lang")
    return found.join(F.broadcast(langs), "file_ord")


def rejected(files: DataFrame) -> DataFrame:
    """(fname, reason) of files that can't be packed: not UTF-8, or Python that can't be tokenized."""
    unread = files.where("error is not null").select("fname", F.col("error").alias("reason"))
    bad = tokens.python_tokens(files.where((F.col("file_type") == "p") & F.col("text").isNotNull())).where("error is not null")
    return unread.unionByName(bad.join(files.select("file_ord", "fname"), "file_ord").select("fname", F.col("error").alias("reason")))


def build_dictionary(python: DataFrame, generic: DataFrame) -> DataFrame:
    """The dictionary of both kinds of sources; either may be empty."""
    words = lexicon(python.sparkSession)
    a, b = (dictionary.build(dictionary.classify(t, words)) for t in (python, generic))
    return dictionary.merge(a, b)


def pack(files: DataFrame, images: DataFrame | None = None, clusters: int = image.CLUSTERS, archive_id: str = "archive") -> tuple[DataFrame, DataFrame]:
    """((archive_id, blob), (img, psnr)): one archive of the files of ``scan_directory`` or ``scan_files``.

    Of equal base names the last counts. Streams come by kind: Python, other code, SVG, images.
    """
    spark = files.sparkSession
    files = sources.last_of_name(files).where("error is null").withColumn("file_ord", F.col("first_ord")).cache()
    python, generic = token_rows(files, "p").cache(), token_rows(files, "c").cache()
    entries = build_dictionary(python, generic).cache()
    coded = codec.encode_tokens(python.unionByName(generic), entries)
    code = codec.streams(coded).select("file_ord", F.unhex("stream_hex").alias("stream"))
    untokenized = tokens.python_tokens(files.where("file_type = 'p'")).where("error is not null").select("file_ord").distinct()
    sourced = files.where("file_type in ('p', 'c')").join(untokenized, "file_ord", "left_anti").join(code, "file_ord", "left")
    head = ["file_ord", "fname", "file_type"]
    streams = sourced.select(*head, F.coalesce("stream", F.lit(b"")).alias("stream"))
    drawn = svg.rewrite(files.where("file_type = 's'")).select(*head, F.encode("text", "UTF-8").alias("stream"))
    streams = streams.unionByName(drawn)
    psnr = spark.createDataFrame([], "img string, psnr double")
    if images is not None:
        encoded = image.encode_images(images, clusters).cache()
        psnr = encoded.select("img", "psnr")
        streams = streams.unionByName(files.where("file_type = 'g'").join(encoded, F.col("fname") == F.col("img")).select(*head, "stream"))
    rank = F.when(F.col("file_type") == "p", 0).when(F.col("file_type") == "c", 1).when(F.col("file_type") == "s", 2).otherwise(3)
    ordered = streams.withColumn("file_ord", rank.cast("long") * (1 << 40) + F.col("file_ord")).withColumn("archive_id", F.lit(archive_id))
    block = dictionary.serialize(entries)
    if files.where("file_type in ('p', 'c')").isEmpty():
        block = spark.createDataFrame([(b"",)], "block binary")
    return sinks.pack(ordered, block.select(F.lit(archive_id).alias("archive_id"), F.col("block").alias("dictionary"))), psnr


def unpack(archived: DataFrame) -> DataFrame:
    """(archive_id, fname, file_type, kind, text, width, height, content) of ``scan_archives``; ``content`` is what a file gets."""
    code = codec.decode_streams(archived.where("file_type in ('p', 'c')"))
    by = ("archive_id", "file_ord")
    typed = code.join(archived.select(*by, "file_type"), list(by))
    texts = respace.texts(typed.where("file_type = 'p'"), respace.python_space(), by).unionByName(respace.texts(typed.where("file_type = 'c'"), respace.generic_space(), by))
    named = archived.select(*by, "fname", "file_type", "stream")
    code_files = named.where("file_type in ('p', 'c')").join(texts, list(by), "left").withColumn("text", F.coalesce("text", F.lit("")))
    svg_files = named.where("file_type = 's'").withColumn("text", F.decode("stream", "UTF-8"))
    columns = ["archive_id", "file_ord", "fname", "file_type"]
    sources_ = code_files.unionByName(svg_files).select(*columns, F.lit("source").alias("kind"), "text", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.encode("text", "UTF-8").alias("content"))

    def pictures(batches):
        for b in batches:
            done = [image.decode_image(s) for s in b["stream"]]
            own = {c: b[c].tolist() for c in columns}
            yield pd.DataFrame(own | {"kind": "image", "text": None, "width": [w for w, _, _ in done], "height": [h for _, h, _ in done], "content": [sinks.png(*x) for x in done]})

    pics = named.where("file_type = 'g'").select(*columns, "stream").mapInPandas(pictures, sources_.schema)
    return sources_.unionByName(pics)


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    return unpack(sources.scan_archives(spark, path))
