"""Command lines: ``python -m lexiloom.plans.cli pack|unpack ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import image, report
from ..sources import files as sources
from ..sources import sinks
from . import archive


def pack(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.directory:
        files = sources.scan_directory(spark, args.directory)
    elif args.inputs:
        files, left = sources.scan_files(spark, args.inputs)
        for r in left.toLocalIterator():
            print(f"skipped {r.asked}: {r.reason}", file=sys.stderr)
    else:
        print("nothing to pack", file=sys.stderr)
        return 1
    files = files.cache()
    if files.isEmpty():
        print("no supported file", file=sys.stderr)
        return 1
    pngs = [r.path for r in files.where("file_type = 'g'").select("path").toLocalIterator()]
    images = sources.scan_images(spark, pngs) if pngs else None
    if args.info:
        for r in sources.file_info(files, images).orderBy("fname").toLocalIterator():
            print(f"{r.fname}: {r.n_bytes} bytes" + (f", {r.width}x{r.height}, {r.colors} colors" if r.colors else ""))
        return 0
    for r in archive.rejected(files).toLocalIterator():
        print(f"skipped {r.fname}: {r.reason}", file=sys.stderr)
    packed, psnr = archive.pack(files, images, args.clusters)
    path = sinks.archive_path(args.inputs, args.directory, args.output)
    sinks.write_files(packed.select(F.lit(os.path.basename(path)).alias("fname"), F.col("blob").alias("content")), os.path.dirname(path))
    size, orig = os.path.getsize(path), report.original_bytes(files).first().orig_bytes
    print(f"{path}: {size} of {orig} bytes" + (f", {100 * size / orig:.1f}%, {orig / size:.1f}x" if orig else ""))
    for r in report.by_type(files).orderBy("file_type").toLocalIterator():
        print(f"{r.file_type}: {r.files} files ({r.exts})")
    for r in psnr.toLocalIterator():
        print(f"{r.img}: {r.psnr:.1f} dB with {args.clusters} colors")
    return 0


def unpack(spark: SparkSession, args: argparse.Namespace) -> int:
    if not os.path.exists(args.input):
        print(f"no such file: {args.input}", file=sys.stderr)
        return 1
    done = archive.open_archive(spark, args.input).cache()
    out = sinks.output_directory(args.input, done.count(), args.output)
    sinks.write_files(done, out)
    print(f"{done.count()} files in {out}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexiloom")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("pack", help="files into an archive")
    p.add_argument("inputs", nargs="*")
    p.add_argument("-d", "--directory")
    p.add_argument("-o", "--output")
    p.add_argument("-k", "--clusters", type=int, default=image.CLUSTERS)
    p.add_argument("--info", action="store_true", help="only tell what the files are")
    p.set_defaults(run=pack)
    p = sub.add_parser("unpack", help="an archive into files")
    p.add_argument("input")
    p.add_argument("output", nargs="?", default="output")
    p.set_defaults(run=unpack)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
