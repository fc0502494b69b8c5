"""Sinks: archives, decoded files, PNG images, bundles."""

from __future__ import annotations

import base64
import json
import lzma
import os
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESET = 9


def build_container(block: bytes, files: list[tuple[str, str, bytes]]) -> bytes:
    """The bytes of an archive: dictionary, headers, then all streams, compressed in one go.

    Names that could leave the output folder, unknown types and sizes beyond the format's fields raise ValueError.
    """
    if len(files) > 0xFFFF:
        raise ValueError("an archive holds 65535 files at most")
    head = [struct.pack(">I", len(block)), block, struct.pack(">H", len(files))]
    for name, kind, stream in files:
        check_name(name)
        raw = name.encode()
        if kind not in "pcsg" or len(kind) != 1:
            raise ValueError(f"{name}: unknown file type {kind!r}")
        if len(raw) > 0xFFFF or len(stream) > 0xFFFFFFFF:
            raise ValueError(f"{name}: too long")
        head.append(struct.pack(">H", len(raw)) + raw + struct.pack(">cI", kind.encode(), len(stream)))
    return lzma.compress(b"".join(head + [stream for _, _, stream in files]), preset=PRESET)


def check_name(name: str) -> None:
    if not name or name.startswith("/") or "\\" in name or "\x00" in name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"unsafe file name {name!r}")


def pack(streams: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(archive_id, blob) of (archive_id, file_ord, fname, file_type, stream) and (archive_id, dictionary).

    An archive is one compressed value, so one task builds it; many archives are built side by side.
    """

    def build(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("file_ord")
        block = next((bytes(d) for d in files["dictionary"] if d is not None), b"")
        blob = build_container(block, [(n, k, bytes(s)) for n, k, s in zip(files["fname"], files["file_type"], files["stream"])])
        return pd.DataFrame({"archive_id": [files["archive_id"].iloc[0]], "blob": [blob]})

    joined = streams.join(dictionaries, "archive_id", "left").select("archive_id", "file_ord", "fname", "file_type", "stream", "dictionary")
    return joined.groupBy("archive_id").applyInPandas(build, "archive_id string, blob binary")


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An RGB image as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def write_files(files: DataFrame, directory: str) -> None:
    """Writes (fname, content) below a directory that all executors share, each file whole by the task that has it."""

    def run(rows) -> None:
        for r in rows:
            check_name(r.fname)
            path = os.path.join(directory, r.fname)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "wb") as f:
                f.write(r.content)
            os.replace(path + ".part", path)  # a task that runs twice leaves the same file

    files.select("fname", F.col("content").cast("binary").alias("content")).foreachPartition(run)


def archive_path(inputs: list[str], directory: str | None = None, output: str | None = None) -> str:
    """Where an archive goes: the output folder, else compress/ and the base name; the base is the directory's or the first input's."""
    if directory:
        base = os.path.basename(os.path.normpath(directory))
    else:
        base = os.path.splitext(os.path.basename(inputs[0]))[0]
    return os.path.join(output or os.path.join("compress", base), f"{base}.compress")


def output_directory(archive: str, files: int, output: str = "output") -> str:
    """Where an archive's files go: a folder of its own if there are several."""
    return os.path.join(output, os.path.splitext(os.path.basename(archive))[0]) if files > 1 else output


def build_bundle(files: dict[str, str]) -> str:
    """A self-extracting bundle's literal."""
    return base64.b64encode(zlib.compress(json.dumps(files).encode())).decode()
