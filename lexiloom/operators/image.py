"""Images: colour quantization, runs of equal colours, their bytes.

Relational forms: labels (img, y, x, ci), palette (img, ci, r, g, b), runs (img, ci, y, start_x, length).
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import files

# Fixed values of the quantizer and of the run format.
CLUSTERS, SEED, RESTARTS, MINI_FROM, MINI_RESTARTS, STEPS = 16, 42, 10, 20, 3, 100
SHORT_DELTA, SHORT_RUN = 128, 255


def quantize(points: DataFrame, features: list[str], k: int = CLUSTERS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(labelled, palette): ``points`` with ``ci``, and the centres, clipped to 0..255 and truncated.

    Distributed Lloyd steps from several seeded starts, the cheapest kept: ten starts below 20 clusters, three from there on.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    # Equal points are one, with a weight: an image has far fewer colours than pixels.
    data = assembler.transform(points.groupBy(*features).agg(F.count("*").cast("double").alias("_weight"))).cache()
    starts = RESTARTS if k < MINI_FROM else MINI_RESTARTS
    models = [KMeans(k=k, seed=seed + i, maxIter=STEPS, featuresCol="_features", predictionCol="ci", weightCol="_weight").fit(data) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = [(i, *[int(max(0.0, min(255.0, x))) for x in c]) for i, c in enumerate(model.clusterCenters())]
    palette = points.sparkSession.createDataFrame(centres, "ci int, " + ", ".join(f"c_{f} int" for f in features))
    data.unpersist()
    return model.transform(assembler.transform(points)).drop("_features"), palette


def quality(labelled: DataFrame, palette: DataFrame, features: list[str]) -> DataFrame:
    """One row (mse, psnr): the points against the palette's colours."""
    joined = labelled.join(F.broadcast(palette), "ci")
    error = sum(F.pow(F.col(f).cast("double") - F.col(f"c_{f}"), 2) for f in features) / len(features)
    return joined.agg(F.avg(error).alias("mse")).select("mse", scalars.psnr(F.col("mse")).alias("psnr"))


def runs(labels: DataFrame) -> DataFrame:
    """Maximal stretches of neighbouring columns of one colour in one row: one sort by (img, ci, y, x)."""
    nth = F.row_number().over(Window.partitionBy("img", "ci", "y").orderBy("x"))
    islands = labels.withColumn("_island", F.col("x") - nth)
    return islands.groupBy("img", "ci", "y", "_island").agg(F.min("x").alias("start_x"), F.count("*").cast("int").alias("length")).drop("_island")


def row_deltas(run_rows: DataFrame) -> DataFrame:
    """(img, ci, y, n_runs, delta): each colour's rows and the step from the one before, which is -1 at first."""
    rows = run_rows.groupBy("img", "ci", "y").agg(F.count("*").cast("int").alias("n_runs"))
    return rows.withColumn("delta", F.col("y") - F.lag("y", 1, -1).over(Window.partitionBy("img", "ci").orderBy("y")))


def restore_rows(deltas: DataFrame) -> DataFrame:
    """``deltas`` with ``y`` again, from the steps; ``nth`` orders them."""
    upto = Window.partitionBy("img", "ci").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.withColumn("y", (F.sum("delta").over(upto) - 1).cast("int"))


def hex_delta(delta):
    """One byte below 128, else two with the first one's high bit set."""
    return F.when(delta < SHORT_DELTA, scalars.hex_be(delta, 1)).otherwise(scalars.hex_be(delta + 0x8000, 2))


def hex_run(start, length):
    """The start in two little-endian bytes; the length in one below 255, else 255 and two little-endian bytes."""
    return F.concat(scalars.hex_le16(start), F.when(length < SHORT_RUN, scalars.hex_be(length, 1)).otherwise(F.concat(F.lit("FF"), scalars.hex_le16(length))))


def stream_hex(run_rows: DataFrame, palette: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, stream_hex): size, palette and the runs by colour and row, for (img, width, height)."""
    row = run_rows.groupBy("img", "ci", "y").agg(scalars.ordered_join(F.col("start_x"), hex_run(F.col("start_x"), F.col("length"))).alias("body"))
    row = row.join(row_deltas(run_rows), ["img", "ci", "y"]).select("img", "ci", "y", F.concat(hex_delta(F.col("delta")), scalars.hex_be(F.col("n_runs"), 1), F.col("body")).alias("body"))
    per = row.groupBy("img", "ci").agg(F.concat(scalars.hex_le16(F.count("*")), scalars.ordered_join(F.col("y"), F.col("body"))).alias("body"))
    every = palette.join(per, ["img", "ci"], "left").withColumn("body", F.coalesce("body", F.lit("0000")))
    rgb = F.concat(*[scalars.hex_be(F.col(c), 1) for c in "rgb"])
    head = every.groupBy("img").agg(scalars.hex_be(F.count("*"), 1).alias("k"), scalars.ordered_join(F.col("ci"), rgb).alias("colors"), scalars.ordered_join(F.col("ci"), F.col("body")).alias("body"))
    return sizes.join(head, "img").select("img", F.concat(scalars.hex_le32(F.col("width")), scalars.hex_le32(F.col("height")), "k", "colors", "body").alias("stream_hex"))


def expand(run_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, y, x, ci): the pixels that runs cover, cut off at the image's width."""
    joined = run_rows.join(F.broadcast(sizes.select("img", "width")), "img").where("length > 0 and start_x < width")
    last = F.least(F.col("start_x") + F.col("length"), F.col("width")) - 1
    return joined.select("img", "y", F.explode(F.sequence("start_x", last)).alias("x"), "ci")


def encode_runs(labels: np.ndarray, centres: np.ndarray) -> bytes:
    """The run bytes of a label matrix; sizes beyond the format's fields raise ValueError."""
    if len(centres) > 255:
        raise ValueError("a palette holds 255 colours at most")
    h, w = labels.shape
    out = [bytes([len(centres)]), np.asarray(centres, np.uint8).tobytes()]
    # Starts and ends of all runs at once, in order of rows.
    change = np.ones((h, w + 1), bool)
    change[:, 1:w] = labels[:, 1:] != labels[:, :-1]
    y, start = np.nonzero(change[:, :w])
    _, end = np.nonzero(change[:, 1:])
    color, length = labels[y, start], end + 1 - start
    order = np.lexsort((start, y, color))
    y, start, color, length = y[order], start[order], color[order], length[order]
    for c in range(len(centres)):
        a, b = np.searchsorted(color, [c, c + 1])
        rows, first, counts = np.unique(y[a:b], return_index=True, return_counts=True)
        if len(rows) > 0xFFFF or (len(counts) and counts.max() > 255) or w > 0xFFFF:
            raise ValueError("an image is too large for the run format")
        out.append(struct.pack("<H", len(rows)))
        before = -1
        for row, at, n in zip(rows.tolist(), (first + a).tolist(), counts.tolist()):
            delta, before = row - before, row
            if delta >= 1 << 15:
                raise ValueError("an image is too large for the run format")
            out.append(struct.pack(">H", delta + 0x8000) if delta >= SHORT_DELTA else bytes([delta]))
            out.append(bytes([n]))
            for s, size in zip(start[at : at + n].tolist(), length[at : at + n].tolist()):
                out.append(struct.pack("<HB", s, size) if size < SHORT_RUN else struct.pack("<HBH", s, SHORT_RUN, size))
    return b"".join(out)


def parse_runs(data: bytes):
    """(palette, [(ci, y, start_x, length)]) of run bytes."""
    k, pos, found = data[0], 1, []
    palette = np.frombuffer(data, np.uint8, 3 * k, pos).reshape(k, 3)
    pos += 3 * k
    for ci in range(k):
        (rows,) = struct.unpack_from("<H", data, pos)
        pos, y = pos + 2, -1
        for _ in range(rows):
            step, pos = data[pos], pos + 1
            if step >= SHORT_DELTA:
                step, pos = (step - SHORT_DELTA) * 256 + data[pos], pos + 1
            y += step
            n, pos = data[pos], pos + 1
            for _ in range(n):
                start, length = struct.unpack_from("<HB", data, pos)
                pos += 3
                if length == SHORT_RUN:
                    (length,) = struct.unpack_from("<H", data, pos)
                    pos += 2
                found.append((ci, y, start, length))
    return palette, found


def decode_image(stream: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes) of an image stream; what no run covers is black, what a run has beyond the width is dropped."""
    w, h = struct.unpack_from("<II", stream)
    palette, found = parse_runs(stream[8:])
    out = np.zeros((h, w, 3), np.uint8)
    for ci, y, start, length in found:
        out[y, start : min(start + length, w)] = palette[ci]
    return w, h, out.tobytes()


def _lloyd(pixels: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of one image's distinct colours, weighted by their counts, seeded by k-means++, the cheapest of several starts."""
    colors, inverse, counts = np.unique(pixels, axis=0, return_inverse=True, return_counts=True)
    data, best = colors.astype(float), None
    k = min(k, len(data))
    for start in range(RESTARTS if k < MINI_FROM else MINI_RESTARTS):
        rng = np.random.default_rng(seed + start)
        centres = data[[rng.choice(len(data), p=counts / counts.sum())]]
        while len(centres) < k:
            d = ((data[:, None] - centres[None]) ** 2).sum(2).min(1) * counts
            centres = np.vstack([centres, data[rng.choice(len(data), p=d / d.sum())]])
        for _ in range(STEPS):
            label = ((data[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            weight = np.bincount(label, counts, minlength=k)
            moved = np.stack([np.bincount(label, counts * data[:, i], minlength=k) for i in range(3)], 1)
            moved = np.where(weight[:, None] > 0, moved / np.maximum(weight, 1)[:, None], centres)
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = (((data - centres[label]) ** 2).sum(1) * counts).sum()
        if best is None or cost < best[0]:
            best = (cost, centres, label)
    return best[2][inverse.ravel()], np.clip(best[1], 0, 255).astype(np.uint8)


def encode_images(images: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """(img, width, height, stream, psnr) of ``sources.files.scan_images``, each image in the task that has it."""

    def run(batches):
        for b in batches:
            rows = []
            for img, w, h, data in zip(b["img"], b["width"], b["height"], b["pixels"]):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, 3)
                label, palette = _lloyd(pixels, k, seed)
                mse = ((pixels.astype(float) - palette[label]) ** 2).mean()
                stream = struct.pack("<II", w, h) + encode_runs(label.reshape(h, w), palette)
                rows.append((img, w, h, stream, float(10 * np.log10(65025 / mse)) if mse > 0 else float("inf")))
            yield pd.DataFrame(rows, columns=["img", "width", "height", "stream", "psnr"])

    return images.mapInPandas(run, "img string, width int, height int, stream binary, psnr double")


def colors(images: DataFrame) -> DataFrame:
    """(img, colors): distinct colours of each image."""
    return files.pixels(images).groupBy("img").agg(F.countDistinct("r", "g", "b").alias("colors"))
