"""Dense images in one row: what a pixel's neighbourhood decides, in one pass.

Pixels and low-resolution logits are gathered into one row per image by one shuffle; the
image itself bounds the row. One narrow pass then upsamples the logits, predicts, compares
predictions with their neighbours and measures how far a pixel is from the next
label. Any radius is a comparison with that distance. Whatever needs no neighbour
(scores, losses, regions) stays with the column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: Pixels that are worked on at once (16 MB of eight logits).
PIXELS = 1 << 18


def gather_images(cells: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per image: keys, height, width and each value as an array in row order.

    A missing or repeated pixel is an error.
    """
    named = cells.select(*keys, F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[c.alias(n) for n, c in values.items()]).alias("cell"))
    images = named.groupBy(*keys).agg(F.array_sort(F.collect_list("cell")).alias("cells"), (F.max("cell.y") + 1).alias("height"), (F.max("cell.x") + 1).alias("width"))
    # in row order, every pixel stands where its coordinates say
    placed = F.forall(F.transform("cells", lambda c, i: c["y"] * F.col("width") + c["x"] == i), lambda ok: ok)
    whole = (F.size("cells") == F.col("height") * F.col("width")) & placed
    checked = F.when(whole, F.col("height")).otherwise(F.raise_error(F.lit("an image must be a full grid of single pixels")))
    return images.select(*keys, checked.alias("height"), "width", *[F.col(f"cells.{n}").alias(n) for n in values])


def axis_weights(size: int, target: int) -> np.ndarray:
    """Half-pixel bilinear weights, target positions by source positions."""
    weights = np.zeros((target, size))
    source = np.maximum((np.arange(target) + 0.5) * size / target - 0.5, 0.0)
    first = np.floor(source).astype(int)
    part = source - first
    weights[np.arange(target), first] += 1.0 - part
    weights[np.arange(target), np.minimum(first + 1, size - 1)] += part
    return weights


def _shifts(grid: np.ndarray) -> Iterator[np.ndarray]:
    """The nine neighbours of each cell of the last two axes, edges repeated."""
    padded = np.pad(grid, [(0, 0)] * (grid.ndim - 2) + [(1, 1)] * 2, mode="edge")
    for dy in range(3):
        for dx in range(3):
            yield padded[..., dy : dy + grid.shape[-2], dx : dx + grid.shape[-1]]


def label_distance(labels: np.ndarray, reach: int) -> np.ndarray:
    """Chessboard distance to the nearest pixel of another label, reach + 1 if farther; images are the last two axes.

    Extremes of a box grow by one ring in two line passes; a pixel's distance
    is the first ring at which they differ.
    """
    distance = np.full(labels.shape, reach + 1, dtype=np.int32)
    high, low = labels.copy(), labels.copy()
    for r in range(1, reach + 1):
        for axis in (-2, -1):
            ends = [np.concatenate([np.take(g, [0], axis), g, np.take(g, [-1], axis)], axis) for g in (high, low)]
            parts = [[np.take(e, range(k, k + labels.shape[axis]), axis) for k in range(3)] for e in ends]
            high, low = np.maximum.reduce(parts[0]), np.minimum.reduce(parts[1])
        distance[(high != low) & (distance > r)] = r
    return distance


def image_units(logits: DataFrame, labels: DataFrame, keys: list[str], sample: str, classes: int, reach: int, digits: int | None = None) -> DataFrame:
    """Pixels of every logit image, upsampled to its labels: keys, y, x, label, logits, local_disagreement, distance.

    ``logits``: gathered by ``keys`` with ``logits`` (one array a cell); ``labels``: gathered by
    ``sample`` with ``label``. Ignored labels take part in distances. ``digits`` rounds
    upsampled logits, so that exact ties do not hang on the order of a sum.
    """
    fields = [logits.schema[k] for k in keys]
    schema = StructType(
        [*fields, *[StructField(n, IntegerType()) for n in ("y", "x", "label")], StructField("logits", ArrayType(DoubleType())), StructField("local_disagreement", DoubleType()), StructField("distance", IntegerType())]
    )

    def numbers(batch: pa.RecordBatch, name: str, at: np.ndarray) -> np.ndarray:
        return batch.column(name).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column(n).to_numpy() for n in ("_h", "_w", "height", "width")], axis=1)
            for h, w, height, width in np.unique(sizes, axis=0):
                same = np.flatnonzero((sizes == (h, w, height, width)).all(axis=1))
                most = max(1, PIXELS // (height * width))
                for at in np.split(same, range(most, len(same), most)):
                    coarse = numbers(batch, "_z", at).reshape(len(at), h, w, classes)
                    fine = np.tensordot(axis_weights(h, height), coarse, (1, 1)).transpose(1, 0, 2, 3)
                    fine = np.tensordot(fine, axis_weights(w, width), (2, 1)).transpose(0, 1, 3, 2)
                    fine = fine if digits is None else np.round(fine, digits)
                    label = numbers(batch, "label", at).astype(np.int32).reshape(len(at), height, width)
                    winner = fine.argmax(axis=3)
                    differs = sum((near != winner).astype(int) for near in _shifts(winner)) / 9.0
                    _, y, x = np.indices(label.shape, dtype=np.int32)
                    lists = pa.ListArray.from_arrays(np.arange(label.size + 1, dtype=np.int32) * np.int32(classes), fine.reshape(-1))
                    found = [y, x, label, lists, differs, label_distance(label, reach)]
                    columns = [c if isinstance(c, pa.Array) else pa.array(c.ravel()) for c in found]
                    owner = pa.array(np.repeat(at, height * width))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(owner) for k in keys], *columns], names=schema.names)

    coarse = logits.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w"), F.flatten("logits").alias("_z"))
    # gathered images are far larger than the files that Spark sizes them by: never broadcast
    return coarse.join(labels.select(sample, "height", "width", "label").hint("merge"), sample).mapInArrow(pixels, schema)
