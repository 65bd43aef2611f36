"""Image operators over rows of pixels: crop and preprocess, perceptual block hash, text extraction.

Images are rows (id, width, height, channels, data) with row-major bytes, channels in the
order of Spark's image source (blue, green, red[, alpha]; 1 is grey). Only pixel work runs
in Python, on Arrow batches; boxes and size checks are columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import crop_box, large_enough
from ..functions.text import base64_text, clean_text
from ..sources.readers import read_images_checked

# Fixed values of the filter chain.
CONTRAST = 0.73
BRIGHTNESS = 0.235
COLOUR_REGIONS = ("art", "flavor")
BLUR_FACTOR, BLUR_SHIFT = 57, 9  # a ninth of a sum in whole numbers
SIDE = 16
BANDS = 4


def from_image_source(df: DataFrame) -> DataFrame:
    """Rows of Spark's image source as id, width, height, channels, data."""
    i = "image."
    return df.select(F.col(i + "origin").alias("id"), F.col(i + "width").alias("width"), F.col(i + "height").alias("height"), F.col(i + "nChannels").alias("channels"), F.col(i + "data").alias("data"))


def split_by_size(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(large enough, rejected with an error)."""
    fits = F.coalesce(large_enough(F.col("width"), F.col("height")), F.lit(False))
    return images.where(fits), images.where(~fits).drop("data").withColumn("error", F.lit("Image is too small"))


def _pixels(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width, channels).astype(float)


def _mean(p: np.ndarray) -> np.ndarray:
    """The mean of 3 x 3 neighbours in whole numbers, edges repeated."""
    pad = np.pad(p, ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = p.shape[:2]
    return sum(pad[y : y + h, x : x + w] for y in range(3) for x in range(3)) * BLUR_FACTOR >> BLUR_SHIFT


def preprocess(pixels: np.ndarray, grey: bool = True) -> np.ndarray:
    """Grey, contrast, brightness, then a blur of radius 1: two passes of a 3 x 3 mean."""
    p = pixels[..., :3]
    if grey and p.shape[2] == 3:
        p = (p @ np.array([0.0722, 0.7152, 0.2126]))[..., None]
    p = np.clip(np.floor((1 + CONTRAST) / (1 - CONTRAST) * (p - 127) + 127), 0, 255)
    p = np.clip(p + (255 - p) * BRIGHTNESS, 0, 255).astype(np.int64)
    return _mean(_mean(p)).astype(np.uint8)


def snippets(images: DataFrame, regions: tuple[str, ...] = ("name", "type", "art", "flavor"), preserve_colour: bool = False) -> DataFrame:
    """Cropped, preprocessed regions of the images that are large enough: id, region, width, height, channels, data.

    split_by_size gives the other images.
    """
    images = split_by_size(images)[0]
    each = images.select("*", F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"))
    each = each.withColumn("box", crop_box(F.col("width"), F.col("height"), F.col("region"))).select(
        "id", "region", "width", "height", "channels", "data", "box.left", "box.top", F.col("box.width").alias("w"), F.col("box.height").alias("h")
    )
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                p = _pixels(r["width"], r["height"], r["channels"], r["data"])
                p = p[r["top"] : r["top"] + r["h"], r["left"] : r["left"] + r["w"]]
                out.append(preprocess(p, not (preserve_colour and r["region"] in COLOUR_REGIONS)))
            sizes = [pa.array([x.shape[k] for x in out], pa.int32()) for k in (1, 0, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *sizes, pa.array([x.tobytes() for x in out], pa.binary())], ["id", "region", "width", "height", "channels", "data"])

    return each.mapInArrow(run, f"id {kind}, region string, width int, height int, channels int, data binary")


def block_hash(pixels: np.ndarray, side: int = SIDE) -> str:
    """Hexadecimal hash of side x side blocks against the median of their band."""
    height, width, channels = pixels.shape
    value = pixels[..., :3].sum(2) if channels >= 3 else pixels[..., 0] * 3
    if channels == 4:
        value = np.where(pixels[..., 3] == 0, 765, value)

    def weights(size: int) -> np.ndarray:
        edge = np.arange(side + 1) * size / side
        at = np.arange(size)
        return np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, None)

    blocks = weights(height) @ value @ weights(width).T
    half = (width / side) * (height / side) * 256 * 3 / 2
    bands = blocks.reshape(BANDS, -1)
    median = np.median(bands, axis=1)[:, None]
    bits = (bands > median) | ((np.abs(bands - median) < 1) & (median > half))
    nibbles = bits.reshape(-1, 4) @ np.array([8, 4, 2, 1])
    return "".join(f"{x:x}" for x in nibbles)


def hash_images(images: DataFrame, side: int = SIDE) -> DataFrame:
    """id, hash."""
    kind = images.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [block_hash(_pixels(*x), side) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.string())], ["id", "hash"])

    return images.select("id", "width", "height", "channels", "data").mapInArrow(run, f"id {kind}, hash string")


def hash_paths(spark: SparkSession, paths: list[str], side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """Hashes of images by path: (path, hash), and (path, error) of paths that are no image. Paths are those of any store that Spark reads."""
    good, bad = read_images_checked(spark, paths)
    return hash_images(from_image_source(good), side).withColumnRenamed("id", "path"), bad


class Extractor(Protocol):
    """Reads text from a preprocessed snippet; built once per task by the factory given to extract_text."""

    def __call__(self, width: int, height: int, channels: int, data: bytes) -> str: ...


def extract_text(snips: DataFrame, factory: Callable[[], Extractor], keep_spaces: bool = False) -> DataFrame:
    """id, region, dirty_text, clean_text. No recogniser is bundled: callers bring the factory."""
    kind = snips.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = factory()
        for b in batches:
            texts = [read(*x) for x in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "region", "dirty_text"])

    out = snips.select("id", "region", "width", "height", "channels", "data").mapInArrow(run, f"id {kind}, region string, dirty_text string")
    return out.withColumn("clean_text", clean_text(F.col("dirty_text"), keep_spaces))


def read_regions(
    images: DataFrame, factory: Callable[[], Extractor], regions: tuple[str, ...] = ("name", "type"), keep_spaces: bool = False,
) -> DataFrame:
    """Crop, preprocess and extract in one call: id, region, dirty_text, clean_text."""
    return extract_text(snippets(images, regions), factory, keep_spaces)


def base64_images(snips: DataFrame) -> DataFrame:
    """One row per id with the four regions as base64 text."""
    one = lambda r: F.max(F.when(F.col("region") == r, base64_text(F.col("data")))).alias(f"{r}_image")
    return snips.groupBy("id").agg(*[one(r) for r in ("flavor", "art", "type", "name")])
