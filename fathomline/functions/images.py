"""Decoded images and their crops, for image encoders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.encoders import loaded
from fathomline.functions.exprs import box, crop_bounds
from fathomline.shipping import ship


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, height, width, channels, data)`` of the images below a folder, decoded in the JVM; broken files are dropped."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Floats from 0 to 255 as (height, width, 3), from decoded bytes in the order blue, green, red; grey is repeated, transparency dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]).astype(np.float32)


def crops(images: DataFrame, regions: DataFrame, key: str = "path") -> DataFrame:
    """Regions with ``crop``, the bounds in whole pixels inside their image, and the image's columns."""
    known = regions.join(images, key)
    return known.withColumn("crop", crop_bounds(box(), F.col("width"), F.col("height")))


def encode_crops(cropped: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "embedding") -> DataFrame:
    """Regions with a vector each from ``make()(pixels)``, made once per worker; the pixels are dropped."""
    ship(cropped.sparkSession)
    call = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        encode = loaded(call, make)
        for rows in batches:
            made = []
            for data, h, w, c, x1, y1, x2, y2 in rows.itertuples(index=False):
                made.append(np.asarray(encode(rgb(data, h, w, c)[y1:y2, x1:x2]), np.float32))
            yield pd.Series(made, index=rows.index, dtype=object)

    columns = F.struct("data", "height", "width", "channels", *[F.col(f"crop.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return cropped.withColumn(out, run(columns)).drop("data", "height", "width", "channels")


def colour_grid(cells: int = 4) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A stand-in image encoder: mean colours of a grid of cells, unit length (black stays zero)."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def encode(pixels: np.ndarray) -> np.ndarray:
            h, w, _ = pixels.shape
            made = [pixels[i * h // cells : max(i * h // cells + 1, (i + 1) * h // cells), j * w // cells : max(j * w // cells + 1, (j + 1) * w // cells)].mean(axis=(0, 1)) for i in range(cells) for j in range(cells)]
            v = np.concatenate(made)
            size = np.linalg.norm(v)
            return v / size if size >= 1e-8 else v

        return encode

    return make
