"""Reproducible samples of images, and the images that stand for a category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_images(images: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` images without replacement: those with the least hash of key and seed; all where there are fewer.

    The same rows whatever their order; a top-k, not a sort of all rows.
    """
    return images.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(n)


def reference_samples(boxes: DataFrame, usable: DataFrame | None = None, per_label: int = 1, label: str = "label", image: str = "image_id", order: str = "seq") -> DataFrame:
    """``(label, image_id, seq)``: the first ``per_label`` boxes of each label, by image and place.

    ``usable(image_id)`` lists the images that can be read; boxes of others do not count.
    """
    own = boxes if usable is None else boxes.join(usable.select(image).distinct(), image, "left_semi")
    if per_label == 1:  # a map-side combined minimum, no sort
        return own.groupBy(label).agg(F.min(F.struct(image, order)).alias("f")).select(label, "f.*")
    n = F.row_number().over(Window.partitionBy(label).orderBy(image, order))
    return own.select(label, image, order, n.alias("_n")).where(F.col("_n") <= per_label).drop("_n")
