"""Scalar expressions on columns; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def rounded(x: Column, digits: int) -> Column:
    """``x`` to some digits as SQL engines with binary doubles round: the scaled value, halves away from zero.

    Spark's own goes by the decimal form and drops the sign of what becomes zero.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(x * scale)
    down = F.floor(size).cast("double")
    return F.when(size < 2.0**52, (down + F.when(size - down >= 0.5, 1.0).otherwise(0.0)) / scale * F.signum(x)).otherwise(x)


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector plus the guard against zero."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(EPS)


def normalized(vector: Column) -> Column:
    """The vector over its guarded length."""
    a = as_doubles(vector)
    return F.transform(a, lambda x: x / norm(a))


def unit_or_same(vector: Column) -> Column:
    """Encoders' normalisation: vectors of next to no length stay as they are."""
    a = as_doubles(vector)
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size < EPS, a).otherwise(F.transform(a, lambda x: x / size))


def cosine(a: Column, b: Column) -> Column:
    a, b = as_doubles(a), as_doubles(b)
    return dot(a, b) / (norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; touching boxes have none."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(inter / F.greatest(union, F.lit(EPS)))


def box(row: Column | None = None, prefix: str = "") -> dict[str, Column]:
    """The four sides as columns, of a struct or by column name."""
    return {k: (row[k] if row is not None else F.col(prefix + k)) for k in ("x1", "y1", "x2", "y2")}


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def crop_bounds(b: dict[str, Column], width: Column, height: Column) -> Column:
    """Whole-pixel bounds of a crop: cut towards zero, at least one pixel, inside the image."""
    x1 = F.least(F.greatest(b["x1"].cast("int"), F.lit(0)), width - 1)
    y1 = F.least(F.greatest(b["y1"].cast("int"), F.lit(0)), height - 1)
    x2 = F.greatest(x1 + 1, F.least(width, b["x2"].cast("int")))
    y2 = F.greatest(y1 + 1, F.least(height, b["y2"].cast("int")))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def confidence(agg: Column, margin: Column, consistency: Column, objectness: Column, support: Column) -> Column:
    """Logistic function of the evidence of a label."""
    x = F.lit(4.5) * agg + F.lit(2.0) * margin - F.lit(3.0) * consistency + F.lit(0.5) * F.log1p(support * 10.0) + F.lit(2.0) * objectness
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def modality_passes(modality: Column, wanted: str) -> Column:
    """Equal after trimming and lower-casing; rows without a modality pass."""
    return F.trim(F.lower(F.coalesce(modality, F.lit("")))).isin("", wanted.strip().lower())


def attributes_equal(attrs: dict[str, Column], wanted: dict[str, object]) -> Column:
    """All wanted values, null-safe: an absent attribute equals null only."""
    return reduce(lambda a, b: a & b, [attrs[k].eqNullSafe(F.lit(v)) if k in attrs else F.lit(v is None) for k, v in wanted.items()], F.lit(True))


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty, first of equal values kept."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def from_csv(value: Column) -> Column:
    """Comma-separated queries, trimmed and without blanks (repeats stay)."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def resolved_modality(modality: Column, text_keys: list[Column], image_keys: list[Column]) -> Column:
    """The stated modality, else by which keys are present (text first), else text."""
    stated = F.lower(F.trim(modality))
    has_text = reduce(lambda a, b: a | b, [c.isNotNull() for c in text_keys])
    has_image = reduce(lambda a, b: a | b, [c.isNotNull() for c in image_keys])
    return F.when(stated.isin("text", "image"), stated).when(has_text, "text").when(has_image, "image").otherwise("text")


def two_digits(x: Column) -> Column:
    """``x`` to two digits by its binary value, as C's printf rounds (Java's goes by the decimal form).

    ``p + e`` is a hundred times ``x`` without error: only an exact half is a tie.
    """
    high = x * 134217729.0 - (x * 134217729.0 - x)
    p = x * 100.0
    e = (high * 100.0 - p) + (x - high) * 100.0
    down = F.floor(p).cast("double")
    tie = F.when(e < 0, down).when(e > 0, down + 1).otherwise(F.rint(p))
    return F.when(p - down == 0.5, tie).otherwise(F.rint(p)) / 100.0


def overlay_label(label: Column, confidence: Column, score: Column) -> Column:
    """Caption of a drawn box."""
    return F.format_string("%s: %.2f", F.coalesce(label, F.lit("object")), two_digits(F.coalesce(confidence, score, F.lit(0.0))))
