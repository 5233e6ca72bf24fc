"""Encoders at the edge of the engine: any function from a batch of inputs to vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.shipping import ship


#: Models of this Python worker, by the call that asked for them.
_loaded: dict[str, Callable] = {}


def loaded(call: str, make: Callable[[], Callable]) -> Callable:
    """What ``make`` returns, made once per worker and call."""
    if call not in _loaded:
        _loaded.clear()  # a worker holds the model of one call at a time
        _loaded[call] = make()
    return _loaded[call]


def encode_column(df: DataFrame, column: str, make: Callable[[], Callable[[list], np.ndarray]], out: str = "embedding") -> DataFrame:
    """The frame with vectors of ``column``; ``make`` is called once per Python worker (models load there)."""
    ship(df.sparkSession)
    call = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = loaded(call, make)
        for values in batches:
            yield pd.Series(list(np.asarray(encode(values.tolist()), np.float32)), index=values.index)

    return df.withColumn(out, run(F.col(column)))


def hashed_words(dim: int = 64) -> Callable[[], Callable[[list], np.ndarray]]:
    """A stand-in text encoder: signed hashed words, unit length; blank texts are zero."""

    def make() -> Callable[[list], np.ndarray]:
        import hashlib

        def encode(texts: list) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for word in (text or "").lower().split():
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
                size = np.linalg.norm(out[i])
                out[i] /= size if size >= 1e-8 else 1
            return out

        return encode

    return make


def propose(df: DataFrame, make: Callable[[], Callable[[bytes], list[tuple[list[float], float]]]], image: str = "image_id", content: str = "content", most: int = 180) -> DataFrame:
    """``(image_id, seq, objectness, x1, y1, x2, y2)`` from a proposal model over image bytes."""
    ship(df.sparkSession)
    kind = df.schema[image].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = [(key, n, score, *box) for key, data in zip(batch[image], batch[content], strict=True) for n, (box, score) in enumerate(model(data)[: max(1, most)])]
            yield pd.DataFrame(rows, columns=["image_id", "seq", "objectness", "x1", "y1", "x2", "y2"])

    return df.select(image, content).mapInPandas(run, f"image_id {kind}, seq int, objectness double, x1 double, y1 double, x2 double, y2 double")
