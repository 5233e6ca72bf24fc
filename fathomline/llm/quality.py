"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a lexical and a shape feature (both hashed into fixed ranges), and
the text adds marks for words that repeat the one before or occurred already.
Each feature owns a sparse ternary index vector; its word vector is that plus the
index vectors of its neighbours over the training rows. A document is the mean of
its features' vectors; a two-layer network with a temperature fitted on rows kept
back turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts, worker_table
from fathomline.llm.sample import crc_rest, fit_in_one_task, labelled_sample

LEXICAL, SHAPES, DIM, NONZERO, HIDDEN = 2048, 1024, 64, 6, 32
AGAIN, SEEN = LEXICAL + SHAPES, LEXICAL + SHAPES + 1
FEATURES = LEXICAL + SHAPES + 2
MOST_WORDS = 400_000


def shape(word: str) -> str:
    """Kinds of the characters, runs shortened: 'Ered***' is 'Aa*'."""
    out = []
    for c in word:
        kind = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


class Words(dict):
    """A word's features packed into one integer: lexical, shape, length over three, hash."""

    def __missing__(self, word: str) -> int:
        stem = "".join(c for c in word.lower() if c.isalpha())
        lexical = xxhash.xxh64_intdigest(stem) % LEXICAL
        made = lexical | xxhash.xxh64_intdigest(shape(word)) % SHAPES << 11 | (len(stem) > 3) << 21 | (xxhash.xxh64_intdigest(word) >> 23) << 22
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


_words = worker_table("quality", Words())


def document_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its document, lexical and shape feature; and the documents' counts of marks (n, 2)."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    packed = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    marks = np.zeros((len(texts), 2))
    if len(packed):
        same = (packed[1:] == packed[:-1]) & (owner[1:] == owner[:-1])
        marks[:, 0] = np.bincount(owner[1:][same], minlength=len(texts))
        longer = (packed >> 21 & 1).astype(bool)
        key = np.sort(packed[longer] >> 22 | owner[longer].astype(np.int64) << 49)
        repeat = key[1:][key[1:] == key[:-1]]
        marks[:, 1] = np.bincount(repeat >> 49, minlength=len(texts))
    return owner, packed & (LEXICAL - 1), LEXICAL + (packed >> 11 & (SHAPES - 1)), marks


def counts(texts: list[str]) -> np.ndarray:
    """Feature counts (documents, FEATURES)."""
    out = np.empty((len(texts), FEATURES), np.float32)
    for at in range(0, len(texts), 1024):  # documents at once; the owner of a word has 14 bits above
        part = texts[at : at + 1024]
        owner, lexical, shapes, marks = document_features(part)
        own = out[at : at + len(part)]
        own[:] = np.bincount(np.r_[owner * FEATURES + lexical, owner * FEATURES + shapes], minlength=len(part) * FEATURES).reshape(-1, FEATURES)
        own[:, AGAIN], own[:, SEEN] = marks[:, 0], marks[:, 1]
    return out


def index_vectors() -> np.ndarray:
    """The sparse ternary index vectors of all features, from a fixed seed."""
    rng = np.random.default_rng(20)
    out = np.zeros((FEATURES, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


@dataclass
class Network:
    """Word vectors, weights of both layers, input scaling and the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, counted: np.ndarray) -> np.ndarray:
        words = np.maximum(1, counted[:, :LEXICAL].sum(axis=1, keepdims=True))
        return (counted @ self.vectors) / words

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.logits(self.pooled(counts(texts))) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(float)))


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Adam on the weighted log loss; every fifth row is kept back for the temperature."""
    rng = np.random.default_rng(21)
    held = np.arange(len(y)) % 5 == 4
    held &= len(y) >= 50
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    own = np.flatnonzero(~held)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            hidden = np.tanh(z[at] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3][0], -40, 40))) - y[at]) * weight[at] / weight[at].sum()
            back = error[:, None] * p[2] * (1 - hidden**2)
            grads = [z[at].T @ back + decay * p[0], back.sum(axis=0), hidden.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if held.any():
        logit = np.tanh(z[held] @ p[0] + p[1]) @ p[2] + p[3][0]
        tried = np.geomspace(0.25, 8, 41)
        loss = [(weight[held] * np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t)).sum() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    return mean, scale, p[0], p[1], p[2], float(p[3][0]), temperature


def fit_network(chunks: Iterator[tuple[list[str], np.ndarray, np.ndarray]]) -> Network:
    """Word vectors from the neighbours in all rows, then the network on the pooled rows."""
    index = index_vectors()
    vectors = np.zeros((FEATURES, DIM), np.float64)
    sparse, labels, weights = [], [], []
    for texts, y, weight in chunks:
        for at in range(0, len(texts), 256):
            owner, lexical, shapes, _ = document_features(texts[at : at + 256])
            for gap in (1, 2):
                inside = owner[gap:] == owner[:-gap]
                for ids in (lexical, shapes):
                    a, b = ids[:-gap][inside], ids[gap:][inside]
                    pairs, n = np.unique(np.r_[a * FEATURES + b, b * FEATURES + a], return_counts=True)
                    order = pairs // FEATURES
                    starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.empty(0, int)
                    if len(starts):
                        vectors[order[starts]] += np.add.reduceat(n[:, None] * index[pairs % FEATURES], starts, axis=0)
            sparse += [(np.flatnonzero(row).astype(np.int32), row[row > 0]) for row in counts(texts[at : at + 256])]
        labels.append(y)
        weights.append(weight)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = (index / np.sqrt(NONZERO) + vectors / np.maximum(size, 1e-9)).astype(np.float32)
    net = Network(vectors, *[None] * 5, 0.0, 1.0)
    x = np.empty((len(sparse), DIM))
    for i, (ids, n) in enumerate(sparse):
        row = np.zeros((1, FEATURES), np.float32)
        row[0, ids] = n
        x[i] = net.pooled(row)[0]
    y, weight = np.concatenate(labels).astype(float), np.concatenate(weights)
    net.mean, net.scale, net.w1, net.b1, net.w2, net.b2, net.temperature = train_network(x, y, weight)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", modulus: int = 5, held_out: int = 0, threshold: float = 0.3, per_class: int = 3000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per input row.

    Learned from about ``per_class`` labelled rows of each class that are not held
    out. Null and empty texts are scored as the text without words; without any
    labelled row every score is 0.5; very long texts are read whole; repeated rows,
    null ids and empty tables pass through; other columns are ignored. The fit does
    not depend on the order or place of rows; scores have six digits.
    """
    model = fit_in_one_task(labelled_sample(docs, labels, label, doc_id, text, modulus, held_out, per_class), fit_network)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 0.8 MB of word vectors

    def setup():
        own = shared.value
        return lambda texts: {"score": pa.array(np.round(own.scores(texts), 6) if own else np.full(len(texts), 0.5))}

    scored = map_texts(docs, [doc_id], text, "score double", None, setup, "quality")
    return scored.select(F.col(f"`{doc_id}`"), F.coalesce(crc_rest(doc_id, modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
