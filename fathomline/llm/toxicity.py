"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters with two tags, other and toxic. Training needs labelled
tokens: documents are labelled, so a token counts as toxic when its word stands out
in the toxic documents of the training rows (log odds over documents). The field
then learns weights of words, affixes and transitions; forward-backward gives each
token's marginal, marginals give a document's score and the offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts
from fathomline.llm.sample import crc_rest, fit_in_one_task, labelled_sample

TOKEN = re.compile(r"[^\W\d_]+")
WEIGHTS = 1 << 17
AFFIXES = 5  # features of a word: itself, prefixes of 4 and 6, suffixes of 4 and 6
WINDOW = 21  # tokens of a training sequence
BLOCK = 64
MOST_WORDS = 400_000


def features(word: str) -> list[int]:
    """Hashed features of a word in lower case."""
    w = word.lower()
    return [xxhash.xxh64_intdigest(x) % WEIGHTS for x in (f"w{w}", f"p{w[:4]}", f"q{w[:6]}", f"s{w[-4:]}", f"t{w[-6:]}")]


def chain_marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of tag 1 for each position of many chains laid end to end.

    ``emission``: score of tag 1 over tag 0; ``first``: where a chain begins;
    ``start`` and ``move``: scores of first tags and of transitions. Matrices of the
    positions are multiplied in blocks of fixed length, all blocks at once, so the
    work is linear and no chain is too long. A chain's first matrix forgets what
    stands before it.
    """
    n = len(emission)
    if not n:
        return np.empty(0)
    e = np.exp(np.clip(emission, -30, 30))
    blocks = -(-n // BLOCK)
    steps = np.tile(np.eye(2), (blocks * BLOCK, 1, 1))
    s, m = np.exp(start), np.exp(move)
    steps[:n] = np.where(first[:, None, None], np.tile(s, (2, 1)), m)
    steps[:n, :, 1] *= e[:, None]
    steps = steps.reshape(blocks, BLOCK, 2, 2)
    product = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(BLOCK):
        product = product @ steps[:, t]
        product /= product.sum(axis=(1, 2), keepdims=True)
    into, back = np.empty((blocks, 2)), np.empty((blocks, 2))
    a0 = a1 = b0 = b1 = 0.5
    flat = product.reshape(blocks, 4).tolist()
    for k in range(blocks):
        into[k] = a0, a1
        p = flat[k]
        a0, a1 = a0 * p[0] + a1 * p[2], a0 * p[1] + a1 * p[3]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
    for k in range(blocks - 1, -1, -1):
        back[k] = b0, b1
        p = flat[k]
        b0, b1 = p[0] * b0 + p[1] * b1, p[2] * b0 + p[3] * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    forward = np.empty((blocks, BLOCK, 2))
    for t in range(BLOCK):
        into = (into[:, None, :] @ steps[:, t])[:, 0]
        into /= into.sum(axis=1, keepdims=True)
        forward[:, t] = into
    out = np.empty((blocks, BLOCK))
    for t in range(BLOCK - 1, -1, -1):
        both = forward[:, t] * back
        out[:, t] = both[:, 1] / both.sum(axis=1)
        back = (steps[:, t] @ back[:, :, None])[:, :, 0]
        back /= back.sum(axis=1, keepdims=True)
    return out.ravel()[:n]


class Emissions(dict):
    """Score of each word, computed when first met."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        made = float(self.weights[features(word)].sum())
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


@dataclass
class Field:
    """Weights of a trained field and of the document score."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    calibration: np.ndarray | None = None

    def marginals(self, texts: list[str], emissions: Emissions) -> list[np.ndarray]:
        """Each text's marginals, one per token."""
        tokens = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        scores = np.fromiter(map(emissions.__getitem__, chain.from_iterable(tokens)), float, int(sizes.sum()))
        ends = np.cumsum(sizes)
        first = np.zeros(len(scores), bool)
        first[(ends - sizes)[sizes > 0]] = True
        return np.split(chain_marginals(scores, first, self.start, self.move), ends[:-1])

    @staticmethod
    def evidence(marginals: list[np.ndarray]) -> np.ndarray:
        """What a document's score is made of: log of the summed cubes of the marginals
        (weak ones hardly count), the largest marginal, log length, and one."""
        return np.array([(np.log((m**3).sum() + 0.02), m.max(initial=0.0), np.log1p(len(m)), 1.0) for m in marginals]).reshape(-1, 4)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(marginals) @ self.calibration, -40, 40)))


def spans(text: str, marginal: np.ndarray, least: float = 0.5) -> list[dict[str, object]]:
    """Offsets (characters, end exclusive) of runs of tokens with marginals of ``least`` or more."""
    out: list[dict[str, object]] = []
    if not (marginal >= least).any():
        return out
    open_run = False
    for token, p in zip(TOKEN.finditer(text), marginal.tolist(), strict=True):
        if p >= least:
            if open_run:
                out[-1]["end"], out[-1]["p"] = token.end(), max(out[-1]["p"], p)
            else:
                out.append({"start": token.start(), "end": token.end(), "p": p})
        open_run = p >= least
    return out


def toxic_words(toxic: Counter, clean: Counter, n_toxic: float, n_clean: float, least: int = 3, odds: float = 12.0) -> set[str]:
    """Words of at least ``least`` toxic documents that are ``odds`` times as frequent there as elsewhere."""
    return {w for w, n in toxic.items() if n >= least and n / n_toxic >= odds * (clean[w] + 0.5) / (n_clean + 1)}


def train_field(sequences: np.ndarray, tags: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """AdaGrad on the log likelihood of sequences of equal length.

    ``sequences``: features (n, WINDOW, AFFIXES), ``tags`` 0 or 1 (n, WINDOW).
    """
    rng = np.random.default_rng(30)
    w, start, move = np.zeros(WEIGHTS), np.zeros(2), np.zeros((2, 2))
    gw, gs, gm = np.full(WEIGHTS, 1e-2), np.full(2, 1e-2), np.full((2, 2), 1e-2)
    length = sequences.shape[1]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 32)):
            f, y = sequences[at], tags[at]
            e = np.zeros((len(at), length, 2))
            e[:, :, 1] = w[f].sum(axis=2)
            forward, back = np.empty_like(e), np.zeros_like(e)
            forward[:, 0] = start + e[:, 0]
            for t in range(1, length):
                forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + e[:, t]
            for t in range(length - 2, -1, -1):
                nxt = e[:, t + 1] + back[:, t + 1]
                back[:, t] = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
            p = np.exp(forward[:, :, 1] + back[:, :, 1] - z)
            pair = np.exp(forward[:, :-1, :, None] + move + (e + back)[:, 1:, None, :] - z[:, :, None, None]).sum(axis=(0, 1))
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            n = len(at)
            grad = np.bincount(f.ravel(), np.repeat((p - y).ravel() / n, AFFIXES), minlength=WEIGHTS) + decay * w
            first = np.array([(1 - p[:, 0] - (1 - y[:, 0])).mean(), (p[:, 0] - y[:, 0]).mean()])
            trans = (pair - seen) / n
            gw += grad * grad
            gs += first * first
            gm += trans * trans
            w -= rate * grad / np.sqrt(gw)
            start -= rate * first / np.sqrt(gs)
            move -= rate * trans / np.sqrt(gm)
    return Field(w.astype(np.float32), start, move)


def fit_field(chunks: Iterator[tuple[list[str], np.ndarray, np.ndarray]]) -> Field:
    """Token labels from documents, then the field, then the document score."""
    toxic, clean, total = Counter(), Counter(), np.zeros(2)
    kept: list[tuple[list[str], int, float]] = []
    for texts, labels, weights in chunks:
        for text, y, weight in zip(texts, labels.tolist(), weights.tolist(), strict=True):
            tokens = TOKEN.findall(text)
            (toxic if y else clean).update({w.lower() for w in tokens})
            total[y] += 1
            kept.append((tokens, y, weight))
    words = toxic_words(toxic, clean, total[1], total[0]) if total.min() else set()
    rng = np.random.default_rng(31)
    known: dict[str, list[int]] = {}
    sequences, tags = [], []
    pad = features("")
    for tokens, y, _ in kept:
        hits = [i for i, w in enumerate(tokens) if w.lower() in words]
        centres = (hits if y else []) + rng.integers(0, len(tokens), min(len(tokens), 3)).tolist() if tokens else []
        for c in centres:
            part = tokens[max(0, c - WINDOW // 2) : c + WINDOW // 2 + 1]
            row = [known.setdefault(w, features(w)) for w in part] + [pad] * (WINDOW - len(part))
            sequences.append(row)
            tags.append([int(y == 1 and w.lower() in words) for w in part] + [0] * (WINDOW - len(part)))
        if len(known) > MOST_WORDS:
            known.clear()
    field = train_field(np.array(sequences, np.int32).reshape(-1, WINDOW, AFFIXES), np.array(tags, np.int8).reshape(-1, WINDOW).astype(np.int64))
    emissions = Emissions(field.weights)
    x = np.concatenate([field.evidence(field.marginals([" ".join(tokens)], emissions)) for tokens, _, _ in kept])
    y, weight = np.array([k[1] for k in kept], float), np.array([k[2] for k in kept])
    field.calibration = logistic_regression(x, y, weight)
    return field


def logistic_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on the weighted log loss."""
    b = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", modulus: int = 3, held_out: int = 1, threshold: float = 0.7, per_class: int = 3000) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)``: one row per input row.

    ``spans`` are character offsets with the largest marginal in each. Learned from
    about ``per_class`` labelled rows of each class that are not held out. Null and
    empty texts are scored as the text without tokens and have no spans; without any
    labelled row every score is 0.5; very long texts are read whole; repeated rows,
    null ids and empty tables pass through; other columns are ignored. The fit does
    not depend on the order or place of rows; scores have six digits.
    """
    model = fit_in_one_task(labelled_sample(docs, labels, label, doc_id, text, modulus, held_out, per_class), fit_field)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 0.5 MB of weights
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def setup():
        own = shared.value
        emissions = Emissions(own.weights) if own else None

        def work(texts: list[str]) -> dict[str, object]:
            if own is None:
                return {"score": pa.array(np.full(len(texts), 0.5)), "spans": pa.array([[]] * len(texts), kind)}
            marginals = own.marginals(texts, emissions)
            return {"score": pa.array(np.round(own.scores(marginals), 6)), "spans": pa.array([spans(t, m) for t, m in zip(texts, marginals, strict=True)], kind)}

        return work

    scored = map_texts(docs, [doc_id], text, "score double, spans array<struct<start:int,end:int,p:double>>", None, setup)
    return scored.select(F.col(f"`{doc_id}`"), F.coalesce(crc_rest(doc_id, modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
