"""Quality scores from random-indexing word vectors and a small calibrated network.

Words get vectors by random indexing: every word of the vocabulary has a sparse random index vector,
and a word's vector is the damped sum of its neighbours' index vectors. A text is the mean and the
spread of its words' vectors. A two-layer network in numpy maps that to a logit, and a temperature
fitted on rows kept out of training turns it into a probability.

Defined cases: null text counts as empty; empty texts get the score of a text without words; with no
labelled rows, or only one label, the score is that label's share (0.5 if there are none); labels other
than 0 and 1 and null ids are not learned from; repeated labelled rows count each; columns other than
those named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

TOKEN = re.compile(r"\w+|[^\w\s]+")
DIMS, REACH, OTHER = 64, 2, 4  # vector size, neighbours to either side, ids before the vocabulary


def _tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def parts(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self))


def _ids(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """Vocabulary ids; unknown words are one of three kinds: all capitals, with a letter or digit, or marks.
    A word that repeats the one before it (a mark may stand between) has an id of its own."""
    out = np.fromiter((known.get(t, -1) for t in tokens), np.int64, len(tokens))
    for i in np.flatnonzero(out < 0):
        t = tokens[i]
        out[i] = 0 if len(t) > 1 and t.isupper() else 1 if t[0].isalnum() or t[0] == "_" else 2
    if len(tokens) > 2:
        same = np.array(tokens, object)
        word = np.fromiter((t > "@" for t in tokens), bool, len(tokens))
        again = np.r_[False, same[1:] == same[:-1]]
        again[2:] |= same[2:] == same[:-2]
        out[again & word] = 3
    return out


def _pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, and the log of their number."""
    if not len(ids):
        return np.zeros(2 * vectors.shape[1] + 1, np.float32)
    n = np.bincount(ids, minlength=len(vectors)).astype(np.float32)
    at = np.flatnonzero(n)
    share, own = n[at] / len(ids), vectors[at]
    mean = share @ own
    return np.concatenate([mean, np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0)), [np.log1p(len(ids))]]).astype(np.float32)


def _vectors(rows: list[np.ndarray], size: int, rng: np.random.Generator) -> np.ndarray:
    index = rng.choice([-1.0, 0.0, 1.0], (size, DIMS), p=[0.1, 0.8, 0.1]).astype(np.float32)
    near = np.zeros(size * size, np.float32)
    for ids in rows:
        for k in range(1, REACH + 1):
            if len(ids) > k:
                cell, n = np.unique(ids[:-k] * size + ids[k:], return_counts=True)
                near[cell] += n
    near = near.reshape(size, size)
    near = np.log1p(near + near.T)
    total = near.sum(axis=1, keepdims=True)
    out = (near @ index) / np.maximum(total, 1) + 0.5 * index / np.sqrt(DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _forward(x: np.ndarray, w1, b1, w2, b2) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, hidden: int, epochs: int):
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 128):
            i = order[k : k + 128]
            h, z = _forward(x[i], *p)
            err = (1 / (1 + np.exp(-z)) - y[i]) / len(i)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [x[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum()]
            t += 1
            for j, g in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return p


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column, label: str = "quality", rows: int = 4000, vocabulary: int = 2048, hidden: int = 24, epochs: int = 40, seed: int = 3) -> Model:
    """Learns from labelled rows where `learn` (over doc_id) holds; at most about `rows`, chosen by a hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).filter(learn)
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * rows / max(n, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(own), "doc_id").select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "y", "text"])
    y = got["y"].to_numpy(float)
    empty = np.zeros((1, 1), np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model((), empty, empty[0], empty[0], empty, empty[0], empty[0], 0.0, 1.0, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    tokens = [_tokens(t) for t in got["text"]]
    seen = Counter(w for t in tokens for w in set(t))
    words = tuple(w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary] if c > 1)
    known = {w: k + OTHER for k, w in enumerate(words)}
    ids = [_ids(t, known) for t in tokens]
    vectors = _vectors(ids, len(words) + OTHER, rng)
    x = np.stack([_pool(i, vectors) for i in ids]).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    kept_out = rng.random(len(y)) < 0.2
    if len(set(y[~kept_out])) < 2 or not kept_out.any():
        kept_out[:] = False
    p = _train(x[~kept_out], y[~kept_out], rng, hidden, epochs)
    t = _temperature(_forward(x[kept_out], *p)[1], y[kept_out]) if kept_out.any() else 1.0
    return Model(words, vectors, mean, scale, p[0], p[1], p[2], float(p[3]), t)


def score_texts(texts: list[str | None], model: Model, known: dict[str, int]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    if not texts:
        return np.zeros(0)
    x = np.stack([_pool(_ids(_tokens(t), known), model.vectors) for t in texts]).astype(float)
    x = np.clip((x - model.mean) / model.scale, -8, 8)
    z = _forward(x, model.w1, model.b1, model.w2, model.b2)[1] / model.temperature
    return 1 / (1 + np.exp(-z))


def scores(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """The rows of docs (their doc_id, or the columns named) with the score of their whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        known = {w: k + OTHER for k, w in enumerate(own.words)}
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), own, known))

    return docs.select(*(columns or ["doc_id"]), score(F.col("text").cast("string")).alias(name))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`; columns as they are, whatever they are called.

    Null texts are scored as empty ones; repeated rows are judged each; very long texts are read whole; an
    empty table gives no rows.
    """
    (name,) = free_names(docs, "score")
    return scores(docs, model, [f"`{c}`" for c in docs.columns], name).filter(F.col(name) >= least).drop(name)
