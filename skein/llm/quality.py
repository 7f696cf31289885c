"""Quality by nearest-neighbour voting in a latent semantic space.

A text is described by its terms (words, and the character trigrams of words beyond ASCII, hashed to TERMS places), by
how often its characters' kinds follow each other (letters by vowel and consonant, each punctuation mark by itself), and
by how often lines and words repeat. Square-root shares are weighted by inverse document frequency and projected on the
leading singular vectors of the labelled texts (latent semantic analysis; by subspace iteration from a fixed start).
The labelled vectors, at most MAX_LABELLED of DIMENSIONS numbers, are broadcast; every document's cosine to all of them
is computed exactly, in blocks, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.

The space and the voters come from at most MAX_LABELLED labelled texts (chosen by a hash of the id: the bound is that
parameter); every text is described and scored whole.

Edge cases: null and empty texts are scored by their own (empty) description, that is by the votes of whatever is
nearest to the origin's constant direction; null labels are not learnt from; without labelled texts every score is 0;
of neighbours with the same cosine the earlier voter (in order of id) counts first; repeated rows are scored alike; only
doc_id and text (and doc_id, quality of the labels) are read.
"""

from __future__ import annotations

import zlib
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, map_texts, prepare

MAX_LABELLED = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0

KINDS = 39
TERMS = 1024
#: Weight of the terms beside the kinds.
TERM_WEIGHT = 0.5
#: Words whose places a worker process remembers.
CACHE_WORDS = 500_000


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 vowel, 1 consonant, 2 upper case, 3 digit, 4 space, 5 line end, 6 other, 7.. punctuation."""
    out, at = np.full(256, 6, np.int64), 7
    for b in range(128):
        c = chr(b)
        if c.islower():
            out[b] = 0 if c in "aeiou" else 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in " \t":
            out[b] = 4
        elif c in "\r\n":
            out[b] = 5
        elif 32 < b < 127:
            out[b] = at
            at += 1
    return out


_KIND = _kinds()
#: Weights of the last numbers: constant, length, distinct lines, distinct words, word length, words like the one before.
PLAIN_WEIGHTS = (0.5, 0.5, 0.5, 1.0, 0.5, 2.0)
WIDTH = TERMS + KINDS * KINDS + len(PLAIN_WEIGHTS)


class _Places(dict):
    """Word -> the places of its terms."""

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        parts = [word] if word.isascii() else [word, *(word[i : i + 3] for i in range(len(word) - 2))]
        out = self[word] = [zlib.crc32(p.encode("utf-8", "replace")) % TERMS for p in parts]
        return out


_PLACES = _Places()


def describe(text: str) -> np.ndarray:
    """WIDTH numbers: square roots of the shares of terms and of pairs of kinds, then length and repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    k = _KIND[raw]
    out = np.zeros(WIDTH, np.float32)
    if len(k) > 1:
        pairs = np.bincount(k[:-1] * KINDS + k[1:], minlength=KINDS * KINDS)
        out[TERMS : TERMS + KINDS * KINDS] = np.sqrt(pairs / (len(k) - 1))
    lines = [x for x in text.split("\n") if x]
    words = text.split()
    if words:
        terms = np.bincount(list(chain.from_iterable(map(_PLACES.__getitem__, text.lower().split()))), minlength=TERMS)
        out[:TERMS] = TERM_WEIGHT * np.sqrt(terms / terms.sum())
    out[-6] = 1.0
    out[-5] = np.log1p(len(words)) / 12
    out[-4] = len(set(lines)) / len(lines) if lines else 0
    out[-3] = len(set(words)) / len(words) if words else 0
    out[-2] = min(1.0, len(text) / len(words) / 20) if words else 0
    out[-1] = sum(map(eq, words, words[1:])) / len(words) if words else 0
    return out


def _leading(w: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of w, as columns, by subspace iteration."""
    size = min(most + 16, *w.shape)
    v = np.linalg.qr(np.random.default_rng(7).normal(size=(w.shape[1], size)).astype(np.float32))[0]
    for _ in range(rounds):
        v = np.linalg.qr(w.T @ (w @ v))[0]
    _, _, turn = np.linalg.svd(w @ v, full_matrices=False)
    return (v @ turn.T)[:, :most].astype(np.float32)


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int):
        self.neighbours = neighbours
        seen = (x > 0).mean(0)
        self.weight = (np.log((1 + len(x)) / (1 + seen * len(x))) + 1).astype(np.float32)
        self.weight[-len(PLAIN_WEIGHTS) :] = PLAIN_WEIGHTS
        w = x * self.weight
        self.basis = _leading(w, dimensions)
        self.vectors = self._unit(w @ self.basis)
        self.labels = labels.astype(np.float64)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray) -> np.ndarray:
        v = self._unit((x * self.weight) @ self.basis)
        cosine = v @ self.vectors.T
        near = nearest(cosine, self.neighbours)
        c = np.take_along_axis(cosine, near, 1).astype(np.float64)
        w = np.exp(SHARPNESS * (c - c.max(1, keepdims=True))) * np.maximum(c, 1e-6)
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k greatest numbers; of equal ones the earlier."""
    k = min(k, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
    for i in np.nonzero((cosine >= least).sum(1) > k)[0]:  # some of a tie stay out
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


def _described(docs: DataFrame, keep: list[str]) -> DataFrame:
    def columns():
        return lambda texts: {"x": pa.array([describe(t).astype(np.float16).tobytes() for t in texts], pa.binary())}

    return map_texts(docs, keep, columns, "x binary")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Voters | None:
    """Learnt from labels of rows that are not held out; None if there are none. At most max_labelled vectors of WIDTH
    half-precision numbers come to the driver."""
    prepare(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    rows = _described(texts, ["doc_id", "quality"]).orderBy("doc_id", "x").limit(max_labelled).collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows])
    return Voters(x, np.array([r["quality"] for r in rows]), dimensions, neighbours)


def score(docs: DataFrame, voters: Voters | None, keep: list[str] = ["doc_id"], threshold: float = 0.3) -> DataFrame:  # noqa: B006
    """The kept columns, score and predicted; a row per row, no shuffle."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def columns():
        v = held.value

        def f(texts):
            s = v.vote(np.stack([describe(t) for t in texts])) if v is not None and texts else np.zeros(len(texts))
            return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

        return f

    return map_texts(docs, keep, columns, "score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, **bounds)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
