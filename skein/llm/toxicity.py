"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; everything else is unlabelled text. Words, and beginnings of words, whose presence tells the two apart become
binary features, and a linear classifier is trained in numpy on the non-negative risk estimate
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
with logistic loss; a step at which the corrected negative risk is below zero goes back along it instead. The
class prior is the toxic share of the labels learnt from or, if less, a tail estimate from the unlabelled texts: with a
prior over their true share the corrected risk would be zero at call-everything weights. All weights, the bias too,
decay, the more so the fewer positives there are, and steps shrink, so that they settle; training ends when they have.
Scores are logistic, so 0.5 is the point where a text is likelier toxic.

The classifier is fitted on at most MAX_POSITIVE and MAX_UNLABELLED texts (chosen by a hash of the id: the bound is
these parameters; of rows that share an id one text, the greatest, is learnt from); every text is scored whole. Words are
collected for at most FEATURES features.

Edge cases: null and empty texts get the score of a text without any feature; null labels are not learnt from; without
confirmed positives every score is 0; with positives but none of their texts (or no other text) at hand every score is
the prior; repeated rows are scored alike; only doc_id and text (and doc_id, toxic of the labels) are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, map_texts, prepare, unused

MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
FEATURES = 512
#: Decay of the weights: DECAY by the number of positives, at most MOST_DECAY.
DECAY, MOST_DECAY = 0.2, 5e-3
#: A feature is at least this many standard errors likelier among positives, and in this many and this share of them.
APART, SUPPORT, SHARE = 5.0, 3, 0.01
WORD = re.compile(r"\w+")


#: Lengths of word beginnings that are features too (abuse inflects): `stem*`.
STEMS = (4, 5, 6, 7, 8)


def words_of(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the texts with these ids, by a hash of the id; one text an id."""
    chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most `most` ids
    return found.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def _words(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [sorted(words_of(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.string()))], names=["positive", "words"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, words array<string>")


def class_prior(x_p: np.ndarray, x_u: np.ndarray, share: float) -> float:
    """The share of positives among unlabelled texts, at most `share`. Whatever the number t of features asked for, at most
    P(t or more | unlabelled) / P(t or more | positive) of them are positive; the least of these over all t that nine
    tenths of the positives with any feature reach is taken (further out few texts tell)."""
    p, u = x_p.sum(1), x_u.sum(1)
    least, t = share, 1
    while (reach := (p >= t).mean()) > 0 and reach >= 0.9 * (p >= 1).mean():
        least = min(least, (u >= t).mean() / reach)
        t += 1
    return float(min(max(least, 0.001), 0.9))


def nn_risk(w: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p(+), the corrected negative risk R_u(-) - prior * R_p(-), and the gradients of both. The last column of
    the samples is one."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    zp, zu = x_p @ w, x_u @ w
    negative = loss(-zu).mean() - prior * loss(-zp).mean()
    return (
        prior * loss(zp).mean(),
        negative,
        -prior * (x_p.T @ sig(-zp)) / len(x_p),
        x_u.T @ sig(zu) / len(x_u) - prior * (x_p.T @ sig(zp)) / len(x_p),
    )


def train_nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 1600, rate: float = 0.05, settled: float = 2e-3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear classifier, by Adam on the non-negative risk of all samples: means of
    100 steps, when none is further than `settled` from the means of the 100 before, or after `steps`."""
    add = lambda x: np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    x_p, x_u = add(x_p), add(x_u)
    decay = min(DECAY / len(x_p), MOST_DECAY)
    w = np.zeros(x_p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v, total, before = np.zeros_like(w), np.zeros_like(w), np.zeros(len(w)), None
    for step in range(1, steps + 1):
        _, negative, g_positive, g_negative = nn_risk(w, x_p, x_u, prior)
        g = (g_positive + g_negative if negative >= 0 else -g_negative) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate / np.sqrt(1 + step / 200) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        total += w
        if step % 100 == 0:
            mean, total = total / 100, np.zeros(len(w))
            if before is not None and np.abs(mean - before).max() <= settled:
                return mean
            before = mean
    return before if before is not None else w


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, features: int = FEATURES):
    """(word -> weight, bias) learnt from labels of rows that are not held out; ({}, None) without any positive."""
    prepare(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return {}, None
    prior = min(max(toxic / n, 0.001), 0.9)
    base = docs.select("doc_id", "text")
    positive = _sample(base, known.where("toxic = 1"), max_positive).withColumn("positive", F.lit(True))
    # unlabelled text: any training row, whatever its label says
    rest = _sample(base, docs.where(~held_out(F.col("doc_id"))).select("doc_id"), max_unlabelled).withColumn("positive", F.lit(False))
    sample = _words(positive.union(rest)).persist()
    try:
        n_p, n_u = sample.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
        if not n_p or not n_u:
            return {}, float(np.log(prior / (1 - prior)))
        share = lambda on, total: F.sum(F.when(on, 1).otherwise(0)) / F.lit(float(total))
        each = sample.select("positive", F.explode("words").alias("word")).groupBy("word")
        # how much likelier a word is among positives, in standard errors if both had the pooled share
        count = lambda on: F.sum(F.when(on, 1).otherwise(0))
        told = each.agg(count(F.col("positive")).alias("p"), count(~F.col("positive")).alias("u")).where(F.col("p") >= max(SUPPORT, SHARE * n_p))
        pooled = (F.col("p") + F.col("u")) / F.lit(float(n_p + n_u))
        apart = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / n_p + 1 / n_u))
        chosen = [r[0] for r in told.withColumn("apart", apart).where(F.col("apart") >= APART).orderBy(F.col("apart").desc(), "word").limit(features).collect()]
        place = {w: i for i, w in enumerate(chosen)}
        picked = sample.select("positive", F.array_intersect("words", F.array(*[F.lit(w) for w in chosen]).cast("array<string>")).alias("words"))
        rows = picked.collect()  # at most max_positive + max_unlabelled rows of at most `features` words
    finally:
        sample.unpersist()
    x = {True: np.zeros((n_p, len(chosen)), np.float32), False: np.zeros((n_u, len(chosen)), np.float32)}
    at = {True: 0, False: 0}
    for on, found in rows:
        for w in found:
            x[on][at[on], place[w]] = 1
        at[on] += 1
    w = train_nnpu(x[True], x[False], class_prior(x[True], x[False], prior))
    return {word: float(w[i]) for word, i in place.items()}, float(w[-1])


def score(docs: DataFrame, model, keep: list[str] = ["doc_id"], threshold: float = 0.5, with_text: bool = False, called: tuple[str, str] = ("score", "predicted")) -> DataFrame:  # noqa: B006
    """The kept columns, text if asked for, score and predicted (or what they are to be called where a kept column has
    that name); a row per row, no shuffle."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def columns():
        weights, bias = held.value
        names = weights.keys()

        def f(texts):
            z = np.array([sum([weights[w] for w in words_of(t) & names]) + bias if bias is not None else -np.inf for t in texts], dtype=np.float64)
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            s[np.isneginf(z)] = 0
            return {called[0]: pa.array(s), called[1]: pa.array((s >= threshold).astype(np.int32))}

        return f

    return map_texts(docs, keep, columns, f"`{called[0]}` double, `{called[1]}` int", with_text)


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't call toxic."""
    names = (unused(docs, "score"), unused(docs, "predicted"))
    told = score(docs, model, [c for c in docs.columns if c != "text"], threshold, True, names)
    return told.where(F.col(names[1]) == 0).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, **bounds)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
