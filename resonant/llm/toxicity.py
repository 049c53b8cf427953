"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Only confirmed toxic rows carry a label in training; all other rows are unlabelled text, toxic or not. With the class
prior p, the share of toxic rows, the risk of a linear classifier f under the logistic loss l is
    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)]),
where the second term is the negatives' risk, kept from going below zero: when a step would push it under -beta, the
step goes up that term's gradient instead. Features are the presence of a word and of its prefixes of several lengths
(stems), as 64-bit hashes, so unseen endings of a known stem count too. A feature is kept if it is clearly more frequent among
the positives than in the unlabelled rows; a document's score is the logistic of the bias and its features' weights.

Training takes bounded samples, those with the smallest text hashes: max_positive toxic rows and max_unlabelled others,
whole texts, one of each group of equal ones and, of the toxic ones, of near copies. Scoring covers every row and whole texts.

Defined cases: a null or empty text scores as one without features; a document with several labels is toxic if one of
them says so; with no toxic row to learn from every score is 0; extra columns are dropped; repeated rows are scored
each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.llm.common import IS_BREAK, WordHashes, chunks, mix, releasing, text_arrays

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
#: Longest text of a training row; longer rows are left to other rows of the sample, never cut.
MAX_SAMPLE_BYTES = 16_000
PREFIXES = (4, 5, 6)
#: A kept feature is so many times as frequent in the positives as in the unlabelled rows, and that by chance with a
#: probability of at most exp(-MIN_EVIDENCE) (Chernoff's bound for a Poisson count).
MIN_LIFT = 3.0
MIN_EVIDENCE = 10.0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their prefixes, and the document of each."""
    w = WordHashes(data, offs, IS_BREAK)
    out, docs = [w.hash(w.starts, w.ends)], [w.doc]
    for n in PREFIXES:
        long = w.ends - w.starts > n
        starts = w.starts[long]
        out.append(w.hash(starts, starts + n) ^ np.uint64(0x1000 + n))
        docs.append(w.doc[long])
    return np.concatenate(out), np.concatenate(docs)


@dataclass
class Model:
    """Sorted feature hashes, their weights, the bias, and a bit filter that spares most words the binary search."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.bias)
        if not len(self.keys):
            return out
        for i, j in chunks(offs):
            h, doc = features(data, offs[i : j + 1])
            maybe = self.filter[(h >> np.uint64(44)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            pair = np.unique(doc[hit].astype(np.int64) * len(self.keys) + at[hit])
            np.add.at(out, i + pair // len(self.keys), self.weights[pair % len(self.keys)])
        return out


def _presence(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (feature hash, document) pairs of the texts, documents ascending, a run of documents at a time."""
    data, offs = text_arrays(pa.array(texts, pa.string()))
    for i, j in chunks(offs):
        h, doc = features(data, offs[i : j + 1])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.r_[True, (np.diff(doc) != 0) | (np.diff(h) != 0)][: len(h)]
        yield h[new], doc[new] + i


def _known(keys: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys and documents of the pairs whose feature is one of them."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = keys[at] == h
    return at[hit], doc[hit]


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]], kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    rows = [(np.zeros(0, kind), np.zeros(0, np.int64)), *parts]
    return np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])


def _one_of_each(h: np.ndarray, doc: np.ndarray, n: int, hashes: int = 16, same: int = 8) -> np.ndarray:
    """Which of the n documents to keep so that near copies in the sample, by min-hashes of their features, count once."""
    sketch = np.zeros((n, hashes), np.uint64)
    if len(h):
        first = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
        for k in range(hashes):
            sketch[doc[first], k] = np.minimum.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))), first)
    keep = np.ones(n, bool)
    heads: dict[tuple[int, int], int] = {}
    for i in range(n):
        near = {heads[k, v] for k, v in enumerate(sketch[i].tolist()) if (k, v) in heads}
        if any((sketch[i] == sketch[j]).sum() >= same for j in near):
            keep[i] = False
        else:
            for k, v in enumerate(sketch[i].tolist()):
                heads.setdefault((k, v), i)
    return keep


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Sample:
    """Presence of features in documents: feature and document of each pair, and how many documents there are."""

    feature: np.ndarray
    doc: np.ndarray
    size: int

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.doc, weights=w[self.feature], minlength=self.size)

    def gradient(self, by_doc: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.feature, weights=by_doc[self.doc], minlength=features)


def risks(w: np.ndarray, b: float, positive: Sample, unlabelled: Sample, prior: float) -> tuple[float, float]:
    """The positives' risk p * E_pos[l(f)] and the negatives' E_unl[l(-f)] - p * E_pos[l(-f)]."""
    zp, zu = positive.logits(w, b), unlabelled.logits(w, b)
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def direction(w: np.ndarray, b: float, positive: Sample, unlabelled: Sample, prior: float, beta: float, gamma: float, l2: float) -> np.ndarray:
    """The gradient that a step goes down, weights first, then the bias: that of both risks, or, where the negatives' is below
    -beta, gamma times the way up that one."""
    zp, zu = positive.logits(w, b), unlabelled.logits(w, b)
    pos = -prior * (1 - _sigmoid(zp)) / positive.size  # of p * l(f) on the positives
    neg_p = -prior * _sigmoid(zp) / positive.size
    neg_u = _sigmoid(zu) / unlabelled.size
    if risks(w, b, positive, unlabelled, prior)[1] < -beta:
        gp, gu = -gamma * neg_p, -gamma * neg_u
    else:
        gp, gu = pos + neg_p, neg_u
    return np.r_[positive.gradient(gp, len(w)) + unlabelled.gradient(gu, len(w)) + l2 / positive.size * w, gp.sum() + gu.sum()]


def fit_nnpu(positive: list[str], unlabelled: list[str], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 0.01, beta: float = 0.0, gamma: float = 1.0) -> Model:
    """Weights that minimise the non-negative risk estimate, by Adam on all sampled rows."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -50.0, prior)
    if not positive or not unlabelled:
        return none
    hp, dp = _joined(_presence(positive), np.uint64)
    own = _one_of_each(hp, dp, len(positive))
    positive = [t for t, k in zip(positive, own, strict=True) if k]
    hp, dp = hp[own[dp]], (np.cumsum(own) - 1)[dp[own[dp]]]
    keys, np_ = np.unique(hp, return_counts=True)
    if not len(keys):
        return none
    nu = np.zeros(len(keys), np.int64)
    for h, d in _presence(unlabelled):
        nu += np.bincount(_known(keys, h, d)[0], minlength=len(keys))
    lift = (np_ / len(positive)) / ((nu + 0.5) / len(unlabelled))
    evidence = np_ * (np.log(np.maximum(lift, 1)) - 1 + 1 / np.maximum(lift, 1))
    keep = (lift >= MIN_LIFT) & (evidence >= MIN_EVIDENCE)
    if not keep.any():
        return none
    keys = keys[keep]
    fp, dp = _known(keys, hp, dp)
    fu, du = _joined(_known(keys, h, d) for h, d in _presence(unlabelled))
    pos, unl = Sample(fp, dp, len(positive)), Sample(fu, du, len(unlabelled))
    w, b = np.zeros(len(keys)), -2.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, steps + 1):
        grad = direction(w, b, pos, unl, prior, beta, gamma, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(keys, w, float(b), prior)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(rows: DataFrame, most: int) -> list[str]:
    """Up to most distinct texts, those with the smallest hashes; rows have text and its hash, h0."""
    # copies pass or fail the threshold together, so distinct texts count
    n = rows.agg(F.countDistinct("h0")).first()[0]
    keep = min(1_000_000, 1 + int(1.5e6 * most / max(n, 1)))
    picked = rows.where(F.pmod("h0", F.lit(1_000_000)) < keep)
    first = picked.groupBy(F.xxhash64("text", F.lit(1)).alias("h")).agg(F.first("text").alias("text")).orderBy("h").limit(most)
    return [r["text"] for r in first.collect()]


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The classifier learned from the rows that are not held out. Without a prior it is the toxic share of the labelled ones."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("toxic").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    texts = docs.where(~held_out(F.col("doc_id")) & (F.octet_length("text") <= MAX_SAMPLE_BYTES)).select("doc_id", "text", F.xxhash64("text").alias("h0"))
    toxic = known.where(F.col("toxic") == 1).select("doc_id")
    if not counts["p"]:
        return fit_nnpu([], [], 0.0)
    pos = _sample(texts.join(toxic, "doc_id", "left_semi"), max_positive)
    # all rows, the confirmed ones among them: their toxic share is the prior
    unl = _sample(texts, max_unlabelled)
    p = prior if prior is not None else counts["p"] / max(counts["n"], 1)
    return fit_nnpu(pos, unl, p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            z = m.logits(*text_arrays(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    out = source.mapInArrow(releasing(run), T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
