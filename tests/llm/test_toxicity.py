"""The risk estimate stays non-negative, planted words are learned from positives and unlabelled text alone."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resonant.llm import toxicity as X
from resonant.llm.common import text_arrays
from tests.conftest import DATA


def make(n, share, seed, stems=("vile", "grubby")):
    rng = random.Random(seed)
    texts, toxic = [], []
    for _ in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(10, 60))]
        bad = rng.random() < share
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "ish", "ness", "o"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_learns_from_positive_and_unlabelled_text():
    texts, toxic = make(1500, 0.15, 1)
    positive = [t for t, y in zip(texts[:700], toxic, strict=False) if y]
    model = X.fit_nnpu(positive, texts[700:], 0.15)
    fresh, truth = make(600, 0.3, 2)
    z = model.logits(*text_arrays(pa.array(fresh)))
    assert ((z >= 0) == np.array(truth, bool)).mean() > 0.97


def test_stems_cover_unseen_endings():
    texts, toxic = make(1200, 0.2, 3)
    model = X.fit_nnpu([t for t, y in zip(texts[:600], toxic, strict=False) if y], texts[600:], 0.2)
    z = model.logits(*text_arrays(pa.array(["an ordinary abc text", "abc grubbyzzz vilexyz abd"])))
    assert z[0] < 0 < z[1]


def documents(spark, n=800):
    texts, toxic = make(n, 0.2, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i % 3], "doc_id long, toxic int")
    return docs, labels, toxic


def test_query_on_a_small_corpus(spark):
    docs, labels, toxic = documents(spark)
    rows = X.classify(docs, labels).collect()
    assert len(rows) == len(toxic)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in out) / len(out) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = documents(spark, 300)
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(X.classify(docs, labels)) == key(X.classify(docs, flipped))


def test_odd_texts_and_tables(spark):
    docs, labels, _ = documents(spark, 300)
    model = X.fit(docs, labels)
    rows = [(1, None), (2, ""), (2, "vile vileness"), (2, "vile vileness"), (None, "!!"), (3, "vile " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = X.score(df, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (1, None)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert X.score(df.limit(0), model).count() == 0
    assert {r.score for r in X.classify(docs, labels.limit(0)).collect()} == {X.score(docs, X.fit_nnpu([], [], 0.0)).first().score}
    assert {r.predicted for r in X.classify(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0}
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert X.classify(docs, twice).count() == docs.count()


def test_the_sample_counts_distinct_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "fit_nnpu", lambda positive, unlabelled, prior: seen.append((sorted(positive), sorted(unlabelled))))
    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 5).cast("string")).alias("text"))
    X.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")), max_positive=100, max_unlabelled=100)
    assert seen == [([f"word {i}" for i in range(5)],) * 2]


def plain_risks(w, b, positive, unlabelled, prior):
    """Both risks document by document, without arrays."""
    loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
    score = lambda doc: b + sum(w[f] for f in doc)
    pos = prior * sum(loss(score(d)) for d in positive) / len(positive)
    return pos, sum(loss(-score(d)) for d in unlabelled) / len(unlabelled) - prior * sum(loss(-score(d)) for d in positive) / len(positive)


@pytest.mark.parametrize("prior, shift", [(0.2, 0.0), (0.9, 4.0)])
def test_risk_and_gradient_match_a_plain_version(prior, shift):
    rng = np.random.default_rng(7)
    docs = lambda n, p: [sorted(set(np.flatnonzero(rng.random(9) < p).tolist())) for _ in range(n)]
    positive, unlabelled = docs(14, 0.5), docs(31, 0.2)
    sample = lambda rows: X.Sample(np.array([f for d in rows for f in d], np.int64), np.array([i for i, d in enumerate(rows) for _ in d], np.int64), len(rows))
    pos, unl = sample(positive), sample(unlabelled)
    w, b = rng.normal(shift, 1, 9), float(shift) - 1
    want = plain_risks(w, b, positive, unlabelled, prior)
    assert np.allclose(X.risks(w, b, pos, unl, prior), want)
    beta, gamma = 0.0, 0.5
    corrected = want[1] < -beta
    assert corrected == (shift > 0)

    def goes_down(x):
        p, n = plain_risks(x[:-1], x[-1], positive, unlabelled, prior)
        return -gamma * n if corrected else p + n

    x, step = np.r_[w, b], 1e-6
    slope = [(goes_down(x + step * e) - goes_down(x - step * e)) / (2 * step) for e in np.eye(10)]
    assert np.allclose(X.direction(w, b, pos, unl, prior, beta, gamma, 0.0), slope, atol=1e-7)


def test_scores_of_the_tables_match_a_loop(spark):
    """The whole query against sums of weights over sets of features, one document at a time."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = X.fit(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in X.classify(docs, labels).collect()}
    for r in docs.collect():
        data, offs = text_arrays(pa.array([r.text], pa.string()))
        h, _ = X.features(data, offs)
        score = 1 / (1 + math.exp(-(model.bias + sum(weight.get(x, 0.0) for x in set(h.tolist())))))
        assert got[r.doc_id][0] == pytest.approx(score, abs=1e-9) and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)
        assert got[r.doc_id][2] == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
