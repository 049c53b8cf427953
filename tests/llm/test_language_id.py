"""Exact code lengths against a plain PPM, held-out accuracy, odd texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resonant.llm import language_id as L
from resonant.llm.common import chunks, text_arrays
from tests.conftest import DATA


def plain_bits(training, text, order):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in training:
        for i in range(len(t)):
            for k in range(order + 1):
                if i >= k:
                    seen[k][t[i - k : i]][t[i]] += 1
    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            followers = seen[k].get(text[i - k : i])
            if followers is None:
                continue
            n, d = sum(followers.values()), len(followers)
            if text[i] in followers:
                total += math.log2((n + d) / followers[text[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_match_a_plain_model(order):
    rng = random.Random(order)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    train = {lang: [" ".join(word(letters) for _ in range(40)).encode() for _ in range(3)] for lang, letters in (("aa", "abcde"), ("bb", "defgé"))}
    model = L.train(train, order)
    texts = ["abc de", "é", "", "zzz zz", "a", "ab\x00", "dddd eee fff ggg é"]
    data, offs = text_arrays(pa.array(texts))
    got = np.vstack([model.code_lengths(data, offs[i : j + 1]) for i, j in chunks(offs)])
    want = [[plain_bits(train[lang], t.encode(), order) for lang in ("aa", "bb")] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)
    for size in (1, 3, 7, 1000):
        assert np.allclose(model.code_lengths(data, offs, size), want, rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.93


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    changed = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())
    assert key(L.identify(docs)) == key(L.identify(changed))


def test_odd_texts_and_tables(spark):
    model = L.train({"de": [b"der die das und ist"], "en": [b"the of and is to"]})
    long = "the and of " * 120_000
    rows = [(1, None), (2, ""), (3, "123 !? ² ½"), (4, "the"), (4, "the"), (5, "1" * 100 + "é"), (None, "und die"), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in L.identify(df, model).collect()))
    assert got[:4] == [(0, "de"), (1, "und"), (2, "und"), (3, "und")] and got[4:6] == [(4, "en"), (4, "en")] and got[6][1] != "und" and got[7] == (6, "en")
    assert L.identify(df.limit(0), model).count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)


def test_two_place_tables_find_every_key():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 50_000, dtype=np.uint32))
    t = L._Table(keys, np.zeros((len(keys), 1)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    absent = np.setdiff1d(np.arange(100_000, dtype=np.uint32), keys)
    assert (t.find(absent) == len(keys)).all()


def test_a_language_of_many_copies_of_few_texts_is_learned(spark):
    copies = spark.range(400_000).select(F.concat(F.lit("word "), (F.col("id") % 5).cast("string")).alias("text"), F.lit("xx").alias("lang"))
    assert sorted(L.sample_texts(copies)["xx"]) == [f"word {i}".encode() for i in range(5)]
