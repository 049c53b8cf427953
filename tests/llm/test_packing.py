"""Packings are complete, gapless and good; ids are the tokenizer's."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resonant.llm import best_fit_packing as B
from resonant.llm.queries import tokenizer_paths
from tests.conftest import DATA


def check(rows, texts, capacity):
    """rows: the result; texts: of each document. Every piece once with the right ids, every sequence gapless and not overfull."""
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in texts:
        ids = (hf.encode(text, add_special_tokens=False).ids if text else []) + [0]
        first = len(ids) % capacity if len(ids) > capacity else len(ids)
        cuts = sorted({0, *range(first, len(ids), capacity)} - {len(ids)})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:] + [len(ids)], strict=True)):
            want.append((doc_id, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_testdata(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = B.pack(docs, *tokenizer_paths()).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= np.ceil(sum(r.length for r in rows) / 2048) + 1


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a  b"), (4, "<|endoftext|> x"), (5, " lead"), (6, "tail \n"), (7, "é🙂 中文 don't"), (8, "word " * 3000), (9, "x" * 5000), (3, "same"), (3, "same")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("z")).withColumn("grp", F.lit(1))
    check(B.pack(df, *tokenizer_paths(), capacity=64, group_size=20).collect(), texts, 64)
    assert B.pack(df.limit(0), *tokenizer_paths()).count() == 0


def test_long_documents_only(spark):
    """Full pieces need no group: books alone, of whole pieces and of some more ids."""
    texts = [(i, " a" * (640 - 1 if i % 2 else 650)) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = B.pack(df, *tokenizer_paths(), capacity=64, group_size=4).collect()
    n = check(rows, texts, 64)
    assert {r.sequence_id for r in rows if r.length == 64} == {r.sequence_id for r in rows if r.sequence_id < 0} and n >= 200
    whole = df.where("doc_id % 2 = 1")
    assert check(B.pack(whole, *tokenizer_paths(), capacity=64).collect(), [t for t in texts if t[0] % 2], 64) == 100


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cut(n, want):
    assert B.cut(n, 8) == want


def test_best_fit_takes_the_tightest_bin():
    lengths = np.array([6, 5, 4, 3, 2])
    assert B.best_fit(np.arange(5), lengths, [], 10).tolist() == [0, 1, 0, 1, 1]


def test_crossover_keeps_every_piece_and_capacity():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 500)
    parents = B.evolve(lengths, [], 100, seed=1, generations=0)
    for k in range(20):
        child = B.crossover(parents[k % 4], parents[(k + 1) % 4], lengths, 100, rng, 10.0)
        fill = np.bincount(child, weights=lengths)
        assert len(child) == 500 and child.min() == 0 and (fill > 0).all() and fill.max() <= 100


def test_evolution_beats_best_fit_decreasing():
    # triples that fill bins exactly; best-fit decreasing alone misses some
    rng = np.random.default_rng(4)
    a = rng.integers(34, 50, 60)
    b = rng.integers(26, 33, 60)
    lengths = np.concatenate([a, b, 100 - a - b])
    first = B.evolve(lengths, [], 100, seed=0, generations=0, size=1)[0]
    best = B.evolve(lengths, [], 100, seed=0, generations=200, size=8)[0]
    assert B.fitness(best, lengths, 100) > B.fitness(first, lengths, 100)
    assert B.fitness(best, lengths, 100)[0] >= B.fitness(first, lengths, 100)[0]
