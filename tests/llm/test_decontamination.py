"""Alignment scores against a plain Smith-Waterman, edited copies found, clean texts left alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.llm import decontamination as D
from tests.conftest import DATA


def plain(a, b):
    best = 0.0
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
            best = max(best, h[i, j])
    return best


def test_alignment_matches_plain_version():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 40))
        score, x, y = D.smith_waterman(a, b)
        assert score == plain(a, b)
        if score:
            # the reported range holds an alignment of that score
            assert plain(a, b[x:y]) == score


ITEMS = [
    (1, "The river carried small boats past the old mill before the evening bells rang over town"),
    (2, "Measure twice, cut once: carpenters say that wood remembers every single careless mistake you make"),
    (3, "short one"),
]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(text, share, seed):
    rng = random.Random(seed)
    out = []
    for w in text.split():
        r = rng.random()
        if r < share / 3:
            continue
        out.append("changed" if r < share else w)
        if rng.random() < share / 4:
            out.append("inserted")
    return " ".join(out)


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([*ITEMS, (None, "a b c d e f g"), (5, None), (6, "")], "item_id long, text string")


def test_copies_are_found_and_clean_texts_are_not(spark, bench):
    docs, want = [], set()
    for i in range(40):
        text = words(60, i)
        if i % 4 == 0:
            item = ITEMS[(i // 4) % 2]
            copy = item[1].upper() if i % 8 else edited(item[1], 0.2, i)
            text = f"{text} {copy} {words(30, 100 + i)}"
            want.add((i, item[0]))
        docs.append((i, text))
    docs += [(50, "short one and the old mill"), (51, None), (52, ""), (None, ITEMS[0][1]), (53, ITEMS[0][1] + " " + ITEMS[1][1]), (53, ITEMS[0][1])]
    want |= {(None, 1), (53, 1), (53, 2)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("score", F.lit("s"))
    for block_items in (10_000, 1):
        rows = D.hits(df, bench, block_items=block_items).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) + 1
        assert all(D.LEAST_SCORE <= r.score <= 1 and r.start_word < r.end_word for r in rows)
        left = D.remove(df, bench, block_items=block_items)
        assert left.columns == df.columns
        assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_every_alignment_of_testdata_is_found(spark):
    """Against every item for every document, without seeds."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 3000")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = D.load_items(bench, 0, 1)
    rows = docs.select("doc_id", "text").collect()
    import pyarrow as pa

    want = set()
    for i, h, counts in D._word_runs(pa.array([r.text for r in rows])):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            for item, w in zip(items.ids, items.words, strict=True):
                if np.isin(w, h[a:b]).mean() >= D.LEAST_SCORE and D.smith_waterman(w, h[a:b])[0] >= D.LEAST_SCORE * D.MATCH * len(w):
                    want.add((rows[i + k].doc_id, item))
    got = {(r.doc_id, r.item_id) for r in D.hits(docs, bench).collect()}
    assert got == want and want


def test_empty_tables_and_long_text(spark, bench):
    docs = spark.createDataFrame([(1, words(200_000, 1) + " " + ITEMS[1][1])], "doc_id long, text string")
    assert [(r.item_id, r.score) for r in D.hits(docs, bench).collect()] == [(2, 1.0)]
    assert D.hits(docs.limit(0), bench).count() == 0
    assert D.hits(docs, bench.limit(0)).count() == 0 and D.remove(docs, bench.limit(0)).count() == 1


def test_seed_across_two_documents_only(spark):
    """The end of one document and the start of the next make a seed, and no document holds one."""
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two alpha beta"), (2, "gamma three four")], "doc_id long, text string").coalesce(1)
    assert D.hits(docs, bench).collect() == []
    assert [r.doc_id for r in D.remove(docs, bench).orderBy("doc_id").collect()] == [1, 2]
