"""Links and components against all pairs, in one task's blocks and in slices."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.llm import ngram_join as J
from tests.conftest import DATA


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.link_components(df, **kw).collect()), key=repr)


def corpus(seed, groups=8, copies=8):
    """Groups of edited copies, a passage that many share, and texts of few words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(25)]
    rows, i = [], 100
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, 60))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += shared
            rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
            i += 1
    return rows + [(i, "A b"), (i + 1, "a  B"), (i + 2, "a"), (i + 3, " "), (i + 4, ""), (i + 5, None), (i + 6, None), (7, "a B"), (7, "a b c d e")]


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"block_tokens": 100}), (3, {"bucket_bytes": 400, "block_tokens": 60, "small_edges": 0})])
def test_matches_all_pairs(spark, seed, kw):
    rows = corpus(seed)
    assert run(spark, rows, **kw) == brute(rows)


def test_large_group_of_near_copies_in_slices(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:40] + [f"y{i}{k}" for k in range(40)])) for i in range(20)]
    assert run(spark, rows, block_tokens=1000) == brute(rows)


def test_short_texts_around_a_shared_passage(spark):
    """Many sets on one list that are no partners, among them some groups: lists stay mixed and are searched in cells."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for g in range(40):
        own = [f"g{g}_{i}" for i in range(rng.randint(3, 6))]
        for c in range(rng.randint(1, 3)):
            t = own + passage if g % 2 else passage + own
            rows.append((len(rows), " ".join(t[: len(t) - c])))
    assert run(spark, rows, block_tokens=40) == run(spark, rows) == brute(rows)


def test_chains_of_links(spark):
    """Each text links with the next one only: one component over many heads."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(100)]
    random.Random(2).shuffle(rows)
    assert run(spark, rows, block_tokens=200) == brute(rows)


def test_boundary_of_the_similarity(spark):
    # 7 shingles of which 6 are shared by sets of 7 and 7: 6 / 8 is exactly 0.75
    a, b, c = "a b c d e f g h i j k", "a b c d e f g h i j z", "a b c d e f g h i y z"
    assert {d: r for d, _, r in run(spark, [(1, a), (2, b), (3, c)])} == {1: 1, 2: 1, 3: 3}


def test_nulls_clashes_and_empty_table(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (5, "one two three four five six"), (None, "alone here")]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string").withColumn("sig", F.lit("s")).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(9))
    assert {(r.doc_id, r.component_id, r.class_size) for r in J.link_components(df).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert J.link_components(df.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(250_000))
    assert run(spark, [(1, text), (2, text + " end"), (3, "w1 w2")]) == [(1, 5000, 1), (2, 5001, 1), (3, 1, 3)]


def test_testdata_matches_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_search_matches_all_pairs():
    rng = random.Random(3)
    for _ in range(10):
        base = [np.array(sorted(rng.sample(range(400), rng.randint(5, 60)))) for _ in range(5)]
        sets = []
        for _ in range(40):
            s = set(rng.choice(base).tolist())
            for _ in range(rng.randint(0, 12)):
                s ^= {rng.randrange(400)}
            sets.append(np.array(sorted(s), np.int64))
        index = J.Index(sets)
        for q, s in enumerate(sets):
            want = [y for y in range(len(sets)) if y != q and len(s) and J._linked(len(np.intersect1d(s, sets[y])), len(s), len(sets[y]))]
            assert sorted(index.search(s, skip=q)) == want


def near_copies(n, seed=6):
    """Edited copies of one text, of which about a third are too different to link, and texts of other sizes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = [f"w{k}" for k in range(100 if i % 9 else 80)]
        for p in rng.sample(range(len(t)), rng.choice([1, 2, 3, 8, 10])):
            t[p] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    return rows


def test_dense_block_matches_all_pairs_and_asks_together(monkeypatch):
    rows = near_copies(400)
    sets = [s.view(np.int64) for s in J.shingle_sets(J.pa.array([t for _, t in rows]))]
    want = {frozenset(g) for g in _groups([c for _, _, c in sorted(brute(rows))])}
    one_by_one = []
    plain = J.Index.search
    monkeypatch.setattr(J.Index, "search", lambda self, *a, **kw: one_by_one.append(1) or plain(self, *a, **kw))
    assert {frozenset(g) for g in _groups(J.search_block(sets))} == want and 1 < len(want) < len(rows)
    assert len(one_by_one) < 10
    # the same in batches of one, with a matrix of few lists, and without one
    for name, value in (("BATCH", 1), ("DENSE_CELLS", 4000), ("DENSE_SETS", 1000)):
        monkeypatch.setattr(J, name, value)
        assert {frozenset(g) for g in _groups(J.search_block(sets))} == want


def _groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, []).append(i)
    return out.values()


def test_large_group_moves_once_for_each_cell_not_for_each_list(spark, monkeypatch):
    rows = near_copies(300)
    seen = []
    search = J._search_mixed
    monkeypatch.setattr(J, "_search_mixed", lambda mixed, *a: seen.append(mixed.count()) or search(mixed, *a))
    assert run(spark, rows, block_tokens=8000) == brute(rows)
    assert len(seen) == 1 and 0 < seen[0] <= len(rows)
