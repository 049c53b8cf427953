"""Exact answers, whatever the block sizes; odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.llm import topk_search as S


def brute(rows, k, every):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    pad = [(i, np.array(v + [0] * (dim - len(v)), dtype=object)) for i, v in ok]
    out = []
    for q in sorted({i for i, _ in pad if i % every == 0}):
        qv = min((v for i, v in ok if i == q))
        qv = np.array(qv + [0] * (dim - len(qv)), dtype=object)
        best = sorted(((-int((qv * v).sum()), i) for i, v in pad if i != q))[:k]
        out += [(q, r, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k, every, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.search(df, F.col("vec_id") % every == 0, k=k, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"pivots": 3, "sample_rows": 10, "query_block": 4}, {"pivots": 1, "sample_rows": 400}])
def test_matches_brute_force(spark, kw):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.1).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # equal vectors: ties go to smaller ids
    assert run(spark, rows, 7, 20, **kw) == brute(rows, 7, 20)


@pytest.mark.parametrize("parts", [3, 32, 200])
def test_any_number_of_partitions(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 8)).tolist())] + [(3001, [5e6, *[1.0] * 7]), (3020, [-5e6, 1e30, *[0.5] * 6])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark, rows, 20, 20, sample_rows=64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 20, 20)


def test_scores_beyond_a_long_rank_exactly(spark):
    big = float(2**40)
    rows = [(0, [big, big]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, -1.0]), (4, [-big, -2.0]), (5, [3.4e38, 0.0]), (6, [1.0, 1.0])]
    got = run(spark, rows, 20, 100)
    assert [v for _, _, v, _ in got] == [5, 2, 1, 6, 3, 4]
    assert [s for *_, s in got] == [2**63 - 1] * 3 + [2 * 2**46 * 64] + [-(2**63)] * 2
    order = sorted([-(10**30), -(1 << 63) - 1, -(1 << 63), 5, (1 << 63) - 1, 1 << 63, 10**80], key=S.stored)
    assert order == sorted(order)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, [-0.001, 0.0]), (7, []), (8, [1e5, 1e5]), (8, [1e5, 1e5]), (9, [4e6, -3999999.25]), (12, [-3.9e6, 4.1e6])]
    assert run(spark, rows, 20, 4) == brute(rows, 20, 4)


def test_few_and_no_candidates(spark):
    assert run(spark, [(0, [1.0])], 20, 20) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 20, 20) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [], 20, 20) == []


def test_pruning_leaves_distant_cells_alone(spark, monkeypatch):
    seen = []
    real = S.products
    monkeypatch.setattr(S, "products", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(0)
    top = S.TopK(3, np.array([-(1 << 62)]))
    top.add(np.zeros(5, np.int64), np.arange(5), np.arange(5))
    q, s, v = top.settle()
    assert s.tolist() == [4, 3, 2] and top.bound[0] == 2
    sample = rng.normal(size=(50, 3))
    assert len(S.choose_pivots(sample, 8)) == 8 and len(S.choose_pivots(np.ones((5, 2)), 8)) == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2)).withColumn("pivot", F.lit(3))
    assert S.search(df, F.col("vec_id") == 0, k=2).count() == 2
