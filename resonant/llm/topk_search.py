"""Exact top-k search by inner product with a pivot-distance index.

Vectors are scaled to integers, so scores are exact. With M the largest squared norm, x' = (x, sqrt(M - |x|^2)) and
q' = (q, 0) turn the largest inner product into the smallest distance: |q' - x'|^2 = |q|^2 + M - 2 q.x. Every vector is
keyed by its nearest pivot and its distance to it; the index is range-partitioned and sorted by (pivot, distance, id),
so a cell with a third of all vectors, or of equal ones, spreads over many tasks. A query expands outward from its own
distance ring by ring in each cell, and leaves a side as soon as the triangle inequality, |d(q,p) - d(x,p)| <= d(q,x),
shows that no vector there can reach its k-th score so far. Pivots and the first bound of that score come from a
bounded sample (sample_rows rows with the smallest hashes); all rows are indexed and the answer is exact.

The order is restored batch by batch where the index is read, as a scan may join files in any order. Vectors with a scaled
component beyond LARGEST sit in a cell of their own, which no bound closes, and are scored in Python's unbounded integers;
a score beyond a long is ranked exactly and returned as the nearest long.

Queries come in blocks of query_block rows, each small enough to broadcast; the vectors are never crossed with anything
that grows. Defined cases: vectors that are null, have a null id or hold null or non-finite components (after scaling) take
no part; shorter vectors count as padded by zeros; repeated rows are candidates each for itself; queries with one id count as
one, with the smallest vector; a query's own id is never its candidate; ties go to the smaller id; fewer than k
candidates are all returned; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from resonant.llm.common import materialize

PIVOTS = 32
SAMPLE_ROWS = 4096
QUERY_BLOCK = 8192
RING_ROWS = 256
#: Scaled components up to this give scores that fit a long in up to 32,767 dimensions; vectors with larger ones are wide.
LARGEST = 1 << 24
#: The cell of wide vectors.
WIDE = -1
_LONG = 1 << 63


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """vec_id and the components times factor, rounded down, of every vector that takes part: v, or w for a wide vector."""
    product = lambda x: F.lit(float(factor)) * x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(product(x)) < float("inf")))
    narrow = F.forall("embedding", lambda x: F.abs(product(x)) <= LARGEST)
    # from 2^53 on a double is a whole number
    whole = lambda x: F.when(F.abs(product(x)) < float(1 << 53), F.floor(product(x)).cast("double")).otherwise(product(x))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(narrow, F.transform("embedding", lambda x: F.floor(product(x)).cast("int"))).alias("v"),
        F.when(~narrow, F.transform("embedding", whole)).alias("w"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The list column as a float64 matrix, padded by zeros; products() takes care of sums that floats can't hold."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rows(vectors: list[list[float]], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's integers."""
    out = np.empty(matrix.shape, object)
    out.ravel()[:] = [int(x) for x in matrix.ravel().tolist()]
    return out


def stored(score: int) -> tuple[int, str]:
    """The nearest long, and a key by which scores of one long sort as the exact ones do."""
    if -_LONG <= score < _LONG:
        return score, "1" if score == -_LONG else ""
    return (_LONG - 1, "1" + str(score).zfill(700)) if score > 0 else (-_LONG, "0" + str(10**700 + score).zfill(700))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 1 << 53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample, each the farthest from those before it, first to last."""
    if not len(sample):
        return sample[:0]
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class TopK:
    """The k best (score, then smaller id) of each query among what was added."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, score, vec_id))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        q, s, v = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = rank == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], s[last])
        keep = rank < self.k
        self.parts = [(q[keep], s[keep], v[keep])]
        return self.parts[0]


class ExactTopK:
    """The k best of each query among scores of any size."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, list[tuple[int, int]]] = {}

    def add(self, query_ids: list[int], queries: np.ndarray, vec_ids: list[int], rows: np.ndarray) -> None:
        for at in range(0, len(vec_ids), RING_ROWS):
            scores = queries @ rows[at : at + RING_ROWS].T
            own = vec_ids[at : at + RING_ROWS]
            for q, row in zip(query_ids, scores.tolist(), strict=True):
                found = [(-s, v) for s, v in zip(row, own, strict=True) if v != q]
                self.best[q] = heapq.nsmallest(self.k, self.best.get(q, []) + found)

    def rows(self) -> list[tuple[int, int, int, str]]:
        return [(q, v, *stored(-s)) for q, best in self.best.items() for s, v in best]


def build_index(rows: DataFrame, pivots: np.ndarray, dim: int, most: float) -> DataFrame:
    """pivot, dist, vec_id, v and w, sorted by the first three within range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift_p = np.sqrt(np.maximum(most - (pivots**2).sum(axis=1), 0))
        for batch in batches:
            near, dist = np.full(batch.num_rows, WIDE, np.int32), np.zeros(batch.num_rows)
            narrow = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            x = _matrix(batch.column(1).take(pa.array(narrow)), dim)
            lift = np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))
            # squared distances in the lifted space: |x'|^2 = |p'|^2 = most
            d2 = 2 * most - 2 * (x @ pivots.T + lift[:, None] * lift_p)
            cell = d2.argmin(axis=1)
            near[narrow], dist[narrow] = cell, np.sqrt(np.maximum(d2[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(dist), *batch.columns], names=["pivot", "dist", "vec_id", "v", "w"])

    schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("dist", T.DoubleType()), *rows.schema.fields])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.mapInArrow(run, schema)
    return keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")


def _search_cells(top: TopK, cell: np.ndarray, dist: np.ndarray, vec_id: np.ndarray, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, reach: np.ndarray, to_pivot: np.ndarray) -> None:
    """Rows sorted by cell and distance, ring by ring outward from each query's own ring, as far as the bounds allow."""
    # the distances' rounding errors are some 1e-8 of the lifted vectors' length
    margin = 1e-6 * reach + 1e-3
    for p in np.unique(cell):
        a, b = np.searchsorted(cell, p, "left"), np.searchsorted(cell, p, "right")
        edges = np.r_[np.arange(a, b, RING_ROWS), b]
        low, high = dist[edges[:-1]], dist[edges[1:] - 1]
        dq = to_pivot[:, p]
        own = np.clip(np.searchsorted(high, dq), 0, len(low) - 1)
        for step in range(len(low)):
            for c in range(len(low)):
                gap = np.maximum(np.maximum(low[c] - dq, dq - high[c]), 0)
                live = (np.abs(own - c) == step) & ((reach - gap**2) / 2 + margin >= top.bound)
                q = np.flatnonzero(live)
                if len(q):
                    lo, hi = edges[c], edges[c + 1]
                    score = products(queries[q], x[lo:hi])
                    i, j = np.nonzero((score >= top.bound[q][:, None]) & (ids[q][:, None] != vec_id[lo:hi]))
                    top.add(q[i], score[i, j], vec_id[lo:hi][j])
            top.settle()


def _search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, pivots: np.ndarray, dim: int, most: float, k: int) -> DataFrame:
    sc = index.sparkSession.sparkContext
    held = sc.broadcast((ids, queries, bound, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_queries, bound, pivots = held.value
        narrow = np.abs(all_queries).max(axis=1, initial=0) <= LARGEST
        ids, queries = all_ids[narrow], all_queries[narrow]
        wide_ids, wide_queries = all_ids[~narrow].tolist(), _exact(all_queries[~narrow])
        top, exact = TopK(k, bound[narrow]), ExactTopK(k)
        reach = (queries**2).sum(axis=1) + most
        to_pivot = np.sqrt(np.maximum(reach[:, None] - 2 * queries @ pivots.T, 0))
        for batch in batches:
            order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
            wide = int((batch.column(0).to_numpy() == WIDE).sum())
            rows = batch.take(pa.array(order[wide:]))
            vec_id, x = rows.column(2).to_numpy(), _matrix(rows.column(3), dim)
            _search_cells(top, rows.column(0).to_numpy(), rows.column(1).to_numpy(), vec_id, x, ids, queries, reach, to_pivot)
            if wide_ids:
                exact.add(wide_ids, wide_queries, vec_id.tolist(), _exact(x))
            if wide:
                rows = batch.take(pa.array(order[:wide]))
                exact.add(all_ids.tolist(), _exact(all_queries), rows.column(2).to_pylist(), _exact(_matrix(rows.column(4), dim)))
        q, s, v = top.settle()
        columns = [ids[q].tolist(), v.tolist(), s.tolist(), [""] * len(q)]
        for row in exact.rows():
            for column, x in zip(columns, row, strict=True):
                column.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long, beyond string")


def search(vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best candidates."""
    rows = scaled(vectors, factor)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    width = F.size(F.coalesce("w", F.col("v").cast("array<double>")))
    stats = rows.agg(F.max(width).alias("dim"), F.max(norm).alias("most"), F.count("v").alias("n"), F.count_if(is_query).alias("q")).first()
    dim, most = max(stats["dim"] or 0, 1), float(stats["most"] or 0)
    keep = min(1_000_000, 1 + int(2e6 * sample_rows / max(stats["n"], 1)))
    picked = rows.where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < keep)).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample_rows).collect()
    sample_ids, sample = np.array([r["vec_id"] for r in picked], np.int64), _rows([r["v"] for r in picked], dim)
    centres = choose_pivots(sample, pivots) if len(sample) else np.zeros((1, dim))
    index = materialize(build_index(rows, centres, dim, most))

    asked = index.where(is_query).groupBy("vec_id").agg(F.min(F.coalesce("w", F.col("v").cast("array<double>"))).alias("v"))
    blocks = max(1, math.ceil(stats["q"] / query_block))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        ids, queries = np.array([r["vec_id"] for r in block], np.int64), _rows([r["v"] for r in block], dim)
        bound = np.full(len(ids), -(1 << 62), np.int64)
        narrow = np.flatnonzero(np.abs(queries).max(axis=1, initial=0) <= LARGEST)
        if len(narrow) and len(sample) > k:
            score = np.where(ids[narrow, None] == sample_ids, -(1 << 62), products(queries[narrow], sample))
            bound[narrow] = np.partition(score, -k, axis=1)[:, -k]
        hits = _search(index, ids, queries, bound, centres, dim, most, k)
        found.append(hits if blocks == 1 else materialize(hits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    merged = reduce(DataFrame.unionByName, found)
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
