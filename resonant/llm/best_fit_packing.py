"""Best-fit packing of documents into sequences by a grouping genetic algorithm (GGA).

Documents are tokenised once, each followed by id 0; a document that is longer than a sequence is cut into full pieces
after a first, shorter one. A full piece is a sequence of its own and goes through no group. The other pieces are dealt by a salt into groups of
about group_size pieces, so that a group fits one task at any input size; loss against one pool is below one sequence
in each group. Each group is evolved on several islands in parallel, populations with different seeds. A crossover
injects whole well-filled bins of one parent into the other, removes the bins that now hold duplicates, and best-fits
the displaced pieces. Between epochs the elite individuals migrate to the next island of their group; the best one of
a group is its packing. Best-fit decreasing seeds every population, so a packing is never worse than that.

The ids are those of the tokenizer file by the tokenizers library. Texts go through tiktoken with the same vocabulary as
ranks, which gives the same ids in a quarter of the time; a text with a special token's string goes through the
tokenizers library itself.

Defined cases: a null or empty text is one piece of one id; repeated rows and equal doc_ids are packed each for
itself; a null doc_id stays null; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.llm.common import materialize, releasing

CAPACITY = 2048
SEPARATOR_ID = 0
GROUP_SIZE = 16_384
ISLANDS = 2
EPOCHS = 2
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Texts to id bytes."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._hf = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            return array("I", self._hf.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._fast.encode_ordinary(text)).tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("salt", T.LongType()),
    ]
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones after a first, possibly shorter one."""
    first = n % capacity if n > capacity else n
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(a, b - a) for a, b in zip(starts, starts[1:] + [n], strict=True)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with the checksum of their ids, and the salt that deals them into groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get((json_path, ranks_path)) or _ENCODERS.setdefault((json_path, ranks_path), Encoder(json_path, ranks_path))
        end, at = array("I", [SEPARATOR_ID]).tobytes(), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                at += 1
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, k, start, length, crc, zlib.crc32(b"%d %d %d" % (at, k, crc))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=_PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), _PIECES)


# --- the genetic algorithm on one group -----------------------------------------------------------------------------


def best_fit(order: np.ndarray, lengths: np.ndarray, residuals: list[int], capacity: int) -> np.ndarray:
    """Bins for the pieces in this order: each goes where the least room is left, else into a new bin."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(residuals):
        if r > 0:
            room[r].append(b)
            mask |= 1 << r
    n = len(residuals)
    out = []
    for size in lengths[order].tolist():
        m = mask >> size
        if m:
            r = size + (m & -m).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            r -= size
        else:
            b, n, r = n, n + 1, capacity - size
        if r:
            room[r].append(b)
            mask |= 1 << r
        out.append(b)
    return np.array(out, np.int64)


def _decreasing(items: np.ndarray, lengths: np.ndarray, noise: float, rng: np.random.Generator) -> np.ndarray:
    key = lengths[items] + (rng.normal(0, noise, len(items)) if noise else 0)
    return items[np.argsort(-key, kind="stable")]


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller full ones."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return -len(fill), float((fill**2).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Whole well-filled bins of b in a: a's bins with duplicates go, their other pieces and a few worst bins' are best-fitted again."""
    fill_b = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(well, max(1, int(len(well) * rng.uniform(0.05, 0.4))), replace=False)] = True
    injected = chosen[b]
    fill_a = np.bincount(a, weights=lengths)
    gone = np.zeros(len(fill_a), bool)
    gone[a[injected]] = True
    worst = np.argsort(fill_a, kind="stable")[: max(1, len(fill_a) // 50)]
    gone[worst] = True
    displaced = np.flatnonzero(gone[a] & ~injected)
    label_a, label_b = np.cumsum(~gone) - 1, np.cumsum(chosen) - 1 + int((~gone).sum())
    child = np.where(injected, label_b[b], label_a[a])
    residuals = np.concatenate([fill_a[~gone], fill_b[chosen]])
    order = _decreasing(displaced, lengths, noise, rng)
    child[order] = best_fit(order, lengths, (capacity - residuals).astype(int).tolist(), capacity)
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = 8, size: int = 4) -> list[np.ndarray]:
    """The population after these generations, best first; an empty one is seeded by best-fit decreasing and noisy orders."""
    rng = np.random.default_rng(seed)
    everything = np.arange(len(lengths))
    population = list(population)
    for k in range(max(0, size - len(population))):
        order = _decreasing(everything, lengths, 0 if not k and not population else 40 * (k + 1), rng)
        bins = np.empty(len(lengths), np.int64)
        bins[order] = best_fit(order, lengths, [], capacity)
        population.append(bins)
    least = math.ceil(int(lengths.sum()) / capacity)
    score = lambda x: fitness(x, lengths, capacity)
    population.sort(key=score, reverse=True)
    for g in range(generations):
        if len(lengths) < 2 or -score(population[0])[0] <= least:
            break
        children = []
        for _ in range(size // 2):
            i, j = sorted(rng.choice(len(population), 2, replace=False)) if len(population) > 1 else (0, 0)
            children.append(crossover(population[i], population[j], lengths, capacity, rng, float(rng.choice([0, 0, 20, 100]))))
        population = sorted([*population, *children], key=score, reverse=True)[:size]
    return population


_STATE = T.StructType([T.StructField("grp", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("lengths", T.BinaryType()), T.StructField("elite", T.BinaryType())])


def _sorted_items(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["doc_id", "piece", "start", "ids_crc32", "salt"], kind="stable", na_position="first").reset_index(drop=True)


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut_up = materialize(pieces(docs, json_path, ranks_path, capacity))
    short = cut_up.where(F.col("length") < capacity)
    groups = max(1, math.ceil(short.count() / group_size))
    items = short.withColumn("grp", F.pmod("salt", F.lit(groups)).cast("long"))
    parts = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))

    def rows(key: tuple, lengths: np.ndarray, population: list[np.ndarray], keep: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], lengths.astype("<i4").tobytes(), p.astype("<i4").tobytes()) for p in population[:keep]], columns=_STATE.names)

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = _sorted_items(pdf)["length"].to_numpy(np.int64)
        return rows(key, lengths, evolve(lengths, [], capacity, seed=int(key[1])), 2)

    def later(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.frombuffer(pdf["lengths"].iloc[0], "<i4").astype(np.int64)
        population = [np.frombuffer(e, "<i4").astype(np.int64) for e in sorted(pdf["elite"])]
        return rows(key, lengths, evolve(lengths, population, capacity, seed=1000 + int(key[1])), 2)

    state = parts.groupBy("grp", "island").applyInPandas(first, _STATE)
    for _ in range(1, epochs):
        moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        state = state.unionByName(moved) if islands > 1 else state
        state = materialize(state).groupBy("grp", "island").applyInPandas(later, _STATE)
    state = materialize(state)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def final(key: tuple, own: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        own = _sorted_items(own)
        lengths = own["length"].to_numpy(np.int64)
        bins = max((np.frombuffer(e, "<i4").astype(np.int64) for e in sorted(states["elite"])), key=lambda x: fitness(x, lengths, capacity))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        new = np.r_[True, np.diff(bins[order]) != 0]
        offset = np.empty(len(own), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(new, begins, 0))
        own["sequence_id"] = (int(key[0]) << 32) + bins
        own["offset"] = offset
        return own[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    packed = items.groupBy("grp").cogroup(state.groupBy("grp")).applyInPandas(final, out)
    # groups number their sequences from 0 on; these are below
    alone = cut_up.where(F.col("length") == capacity).select(*_PIECES.names[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
