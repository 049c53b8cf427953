"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

First the corpus frequency of every n-gram of the test items is counted over all documents. The rarer share of each
item's n-grams are its seeds; where a document holds a seed, the words around it are aligned locally with the whole
item, so copies with replaced, inserted or dropped words are found and a chance hit on a common phrase is not. The
score is the best local alignment divided by the item's alignment with itself; from least_score on the item counts as
contained in the document.

Items are handled in blocks of block_items and about block_bytes, documented bounds under which a block is broadcast; more
or longer items mean more passes over the documents, never a larger broadcast. Documents are never shuffled, so a passage shared by many of
them is no hot key.

Words are runs of bytes other than ASCII punctuation and blanks, lower-cased A-Z. Defined cases: items with a null id or
with fewer than min_words words are no evidence and match nothing; null and empty texts have no hits; repeated items and
rows match each for itself; extra columns are dropped by hits() and kept by remove(); empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonant.llm.common import IS_BREAK, WordHashes, chunks, mix, releasing, text_arrays

SEED_WORDS = 3
#: The share of an item's n-grams, from the rarest on, that are seeds.
SEED_SHARE = 0.75
MIN_WORDS = 5
#: Chance alignments of unrelated texts stay below 0.35 on the test tables, edited copies with a third of their words changed above 0.4.
LEAST_SCORE = 0.4
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
BLOCK_ITEMS = 10_000
#: Bytes of items in a block, about; a longer item is a block of its own size.
BLOCK_BYTES = 16_000_000


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of item in words: score, first word and end in words (end exclusive)."""
    n = len(words)
    col = np.arange(n + 1) * -GAP
    best, at = 0.0, (0, 0)
    row = np.zeros(n + 1)
    start = np.arange(n + 1)  # where the alignment that ends here began
    for i, w in enumerate(item):
        diag = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        new = np.zeros(n + 1)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        begin = np.arange(n + 1)
        begin[1:] = np.where(new[1:] <= 0, np.arange(1, n + 1), np.where(diag >= up, start[:-1], start[1:]))
        lifted = new + col
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= run, np.arange(n + 1), 0))
        row = run - col
        start = np.where(row > 0, begin[source], np.arange(n + 1))
        j = int(row.argmax())
        if row[j] > best:
            best, at = float(row[j]), (int(start[j]), j)
    return best, at[0], at[1]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n:
        return words[:0]
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(3) + words[k : len(words) - n + 1 + k])
    return h


@dataclass
class Items:
    """A block of test items: their word hashes, and their n-grams sorted with the (item, place) pairs of each."""

    ids: list[int]
    words: list[np.ndarray]
    n: int

    def __post_init__(self) -> None:
        grams = [_grams(w, self.n) for w in self.words]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        self._index(flat, item, place)

    def _index(self, flat: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        self.flat, self.item, self.place = flat[order], item[order], place[order]
        self.keys, self.first, self.count = np.unique(self.flat, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams that are keys, and which keys they are."""
        at = np.flatnonzero(self.filter[(grams >> np.uint64(44)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, grams[at]), max(len(self.keys) - 1, 0))
        hit = self.keys[k] == grams[at] if len(at) else np.zeros(0, bool)
        return at[hit], k[hit]

    def keep_rare(self, corpus: np.ndarray, share: float) -> None:
        """Leave each item the given share of its n-grams, those with the smallest corpus counts."""
        count = corpus[np.searchsorted(self.keys, self.flat)] if len(self.keys) else np.zeros(0)
        order = np.lexsort((self.flat, count, self.item))
        size = np.bincount(self.item, minlength=len(self.ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        keep = rank < np.maximum(1, np.ceil(size[self.item] * share))
        self._index(self.flat[keep], self.item[keep], self.place[keep])


def _word_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words of each row) for runs of rows."""
    data, offs = text_arrays(column)
    for i, j in chunks(offs):
        w = WordHashes(data, offs[i : j + 1], IS_BREAK)
        yield i, w.hash(w.starts, w.ends), np.bincount(w.doc, minlength=j - i)


def load_items(bench: DataFrame, block: int, blocks: int, n: int = SEED_WORDS, min_words: int = MIN_WORDS) -> Items:
    rows = bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
    ids: list[int] = []
    words: list[np.ndarray] = []
    got = rows.select("item_id", "text").orderBy("item_id", "text").collect()
    for i, h, counts in _word_runs(pa.array([r["text"] for r in got], pa.string())):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            if b - a >= min_words:
                ids.append(got[i + k]["item_id"])
                words.append(h[a:b])
    return Items(ids, words, n)


def align(items: Items, words: np.ndarray, counts: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the best place of each item in each row that reaches the least score."""
    at, key = items.find(_grams(words, items.n))
    if not len(at):
        return
    ends = np.cumsum(counts)
    row = np.searchsorted(ends, at, "right")
    inside = at + items.n <= ends[row]
    at, key, row = at[inside], key[inside], row[inside]
    if not len(at):
        return
    many = items.count[key]
    slot = np.repeat(items.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, at, row = items.item[slot], np.repeat(at, many), np.repeat(row, many)
    order = np.lexsort((at, item, row))
    item, at, row = item[order], at[order], row[order]
    edges = np.r_[0, np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1, len(row)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        r, k = int(row[a]), int(item[a])
        own = items.words[k]
        reach = 2 * len(own)
        lo, hi = int(ends[r] - counts[r]), int(ends[r])
        best = (0.0, 0, 0)
        places = at[a:b]
        cuts = np.r_[0, np.flatnonzero(np.diff(places) > reach) + 1, len(places)]
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            left = max(lo, int(places[c]) - reach)
            window = words[left : min(hi, int(places[d - 1]) + reach)]
            # an alignment can't score more than its common words do
            if MATCH * np.isin(own, window).sum() < least * MATCH * len(own):
                continue
            score, x, y = smith_waterman(own, window)
            if score > best[0]:
                best = (score, left + x - lo, left + y - lo)
        if best[0] >= least * MATCH * len(own):
            yield r, k, best[0] / (MATCH * len(own)), best[1], best[2]


def _blocks(bench: DataFrame, block_items: int, block_bytes: int = BLOCK_BYTES) -> int:
    n, size = bench.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, math.ceil(n / block_items), math.ceil((size or 0) / block_bytes))


def seeds(docs: DataFrame, bench: DataFrame, block: int, blocks: int, share: float = SEED_SHARE) -> Items:
    """The items of a block with their seeds: n-grams that are rare among all documents."""
    items = load_items(bench, block, blocks)
    held = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for _, words, _ in _word_runs(batch.column(0)):
                total += np.bincount(items.find(_grams(words, items.n))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

    corpus = np.zeros(len(items.keys), np.int64)
    for r in docs.select("text").mapInArrow(releasing(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        corpus[r["key"]] = r["n"]
    items.keep_rare(corpus, share)
    return items


def hits(docs: DataFrame, bench: DataFrame, least_score: float = LEAST_SCORE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: where each test item that a document contains fits best."""
    blocks, out = _blocks(bench, block_items), None
    for b in range(blocks):
        held = docs.sparkSession.sparkContext.broadcast(seeds(docs, bench, b, blocks))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                found = [(i + r, items.ids[k], s, x, y) for i, words, counts in _word_runs(batch.column(1)) for r, k, s, x, y in align(items, words, counts, least_score)]
                rows, ids, score, start, end = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "item_id", "score", "start_word", "end_word"],
                )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "doc_id long, item_id long, score double, start_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out


def remove(docs: DataFrame, bench: DataFrame, least_score: float = LEAST_SCORE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    blocks, left = _blocks(bench, block_items), docs
    at = docs.columns.index("text")
    for b in range(blocks):
        held = docs.sparkSession.sparkContext.broadcast(seeds(docs, bench, b, blocks))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, words, counts in _word_runs(batch.column(at)):
                    for r, *_ in align(held.value, words, counts, least_score):
                        keep[i + r] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(releasing(run), docs.schema)
    return left
