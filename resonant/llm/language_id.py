"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to max_order whose counts are frozen after training. A byte's
probability comes from the longest context of the tree that has been seen, with method C escapes: in a context with n
occurrences and d distinct followers a follower seen c times has c / (n + d) and the escape d / (n + d); below order 0
all 256 bytes are equally likely. A text's code length under a language is the exact sum of -log2 over all of its
bytes, so nothing is sampled or cut. As the counts are frozen, the cost of a byte depends on it and the max_order bytes
before it alone; a small hash table per order keeps that cost for all languages at once, and numpy looks up whole texts.

Training takes a bounded sample of labelled rows: at most docs_per_language texts of each language, those with the
smallest hashes, and bytes_per_language bytes of them. Prediction covers every row.

Defined cases: a null text, an empty one or one without any letter gets "und" with score 0; equal code lengths go to
the language that sorts first; with no labelled rows every text gets "und"; extra columns are dropped, repeated rows
are predicted each for itself, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.llm.common import releasing, text_arrays

UNDETERMINED = "und"
#: Bytes whose costs are looked up at once.
BLOCK_BYTES = 1 << 17
_LETTER = re.compile(r"[^\W\d_]")


class _Table:
    """An open-addressed table from 32-bit keys to float32 rows; every key sits in one of two places, so a lookup is two gathers."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        keys = keys.astype(np.uint64)
        for bits in range(bits, bits + 8):
            if self._place(keys, bits):
                break
        self.rows = np.vstack([rows, np.full((1, rows.shape[1]), np.nan, np.float32)]).astype(np.float32)

    def _slots(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        k = (keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        second = ((keys ^ np.uint64(0x5BD1E995)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
        return (k >> np.uint64(64 - bits)).astype(np.int64), second.astype(np.int64)

    def _place(self, keys: np.ndarray, bits: int) -> bool:
        a, b = self._slots(keys, bits)
        held = np.full(1 << bits, -1, np.int64)
        todo, at = np.arange(len(keys)), a.copy()
        for _ in range(200):
            if not len(todo):
                break
            spot = at[todo]
            evicted = held[spot]
            held[spot] = todo  # the last of several wins
            lost = todo[held[spot] != todo]
            out = np.unique(evicted[evicted >= 0])
            out = out[held[at[out]] != out]
            todo = np.unique(np.concatenate([lost, out]))
            at[todo] = np.where(at[todo] == a[todo], b[todo], a[todo])
        else:
            return False
        self.bits = bits
        self.held = held.astype(np.int32)
        self.keys = np.where(held >= 0, np.append(keys, np.uint64(0))[np.maximum(held, 0)], np.uint64(1 << 40)).astype(np.uint64)
        self.n = len(keys)
        return True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, n where there is none."""
        keys = keys.astype(np.uint64)
        a, b = self._slots(keys, self.bits)
        out = np.where(self.keys[a] == keys, self.held[a], self.n)
        miss = np.flatnonzero(out == self.n)
        bm = b[miss]
        out[miss] = np.where(self.keys[bm] == keys[miss], self.held[bm], self.n)
        return out


@dataclass
class PPMModel:
    """Frozen costs in bits. symbols[k]: of a byte after a context of k bytes; escapes[k]: of leaving that context."""

    languages: list[str]
    max_order: int
    symbols: list[_Table]
    escapes: list[_Table]

    def code_lengths(self, data: np.ndarray, offs: np.ndarray, size: int = BLOCK_BYTES) -> np.ndarray:
        """Bits of each document under each language: documents x languages. Blocks of so many bytes bound the working memory,
        whatever the texts' lengths; a block sees the bytes before it."""
        out = np.zeros((len(offs) - 1, len(self.languages)))
        for a in range(int(offs[0]), int(offs[-1]), size):
            b = min(a + size, int(offs[-1]))
            i, j = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b, "left")  # documents i to j - 1 have bytes here
            starts = offs[i:j]
            sizes = np.minimum(offs[i + 1 : j + 1], b) - np.maximum(starts, a)
            cost = self._costs(data[max(a - self.max_order, int(offs[0])) : b], b - a, np.minimum(np.arange(a, b) - np.repeat(starts, sizes), self.max_order).astype(np.int8))
            full = np.flatnonzero(sizes)
            out[i + full] += np.add.reduceat(cost, (np.maximum(starts, a) - a)[full], axis=0, dtype=np.float64)
        return out

    def _costs(self, data: np.ndarray, n: int, order: np.ndarray) -> np.ndarray:
        """Bits of each of the last n bytes after as many bytes before it as order says."""
        head = len(data) - n
        text = np.concatenate([np.zeros(self.max_order - head, np.uint8), data]).astype(np.uint32)
        grams = [text[self.max_order :]]  # grams[k]: the byte and the k bytes before it
        for k in range(1, self.max_order + 1):
            grams.append(grams[-1] | (text[self.max_order - k : len(text) - k] << np.uint32(8 * k)))
        cost = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n, dtype=np.int32)
        for k in range(self.max_order, -1, -1):
            deep = order[todo] >= k
            at, rest = todo[deep], todo[~deep]
            rows = self.symbols[k].find(grams[k][at])
            hit = rows < self.symbols[k].n
            cost[at[hit]] += self.symbols[k].rows[rows[hit]]
            at = at[~hit]
            rows = self.escapes[k].find(grams[k][at] >> np.uint32(8))
            seen = rows < self.escapes[k].n
            cost[at[seen]] += self.escapes[k].rows[rows[seen]]
            todo = np.concatenate([rest, at])
        cost[todo] += 8.0
        return cost


def _counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of order + 1 bytes within the texts, and how often each occurs."""
    grams = [np.zeros(0, np.uint32)]
    for t in texts:
        a = np.frombuffer(t, np.uint8).astype(np.uint32)
        if len(a) > order:
            g = np.zeros(len(a) - order, np.uint32)
            for k in range(order + 1):
                g = (g << np.uint32(8)) | a[k : len(a) - order + k]
            grams.append(g)
    return np.unique(np.concatenate(grams), return_counts=True)


def train(texts: dict[str, list[bytes]], max_order: int = 3) -> PPMModel:
    """Freeze the context trees of each language's texts. max_order is at most 3: a context and its byte are one 32-bit key."""
    if not 0 <= max_order <= 3:
        raise ValueError("max_order must be from 0 to 3")
    languages = sorted(texts)
    symbols: list[_Table] = []
    escapes: list[_Table] = []
    lower: _Table | None = None
    for k in range(max_order + 1):
        by_language = [_counts(texts[lang], k) for lang in languages]
        grams = np.unique(np.concatenate([g for g, _ in by_language])) if languages else np.zeros(0, np.uint32)
        contexts = np.unique(grams >> np.uint32(8)) if k else np.zeros(min(len(grams), 1), np.uint32)
        if lower is None:
            below = np.full((len(grams), len(languages)), 8.0)
        else:
            below = lower.rows[lower.find(grams & np.uint32((1 << (8 * k)) - 1))].astype(np.float64)
        cost, leave = np.array(below), np.zeros((len(contexts), len(languages)))
        for j, (g, c) in enumerate(by_language):
            if not len(g):
                continue
            own = g >> np.uint32(8) if k else np.zeros(len(g), np.uint32)
            ctx, first = np.unique(own, return_inverse=True)
            total = np.bincount(first, weights=c)
            distinct = np.bincount(first)
            leave[np.searchsorted(contexts, ctx), j] = np.log2((total + distinct) / distinct)
            up = np.searchsorted(contexts, grams >> np.uint32(8)) if k else np.zeros(len(grams), np.int64)
            cost[:, j] += leave[up, j]
            cost[np.searchsorted(grams, g), j] = np.log2((total + distinct)[first] / c)
        lower = _Table(grams, cost)
        symbols.append(lower)
        escapes.append(_Table(contexts, leave))
    return PPMModel(languages, max_order, symbols, escapes)


def sample_texts(
    labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 400, bytes_per_language: int = 1_500_000
) -> dict[str, list[bytes]]:
    """The bounded training sample: of each language the texts with the smallest hashes, whole, until the byte bound is met."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) <= bytes_per_language)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # copies pass or fail the threshold together, so distinct texts count
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return {}
    # a hash threshold for each language that leaves about twice the bound, so that ranking sees a bounded number of rows
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, 1 + int(2e6 * docs_per_language / n)))])
    picked = rows.where(part < share[F.col("lang")]).select("lang", "text", F.xxhash64("text", F.lit(1)).alias("h"), F.octet_length("text").alias("b"))
    out: dict[str, list[bytes]] = {k: [] for k in sizes}
    took: dict[str, list[int]] = {k: [0, 0] for k in sizes}
    local = picked.dropDuplicates(["lang", "h"]).orderBy("lang", "h")
    for r in local.toLocalIterator():
        n, size = took[r["lang"]]
        if n < docs_per_language and size + r["b"] <= bytes_per_language:
            out[r["lang"]].append(r["text"].encode())
            took[r["lang"]] = [n + 1, size + r["b"]]
    return {k: v for k, v in out.items() if v}


def predict(docs: DataFrame, model: PPMModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The kept columns and, under these names, the language, its posterior under equal priors and its bits per byte. The text
    goes to Python once, also where it is one of the kept columns."""
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))])
    out = T.StructType([source.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    at, kept = source.columns.index(text), [source.columns.index(c) for c in keep]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        languages = [*m.languages, UNDETERMINED]
        for batch in batches:
            data, offs = text_arrays(batch.column(at))
            n = batch.num_rows
            pick, score, rate = np.full(n, len(m.languages)), np.zeros(n), np.zeros(n)
            if m.languages and n:
                bits = m.code_lengths(data, offs)
                best = bits.min(axis=1)
                pick = bits.argmin(axis=1)
                score = 1 / np.exp2(np.clip(best[:, None] - bits, -1000, 0)).sum(axis=1)
                rate = best / np.maximum(np.diff(offs), 1)
            for i in range(n):
                a, b = int(offs[i]), int(offs[i + 1])
                # most texts have a letter in their first bytes; only the others are searched to their end
                if a == b or not (_has_letter(data[a : min(b, a + 64)]) or _has_letter(data[a:b])):
                    pick[i], score[i], rate[i] = len(m.languages), 0.0, 0.0
            found = [pa.array([languages[k] for k in pick], pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *found], names=[*keep, *names])

    return source.mapInArrow(releasing(run), out)


def _has_letter(data: np.ndarray) -> bool:
    """Whether the bytes hold a character of a letter category; the pattern also finds numerals such as a superscript two."""
    text = data.tobytes().decode("utf-8", "ignore")
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, **sample: int) -> PPMModel:
    """The model learned from the labelled rows that are not held out."""
    return train(sample_texts(docs.where(~held_out(F.col("doc_id"))), **sample))


def identify(docs: DataFrame, model: PPMModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    found = predict(docs.select("doc_id", "text"), model or fit(docs))
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
