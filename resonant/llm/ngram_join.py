"""Exact Jaccard join of word n-gram sets by T-occurrence search (DivideSkip), to link classes and components.

Sets that are equal form one class, so copies are never expanded into pairs. Four steps find every link between
different sets that their components need, none by sampling:

1. Filter. A set with a partner of similarity t shares all but (1 - t) of its shingles with other sets. The shingles in
   one half of the hash space are dealt into buckets, packed by source batch, where those that only one set has are
   counted; a set with more of them than (1 - t) * size can't have a partner and leaves.
2. Blocks. Of the sets that stay, shingles are ordered from the rarest on; partners must share one of their first
   size - ceil(t * size) + 1 shingles, so only sets on one list of these shingles can be partners. Sets on one list, directly
   or over others, form a block.
3. Search. A block of up to block_tokens shingles is searched in one task.
4. A larger block is not kept together, as chains of lists may join what has little in common. Its lists are searched: the
   set of the smallest name on a list is its head, and every other set goes once, to the smallest head of its lists; a
   head's sets are searched in slices with the head in each. Lists whose sets are then not yet in one component are
   searched once more, equal lists once: the sets outside the list's largest component ask all of the list, slice by slice.
   Where its lists together move more than the block does, as with one large group of near copies, the block is taken as one list.

Within a block, inverted lists of each query set's shingles are divided: the short ones are merged, with a heap that skips
what can't reach the count, or by one counting sort of all their entries where they are many; the L longest are probed by
binary search, and sets that reach the required overlap are verified and united. Queries that share shingles with most of the
block have their long lists probed together, as a product of matrices. A set that is already in the block's largest component need not ask. Hashes have 64 bits; equal
hashes count as equal shingles, sets or lists.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z made lower case. Defined cases: a text of fewer than
n words, but at least one, has the one shingle of all its words; a text without words, null or empty, has no shingles and
is linked with nothing; repeated rows with equal texts link; a null doc_id takes part but is never the smallest id, and a
component of null ids only has a null id; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonant.llm.common import WordHashes, chunks, materialize, releasing, shingle_hashes, text_arrays

WORDS = 5
#: The similarity as a fraction: linked if PARTS * intersection >= LEAST * union.
LEAST, PARTS = 75, 100
#: Text bytes that one bucket of step 1 stands for; a bucket is held in one task's memory.
BUCKET_BYTES = 24_000_000
#: Bits of the map that spares most sets the shuffle of step 2; its size is fixed, an exact join follows.
MAP_BITS = 1 << 23
#: Shingles of a block that one task searches whole.
BLOCK_TOKENS = 6_000_000
#: Shingles of a slice of a larger block: an eighth of what a task searches whole, but not so few that most sets are longer.
SLICE_SHARE, LEAST_SLICE = 8, 1000
#: Shingles on each side of a cell, in which those that ask meet those asked: a quarter of what a task searches whole.
CELL_SHARE = 4
#: Entries of short lists up to which they are merged by a heap.
HEAP_ENTRIES = 2048
#: Indexes of so many sets keep the lists that a DENSE_SHARE-th of the sets are on as a matrix too, of at most so many cells.
DENSE_SETS, DENSE_SHARE, DENSE_CELLS = 256, 16, 1 << 24
#: Queries whose lists have this many entries for each set of the index are counted together, in batches of at most so many cells.
DENSE_ENTRIES, BATCH, BATCH_CELLS = 4, 128, 1 << 22

#: Edges up to this many (16 bytes each) are united in one task; above it by rounds of joins.
SMALL_EDGES = 1_000_000

_LOW40 = np.uint64((1 << 40) - 1)


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    data, offs = text_arrays(column)
    for i, j in chunks(offs):
        w = WordHashes(data, offs[i : j + 1])
        h, made = shingle_hashes(w.hash(w.starts, w.ends), np.bincount(w.doc, minlength=j - i), n)
        ends = np.cumsum(made)
        for a, b in zip(ends - made, ends, strict=True):
            yield np.unique(h[a:b])


def signature(shingles: np.ndarray) -> int:
    """A set's 64-bit name, signed."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


_FLOW = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sig", T.LongType()),
        T.StructField("blob", T.BinaryType()),
    ]
)
_DOC, _SHINGLES, _ALONE = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FLOW.names)


def _deal(buckets: int, n: int):
    """Documents to one row each, and packed rows of their shingles in the lower half of the hash space by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            names, sizes, sets = [], [], []
            seen: set[int] = set()
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                sig = signature(s) if len(s) else None
                rows.append((_DOC, (sig or 0) % buckets, doc_id, len(s), sig, None))
                if len(s) and sig not in seen:
                    seen.add(sig)
                    names.append(sig)
                    sizes.append(len(s))
                    sets.append(s)
            if sets:
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                half = flat < np.uint64(1 << 63)
                flat, owner = flat[half], owner[half]
                bucket = (((flat >> np.uint64(31)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                flat, owner = flat[order], owner[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                name, size = np.array(names, np.int64), np.array(sizes, np.uint32)
                low = (flat & _LOW40).view(np.uint8).reshape(-1, 8)[:, :5] if len(flat) else np.zeros((0, 5), np.uint8)
                for b in range(buckets):
                    a, z = cuts[b], cuts[b + 1]
                    if a < z:
                        who, count = np.unique(owner[a:z], return_counts=True)
                        parts = (np.array([len(who)], "<u4"), name[who], size[who], count.astype("<u4"), low[a:z])
                        rows.append((_SHINGLES, b, None, None, None, b"".join(p.tobytes() for p in parts)))
            yield _batch(rows)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(blob, "<u4", 1)[0])
    name = np.frombuffer(blob, np.int64, k, 4)
    size = np.frombuffer(blob, "<u4", k, 4 + 8 * k)
    count = np.frombuffer(blob, "<u4", k, 4 + 12 * k)
    raw = np.frombuffer(blob, np.uint8, -1, 4 + 16 * k).reshape(-1, 5)
    token = np.zeros((len(raw), 8), np.uint8)
    token[:, :5] = raw
    return name, size, count.astype(np.int64), token.view(np.uint64).ravel()


def _alone(blobs: list[bytes], targets: int) -> list[tuple]:
    """Packed (set, shingles that no other set of this bucket has, size), dealt by set."""
    parts = [_unpack(b) for b in blobs]
    name, size, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    token = np.concatenate([p[3] for p in parts])
    own, first = np.unique(name, return_index=True)
    keep = np.zeros(len(name), bool)
    keep[first] = True  # copies of a set come from several batches
    mine = np.repeat(keep, count)
    token, owner = token[mine], np.repeat(np.searchsorted(own, name[keep]), count[keep])
    order = np.argsort(token, kind="stable")
    token = token[order]
    single = np.r_[True, np.diff(token) != 0] & np.r_[np.diff(token) != 0, True]
    alone = np.bincount(owner[order][single], minlength=len(own))
    some = np.flatnonzero(alone)
    target = (own[some].view(np.uint64) % np.uint64(targets)).astype(np.int64)
    rows = []
    for t in np.unique(target):
        k = some[target == t]
        rows.append((_ALONE, int(t), None, None, None, b"".join((own[k].tobytes(), alone[k].astype("<u4").tobytes(), size[first][k].astype("<u4").tobytes()))))
    return rows


def _count_alone(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            yield batch.filter(pa.array(kind == _DOC))
            for b, blob in zip(*(batch.filter(pa.array(kind == _SHINGLES)).column(i).to_pylist() for i in (1, 5)), strict=True):
                if b != now and blobs:
                    yield _batch(_alone(blobs, targets))
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield _batch(_alone(blobs, targets))

    return run


def _without_partner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sets with more shingles of their own than a partner allows."""
    names, alone, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in pdf["blob"]:
        k = len(blob) // 16
        names.append(np.frombuffer(blob, np.int64, k))
        alone.append(np.frombuffer(blob, "<u4", k, 8 * k).astype(np.int64))
        sizes.append(np.frombuffer(blob, "<u4", k, 12 * k).astype(np.int64))
    name, first, at = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(alone), minlength=len(name))
    size = np.concatenate(sizes)[first]
    return pd.DataFrame({"sig": name[total > size - -(-LEAST * size // PARTS)]})


def _bit_map(wanted: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits of the wanted sets' names, folded on the executors: at most MAP_BITS / 64 rows leave them."""
    bits = wanted.select(F.pmod("sig", F.lit(MAP_BITS)).alias("b"))
    word = bits.select(F.expr("shiftright(b, 6)").alias("w"), F.expr("shiftleft(1L, CAST(b % 64 AS INT))").alias("m"))
    got = word.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.uint64)
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sig, n and shingles of every wanted set, once."""
    held = docs.sparkSession.sparkContext.broadcast(_bit_map(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(0), n):
                sig = signature(s) if len(s) else None
                if sig is None or sig in seen or not int(bits[(sig % MAP_BITS) >> 6]) >> (sig % 64) & 1:
                    continue
                seen.add(sig)
                rows.append((sig, len(s), s.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["sig", "n", "shingles"])

    sets = docs.select("text").mapInArrow(releasing(run), "sig long, n long, shingles array<long>").join(wanted, "sig", "left_semi")
    return sets.groupBy("sig").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges of one partition: every node with the smallest node it is connected with."""
    parts = [pdf[["a", "b"]].to_numpy(np.int64) for pdf in batches]
    edges = np.concatenate([np.zeros((0, 2), np.int64), *parts])
    nodes, at = np.unique(edges, return_inverse=True)
    left, right = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "root": nodes[label]})


def components(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """node and root (the smallest node it is connected with) of every node of the edges (a, b).

    A checked, bounded number of edges is united in one task on an executor; more take rounds of alternating stars."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= small_edges:
        return now.coalesce(1).mapInPandas(_unite, "node long, root long")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = materialize(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = state


def _with(df: DataFrame, key: str, values: DataFrame, how: str = "left") -> DataFrame:
    """df with the columns of values but its first, which is the key, unique in it. values are a table of their own, not an
    aggregate in the same stage, so that a key with many rows in df can be split among tasks at run time."""
    named = values.withColumnRenamed(values.columns[0], "join_key")
    return df.join(named, F.col(key) == F.col("join_key"), how).drop("join_key")


# --- the search within a block --------------------------------------------------------------------------------------


def _linked(both: int | np.ndarray, a: int, b: int | np.ndarray) -> bool | np.ndarray:
    return PARTS * both >= LEAST * (a + b - both)


class Index:
    """Inverted lists, each sorted, over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = [len(s) for s in sets]
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        keys, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        owner = owner[order]
        self.size_array = np.array(self.sizes, np.int64)
        self.lists = {k: owner[a : a + c] for k, a, c in zip(keys.tolist(), first.tolist(), count.tolist(), strict=True)}
        self.by_size = np.sort(self.size_array)
        self.row, self.batch = {}, 1
        if (total := len(sets)) >= DENSE_SETS:
            dense = np.flatnonzero(count * DENSE_SHARE >= total)
            dense = dense[np.argsort(-count[dense], kind="stable")][: DENSE_CELLS // total]
            if len(dense):
                self.row = {k: i for i, k in enumerate(keys[dense].tolist())}
                self.batch = max(1, min(BATCH, BATCH_CELLS // total))
                self.matrix = np.zeros((len(dense), total), np.float32)
                for k, i in self.row.items():
                    self.matrix[i, self.lists[k]] = 1

    def _need(self, size: int) -> int:
        """The least overlap of a set of this size with any partner in the index."""
        at = int(np.searchsorted(self.by_size, -(-LEAST * size // PARTS)))
        return max(1, -(-LEAST * (size + int(self.by_size[at])) // (LEAST + PARTS))) if at < len(self.by_size) else size + 1

    def search_all(self, queries: list[np.ndarray], skips: list[int]) -> list[list[int]]:
        """search() of each query; those that most of the index shares shingles with have their long lists probed together."""
        found: list[list[int]] = [[]] * len(queries)
        together: list[tuple[int, list[np.ndarray]]] = []
        rows: list[list[int]] = []
        for i, (query, skip) in enumerate(zip(queries, skips, strict=True)):
            keys = [t for t in query.tolist() if t in self.lists] if self.row else []
            if sum(len(self.lists[t]) for t in keys) < DENSE_ENTRIES * len(self.sets):
                found[i] = self.search(query, skip)
            elif sum(len(x) > 1 or x[0] != skip for x in map(self.lists.get, keys)) >= self._need(len(query)):
                together.append((i, [self.lists[t] for t in keys if t not in self.row]))
                rows.append([self.row[t] for t in keys if t in self.row])
        for a in range(0, len(together), self.batch):
            part = together[a : a + self.batch]
            asked = np.zeros((len(part), len(self.row)), np.float32)
            for k, r in enumerate(rows[a : a + self.batch]):
                asked[k, r] = 1
            counts = (asked @ self.matrix).astype(np.int64)
            for both, (i, short) in zip(counts, part, strict=True):
                if short:
                    both += np.bincount(np.concatenate(short), minlength=len(both))
                # a set without a common shingle links with nothing
                hit = np.flatnonzero((both > 0) & _linked(both, len(queries[i]), self.size_array))
                found[i] = hit[hit != skips[i]].tolist()
        return found

    def search(self, query: np.ndarray, skip: int = -1) -> list[int]:
        """The sets that link with the query, by DivideSkip; skip is left out."""
        size = len(query)
        need = self._need(size)
        lists = sorted((x for t in query.tolist() if (x := self.lists.get(t)) is not None and (len(x) > 1 or x[0] != skip)), key=len)
        if len(lists) < need:
            return []
        longest = len(lists[-1])
        divide = min(need - 1, len(lists) - 1, int(need / (0.02 * math.log2(max(longest, 2)) + 1)))
        short, long = lists[: len(lists) - divide], lists[len(lists) - divide :]
        least = need - divide
        if sum(map(len, short)) <= HEAP_ENTRIES:
            found = _heap_merge([x.tolist() for x in short], least)
            doc, both = np.array([d for d, _ in found], np.int64), np.array([n for _, n in found], np.int64)
        else:
            doc, both = np.unique(np.concatenate(short), return_counts=True)
            keep = both >= least
            doc, both = doc[keep], both[keep]
        keep = doc != skip
        doc, both = doc[keep], both[keep]
        for k, x in enumerate(reversed(long)):
            keep = both + len(long) - k >= need
            doc, both = doc[keep], both[keep]
            if not len(doc):
                return []
            at = np.minimum(np.searchsorted(x, doc), len(x) - 1)
            both = both + (x[at] == doc)
        return doc[_linked(both, size, self.size_array[doc])].tolist()


def _heap_merge(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """The sets that at least so many of the sorted lists hold, with that number; what can't reach it is skipped."""
    found = []
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        doc = heap[0][0]
        popped = []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found.append((doc, len(popped)))
            target = doc + 1
        else:
            # fewer than least lists hold this set: no set before the next head that least lists can meet at counts
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], target, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return found


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> int:
        a, b = sorted((self.find(a), self.find(b)))
        if a != b:
            self.up[b] = a
            self.size[a] += self.size[b]
        return a


def search_block(sets: list[np.ndarray]) -> list[int]:
    """The smallest member that each set of a block is connected with by links."""
    index, union = Index(sets), Union(len(sets))
    largest, asked = 0, [False] * len(sets)
    todo = list(range(len(sets)))
    while todo:
        left, at, step = [], 0, 1
        while at < len(todo):
            batch = []
            while at < len(todo) and len(batch) < step:
                q = todo[at]
                at += 1
                if asked[q] or (q and union.find(q) == union.find(largest)):
                    left.append(q)
                else:
                    asked[q] = True
                    batch.append(q)
            # the first ones bring most of a cluster together, so that most others need not ask
            step = min(2 * step, index.batch)
            for q, found in zip(batch, index.search_all([sets[q] for q in batch], batch), strict=True):
                for y in found:
                    union.join(q, y)
                root = union.find(q)
                if union.size[root] > union.size[union.find(largest)]:
                    largest = root
        todo = [q for q in left if not asked[q] and union.find(q) != union.find(largest)]
    return [union.find(i) for i in range(len(sets))]


def _search_blocks(blocks: DataFrame) -> DataFrame:
    """(a, b) links that connect the sets of each block (task, root, sig, shingles) as all their links do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, block in pdf.sort_values(["root", "sig"]).groupby("root", sort=False):
            sig = block["sig"].tolist()
            out += [(sig[i], sig[r]) for i, r in enumerate(search_block([np.asarray(s, np.int64) for s in block["shingles"]])) if i != r]
        return pd.DataFrame(out, columns=["a", "b"])

    return blocks.groupBy("task").applyInPandas(run, "a long, b long")


def _around_heads(shared: DataFrame, sets: DataFrame, parts: int, block_tokens: int) -> DataFrame:
    """(a, b) links of sets around heads; shared: sig, n, t and head of every list that several sets are on."""
    home = shared.where("sig <> head").groupBy("sig").agg(F.min("head").alias("head"), F.first("n").alias("n"))
    home = materialize(home)
    slices = materialize(home.groupBy("head").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("slices"), F.sum("n").alias("w")))
    total = slices.agg(F.sum("w")).first()[0] or 0
    tasks = max(1, parts, math.ceil(total / block_tokens))
    dealt = _with(home.select("sig", "head"), "head", slices.select("head", "slices"))
    dealt = dealt.select("sig", "head", F.pmod(F.xxhash64("sig"), F.col("slices")).cast("int").alias("slice"))
    heads = slices.select(F.col("head").alias("sig"), "head", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    blocks = dealt.unionByName(heads).join(sets.select(F.col("sig").alias("s"), "shingles"), F.col("sig") == F.col("s"))
    root = F.concat_ws(":", "head", "slice")
    return _search_blocks(blocks.select(F.pmod(F.xxhash64("head", "slice"), F.lit(tasks)).alias("task"), root.alias("root"), "sig", "shingles"))


def _mixed_lists(shared: DataFrame, roots: DataFrame) -> DataFrame | None:
    """sig, n, t and asks of every list whose sets have several components, equal lists once; None if there is no such list."""
    comp = _with(shared.select("sig", "n", "t"), "sig", roots).select("sig", "n", "t", F.coalesce("root", "sig").alias("comp"))
    lists = comp.groupBy("t").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y")
    )
    kept = materialize(lists.where("lo <> hi").groupBy("k", "x", "y").agg(F.min("t").alias("t")).select("t"))
    if kept.isEmpty():
        return None
    rows = materialize(_with(comp, "t", kept, "inner"))
    sizes = rows.groupBy("t", "comp").agg(F.count("*").alias("k"))
    largest = materialize(sizes.groupBy("t").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest")))
    return materialize(_with(rows, "t", largest).select("sig", "n", "t", (F.col("comp") != F.col("largest")).alias("asks")))


def _search_mixed(mixed: DataFrame, sets: DataFrame, parts: int, block_tokens: int) -> DataFrame:
    """(a, b) links of mixed lists: those of a list that ask against all of it, in cells of at most about block_tokens shingles a side."""
    tokens = mixed.groupBy("t").agg(F.sum("n").alias("w"), F.sum(F.when(F.col("asks"), F.col("n"))).alias("v"))
    cells = materialize(tokens.select("t", *[F.ceil(F.col(c) / block_tokens).cast("int").alias(d) for c, d in (("v", "na"), ("w", "nb"))], "w"))
    total = cells.agg(F.sum(F.col("w") * F.col("na"))).first()[0] or 0
    tasks = max(1, parts, math.ceil(total / block_tokens))
    dealt = materialize(_with(mixed, "t", cells.drop("w")))
    own = F.xxhash64("sig")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = dealt.where("asks").select("t", F.pmod(own, F.col("na")).cast("int").alias("i"), every("nb").alias("j"), "sig", F.lit(True).alias("asks"))
    asked = dealt.select("t", every("na").alias("i"), F.pmod(own, F.col("nb")).cast("int").alias("j"), "sig", F.lit(False).alias("asks"))
    rows = asking.unionByName(asked).join(sets.select(F.col("sig").alias("s"), "shingles"), F.col("sig") == F.col("s")).withColumn("task", F.pmod(F.xxhash64("t", "i", "j"), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, cell in pdf.sort_values(["t", "i", "j", "asks", "sig"]).groupby(["t", "i", "j"], sort=False):
            asks = cell["asks"].to_numpy()
            sig, sets = cell["sig"].to_numpy(), [np.asarray(s, np.int64) for s in cell["shingles"]]
            members = np.flatnonzero(~asks).tolist()
            index = Index([sets[k] for k in members])
            askers = np.flatnonzero(asks).tolist()
            for a in range(0, len(askers), BATCH):
                some = askers[a : a + BATCH]
                for k, found in zip(some, index.search_all([sets[k] for k in some], [-1] * len(some)), strict=True):
                    out += [(int(sig[k]), int(sig[members[y]])) for y in found if sig[members[y]] != sig[k]]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.select("task", "t", "i", "j", "sig", "asks", "shingles").groupBy("task").applyInPandas(run, "a long, b long")


def _moved(rows: DataFrame, by: tuple[str, ...], cell_tokens: int) -> DataFrame:
    """by and moved: about how many shingles the cells of rows (n, asks and the columns by) take, together."""
    v, w = F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)), F.sum("n")
    return rows.groupBy(*by).agg(v.alias("v"), w.alias("w")).select(*by, (F.col("v") * F.ceil(F.col("w") / cell_tokens) + F.col("w") * F.ceil(F.col("v") / cell_tokens)).alias("moved"))


def _cheaper(mixed: DataFrame, blocks: DataFrame, roots: DataFrame, cell_tokens: int) -> DataFrame:
    """The mixed lists, but in place of those of a block the block itself as one list, where that moves no more shingles."""
    comp = _with(blocks, "sig", roots.withColumnRenamed("root", "comp")).select("sig", "n", F.col("root").alias("t"), F.coalesce("comp", "sig").alias("comp"))
    sizes = comp.groupBy("t", "comp").agg(F.count("*").alias("k"))
    largest = materialize(sizes.groupBy("t").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest")))
    whole = materialize(_with(comp, "t", largest).select("sig", "n", "t", (F.col("comp") != F.col("largest")).alias("asks")))
    placed = materialize(_with(mixed, "sig", blocks.select("sig", F.col("root").alias("block"))))
    lists = _moved(placed, ("block", "t"), cell_tokens).groupBy("block").agg(F.sum("moved").alias("listed"))
    both = _moved(whole, ("t",), cell_tokens).join(lists, F.col("t") == F.col("block"))
    taken = materialize(both.where("moved <= listed").select("block"))
    return materialize(placed.join(taken, "block", "left_anti").drop("block").unionByName(whole.join(taken, F.col("t") == F.col("block"), "left_semi")))


def _search_large(shared: DataFrame, sets: DataFrame, blocks: DataFrame, parts: int, slice_tokens: int, cell_tokens: int, small_edges: int) -> DataFrame:
    """(a, b) links of the sets on these lists, as step 4 has it; blocks: sig, n and root of these sets."""
    links = materialize(_around_heads(shared, sets, parts, slice_tokens))
    roots = materialize(components(links, small_edges).select(F.col("node").alias("sig"), "root"))
    mixed = _mixed_lists(shared, roots)
    return links if mixed is None else links.unionByName(_search_mixed(_cheaper(mixed, blocks, roots, cell_tokens), sets, parts, cell_tokens))


def link_components(docs: DataFrame, n: int = WORDS, bucket_bytes: int = BUCKET_BYTES, block_tokens: int = BLOCK_TOKENS, small_edges: int = SMALL_EDGES) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size (rows with the very same set) of every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(size / bucket_bytes))
    dealt = docs.mapInArrow(releasing(_deal(buckets, n)), _FLOW).repartition(max(parts, 1), "bucket").sortWithinPartitions("bucket")
    flow = materialize(dealt.mapInArrow(releasing(_count_alone(parts)), _FLOW))
    named = flow.where(F.col("kind") == _DOC).select("doc_id", "n", "sig")
    lonely = flow.where(F.col("kind") == _ALONE).groupBy("bucket").applyInPandas(_without_partner, "sig long")
    wanted = materialize(named.where("sig is not null").select("sig").distinct().join(lonely, "sig", "left_anti"))
    sets = materialize(_sets_of(docs, wanted, n))

    flat = sets.select("sig", "n", F.explode("shingles").alias("t"))
    common = flat.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    rare_first = flat.join(common, "t").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    # shingles of one set only come first in the order; of the others these are left for the prefix
    reach = F.col("n") - F.ceil(F.col("n") * LEAST / PARTS) + 1 - (F.col("n") - F.size("s"))
    prefix = materialize(rare_first.where(reach > 0).select("sig", "n", F.explode(F.slice("s", F.lit(1), reach.cast("int"))).alias("x")).select("sig", "n", F.col("x.t").alias("t")))
    heads = materialize(prefix.groupBy("t").agg(F.min("sig").alias("head"), F.count("*").alias("k")).where("k > 1").select("t", "head"))
    shared = materialize(_with(prefix, "t", heads, "inner"))
    joined = materialize(components(shared.where("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b")).distinct(), small_edges).select(F.col("node").alias("sig"), "root"))
    sized = materialize(joined.join(sets.select("sig", "n"), "sig"))
    weights = materialize(sized.groupBy("root").agg(F.sum("n").alias("w")))
    total = weights.agg(F.sum("w"), F.max("w")).first()
    tasks = max(1, parts, math.ceil((total[0] or 0) / block_tokens))
    held = materialize(_with(sized.select("sig", "n", "root"), "root", weights))
    small = held.where(F.col("w") <= block_tokens).select(F.col("sig").alias("s"), "root")
    blocks = sets.join(small, F.col("sig") == F.col("s"))
    links = _search_blocks(blocks.select(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), "root", "sig", "shingles"))
    if (total[1] or 0) > block_tokens:
        large = held.where(F.col("w") > block_tokens).select(F.col("sig").alias("s"))
        own = materialize(shared.join(large, F.col("sig") == F.col("s"), "left_semi"))
        inside = held.where(F.col("w") > block_tokens).select("sig", "n", "root")
        sizes = (max(LEAST_SLICE, block_tokens // share) for share in (SLICE_SHARE, CELL_SHARE))
        links = links.unionByName(_search_large(own, sets, inside, parts, *sizes, small_edges))
    roots = materialize(components(links, small_edges).select(F.col("node").alias("sig"), "root"))

    classes = named.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    first = materialize(roots.join(classes, "sig").groupBy("root").agg(F.min("least").alias("component_id")))
    linked = _with(roots, "root", first).select("sig", "component_id", F.lit(True).alias("linked"))
    classes = materialize(_with(classes, "sig", linked).select("sig", "class_size", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    # rows without a set are dealt out by their id
    keyed = named.withColumn("key", F.coalesce("sig", F.xxhash64("doc_id")))
    alone = F.col("sig").isNull()
    return _with(keyed, "key", classes).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size")
    )
