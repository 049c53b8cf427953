"""Table access, lineage cuts and vectorised text hashing shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels handle at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


_OWN_DIR: list[str] = []
_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where that is unset and all run in one
    process, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="resonant-checkpoint-"))
    return _OWN_DIR[0]


def release() -> None:
    """Give a Python worker's free memory back to the machine: workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function for mapInArrow or mapInPandas that gives free memory back at the end of each task."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return whole


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/resonant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with this share of all rows is split into so many parts in a shuffle lookup; there are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_PARTS = 0.001, 64


def lookup(df: DataFrame, on: Column, values: DataFrame, few: bool) -> DataFrame:
    """df with the columns of values but its first, the key, from the row whose key equals on (null equals null); null where there is
    none. Keys of values are unique and its other columns' names new to df. Few values are broadcast; else it is a shuffle join, in
    which the hot keys of df are split into salted parts."""
    wanted = values.columns[1:]
    key = free_name(df, "lookup_key")
    named = values.withColumnRenamed(values.columns[0], key)
    if few:
        return df.join(F.broadcast(named), on.eqNullSafe(F.col(key)), "left").drop(key)
    own, hot_key, hot, part, other_part = (free_name(df, x) for x in ("lookup_own", "lookup_hot_key", "lookup_hot", "lookup_part", "lookup_other_part"))
    keyed = df.withColumn(own, on)
    sizes = keyed.groupBy(F.col(own).alias(hot_key)).agg(F.count("*").alias("n"))
    keys = materialize(sizes.where(F.col("n") >= max(2, HOT_SHARE * df.count())).select(hot_key, F.lit(True).alias(hot)))
    # the rows of a hot key go by their own values, so that a task that runs again deals them out as before
    plain = [F.col(f"`{f.name}`") for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())]
    salt = F.when(F.col(hot), F.pmod(F.xxhash64(*plain), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    left = keyed.join(F.broadcast(keys), F.col(own).eqNullSafe(F.col(hot_key)), "left").withColumn(part, salt).drop(hot_key, hot)
    parts = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = named.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col(hot_key)), "left").select(key, *wanted, F.explode(parts).alias(other_part))
    return left.join(right, F.col(own).eqNullSafe(F.col(key)) & (F.col(part) == F.col(other_part)), "left").drop(own, key, part, other_part)


# --- text as numpy arrays -------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(5_000_011))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: The bytes \x09-\x0D and \x20.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is neither a letter nor a digit.
IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        m = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most size bytes together, or of one longer document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class WordHashes:
    """Words of a run of documents: start and end byte, document, and a 64-bit hash of any byte range."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators: np.ndarray = IS_SPACE):
        base = int(offs[0])
        self.offs = offs - base
        low = ASCII_LOWER[data[base : int(offs[-1])]]
        sep, n = separators[low], len(low)
        first = np.zeros(n + 1, bool)
        first[self.offs] = True
        inside = ~sep
        begins = inside.copy()
        begins[1:] &= sep[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= sep[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(self.offs, self.starts, "right") - 1
        up, self._down = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[low] * up[:n], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-word runs end to end, and how many each has; a shorter document has one of all its words."""
    if not len(words):
        return words[:0], np.zeros(len(counts), np.int64)
    doc_end = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    left = np.minimum(doc_end - at, n)
    with np.errstate(over="ignore"):
        for k in range(n):
            nxt = words[np.minimum(at + k, len(words) - 1)]
            h = np.where(left > k, (h ^ nxt) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1), h)
            h ^= h >> np.uint64(33)
        h = mix(h + left.astype(np.uint64))
    made = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    start = np.cumsum(counts) - counts
    keep = at - np.repeat(start, counts) < np.repeat(made, counts)
    return h[keep], made
