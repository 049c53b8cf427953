"""Waveform files as blocks of samples: listing, container dispatch, metadata, decoding, prefix.

Files are listed and read by Spark's binaryFile source, so any store that Spark reads will do; a file is one row there,
so it has at most 2 GiB. A file that can't be read or isn't supported becomes a row with a status and a reason; it never
fails the job. metadata() hands only the first bytes of each file to Python, and whole files only where those don't
reach. Files are cut into blocks of block_frames, which are dealt out before they are decoded, so one long file keeps
all cores busy and downstream windows never hold a whole channel. Decoded are integer PCM of 8 to 32 bits and 32- and
64-bit float in RIFF files, and FLAC; ALAC files are described from their boxes and tables but not decoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.sources import flac, mp4
from resonant.sources.errors import Unsupported

SUFFIXES = ("wav", "flac", "m4a")
MAX_CHUNKS = 1024
BLOCK_FRAMES = 65_536

#: Bytes of a file that metadata() looks at first.
HEAD_BYTES = 1 << 20
#: Seconds that the fast mode reads.
FAST_SECONDS = 60.0

BLOCKS = "track string, channel int, block long, start_frame long, samples array<double>"
HEADERS = "track string, container string, status string, reason string, sample_rate int, channels int, bits int, encoding string, frames long, pcm_sha256 string"
METADATA = (
    "track string, container string, status string, reason string, track_id int, codec string, sample_rate int, channels int, bits int, frames long, duration double, bit_rate long,"
    " tags array<struct<key:string,value:string>>, pictures int"
)
_RAW = "track string, block long, start_frame long, frames long, channels int, bits int, encoding string, raw binary"


class TimedOut(Exception):
    """The time for one file is over."""


class Guard:
    """Time for one file, asked between pieces of work; the first failure is the one that is reported."""

    def __init__(self, seconds: float | None = None, clock=time.monotonic):
        self._clock, self._end = clock, None if seconds is None else clock() + seconds

    def check(self) -> None:
        if self._end is not None and self._clock() > self._end:
            raise TimedOut("time limit")

    def over(self, parts: Iterator) -> Iterator:
        for part in parts:
            self.check()
            yield part


def outcome(error: Exception) -> tuple[str, str]:
    """Status and reason of a file whose reading ended with this error."""
    if isinstance(error, TimedOut):
        return "timed_out", str(error)
    if isinstance(error, Unsupported):
        return "unsupported", str(error)
    return "failed", f"cut off: {error}" if isinstance(error, EOFError) else str(error)


_ERRORS = (TimedOut, EOFError, ValueError, struct.error, OverflowError)


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    bits: int
    encoding: str
    data_at: int
    data_bytes: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.data_bytes // self.frame_bytes


def container(head: Column) -> Column:
    """What a file is by its first bytes."""
    four = F.substring(head, 1, 4)
    return (
        F.when(four == F.lit(b"RIFF"), "riff").when(four == F.lit(b"fLaC"), "flac").when(F.substring(head, 5, 4) == F.lit(b"ftyp"), "mp4")
        .when(four.isin(F.lit(b"RF64"), F.lit(b"BW64"), F.lit(b"RIFX")), "riff64").otherwise("unknown")
    )


# Fixed value: the end of the format names that an extensible format chunk may have.
_GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")


def parse_header(data: bytes, size: int | None = None) -> Header:
    """Walk the chunks; geometry, bounds and alignment must be right. size: of the file whose first bytes these are; EOFError
    where the walk leaves them."""
    whole = len(data) if size is None else size
    if data[:4] in (b"RF64", b"BW64"):
        raise Unsupported("64-bit RIFF")
    if data[:4] == b"RIFX":
        raise Unsupported("big-endian RIFF")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise Unsupported("not a RIFF waveform")
    at, fmt, count = 12, None, 0
    while at + 8 <= whole:
        if at + 8 > len(data):
            raise EOFError("chunk header")
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at, count = at + 8, count + 1
        if count > MAX_CHUNKS:
            raise Unsupported("too many chunks")
        if at + size > whole:
            raise Unsupported("chunk beyond the end")
        if name == b"fmt " and at + size > len(data):
            raise EOFError("format chunk")
        if name == b"fmt ":
            if size < 16:
                raise Unsupported("short format chunk")
            tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", data, at)
            if tag == 0xFFFE:
                if size < 40 or data[at + 26 : at + 40] != _GUID_TAIL:
                    raise Unsupported("extensible format")
                valid, mask = struct.unpack_from("<HI", data, at + 18)
                if valid != bits or mask.bit_count() not in (0, channels):
                    raise Unsupported("valid bits or channel mask")
                tag = struct.unpack_from("<H", data, at + 24)[0]
            kinds = {(1, b): "int" for b in (8, 16, 24, 32)} | {(3, 32): "float", (3, 64): "float"}
            if (tag, bits) not in kinds:
                raise Unsupported("encoding")
            if not 1 <= channels <= 2 or not 8000 <= rate <= 384_000 or align != channels * bits // 8 or byte_rate != rate * align:
                raise Unsupported("geometry")
            fmt = (rate, channels, bits, kinds[tag, bits])
        elif name == b"data":
            if fmt is None:
                raise Unsupported("data before format")
            if size % (fmt[1] * fmt[2] // 8):
                raise Unsupported("partial frame")
            return Header(*fmt, at, size)
        at += size + size % 2
    raise Unsupported("no data chunk")


def words(raw: bytes, header: Header) -> np.ndarray:
    """Samples of shape frames x channels: whole numbers scaled so that full scale is 1, or floats as they are."""
    if header.encoding == "float":
        x = np.frombuffer(raw, f"<f{header.bits // 8}").astype(np.float64)
        if not np.isfinite(x).all() or (np.abs(x) > 16).any():
            raise Unsupported("float samples out of range")
    elif header.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif header.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{header.bits // 8}") / float(1 << (header.bits - 1))
    return x.reshape(-1, header.channels)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's own files with a known suffix, case ignored."""
    read = spark.read.format("binaryFile").load(folder)
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    return read.where(suffix.isin(*SUFFIXES))


def listing(spark: SparkSession, folder: str, expected: list[str] | None = None) -> DataFrame:
    """(path, length, status, reason) by file name: files that were found, expected names that were not, and one failed row for a folder
    that holds none. Contents aren't read."""
    found = files(spark, folder).select("path", "length", F.lit("found").alias("status"), F.lit(None).cast("string").alias("reason"))
    base = folder.rstrip("/")
    out = found
    if expected:
        names = spark.createDataFrame([(n,) for n in dict.fromkeys(expected)], "name string")
        missing = names.join(found.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_anti")
        out = out.unionByName(missing.select(F.concat(F.lit(f"{base}/"), "name").alias("path"), F.lit(None).cast("long").alias("length"), F.lit("failed").alias("status"), F.lit("not found").alias("reason")))
    none = out.agg(F.count("*").alias("n")).where("n = 0")
    empty = none.select(F.lit(base).alias("path"), F.lit(None).cast("long").alias("length"), F.lit("failed").alias("status"), F.lit("no supported files").alias("reason"))
    return out.unionByName(empty).orderBy(F.element_at(F.split("path", "/"), -1), "path")


def _described(path: str, kind: str, data: bytes, size: int | None) -> tuple:
    try:
        if kind == "flac":
            m = flac.scan(data, size)
            tags = [{"key": k, "value": v} for k, v in m.tags]
            return path, kind, "described", None, 0, "flac", m.rate, m.channels, m.bits, m.frames or None, m.frames / m.rate if m.frames and m.rate else None, None, tags, len(m.pictures)
        if kind == "mp4":
            t = mp4.scan(data, size)
            tags = [{"key": k, "value": v} for k, v in t.tags]
            return path, kind, "described", None, 0, "alac", t.rate, t.channels, t.bits, t.frames, t.frames / t.rate, t.bit_rate, tags, 0
        h = parse_header(data, size)
        return path, kind, "described", None, 0, f"pcm_{h.encoding}", h.rate, h.channels, h.bits, h.frames, h.frames / h.rate, 8 * h.rate * h.frame_bytes, [], 0
    except EOFError as e:
        if size is not None and size > len(data):
            raise
        return path, kind, *outcome(e), *[None] * 10
    except _ERRORS as e:
        return path, kind, *outcome(e), *[None] * 10


def metadata(found: DataFrame, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row for each file from its first bytes: geometry, declared length and tags, no sample is read. Files whose headers
    reach further (so few) are looked at whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, size, kind in zip(pdf["path"], pdf["head"], pdf["length"], pdf["kind"], strict=True):
                try:
                    rows.append(_described(path, kind, data, size))
                except EOFError:
                    rows.append((path, kind, "more", *[None] * 11))
            yield _typed(rows, METADATA)

    shape = lambda content: found.select("path", content.alias("head"), "length", container(F.col("content")).alias("kind"))
    first = shape(F.substring("content", 1, head_bytes)).mapInPandas(run, METADATA)
    again = first.where("status = 'more'").select(F.col("track").alias("path"))
    whole = found.join(F.broadcast(again), "path", "left_semi")
    rest = whole.select("path", F.col("content").alias("head"), "length", container(F.col("content")).alias("kind")).mapInPandas(run, METADATA)
    return first.where("status <> 'more'").unionByName(rest).orderBy("track")


def select_track(described: DataFrame, track_id: int) -> DataFrame:
    """The files' declared track of this number; a file without it is invalid."""
    absent = (F.col("status") == "described") & ~F.col("track_id").eqNullSafe(F.lit(track_id))
    return described.withColumn("reason", F.when(absent, "declared track absent").otherwise(F.col("reason"))).withColumn("status", F.when(absent, "invalid").otherwise(F.col("status")))


def _typed(rows: list[tuple], schema: str) -> pd.DataFrame:
    """A frame of these rows in which whole numbers may be null."""
    fields = re.findall(r"(\w+) (array<\S+>|\w+)", schema)
    kinds = {"int": "Int32", "long": "Int64"}
    return pd.DataFrame(rows, columns=[n for n, _ in fields]).astype({n: kinds[k] for n, k in fields if k in kinds})


def prefix_frames(rate: int, max_seconds: float | None) -> int | None:
    """Whole frames within the prefix; a prefix without any is no valid option."""
    if max_seconds is None:
        return None
    n = int(max_seconds * rate)
    if n < 1:
        raise ValueError("the prefix holds no frame")
    return n


def _pieces(data: bytes, kind: str, max_seconds: float | None, size: int) -> tuple[Header, Iterator[bytes]]:
    """A file's header and its sample bytes within the prefix, in pieces of at least size frames but the last; little-endian words
    of the header's width, FLAC's in 32-bit ones."""
    if kind == "flac":
        stream = flac.scan(data)
        if stream.channels > 2 or not 8000 <= stream.rate <= 384_000:
            raise Unsupported("geometry")
        h = Header(stream.rate, stream.channels, 32, "int", stream.audio_at, 4 * stream.channels * stream.frames)
        most = prefix_frames(h.rate, max_seconds)

        def parts() -> Iterator[bytes]:
            held, n, left = [], 0, most
            for x in flac.decode(data, stream):
                if left is not None:
                    x = x[:left]
                    left -= len(x)
                held.append(x)
                n += len(x)
                if n >= size or left == 0:
                    yield (np.concatenate(held) << (32 - stream.bits)).astype("<i4").tobytes()
                    held, n = [], 0
                if left == 0:
                    return
            if n:
                yield (np.concatenate(held) << (32 - stream.bits)).astype("<i4").tobytes()

        return h, parts()
    h = parse_header(data)
    most = prefix_frames(h.rate, max_seconds)
    n = h.frames if most is None else min(h.frames, most)
    step = size * h.frame_bytes
    end = h.data_at + n * h.frame_bytes
    return h, (data[a : min(a + step, end)] for a in range(h.data_at, end, step))


def headers(found: DataFrame, max_seconds: float | None = None, seconds: float | None = None) -> DataFrame:
    """One row for each file, by path, after reading all of its samples within the prefix: status analysed, unsupported, failed or
    timed_out (more than so many seconds), geometry, frames, digest of the samples' bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True):
                guard = Guard(seconds)
                try:
                    h, parts = _pieces(data, kind, max_seconds, BLOCK_FRAMES)
                    digest, n = hashlib.sha256(), 0
                    for raw in guard.over(parts):
                        digest.update(raw)
                        n += len(raw) // h.frame_bytes
                    bits = flac.scan(data).bits if kind == "flac" else h.bits
                    rows.append((path, kind, "analysed", None, h.rate, h.channels, bits, h.encoding, n, digest.hexdigest()))
                except _ERRORS as e:
                    rows.append((path, kind, *outcome(e), *[None] * 6))
            yield _typed(rows, HEADERS)

    return found.select("path", "content", container(F.col("content")).alias("kind")).mapInPandas(run, HEADERS).orderBy("track")


def blocks(found: DataFrame, max_seconds: float | None = None, block_frames: int = BLOCK_FRAMES, ahead: int = 0) -> DataFrame:
    """Sample blocks of every channel of the files that can be decoded, within the prefix. With ahead, the column after has the
    channel's next so many samples, as far as there are."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True):
                held, k = b"", 0
                try:
                    h, parts = _pieces(data, kind, max_seconds, block_frames)
                    size, more = block_frames * h.frame_bytes, ahead * h.frame_bytes
                    ended = False
                    while not ended or held:
                        while not ended and len(held) < size + more:
                            piece = next(parts, None)
                            ended = piece is None
                            held += piece or b""
                        if held:
                            raw, n = held[: size + more], min(len(held), size) // h.frame_bytes
                            yield pd.DataFrame([(path, k, k * block_frames, n, h.channels, h.bits, h.encoding, raw)], columns=[c.split()[0] for c in _RAW.split(", ")])
                            held, k = held[size:], k + 1
                except _ERRORS:
                    continue

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, k, start, n, channels, bits, encoding, raw in pdf.itertuples(index=False):
                try:
                    x = words(raw, Header(0, channels, bits, encoding, 0, 0))
                except Unsupported:
                    continue
                rows = [(path, c, k, start, x[:n, c], x[n:, c]) for c in range(channels)]
                yield pd.DataFrame([r if ahead else r[:5] for r in rows], columns=["track", "channel", "block", "start_frame", "samples"] + ["after"] * bool(ahead))

    raw = found.select("path", "content", container(F.col("content")).alias("kind")).mapInPandas(cut, _RAW)
    return raw.repartition("track", "block").mapInPandas(run, BLOCKS + (", after array<double>" if ahead else ""))


def samples(blocks_: DataFrame) -> DataFrame:
    """Long rows (track, channel, frame, sample) of blocks."""
    return blocks_.select("track", "channel", "start_frame", F.posexplode("samples").alias("i", "sample")).select("track", "channel", (F.col("start_frame") + F.col("i")).alias("frame"), "sample")


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit waveform file of frames x channels samples, for fixtures and exports."""
    pcm = np.clip(np.round(np.atleast_2d(x.T).T * 32767), -32768, 32767).astype("<i2")
    n = pcm.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + pcm.nbytes, b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", pcm.nbytes)
    return head + pcm.tobytes()
