"""MP4 files with one lossless (ALAC) track: boxes, and the sample tables checked against the media's extents.

Only the movie box is interpreted; media bytes are never read, so the tables' checks are those of a header scan. The
tables come out as numpy arrays, and the checks on them are whole-array conditions.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from resonant.sources.errors import Unsupported

MAX_BOXES = 4096
MAX_MOVIE = 16 << 20
MAX_SAMPLES = 4_000_000
MAX_PACKET = 1 << 20
_MONO, _STEREO = 0x640001, 0x650002
_TABLES = {b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss", b"ctts", b"sdtp"}


@dataclass
class Track:
    rate: int
    channels: int
    bits: int
    frames: int
    packets: int
    chunks: int
    block: int
    bit_rate: int | None
    tags: list[tuple[str, str]]


@dataclass(frozen=True)
class Box:
    kind: bytes
    data: bytes


def top_level(data: bytes, size: int | None = None) -> list[tuple[bytes, int, int]]:
    """(kind, first byte, end) of each box's content; EOFError where these first bytes of a file of that size don't reach."""
    size, at, out = len(data) if size is None else size, 0, []
    while at < size:
        if at + 16 > len(data) and at + 16 <= size or at + 8 > len(data):
            raise EOFError("box header")
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            if at + 16 > len(data):
                raise ValueError("box header")
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif n == 0:
            n = size - at
        if n < head or at + n > size:
            raise ValueError("box beyond the end or smaller than its header")
        out.append((kind, at + head, at + n))
        if len(out) > MAX_BOXES:
            raise Unsupported("too many boxes")
        at += n
    return out


class _Reader:
    def __init__(self) -> None:
        self.count = 0

    def boxes(self, data: bytes) -> list[Box]:
        out, at = [], 0
        while at < len(data):
            if at + 8 > len(data):
                raise ValueError("box header")
            n, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if n == 1:
                n, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            elif n == 0:
                n = len(data) - at
            if n < head or at + n > len(data):
                raise ValueError("box beyond its parent")
            out.append(Box(kind, data[at + head : at + n]))
            at += n
            self.count += 1
            if self.count > MAX_BOXES:
                raise Unsupported("too many boxes")
        return out

    def down(self, boxes: list[Box], *path: bytes) -> list[Box]:
        for kind in path:
            boxes = self.boxes(one(boxes, kind).data)
        return boxes


def one(boxes: list[Box], kind: bytes) -> Box:
    found = [b for b in boxes if b.kind == kind]
    if len(found) != 1:
        raise ValueError(f"exactly one {kind.decode('latin-1')} box is required")
    return found[0]


def _plain(box: Box) -> bytes:
    """The content of a box of version 0 without flags, after those."""
    if box.data[:4] != bytes(4):
        raise Unsupported("box version or flags")
    return box.data[4:]


def _table(box: Box, fields: int, kind: str = ">u4") -> np.ndarray:
    body = _plain(box)
    n = int.from_bytes(body[:4], "big") if len(body) >= 4 else -1
    if len(body) - 4 != n * fields * int(kind[-1]) or not n:
        raise ValueError("table length")
    return np.frombuffer(body, kind, offset=4).reshape(n, fields).astype(np.int64)


def _identity_edit(box: Box) -> bool:
    d = box.data
    if d[:4] == bytes(4):
        return len(d) == 20 and struct.unpack(">I", d[4:8]) + struct.unpack(">iI", d[12:]) == (1, 0, 65536)
    return d[:4] == b"\1\0\0\0" and len(d) == 28 and struct.unpack(">I", d[4:8]) + struct.unpack(">qI", d[16:]) == (1, 0, 65536)


def _description(entry: Box, reader: _Reader) -> tuple[int, int, int, int, int | None]:
    """Rate, channels, bits, block length and bit rate of the codec's own record, checked against the general one."""
    d = entry.data
    if entry.kind != b"alac":
        raise Unsupported("the codec is not ALAC")
    if len(d) < 28:
        raise ValueError("short sample entry")
    version = int.from_bytes(d[8:10], "big")
    if d[6:8] != b"\0\1" or version > 1:
        raise Unsupported("sample entry version or data reference")
    extra = reader.boxes(d[28 if version == 0 else 44 :])
    if any(b.kind == b"sinf" for b in extra):
        raise Unsupported("encrypted track")
    if any(b.kind not in (b"alac", b"btrt", b"chan") or (b.kind == b"btrt" and len(b.data) != 12) for b in extra):
        raise Unsupported("codec configuration")
    cookie = _plain(one(extra, b"alac"))
    if len(cookie) not in (24, 48):
        raise ValueError("codec record length")
    block, version, bits, _, _, _, channels, _, most, bit_rate, rate = struct.unpack(">IBBBBBBHIII", cookie[:24])
    if version or bits not in (16, 24) or channels not in (1, 2) or not 8000 <= rate <= 384_000:
        raise Unsupported("precision, channels or rate")
    if not 1 <= block <= 65_536 or most > MAX_PACKET:
        raise Unsupported("block or packet length")
    layout = _MONO if channels == 1 else _STEREO
    given = [_plain(b) for b in extra if b.kind == b"chan"] + ([cookie[32:]] if len(cookie) == 48 else [])
    if len(cookie) == 48 and cookie[24:32] != struct.pack(">I4s", 24, b"chan") or any(len(g) < 12 or g[-12:] != struct.pack(">IQ", layout, 0) for g in given):
        raise Unsupported("channel layout")
    if int.from_bytes(d[16:18], "big") != channels or int.from_bytes(d[18:20], "big") not in (bits, 16):
        raise ValueError("sample entry and codec record disagree")
    return rate, channels, bits, block, bit_rate or None


def check_tables(tables: list[Box], block: int, frames: int, media: list[tuple[int, int]]) -> tuple[int, int]:
    """Packets and chunks; raises unless counts, times and extents of the sample tables agree with each other and the media."""
    sizes = _plain(one(tables, b"stsz"))
    fixed, packets = struct.unpack(">II", sizes[:8]) if len(sizes) >= 8 else (0, 0)
    if not 1 <= packets <= MAX_SAMPLES:
        raise Unsupported("number of packets")
    if len(sizes) != 8 + (0 if fixed else 4 * packets):
        raise ValueError("packet sizes")
    size = np.full(packets, fixed, np.int64) if fixed else np.frombuffer(sizes, ">u4", offset=8).astype(np.int64)
    if size.min() < 1 or size.max() > MAX_PACKET:
        raise Unsupported("packet size")
    held = {b.kind for b in tables}
    if b"sdtp" in held:
        depends = _plain(one(tables, b"sdtp"))
        if len(depends) != packets:
            raise ValueError("packet dependencies")
        if any(depends):
            raise Unsupported("packet dependencies")
    count, delta = _table(one(tables, b"stts"), 2).T
    if (count < 1).any() or (delta < 1).any() or (delta > block).any() or count.sum() != packets or (count * delta).sum() != frames:
        raise ValueError("packet times")
    if b"stss" in held:
        sync = _table(one(tables, b"stss"), 1).ravel()
        if sync[0] < 1 or (np.diff(sync) < 1).any() or sync[-1] > packets:
            raise ValueError("sync packets")
    if b"ctts" in held:
        count, shift = _table(one(tables, b"ctts"), 2).T
        if (count < 1).any() or shift.any():
            raise Unsupported("composition offsets")
        if count.sum() != packets:
            raise ValueError("composition offsets")
    if (b"stco" in held) == (b"co64" in held):
        raise ValueError("exactly one table of chunk offsets is required")
    offset = _table(one(tables, b"stco"), 1).ravel() if b"stco" in held else _table(one(tables, b"co64"), 1, ">u8").ravel()
    first, per, entry = _table(one(tables, b"stsc"), 3).T
    if first[0] != 1 or (np.diff(first) < 1).any() or first[-1] > len(offset) or (per < 1).any() or (entry != 1).any():
        raise ValueError("packets to chunks")
    in_chunk = np.repeat(per, np.diff(np.append(first, len(offset) + 1)))
    if in_chunk.sum() != packets:
        raise ValueError("chunk and packet counts")
    ends = np.cumsum(in_chunk)
    total = np.concatenate([[0], np.cumsum(size)])
    end = offset + total[ends] - total[ends - in_chunk]
    inside = np.zeros(len(offset), bool)
    for a, b in media:
        inside |= (offset >= a) & (end <= b)
    if not inside.all() or (offset[1:] < end[:-1]).any() or (offset < 0).any():
        raise ValueError("chunk overlaps another or leaves the media")
    return packets, len(offset)


def _tags(movie: list[Box], reader: _Reader) -> list[tuple[str, str]]:
    """Text of the item list, by item name; other data is left out."""
    out = []
    try:
        meta = one(reader.down(movie, b"udta"), b"meta").data
        items = reader.boxes(one(reader.boxes(meta[4:]), b"ilst").data)
    except ValueError:
        return out
    for item in items:
        parts = reader.boxes(item.data)
        name = b"----:" + b":".join(b.data[4:] for b in parts if b.kind in (b"mean", b"name")) if item.kind == b"----" else item.kind
        out += [(name.decode("latin-1"), b.data[8:].decode("utf-8", "replace")) for b in parts if b.kind == b"data" and b.data[:4] == b"\0\0\0\1"]
    return out


def scan(data: bytes, size: int | None = None) -> Track:
    """The one track of a file whose bytes, or first bytes with the whole movie box among them, these are."""
    found = top_level(data, size)
    kinds = [k for k, _, _ in found]
    if not kinds or kinds[0] != b"ftyp" or kinds.count(b"ftyp") != 1 or not 8 <= found[0][2] - found[0][1] <= 1024 or (found[0][2] - found[0][1]) % 4:
        raise ValueError("file type box")
    if {b"moof", b"mfra", b"sidx"} & set(kinds):
        raise Unsupported("fragmented file")
    if set(kinds) - {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"}:
        raise Unsupported("top-level box")
    if kinds.count(b"moov") != 1 or b"mdat" not in kinds:
        raise ValueError("one movie box and media are required")
    _, a, b = found[kinds.index(b"moov")]
    if b - a > MAX_MOVIE:
        raise Unsupported("movie box too large")
    if b > len(data):
        raise EOFError("movie box")
    reader = _Reader()
    movie = reader.boxes(data[a:b])
    if any(x.kind == b"mvex" for x in movie):
        raise Unsupported("fragmented file")
    if sum(x.kind == b"trak" for x in movie) != 1:
        raise Unsupported("one track is required")
    track = reader.down(movie, b"trak")
    media = reader.down(track, b"mdia")
    if one(media, b"hdlr").data[8:12] != b"soun":
        raise Unsupported("the track is not audio")
    head = one(media, b"mdhd").data
    if head[:4] == bytes(4) and len(head) >= 20:
        scale, frames = struct.unpack(">II", head[12:20])
    elif head[:4] == b"\1\0\0\0" and len(head) >= 32:
        scale, frames = struct.unpack(">IQ", head[20:32])
    else:
        raise Unsupported("media header")
    info = reader.down(media, b"minf")
    references = _plain(one(reader.down(info, b"dinf"), b"dref"))
    if references[:4] != b"\0\0\0\1" or [(b.kind, b.data) for b in reader.boxes(references[4:])] != [(b"url ", b"\0\0\0\1")]:
        raise Unsupported("external data")
    tables = reader.down(info, b"stbl")
    entries = _plain(one(tables, b"stsd"))
    described = reader.boxes(entries[4:])
    if entries[:4] != b"\0\0\0\1" or len(described) != 1:
        raise Unsupported("one sample description is required")
    rate, channels, bits, block, bit_rate = _description(described[0], reader)
    if {b.kind for b in tables} - _TABLES:
        raise Unsupported("sample table")
    if any(x.kind == b"edts" for x in track) and not _identity_edit(one(reader.down(track, b"edts"), b"elst")):
        raise Unsupported("edit list")
    if scale != rate:
        raise Unsupported("media time scale")
    if not frames:
        raise ValueError("no frames")
    packets, chunks = check_tables(tables, block, frames, [(x, y) for k, x, y in found if k == b"mdat"])
    return Track(rate, channels, bits, frames, packets, chunks, block, bit_rate, _tags(movie, reader))
