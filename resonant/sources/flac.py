"""FLAC streams by their public format: metadata blocks, frame layout, and the samples themselves.

Metadata is read from the first bytes alone. Frames are walked bit by bit where that can't be avoided (the places of the
Rice codes); everything else, the quotients and remainders, the predictors and the checksums, is done with numpy for
many codes or many subframes at once. A frame's header and body carry checksums and the stream an MD5 of its samples;
all of them are verified.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from resonant.sources.errors import Unsupported

MAX_BLOCKS = 1024
MAX_RECORDS = 65_536
MAX_METADATA = 64 << 20
MAX_FRAME = 16 << 20


@dataclass
class Stream:
    """STREAMINFO, tags in order, the other blocks, and where the frames begin."""

    rate: int
    channels: int
    bits: int
    frames: int
    md5: bytes
    least_block: int
    most_block: int
    most_bytes: int
    vendor: str | None = None
    tags: list[tuple[str, str]] = field(default_factory=list)
    pictures: list[tuple[int, str, int]] = field(default_factory=list)
    seek_points: int = 0
    cue_tracks: int = 0
    opaque: list[tuple[int, int]] = field(default_factory=list)
    audio_at: int = 0


class _Fields:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("field beyond its block")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, order: str) -> int:
        return int.from_bytes(self.take(4), order)


def _picture(data: bytes) -> tuple[int, str, int]:
    """Kind, media type and bytes of a picture."""
    f = _Fields(data)
    kind = f.number("big")
    media = f.take(f.number("big")).decode("ascii", "replace")
    f.take(f.number("big"))
    f.take(16)
    size = f.number("big")
    f.take(size)
    if f.at != len(data):
        raise ValueError("picture length")
    return kind, media, size


def _comments(data: bytes, out: Stream) -> int:
    f = _Fields(data)
    out.vendor = f.take(f.number("little")).decode("utf-8", "replace")
    count = f.number("little")
    if count > (len(data) - f.at) // 4:
        raise ValueError("comment count exceeds block")
    for _ in range(count):
        key, _, value = f.take(f.number("little")).decode("utf-8", "replace").partition("=")
        if key.lower() == "metadata_block_picture":
            try:
                out.pictures.append(_picture(base64.b64decode(value, validate=True)))
            except binascii.Error as e:
                raise ValueError("picture text") from e
        out.tags.append((key, value))
    return count


def _cues(data: bytes) -> tuple[int, int]:
    """Tracks, and records in all."""
    f = _Fields(data)
    f.take(395)
    tracks = f.take(1)[0]
    records = tracks
    for _ in range(tracks):
        f.take(35)
        points = f.take(1)[0]
        f.take(12 * points)
        records += points
    return tracks, records


def scan(data: bytes, size: int | None = None) -> Stream:
    """The metadata of a stream whose first bytes these are; EOFError where they end before the metadata does.

    size: of the whole file, if these are its first bytes only."""
    if data[:4] != b"fLaC":
        raise Unsupported("not a FLAC stream")
    at, records, out = 4, 0, None
    for index in range(MAX_BLOCKS):
        if at + 4 > len(data):
            raise EOFError("metadata header")
        kind, n, last = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big"), data[at] >> 7
        at += 4
        if at + n > (size if size is not None else len(data)) or at + n > MAX_METADATA:
            raise ValueError("metadata block beyond the end")
        if (index == 0) != (kind == 0) or (kind == 0 and n != 34):
            raise ValueError("one leading stream description of 34 bytes is required")
        if at + n > len(data):
            raise EOFError("metadata block")
        body = data[at : at + n]
        if kind == 0:
            least, most = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            out = Stream(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:], least, most, int.from_bytes(body[7:10], "big"))
        elif kind == 2 and n < 4:
            raise ValueError("short application block")
        elif kind == 3:
            if n % 18:
                raise ValueError("seek table length")
            out.seek_points += n // 18
            records += n // 18
        elif kind == 4:
            records += _comments(body, out)
        elif kind == 5:
            tracks, more = _cues(body)
            out.cue_tracks += tracks
            records += more
        elif kind == 6:
            out.pictures.append(_picture(body))
        elif kind == 127:
            raise ValueError("reserved metadata kind")
        elif kind != 1:
            out.opaque.append((kind, n))
        if records > MAX_RECORDS:
            raise Unsupported("too many metadata records")
        at += n
        if last:
            out.audio_at = at
            return out
    raise Unsupported("too many metadata blocks")


# --- checksums ------------------------------------------------------------------------------------------------------


def _crc_table(width: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07).tolist(), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(frames: list[bytes]) -> np.ndarray:
    """Checksums of many frames in step: zeros before a frame leave its checksum as it is, so all end at one place."""
    longest = max(map(len, frames), default=0)
    data = np.zeros((len(frames), longest), np.uint8)
    for k, f in enumerate(frames):
        data[k, longest - len(f) :] = np.frombuffer(f, np.uint8)
    crc = np.zeros(len(frames), np.int64)
    for column in data.T:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ column]
    return crc


# --- frames ---------------------------------------------------------------------------------------------------------


@dataclass
class Subframe:
    """What a subframe says before its samples are rebuilt: samples = residual + prediction, shifted left by wasted bits."""

    kind: str
    wasted: int
    start: np.ndarray
    residual: np.ndarray
    coefficients: np.ndarray
    shift: int = 0


@dataclass
class Frame:
    number: int
    by_sample: bool
    assignment: int
    samples: int
    rate: int
    at: int
    end: int
    subframes: list[Subframe]


class _Bits:
    """Bits of one frame's body: single fields by Python's integers, runs of fields by numpy."""

    def __init__(self, data: bytes):
        self.data = data
        self.n = 8 * len(data)
        self.at = 0
        self._bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.where(self._bits, np.arange(self.n), self.n)
        self._next = np.minimum.accumulate(ones[::-1])[::-1]
        self._next_list: list[int] | None = None
        self._words = np.frombuffer(data + bytes(16), np.uint8)

    def _need(self, n: int) -> None:
        if self.at + n > self.n:
            raise EOFError("subframe beyond the frame")

    def take(self, n: int) -> int:
        self._need(n)
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        self._need(1)
        q = int(self._next[self.at])
        if q >= self.n:
            raise EOFError("unary run beyond the frame")
        zeros, self.at = q - self.at, q + 1
        return zeros

    def fields(self, places: np.ndarray, width: int) -> np.ndarray:
        """Unsigned fields of up to 57 bits at these places."""
        if not width:
            return np.zeros(len(places), np.int64)
        byte = places >> 3
        word = np.zeros(len(places), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | self._words[byte + k].astype(np.uint64)
        left = word << (places & 7).astype(np.uint64)
        return (left >> np.uint64(64 - width)).astype(np.int64)

    def signed_run(self, count: int, width: int) -> np.ndarray:
        self._need(count * width)
        v = self.fields(self.at + width * np.arange(count), width)
        self.at += count * width
        return v - ((v >> max(width - 1, 0)) << width) if width else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """Signed Rice codes: the places of the stops one after the other, the rest at once."""
        if self._next_list is None:
            self._next_list = self._next.tolist()
        nxt, at, n, stops = self._next_list, self.at, self.n, []
        for _ in range(count):
            if at >= n:
                raise EOFError("code beyond the frame")
            q = nxt[at]
            stops.append(q)
            at = q + 1 + k
        if at > n or (stops and stops[-1] >= n):
            raise EOFError("code beyond the frame")
        q = np.array(stops, np.int64)
        starts = np.concatenate([[self.at], q[:-1] + 1 + k]) if count else q
        folded = (q - starts << k) | self.fields(q + 1, k)
        self.at = at
        return (folded >> 1) ^ -(folded & 1)


def _residual(bits: _Bits, samples: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise ValueError("reserved residual coding")
    width = 4 + method
    parts = 1 << bits.take(4)
    if samples % parts or samples // parts <= order and parts > 1 or samples // parts < order:
        raise ValueError("residual partitions")
    out = []
    for p in range(parts):
        count = samples // parts - (order if p == 0 else 0)
        k = bits.take(width)
        out.append(bits.signed_run(count, bits.take(5)) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Bits, samples: int, precision: int) -> Subframe:
    head = bits.take(8)
    if head & 128:
        raise ValueError("reserved subframe bit")
    wasted = bits.unary() + 1 if head & 1 else 0
    if wasted >= precision:
        raise ValueError("wasted bits exhaust the precision")
    precision -= wasted
    kind, none = head >> 1, np.zeros(0, np.int64)
    if kind == 0:
        return Subframe("constant", wasted, np.full(samples, bits.signed(precision), np.int64), none, none)
    if kind == 1:
        return Subframe("verbatim", wasted, bits.signed_run(samples, precision), none, none)
    if 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > samples:
            raise ValueError("predictor exceeds the block")
        start = bits.signed_run(order, precision)
        if kind < 32:
            return Subframe("fixed", wasted, start, _residual(bits, samples, order), np.array(_FIXED[order], np.int64))
        width = bits.take(4) + 1
        shift = bits.signed(5)
        if width == 16 or shift < 0:
            raise ValueError("reserved predictor")
        coefficients = bits.signed_run(order, width)
        return Subframe("lpc", wasted, start, _residual(bits, samples, order), coefficients, shift)
    raise ValueError("reserved subframe kind")


_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def read_frame(data: bytes, at: int, stream: Stream) -> Frame:
    """The frame that begins here, whole: header, subframes, zero padding. Checksums of bodies are checked by decode()."""
    if len(data) - at < 10:
        raise EOFError("frame header")
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should begin")
    ones = next((k for k in range(8) if not data[at + 4] >> (7 - k) & 1), 8)
    if ones in (1, 8):
        raise ValueError("coded number")
    many = max(ones, 1)
    number = data[at + 4] & (0x7F >> ones)
    for b in data[at + 5 : at + 4 + many]:
        if b >> 6 != 2:
            raise ValueError("coded number")
        number = number << 6 | b & 63
    p, size_code, rate_code = at + 4 + many, data[at + 2] >> 4, data[at + 2] & 15
    samples, rate = _SIZES.get(size_code), _RATES.get(rate_code, stream.rate)
    if size_code in (6, 7):
        samples = int.from_bytes(data[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    if rate_code in (12, 13, 14):
        n = 1 if rate_code == 12 else 2
        rate = int.from_bytes(data[p : p + n], "big") * (1000, 1, 10)[rate_code - 12]
        p += n
    if samples is None or rate_code == 15:
        raise ValueError("reserved block size or rate")
    assignment, bits_code = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if assignment > 10 or data[at + 3] & 1:
        raise ValueError("reserved channel assignment")
    if (assignment + 1 if assignment < 8 else 2) != stream.channels:
        raise ValueError("channel assignment changed")
    if (bits_code and _BITS.get(bits_code) != stream.bits) or bits_code == 3:
        raise ValueError("sample precision changed")
    if rate != stream.rate:
        raise ValueError("sample rate changed")
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise ValueError("header checksum")
    body = p + 1
    room = samples * stream.channels * (stream.bits + 1) // 8 + 4096
    while True:
        bits = _Bits(data[body : min(body + room, len(data))])
        try:
            subframes = [_subframe(bits, samples, stream.bits + ((assignment, c) in ((8, 1), (10, 1), (9, 0)))) for c in range(stream.channels)]
            break
        except EOFError:
            if body + room >= len(data) or room > MAX_FRAME:
                raise
            room *= 4
    padding = -bits.at % 8
    if bits.take(padding):
        raise ValueError("frame padding")
    end = body + bits.at // 8 + 2
    if end > len(data):
        raise EOFError("frame checksum")
    return Frame(number, bool(data[at + 1] & 1), assignment, samples, rate, at, end, subframes)


def _rebuild(subframes: list[Subframe]) -> list[np.ndarray]:
    """Samples of many subframes; those with predictors of one length are run in step."""
    out: list[np.ndarray | None] = [None] * len(subframes)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(subframes):
        if s.kind in ("constant", "verbatim"):
            out[k] = s.start
        elif s.kind == "fixed":
            # the order-th differences are the residual: sum them up again, order times
            order, x = len(s.start), s.residual
            for d in range(order - 1, -1, -1):
                x = np.concatenate([np.diff(s.start, d)[-1:], x])
                x = np.cumsum(x)[1:]
            out[k] = np.concatenate([s.start, x])
        else:
            alike.setdefault((len(s.start), len(s.residual)), []).append(k)
    for (order, n), own in alike.items():
        x = np.zeros((order + n, len(own)), np.int64)
        x[:order] = np.array([subframes[k].start for k in own]).T
        residual = np.array([subframes[k].residual for k in own]).reshape(len(own), n).T
        weights = np.array([subframes[k].coefficients[::-1] for k in own]).T
        shift = np.array([subframes[k].shift for k in own])
        for i in range(n):
            x[order + i] = residual[i] + ((x[i : i + order] * weights).sum(axis=0) >> shift)
        for j, k in enumerate(own):
            out[k] = x[:, j]
    return [x << s.wasted if s.wasted else x for x, s in zip(out, subframes, strict=True)]


def _together(frame: Frame, parts: list[np.ndarray]) -> np.ndarray:
    """Channels of a frame, samples x channels."""
    if frame.assignment < 8:
        return np.stack(parts, axis=1)
    a, b = parts
    if frame.assignment == 8:
        return np.stack([a, a - b], axis=1)
    if frame.assignment == 9:
        return np.stack([a + b, b], axis=1)
    mid = (a << 1) | (b & 1)
    return np.stack([mid + b >> 1, mid - b >> 1], axis=1)


def frames(data: bytes, stream: Stream) -> Iterator[Frame]:
    """All frames in order, which must follow one another without a gap or a rest."""
    at, sample, count = stream.audio_at, 0, 0
    while at < len(data):
        frame = read_frame(data, at, stream)
        if frame.number != (sample if frame.by_sample else count):
            raise ValueError("frames out of order")
        if frame.samples > stream.most_block or (frame.samples < stream.least_block and frame.end < len(data)):
            raise ValueError("block size out of the declared bounds")
        sample, count, at = sample + frame.samples, count + 1, frame.end
        yield frame


def decode(data: bytes, stream: Stream, group: int = 64) -> Iterator[np.ndarray]:
    """Whole-number samples in runs of frames, samples x channels. Every frame's checksum, the number of samples and, where the
    stream has one, their MD5 must be right; that is known only at the end."""
    digest, total = hashlib.md5(), 0
    for run in _runs(frames(data, stream), group):
        given = np.array([int.from_bytes(data[f.end - 2 : f.end], "big") for f in run])
        if (crc16([data[f.at : f.end - 2] for f in run]) != given).any():
            raise ValueError("frame checksum")
        parts = _rebuild([s for f in run for s in f.subframes])
        c = stream.channels
        x = np.concatenate([_together(f, parts[c * k : c * k + c]) for k, f in enumerate(run)])
        if ((x < -(1 << (stream.bits - 1))) | (x >= 1 << (stream.bits - 1))).any():
            raise ValueError("sample out of range")
        total += len(x)
        if any(stream.md5):
            width = (stream.bits + 7) // 8
            digest.update(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        yield x
    if stream.frames and total != stream.frames:
        raise ValueError("number of samples")
    if any(stream.md5) and digest.digest() != stream.md5:
        raise ValueError("digest of the samples")


def _runs(found: Iterator[Frame], group: int) -> Iterator[list[Frame]]:
    run: list[Frame] = []
    for f in found:
        run.append(f)
        if len(run) == group:
            yield run
            run = []
    if run:
        yield run
