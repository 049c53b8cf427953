"""Small encoders for tests: FLAC streams and MP4 files, written plainly from their public formats."""

import hashlib
import struct

import numpy as np


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def signed(self, value, n):
        self.put(value & ((1 << n) - 1), n)

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))


def crc(data, width, poly):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return c


def rice(w, residual, k, parts=1, samples=None, order=0, wide=False, escape=False):
    w.put(int(wide), 2)
    w.put(parts.bit_length() - 1, 4)
    at, size = 0, (samples or len(residual) + order) // parts
    for p in range(parts):
        n = size - (order if p == 0 else 0)
        part = residual[at : at + n]
        at += n
        if escape:
            w.put(31 if wide else 15, 5 if wide else 4)
            w.put(20, 5)
            for v in part:
                w.signed(int(v), 20)
            continue
        w.put(k, 5 if wide else 4)
        for v in part:
            u = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
            w.put(0, u >> k)
            w.put(1, 1)
            w.put(u & ((1 << k) - 1), k)


def subframe(w, x, bits, kind, wasted=0, **kw):
    x = [int(v) >> wasted for v in x]
    bits -= wasted
    code = {"constant": 0, "verbatim": 1}.get(kind[0], 8 + kind[1] if kind[0] == "fixed" else 31 + len(kind[1]) if kind[0] == "lpc" else 0)
    w.put(code << 1 | (wasted > 0), 8)
    if wasted:
        w.put(1, wasted)
    if kind[0] == "constant":
        w.signed(x[0], bits)
    elif kind[0] == "verbatim":
        for v in x:
            w.signed(v, bits)
    elif kind[0] == "fixed":
        order = kind[1]
        for v in x[:order]:
            w.signed(v, bits)
        rice(w, np.diff(np.array(x, np.int64), order), kw.get("k", 4), kw.get("parts", 1), len(x), order, kw.get("wide", False), kw.get("escape", False))
    else:
        coefficients, shift = kind[1], kind[2]
        order = len(coefficients)
        for v in x[:order]:
            w.signed(v, bits)
        w.put(11, 4)
        w.signed(shift, 5)
        for c in coefficients:
            w.signed(c, 12)
        residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(order, len(x))]
        rice(w, residual, kw.get("k", 6), kw.get("parts", 1), len(x), order, kw.get("wide", False))


def coded_number(n):
    if n < 128:
        return bytes([n])
    many = 2
    while n >= 1 << (5 * many + 1):
        many += 1
    tail = [0x80 | (n >> (6 * i) & 63) for i in range(many - 1)][::-1]
    return bytes([(0xFF << (8 - many) & 0xFF) | n >> (6 * (many - 1)), *tail])


def flac(x, rate=48_000, bits=16, block=256, kinds=(("fixed", 2),), assignment=None, wasted=0, tags=(), md5=True, blocks=(), **kw):
    """x: samples x channels. kinds go round the subframes."""
    channels = x.shape[1]
    out, turn = b"", 0
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block].astype(np.int64)
        mode = assignment if assignment is not None else channels - 1
        lanes = [part[:, c] for c in range(channels)]
        if mode >= 8:
            left, right = lanes
            side = left - right
            lanes = [left, side] if mode == 8 else [side, right] if mode == 9 else [(left + right) >> 1, side]
        head = bytes([0xFF, 0xF8, 7 << 4, mode << 4]) + coded_number(number) + struct.pack(">H", len(part) - 1)
        head += bytes([crc(head, 8, 0x07)])
        w = Writer()
        for c, lane in enumerate(lanes):
            extra = (mode, c) in ((8, 1), (9, 0), (10, 1))
            subframe(w, lane, bits + extra, kinds[turn % len(kinds)], wasted, **kw)
            turn += 1
        frame = head + w.bytes()
        out += frame + struct.pack(">H", crc(frame, 16, 0x8005))
    digest = hashlib.md5(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()).digest() if md5 else bytes(16)
    info = struct.pack(">HH", min(block, 65535), block) + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(x)).to_bytes(8, "big") + digest
    text = struct.pack("<I", 4) + b"test" + struct.pack("<I", len(tags))
    for k, v in tags:
        raw = f"{k}={v}".encode()
        text += struct.pack("<I", len(raw)) + raw
    rows = [(0, info), *blocks, (4, text)]
    meta = b"".join(bytes([kind | (128 if i == len(rows) - 1 else 0)]) + len(d).to_bytes(3, "big") + d for i, (kind, d) in enumerate(rows))
    return b"fLaC" + meta + out


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def m4a(rate=44_100, bits=16, channels=2, sizes=(100, 120, 80), block=4096, last=1000, per=2, codec=b"alac", extra=(), tables=(), edit=None, gap=0, media_first=False, tags=(), top=()):
    """One ALAC track with packets of these sizes, per packets a chunk."""
    frames = block * (len(sizes) - 1) + last
    layout = 0x640001 if channels == 1 else 0x650002
    cookie = struct.pack(">IBBBBBBHIII", block, 0, bits, 40, 10, 14, channels, 255, 0, 700_000, rate)
    entry = bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", channels, 16, 0, 0, (rate & 0xFFFF) << 16) + box(b"alac", bytes(4), cookie) + box(b"chan", bytes(4), u32(layout, 0, 0)) + b"".join(extra)
    chunks = -(-len(sizes) // per)
    maps = [(1, per, 1)] + ([(chunks, len(sizes) % per, 1)] if len(sizes) % per else [])
    if chunks == 1 and len(maps) > 1:
        maps = maps[1:]

    def movie(media_at):
        at, offsets = media_at, []
        for c in range(chunks):
            offsets.append(at)
            at += sum(sizes[c * per : (c + 1) * per]) + gap
        stbl = box(
            b"stbl", box(b"stsd", bytes(4), u32(1), box(codec, entry)), box(b"stts", bytes(4), u32(2 if len(sizes) > 1 else 1), *([u32(len(sizes) - 1, block)] if len(sizes) > 1 else []), u32(1, last)),
            box(b"stsc", bytes(4), u32(len(maps)), *[u32(*m) for m in maps]), box(b"stsz", bytes(4), u32(0, len(sizes)), u32(*sizes)), box(b"stco", bytes(4), u32(chunks), u32(*offsets)), *tables,
        )
        minf = box(b"minf", box(b"dinf", box(b"dref", bytes(4), u32(1), box(b"url ", u32(1)))), stbl)
        mdia = box(b"mdia", box(b"mdhd", bytes(4), u32(0, 0, rate, frames), bytes(4)), box(b"hdlr", bytes(8), b"soun", bytes(13)), minf)
        edts = [box(b"edts", box(b"elst", bytes(4), u32(1, frames, *edit)))] if edit else []
        items = box(b"ilst", *[box(k, box(b"data", u32(1, 0), v.encode())) for k, v in tags])
        return box(b"moov", box(b"trak", *edts, mdia), box(b"udta", box(b"meta", bytes(4), items)))

    head = box(b"ftyp", b"M4A ", u32(0), b"M4A ") + b"".join(top)
    data = box(b"mdat", bytes(sum(sizes) + gap * chunks))
    if media_first:
        return head + data + movie(len(head) + 8)
    return head + movie(len(head) + len(movie(0)) + 8) + data
