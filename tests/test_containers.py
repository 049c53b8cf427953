"""FLAC and MP4 read back from test encoders: samples, metadata, and what must be refused."""

import struct

import numpy as np
import pytest

from resonant.sources import flac, mp4
from resonant.sources.errors import Unsupported
from tests import encoders as E

RNG = np.random.default_rng(8)


def wave(n, channels, amplitude=9000):
    t = np.arange(n)
    x = np.stack([amplitude * np.sin(t / (7 + 3 * c)) + RNG.normal(0, 40, n) for c in range(channels)], axis=1)
    return np.round(x).astype(np.int64)


def decoded(data, group=64):
    return np.concatenate([*flac.decode(data, flac.scan(data), group)])


LPC = ("lpc", (1800, -900, 100), 10)
CASES = {
    "fixed 0 to 4": (wave(1300, 1), {"kinds": [("fixed", k) for k in range(5)]}),
    "verbatim": (wave(300, 2), {"kinds": [("verbatim",)]}),
    "constant": (np.full((600, 2), -77), {"kinds": [("constant",)]}),
    "lpc": (wave(2000, 2), {"kinds": [LPC, ("lpc", (1023,), 9)], "block": 512}),
    "left and side": (wave(900, 2), {"assignment": 8}),
    "right and side": (wave(900, 2), {"assignment": 9, "kinds": [LPC]}),
    "mid and side": (wave(900, 2), {"assignment": 10, "kinds": [("fixed", 1), LPC]}),
    "partitions": (wave(1024, 1), {"parts": 8, "k": 9, "wide": True}),
    "escaped": (wave(512, 1), {"escape": True}),
    "wasted bits": (wave(512, 1) << 3, {"wasted": 3, "bits": 24}),
    "24 bits": (wave(700, 2, 3_000_000), {"bits": 24, "kinds": [("fixed", 2), LPC], "k": 12}),
    "8 bits": (np.clip(wave(700, 1, 60), -128, 127), {"bits": 8, "k": 3}),
    "many frames": (wave(16 * 300, 1), {"block": 16, "kinds": [("fixed", 1)]}),
    "six channels": (wave(400, 6), {}),
    "no digest": (wave(400, 1), {"md5": False}),
    "empty": (np.zeros((0, 1), np.int64), {}),
}


@pytest.mark.parametrize("name", CASES)
def test_flac_samples_come_back(name):
    x, kw = CASES[name]
    data = E.flac(x, **kw)
    if len(x):
        for group in (1, 64):
            assert (decoded(data, group) == x).all()
    info = flac.scan(data)
    assert (info.rate, info.channels, info.bits, info.frames) == (48_000, x.shape[1], kw.get("bits", 16), len(x))
    assert sum(f.samples for f in flac.frames(data, info)) == len(x)


def test_flac_metadata_from_first_bytes():
    picture = struct.pack(">I", 3) + struct.pack(">I", 9) + b"image/png" + struct.pack(">I", 0) + bytes(16) + struct.pack(">I", 5) + b"12345"
    blocks = [(3, bytes(36)), (6, picture), (2, b"abcd"), (1, bytes(100))]
    data = E.flac(wave(64, 1), tags=[("TITLE", "a=b"), ("artist", "é"), ("broken", "")], blocks=blocks)
    info = flac.scan(data[:400], len(data))
    assert info.tags == [("TITLE", "a=b"), ("artist", "é"), ("broken", "")] and info.vendor == "test"
    assert info.pictures == [(3, "image/png", 5)] and info.seek_points == 2 and info.opaque == [(2, 4)]
    with pytest.raises(EOFError):
        flac.scan(data[:60], len(data))


@pytest.mark.parametrize("blocks", [[(3, bytes(17))], [(0, bytes(34))], [(127, b"")], [(2, b"abc")], [(6, b"\0" * 10)], [(5, b"")], [(4, struct.pack("<II", 0, 9))]])
def test_flac_metadata_that_is_refused(blocks):
    with pytest.raises(ValueError):
        flac.scan(E.flac(wave(64, 1), blocks=blocks))


def test_flac_changes_are_noticed():
    x = wave(900, 2)
    data = E.flac(x, kinds=[("fixed", 2), LPC])
    info = flac.scan(data)
    for at in RNG.integers(info.audio_at, len(data), 60).tolist():
        bad = bytearray(data)
        bad[at] ^= 1 << int(RNG.integers(8))
        with pytest.raises((ValueError, EOFError)):
            decoded(bytes(bad))
    for bad in (data[:-1], data + b"\0", data + bytes(40)):
        with pytest.raises((ValueError, EOFError)):
            decoded(bad)
    other = bytearray(data)
    other[4 + 4 + 20] ^= 1  # the digest
    with pytest.raises(ValueError, match="digest"):
        decoded(bytes(other))


def test_mp4_track():
    for kw in ({}, {"media_first": True}, {"channels": 1, "bits": 24}, {"sizes": (50,), "per": 1}, {"sizes": tuple(range(1, 60)), "per": 7}, {"edit": (0, 65536)}, {"gap": 5}):
        data = E.m4a(**kw)
        t = mp4.scan(data)
        sizes = kw.get("sizes", (100, 120, 80))
        assert (t.rate, t.channels, t.bits, t.packets) == (44_100, kw.get("channels", 2), kw.get("bits", 16), len(sizes))
        assert t.frames == 4096 * (len(sizes) - 1) + 1000 and t.chunks == -(-len(sizes) // kw.get("per", 2)) and t.bit_rate == 700_000
    data = E.m4a(tags=[(b"\xa9nam", "Title"), (b"\xa9ART", "é")])
    assert mp4.scan(data).tags == [("©nam", "Title"), ("©ART", "é")]
    assert mp4.scan(data[:-250], len(data)).frames == mp4.scan(data).frames
    with pytest.raises(EOFError):
        mp4.scan(E.m4a(media_first=True)[:80], len(data))


@pytest.mark.parametrize(
    "kw, error",
    [
        ({"codec": b"mp4a"}, Unsupported), ({"rate": 4000}, Unsupported), ({"bits": 20}, Unsupported), ({"extra": [E.box(b"sinf")]}, Unsupported), ({"extra": [E.box(b"btrt", bytes(3))]}, Unsupported),
        ({"tables": [E.box(b"sgpd", bytes(8))]}, Unsupported), ({"edit": (5, 65536)}, Unsupported), ({"sizes": (0, 5)}, Unsupported), ({"last": 5000}, ValueError), ({"top": [E.box(b"moof")]}, Unsupported), ({"top": [E.box(b"junk")]}, Unsupported),
        ({"tables": [E.box(b"stss", bytes(4), E.u32(2, 2, 1))]}, ValueError), ({"tables": [E.box(b"ctts", bytes(4), E.u32(1, 3, 9))]}, Unsupported), ({"tables": [E.box(b"sdtp", bytes(4), b"\0\0\1")]}, Unsupported), ({"gap": -5}, ValueError),
    ],
)
def test_mp4_that_is_refused(kw, error):
    with pytest.raises(error):
        mp4.scan(E.m4a(**kw))


def test_mp4_cut_anywhere():
    data = E.m4a()
    for n in range(0, len(data), 7):
        with pytest.raises((ValueError, EOFError)):
            mp4.scan(data[:n])
