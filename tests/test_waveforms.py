"""Waveform files, kernels on tones with known answers."""

import numpy as np
import pytest

from resonant.operators import kernels as K
from resonant.sources import wav
from tests import encoders as E


@pytest.fixture
def folder(tmp_path):
    t = np.arange(48_000) / 48_000
    stereo = np.stack([0.5 * np.sin(2 * np.pi * 997 * t), 0.25 * np.sin(2 * np.pi * 1379 * t)], axis=1)
    (tmp_path / "b.WAV").write_bytes(wav.encode(stereo, 48_000))
    (tmp_path / "a.wav").write_bytes(wav.encode(stereo[:100, :1], 8_000)[:-2])
    (tmp_path / "c.flac").write_bytes(b"fLaC" + bytes(40))
    (tmp_path / "d.txt").write_bytes(b"no")
    return str(tmp_path), stereo


def test_headers_report_each_file(spark, folder):
    path, _ = folder
    rows = [r for r in wav.headers(wav.files(spark, path)).collect()]
    got = {r.track.rsplit("/", 1)[1]: (r.container, r.status, r.reason, r.frames) for r in rows}
    assert got["b.WAV"] == ("riff", "analysed", None, 48_000)
    assert got["a.wav"][1:3] == ("unsupported", "chunk beyond the end")
    assert got["c.flac"][:2] == ("flac", "failed")
    assert "d.txt" not in got


def test_blocks_hold_the_samples_and_the_prefix(spark, folder):
    path, stereo = folder
    b = wav.blocks(wav.files(spark, path), max_seconds=0.5, block_frames=10_000)
    s = wav.samples(b).toPandas().sort_values(["channel", "frame"])
    assert len(s) == 2 * 24_000
    for c in range(2):
        assert np.abs(s[s.channel == c]["sample"].to_numpy() - stereo[:24_000, c]).max() < 1e-4


def test_loudness_and_spectrum_of_a_tone(spark, folder):
    path, _ = folder
    found = wav.files(spark, path)
    spec = K.mean_spectra(wav.blocks(found, block_frames=7_000, ahead=K.WIDTH)).where("channel = 0").toPandas()
    whole = K.mean_spectra(wav.blocks(found, ahead=K.WIDTH)).where("channel = 0").toPandas()
    assert np.allclose(spec.sort_values("bin")["power"], whole.sort_values("bin")["power"])
    b = wav.blocks(found, block_frames=7_000)
    assert spec["frames"].iloc[0] == K.frame_count(48_000)
    assert abs(spec.loc[spec["power"].idxmax(), "bin"] * 48_000 / K.WIDTH - 997) < 12
    level = K.integrated_loudness(K.weighted_hops(b, wav.headers(found))).first()
    # a 997 Hz sine of amplitude a has about 10 log10(a * a / 2) - 0.691 + 0.69
    assert level.level == pytest.approx(10 * np.log10((0.25 + 0.0625) / 2), abs=0.3)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_integer_words(bits):
    h = wav.Header(48_000, 1, bits, "int", 0, 0)
    raw = {8: bytes([255, 128, 0]), 16: b"\xff\x7f\x00\x00\x00\x80", 24: b"\xff\xff\x7f\x00\x00\x00\x00\x00\x80", 32: b"\xff\xff\xff\x7f\x00\x00\x00\x00\x00\x00\x00\x80"}[bits]
    x = wav.words(raw, h)[:, 0]
    assert x[0] == pytest.approx(1, abs=0.01) and x[1] == 0 and x[2] == -1


def test_lapped_transform_is_orthonormal_and_finds_its_grid():
    rng = np.random.default_rng(1)
    n = 32
    w = K.power_sine_window(2 * n)
    assert np.allclose(w[:n] ** 2 + w[n:] ** 2, 1)
    k = K.kaiser_window(2 * n)
    assert np.allclose(k[:n] ** 2 + k[n:] ** 2, 1)
    # overlap-add of sparse coefficients gives a signal whose transform on that grid is sparse again
    c = np.where(rng.random((40, n)) < 0.2, rng.normal(size=(40, n)), 0)
    i, j = np.arange(2 * n), np.arange(n)[:, None]
    basis = np.sqrt(2 / n) * np.cos(np.pi / n * (i + 0.5 + n / 2) * (j + 0.5))
    x = np.zeros(41 * n)
    for f in range(40):
        x[f * n : f * n + 2 * n] += (c[f] @ basis) * w
    grid = K.transform_grid(x, n, w, quiet=1e-6)
    assert grid.argmax() == 0 and grid[0] > 0.6 > 0.2 > np.sort(grid)[-2]


def test_biquad_carries_its_registers():
    x = np.random.default_rng(2).normal(size=300)
    c = K.butterworth(8000, 1000, True)
    whole, _ = K.biquad(x, c)
    a, s = K.biquad(x[:100], c)
    b, _ = K.biquad(x[100:], c, s)
    assert np.array_equal(whole, np.concatenate([a, b]))


def test_cascade_of_blocks_is_the_plain_filter():
    x = np.random.default_rng(3).normal(size=1000)
    sections = K.k_weighting(48_000)
    want = K.biquad(K.biquad(x, sections[0])[0], sections[1])[0]
    c = K.Cascade(sections)
    whole, end = c(x)
    assert np.allclose(whole, want, atol=1e-12)
    a, s = c(x[:333])
    b, e = c(x[333:], s)
    assert np.allclose(np.concatenate([a, b]), want, atol=1e-12) and np.allclose(e, end, atol=1e-12)
    assert np.allclose(s @ c.advance(667) + c(x[333:])[1], end, atol=1e-12)


def test_block_sizes_change_neither_spectrum_nor_loudness(spark, folder):
    path, _ = folder
    found = wav.files(spark, path)
    spectra, levels = [], []
    for size in (5_000, 48_000):
        b = wav.blocks(found, block_frames=size, ahead=K.WIDTH)
        spectra.append({(r.channel, r.bin): r.power for r in K.mean_spectra(b).collect()})
        levels.append(sorted((r.channel, r.block, r.ms) for r in K.weighted_hops(b, wav.headers(found)).collect()))
    assert spectra[0].keys() == spectra[1].keys() and len(levels[0]) == 20
    assert all(abs(spectra[0][k] - v) <= 1e-6 * max(v, 1e-3) for k, v in spectra[1].items())
    assert np.allclose(levels[0], levels[1], atol=1e-12)


def test_small_kernels():
    assert K.next_fast_length(13) == 14 and K.next_fast_length(97) == 98
    assert K.loudest_anchors(np.array([5, 9, 9, 1, 7.0]), 2, 1) == [1, 4]
    assert K.probe_offsets(48_000 * 60, 48_000)[-1] == 48_000 * 58 and len(K.probe_offsets(48_000 * 60, 48_000)) == 9
    assert K.probe_offsets(10, 8000) == []
    left = np.zeros(50, np.int32)
    left[[10, 11, 13]] = 1 << 17
    assert K.sync_positions(left, np.zeros(50, np.int32), "1101") == [(17, 10)]
    assert K.lattice_vote(np.array([1.0, 2, 3, 4]) ** (4 / 3), np.array([1.0])) == 1.0
    band = K.brickwall(np.sin(2 * np.pi * 100 * np.arange(1000) / 1000) + np.sin(2 * np.pi * 300 * np.arange(1000) / 1000), 1000, 50, 200)
    assert np.abs(band - np.sin(2 * np.pi * 100 * np.arange(1000) / 1000)).max() < 1e-9


@pytest.fixture
def mixed(tmp_path):
    x = np.round(8000 * np.sin(np.arange(30_000) / 20)).astype(np.int64)
    x = np.stack([x, x[::-1]], axis=1)
    (tmp_path / "a.flac").write_bytes(E.flac(x, rate=16_000, block=4096, kinds=[("fixed", 2)], assignment=10, tags=[("TITLE", "Tone")]))
    (tmp_path / "b.wav").write_bytes(wav.encode(x / 32767, 16_000))
    (tmp_path / "c.m4a").write_bytes(E.m4a(tags=[(b"\xa9nam", "Song")], media_first=True))
    (tmp_path / "d.flac").write_bytes((tmp_path / "a.flac").read_bytes()[:-100])
    (tmp_path / "e.wav").write_bytes(b"RF64" + bytes(40))
    return tmp_path, x


def names(rows):
    return {r.track.rsplit("/", 1)[1]: r for r in rows}


def test_flac_and_riff_give_the_same_samples(spark, mixed):
    path, x = mixed
    found = wav.files(spark, str(path))
    for seconds, n in ((None, 30_000), (1.5, 24_000)):
        b = wav.blocks(found, max_seconds=seconds, block_frames=5000, ahead=300)
        got = {}
        for r in b.collect():
            got.setdefault((r.track.rsplit("/", 1)[1], r.channel), {})[r.start_frame] = (r.samples, r.after)
        for name in ("a.flac", "b.wav"):
            for c in range(2):
                parts = got[name, c]
                assert sorted(parts) == list(range(0, n, 5000))
                whole = np.concatenate([parts[k][0] for k in sorted(parts)])
                assert np.array_equal(np.round(whole * 32768), x[:n, c])
                assert all(np.array_equal(parts[k][1], whole[k + 5000 : k + 5300]) for k in parts)
    rows = names(wav.headers(found).collect())
    assert (rows["a.flac"].status, rows["a.flac"].frames, rows["a.flac"].bits) == ("analysed", 30_000, 16)
    assert rows["d.flac"].status == "failed" and rows["d.flac"].reason.startswith("cut off") and rows["c.m4a"].status == "unsupported" and rows["e.wav"].reason == "64-bit RIFF"
    assert names(wav.headers(found, seconds=-1).collect())["a.flac"].status == "timed_out"
    assert names(wav.headers(found, max_seconds=1e-6).collect())["b.wav"].reason == "the prefix holds no frame"


def test_metadata_reads_first_bytes_only(spark, mixed):
    path, _ = mixed
    found = wav.files(spark, str(path))
    for head in (1 << 20, 64, 16):
        rows = names(wav.metadata(found, head).collect())
        assert list(rows) == sorted(rows) and len(rows) == 5
        a, b, c = rows["a.flac"], rows["b.wav"], rows["c.m4a"]
        assert (a.status, a.codec, a.sample_rate, a.channels, a.bits, a.frames, a.tags[0].value) == ("described", "flac", 16_000, 2, 16, 30_000, "Tone")
        assert (b.codec, b.frames, b.duration, b.bit_rate) == ("pcm_int", 30_000, 30_000 / 16_000, 512_000)
        assert (c.codec, c.sample_rate, c.tags[0].key, c.tags[0].value) == ("alac", 44_100, "©nam", "Song")
        assert rows["d.flac"].status == "described" and rows["e.wav"].status == "unsupported"
    chosen = names(wav.select_track(wav.metadata(found), 0).collect())
    assert chosen["a.flac"].status == "described" and chosen["e.wav"].status == "unsupported"
    assert {r.status for r in wav.select_track(wav.metadata(found), 3).collect()} == {"invalid", "unsupported"}


def test_listing_has_rows_for_what_is_not_there(spark, mixed):
    path, _ = mixed
    rows = [(r.path.rsplit("/", 1)[1], r.status, r.reason) for r in wav.listing(spark, str(path), ["a.flac", "zz.wav", "zz.wav"]).collect()]
    assert rows == [("a.flac", "found", None), ("b.wav", "found", None), ("c.m4a", "found", None), ("d.flac", "found", None), ("e.wav", "found", None), ("zz.wav", "failed", "not found")]
    (path / "empty").mkdir()
    (path / "empty" / "note.txt").write_text("x")
    (only,) = wav.listing(spark, str(path / "empty")).collect()
    assert (only.status, only.reason) == ("failed", "no supported files")


def test_guard_reports_the_first_failure():
    now = iter([0.0, 0.5, 2.0])
    guard = wav.Guard(1.0, clock=lambda: next(now))
    guard.check()
    with pytest.raises(wav.TimedOut):
        list(guard.over(iter([1])))
    assert wav.outcome(wav.Unsupported("x")) == ("unsupported", "x") and wav.outcome(EOFError("y")) == ("failed", "cut off: y")


def riff(fmt, data):
    import struct

    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_extensible_and_double_formats():
    import struct

    plain = struct.pack("<HHIIHH", 3, 1, 8000, 64_000, 8, 64)
    h = wav.parse_header(riff(plain, np.array([0.5, -1.0]).tobytes()))
    assert wav.words(np.array([0.5, -1.0]).tobytes(), h)[:, 0].tolist() == [0.5, -1.0]
    wide = lambda valid, mask, tail: struct.pack("<HHIIHHHHIH", 0xFFFE, 2, 8000, 32_000, 4, 16, 22, valid, mask, 1) + tail
    good = bytes.fromhex("000000001000800000aa00389b71")
    assert wav.parse_header(riff(wide(16, 3, good), bytes(8))).frames == 2
    for bad in (wide(12, 3, good), wide(16, 7, good), wide(16, 3, bytes(14))):
        with pytest.raises(wav.Unsupported):
            wav.parse_header(riff(bad, bytes(8)))
