"""Detectors on generated waveforms with known answers, kernels against plain loops, pictures and jobs."""

import math
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonant.functions import rendering
from resonant.operators import detectors as D
from resonant.operators import kernels as K
from resonant.operators import source_profile as P
from resonant.sources import wav
from resonant.streaming import jobs

RATE = 48_000
BLOCK = 65_536


def synthesis(coefficients, window):
    """Overlapped inverse of the lapped transform: frame k begins at k hops."""
    n = coefficients.shape[1]
    frames = (coefficients @ D._cosines(2 * n).T) * window
    out = np.zeros((len(frames) + 1) * n)
    for k, f in enumerate(frames):
        out[k * n : k * n + 2 * n] += f
    return out


def quantised(frames, rng):
    """Coefficients on the lattice of whole numbers up to 12, to the power 4 / 3, times the step that the fifth scale stands for."""
    c = np.zeros((frames, 1024))
    for a, b in zip(D.BANDS[:-1], D.BANDS[1:], strict=True):
        c[:, a:b] = rng.integers(-12, 13, (frames, b - a))
        c[:, a] = 12
    share = 3 / 16 * (0.3 + 0.4 * 4 / 7)
    step = 2 ** (share * (16 + 16 / 9 * math.log2(12)) / (0.75 - 4 / 3 * share))
    return np.sign(c) * np.abs(c) ** (4 / 3) * step


@pytest.fixture(scope="module")
def tracks(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tracks")
    rng = np.random.default_rng(6)
    n = 20 * RATE
    noise = rng.normal(0, 0.1, n)
    spectrum = np.fft.rfft(noise)
    spectrum[np.fft.rfftfreq(n, 1 / RATE) > 16_000] = 0
    low = np.fft.irfft(spectrum, n)
    coded = synthesis(quantised(n // 1024, rng), K.kaiser_window(2048))[:n] / 32_768
    sparse = np.where(rng.random((n // 1024, 1024)) < 0.5, 0, rng.normal(0, 0.05, (n // 1024, 1024)))
    grid = synthesis(sparse, K.power_sine_window(2048))[:n]
    files = {"low": np.stack([low, low[::-1]], axis=1), "coded": coded[:, None], "grid": grid[:, None], "noise": noise[:, None]}
    for name, x in files.items():
        # 32-bit float, so that nothing is rounded
        pcm = x.astype("<f4").tobytes()
        fmt = struct.pack("<HHIIHH", 3, x.shape[1], RATE, RATE * 4 * x.shape[1], 4 * x.shape[1], 32)
        body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm
        (folder / f"{name}.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    words = np.zeros((4000, 2), np.int64)
    start = 1000
    payload = {35 + 3 + i: b for i, b in enumerate("1001")} | {35 + 29 + i: b for i, b in enumerate("10001")}
    for i, b in enumerate(D.MARKER):
        words[start + i, 0] |= int(b) << 1
    for i, b in payload.items():
        words[start + i, 0] |= int(b) << 1
    (folder / "marked.wav").write_bytes(wav.encode(words / 32_767, 44_100))
    return str(folder), files


def test_report(spark, tracks):
    folder, _ = tracks
    found = wav.files(spark, folder)
    info = wav.headers(found)
    rows = {}
    for r in D.report(wav.blocks(found, block_frames=BLOCK), info, BLOCK).collect():
        rows.setdefault((r.track.rsplit("/", 1)[1][:-4], r.detector), []).append(r)
    status = {k: {r.status for r in v} for k, v in rows.items()}
    assert status["low", "segment_wall"] == {"hit"} and status["noise", "segment_wall"] == {"not_detected"}
    assert status["coded", "lattice_mono"] == {"hit"} and "hit" not in status["noise", "lattice_mono"] and {("low", "lattice_mid"), ("low", "lattice_side")} < set(status)
    assert status["grid", "transform_grid"] == {"hit"} and status["noise", "transform_grid"] == {"not_detected"}
    (marked,) = rows["marked", "marker"]
    # sixteen-bit words fill the upper half, so their second bit is plane 17
    assert marked.status == "hit" and marked.detail == "plane 17 end 1035 rate 96000 provenance 17"
    assert status["noise", "marker"] == {"unsupported"} and status["marked", "transform_grid"] == {"unsupported"}


def test_spans_are_cut_whole(spark, tracks):
    folder, files = tracks
    found = wav.files(spark, folder).where(F.col("path").endswith("noise.wav"))
    track = found.select("path").first()[0]
    plan = spark.createDataFrame([(track, 0, 65_000, 66_000), (track, 1, 0, 140_000), (track, 2, len(files["noise"]) - 5, len(files["noise"]) + 5)], D._PLAN)
    got = {r.probe: r.samples for r in D.spans(wav.blocks(found, block_frames=10_240), plan, 10_240).collect()}
    x = files["noise"][:, 0].astype(np.float32)
    assert set(got) == {0, 1} and np.array_equal(got[0], x[65_000:66_000]) and np.array_equal(got[1], x[:140_000])


def test_band_votes_match_loops():
    rng = np.random.default_rng(1)
    c = np.concatenate([quantised(2, rng), rng.normal(0, 900, (2, 1024)), np.zeros((1, 1024))])
    eligible, flagged = D.band_votes(c)
    for row, (e, f) in enumerate(zip(eligible, flagged, strict=True)):
        bands = [c[row, a:b] for a, b in zip(D.BANDS[:-1], D.BANDS[1:], strict=True)]
        powers = [float((b**2).mean()) for b in bands]
        for s in range(8):
            want = [0, 0]
            for b, p in zip(bands, powers, strict=True):
                if p > max(1.0, 1e-6 * max(powers)):
                    fine = 16 + 4 / 3 * math.log2(max(np.abs(b).max(), 1e-12))
                    scaled = np.abs(b) ** 0.75 * 2 ** (-3 * (0.3 * fine + s / 7 * 0.4 * fine) / 16)
                    if 2 * (scaled >= 0.5).sum() >= len(b):
                        want[0] += 1
                        want[1] += ((np.round(scaled) - scaled) ** 2).sum() < D._error_limit(len(b))
            assert [e[s], f[s]] == want
    assert D._error_limit(4) == pytest.approx(0.034627743940669975, rel=1e-9) and D._error_limit(96) == pytest.approx(6.301075723711526, rel=1e-9)


def test_plans():
    assert D.reference_offsets(100, 32_000) == [] and D.reference_offsets(17 * RATE, RATE) == []
    offsets = D.reference_offsets(60 * RATE, RATE)
    assert len(offsets) == 9 and offsets == sorted(offsets) and offsets[-1] == 58 * RATE and 58 * RATE // 8 in offsets
    assert D.grid_positions(100_000, 96_000) == [] and all(p % 1024 == 0 for p in D.grid_positions(20 * RATE, RATE)) and len(D.grid_positions(20 * RATE, RATE)) == 12


def test_adaptive_wall(spark):
    rows = [(23_000.0, 40.0, None, None, 16_500.0), (15_000.0, 20.0, None, None, 16_500.0), (18_000.0, 40.0, None, True, 16_500.0), (20_220.0, 40.0, None, False, 20_620.0), (18_000.0, 40.0, -90.0, False, 18_400.0)]
    rows += [(18_000.0, 40.0, -50.0, False, 16_500.0), (18_000.0, 40.0, -50.0, None, 16_500.0), (20_220.0, 40.0, -50.0, None, None), (18_000.0, 40.0, None, False, None), (None, 40.0, -90.0, False, None), (18_000.0, None, -90.0, False, None)]
    df = spark.createDataFrame(rows, "c double, d double, v double, r boolean, want double")
    got = df.select("want", D.adaptive_wall(F.col("c"), F.col("d"), F.col("v"), F.col("r"), F.lit(RATE)).alias("wall")).collect()
    assert [g.wall for g in got] == [g.want for g in got]


def test_filters_and_profiles():
    t = np.arange(4 * RATE) / RATE
    for f, gain in ((100, 1e-4), (1000, math.sqrt(0.5)), (8000, 1.0)):
        y, _ = K.Cascade(P.butterworth4(RATE, 1000.0))(np.sin(2 * np.pi * f * t))
        assert math.sqrt(2) * y[RATE:].std() == pytest.approx(gain, rel=0.02)
    x = 0.5 * np.sin(2 * np.pi * 3000 * t) + 0.1 * np.sin(2 * np.pi * 12_000 * t)
    band = P.band_profile(x, RATE, 10_000.0, 20_000.0, 24)
    assert band["rms_db"] == pytest.approx(20 * math.log10(0.1 / math.sqrt(2)), abs=0.01) and band["second_std_db"] < 0.01 and band["lag_correlation"] == pytest.approx(1.0, abs=0.2)
    assert P.band_profile(x, RATE, None, 20_000.0, 25)["rms_db"] is None
    rng = np.random.default_rng(3)
    v = np.abs(np.round(rng.normal(0, 3, 2000)))
    width = 7
    want = [np.mean([v[min(max(i + k, 0), 1999)] for k in range(-3, 4)]) * math.pi / 2 for i in range(2000)]
    assert np.allclose(P.edge_mean(v, width), want)
    peaks = P.high_peaks(v, 4.0, 10)
    assert (v[peaks] >= 4).all() and (np.diff(peaks) >= 10).all() and len(peaks) > 20
    quiet = np.concatenate([rng.normal(0, 0.2, RATE), rng.normal(0, 0.001, 3 * RATE), rng.normal(0, 0.2, RATE), np.zeros(RATE // 4)])
    frames, ratio = P.silence_ratio(quiet, RATE)
    assert frames == pytest.approx(3 * RATE, abs=20) and 0 < ratio < 0.01
    hits = np.zeros(2 * RATE)
    hits[[RATE // 2, RATE]] = 1.0
    found = P.attacks(np.convolve(hits, np.ones(100), "same") * 0.9 + rng.normal(0, 1e-4, 2 * RATE), RATE)
    assert found["attacks"] == found["eligible_attacks"] == 2 and found["clicks"] >= 2


def test_profiles_and_spectrogram_of_files(spark, tracks):
    folder, files = tracks
    found = wav.files(spark, folder).where(F.col("path").endswith("low.wav"))
    info = wav.headers(found)
    cut = info.select("track", F.lit(16_000.0).alias("cutoff"))
    row = P.profiles(wav.blocks(found), info, cut).first()
    assert row.rms_db < -60 and row.silence_ratio is None and row.fft_length >= 20 * RATE
    blocks = wav.blocks(found, max_seconds=2, block_frames=9_000, ahead=1024)
    got = {(r.channel, r.column, r.bin): r.power_db for r in P.spectrogram(blocks, columns=50).collect()}
    x = files["low"][: 2 * RATE, 0].astype(np.float32).astype(np.float64)
    m = K.magnitudes(x, 1024, 512).astype(np.float64) ** 2
    merged = 4
    assert max(c for _, c, _ in got) == (len(m) - 1) // merged <= 49
    assert all(got[0, c, b] == pytest.approx(max(-140, 10 * math.log10(m[c * merged : (c + 1) * merged, b].mean())), abs=1e-4) for c in (0, 7, 46) for b in (0, 100, 512))


def test_pictures(tmp_path):
    db = np.linspace(-140, 0, 30).reshape(5, 6)
    rgb = rendering.colours(rendering.canvas(db, 10, 12))
    assert rgb.shape == (12, 10, 3) and rendering.colours(np.array([[0.0]])).tolist() == [[[255, 240, 160]]]
    png = rendering.png(rgb)
    size = int.from_bytes(png[33:37], "big")
    raw = np.frombuffer(zlib.decompress(png[41 : 41 + size]), np.uint8).reshape(12, 31)
    assert (raw[:, 0] == 0).all() and np.array_equal(raw[:, 1:].reshape(12, 10, 3), rgb)
    assert rendering.ppm(rgb) == b"P6\n10 12\n255\n" + rgb.tobytes()
    path = str(tmp_path / "a.png")
    rendering.save(path, png)
    with pytest.raises(FileExistsError):
        rendering.save(path, b"")
    with pytest.raises(TypeError):
        rendering.save(str(tmp_path / "b.png"), None)
    assert not (tmp_path / "b.png").exists() and (tmp_path / "a.png").read_bytes() == png
    with pytest.raises(ValueError):
        rendering.canvas(db, 0, 5)


def test_jobs(spark):
    worker = jobs.Worker(spark)
    assert worker.submit(lambda s: s.range(100).count()).wait(60) == 100
    started, release = threading.Event(), threading.Event()

    def slow(s):
        started.set()
        release.wait(30)
        return s.range(10**13).selectExpr("sum(id * 3 % 7)").first()

    job, later = worker.submit(slow), worker.submit(lambda s: 1)
    assert started.wait(30) and job.status == "running" and later.status == "queued"
    later.cancel()
    release.set()
    while job.progress()[1] == 0:
        pass
    job.cancel()
    with pytest.raises(RuntimeError):
        job.wait(60)
    with pytest.raises(RuntimeError):
        later.wait(1)
    with pytest.raises(ZeroDivisionError):
        worker.submit(lambda s: 1 / 0).wait(60)
    worker.close()
