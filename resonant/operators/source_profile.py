"""Profiles of a track's mid signal: filtered bands, attacks and clicks, high-band energy of silence against music.

What they need is bounded by their definition, the first three minutes of a track, so one task holds one track; the
numbers that come out are ordinary columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonant.operators.kernels import Cascade, next_fast_length

CAP_SECONDS = 180
PROFILE = "track string, attacks long, eligible_attacks long, affected_attacks long, preceding_percent double, hf_median double, clicks long, clicks_per_minute double, rms_db double, std_db double, lag_correlation double, second_std_db double, fft_length long, silence_frames long, silence_ratio double"


def butterworth4(rate: int, low: float, high: float | None = None) -> tuple[tuple[float, ...], ...]:
    """Sections (b0, b1, b2, a1, a2) of a Butterworth filter of order four: high pass from low on, or band pass low to high.

    The prototype's poles lie on the unit circle; they are moved to the band, mapped by the bilinear transform and paired with
    their conjugates. The gain is one at the Nyquist frequency, or in the middle of the band."""
    fs = 2.0 * rate
    edge = lambda f: fs * math.tan(math.pi * f / rate)
    w0 = edge(low)
    prototype = np.exp(1j * np.pi * (2 * np.arange(4) + 5) / 8)
    if high is None:
        analogue = w0 / prototype
    else:
        half = prototype * (edge(high) - w0) / 2
        root = np.sqrt(half**2 - w0 * edge(high))
        analogue = np.concatenate([half + root, half - root])
    poles = (fs + analogue) / (fs - analogue)
    upper = sorted(poles[poles.imag > 0], key=abs)
    # zeros: at -1 and 1 for a band, at 1 for a high pass
    zero = [1.0] * (len(upper) // 2) + [-1.0] * (len(upper) - len(upper) // 2) if high is not None else [-1.0] * len(upper)
    middle = math.pi if high is None else 2 * math.atan(math.sqrt(w0 * edge(high)) / fs)
    z = np.exp(-1j * middle)
    sections = [(1.0, 2 * s, 1.0, -2 * p.real, abs(p) ** 2) for s, p in zip(zero, upper, strict=True)]
    gain = abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))
    return tuple((b0 / gain, b1 / gain, b2 / gain, a1, a2) if k == 0 else (b0, b1, b2, a1, a2) for k, (b0, b1, b2, a1, a2) in enumerate(sections))


def band_profile(x: np.ndarray, rate: int, low: float | None, high: float | None, lag: int) -> dict[str, float | None]:
    """Levels, lag correlation and spread over seconds of a signal with all bins outside the band removed."""
    out: dict[str, float | None] = {"rms_db": None, "std_db": None, "lag_correlation": None, "second_std_db": None, "fft_length": 0}
    if not len(x) or low is None or high is None or not 0 <= low < high < rate / 2:
        return out
    n = next_fast_length(len(x))
    spectrum = np.fft.rfft(x, n)
    f = np.fft.rfftfreq(n, 1 / rate)
    y = np.fft.irfft(np.where((f >= low) & (f <= high), spectrum, 0), n)[: len(x)]
    level = lambda v: 20 * math.log10(v + 1e-12)
    out |= {"fft_length": n, "rms_db": level(math.sqrt(np.mean(y * y))), "std_db": level(y.std())}
    if len(y) > 2 * lag:
        a, b = y[:-lag], y[lag:]
        if a.var() > 1e-20 and b.var() > 1e-20:
            out["lag_correlation"] = min(1.0, abs(float(np.mean((a - a.mean()) * (b - b.mean())) / math.sqrt(a.var() * b.var()))))
    seconds = len(y) // rate
    if seconds >= 2 and y.std() > 1e-10:
        power = (y[: seconds * rate].reshape(seconds, rate) ** 2).mean(axis=1)
        out["second_std_db"] = float(np.std(20 * np.log10(np.sqrt(power) + 1e-12)))
    return out


def edge_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Centred means of sizes over an odd width whose windows repeat the end values, times pi / 2."""
    half = width // 2
    padded = np.concatenate([np.full(half, abs(x[0])), np.abs(x), np.full(half, abs(x[-1]))]) if len(x) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(padded)])
    return (sums[width:] - sums[:-width]) / width * math.pi / 2 if len(x) else x


def high_peaks(v: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Middles of the local maxima at least so high, from the highest down (of equal ones the later first), none nearer than the
    distance to one that was kept."""
    if len(v) < 3:
        return np.zeros(0, np.int64)
    start = np.r_[0, np.flatnonzero(np.diff(v)) + 1]
    end = np.r_[start[1:], len(v)] - 1
    level = v[start]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]) & (level[1:-1] >= height)) + 1
    at, level = (start[top] + end[top]) // 2, level[top]
    alive, kept = np.ones(len(at), bool), []
    for i in np.lexsort((-at, -level)):
        if alive[i]:
            kept.append(int(at[i]))
            a, b = np.searchsorted(at, at[i] - distance, "right"), np.searchsorted(at, at[i] + distance, "left")
            alive[a:b] = False
    return np.array(sorted(kept), np.int64)


def attacks(x: np.ndarray, rate: int) -> dict[str, float | None]:
    """Attacks of the envelope, those with raised high-band power right before them, and clicks."""
    found = high_peaks(edge_mean(x, int(0.001 * rate) | 1), 10 ** (-3 / 20), int(rate * 0.05))
    sharp = edge_mean(Cascade(butterworth4(rate, 1000.0))(x)[0], int(0.0005 * rate) | 1)
    middle = float(np.median(sharp)) if len(sharp) else 0.0
    clicks = len(high_peaks(sharp, 3 * middle, int(rate * 0.01)))
    eligible = affected = 0
    base = None
    if rate / 2 - 100 > 10_000 and len(x):
        power = Cascade(butterworth4(rate, 10_000.0, min(20_000.0, rate / 2 - 100)))(x)[0] ** 2
        base = float(np.median(power))
        sums = np.concatenate([[0.0], np.cumsum(power)])
        before, near = int(rate * 0.02), int(rate * 0.01)
        own = found[found >= before + near]
        eligible = len(own)
        affected = int(((sums[own - near] - sums[own - before]) / (before - near) > 3 * base).sum())
    known = eligible > 0 and base is not None and base > 1e-24
    return {
        "attacks": len(found), "eligible_attacks": eligible, "affected_attacks": affected, "preceding_percent": 100.0 * affected / eligible if known else None,
        "hf_median": base, "clicks": clicks, "clicks_per_minute": clicks * 60.0 * rate / len(x) if len(x) and middle > 1e-12 else None,
    }


def high_band_energy(x: np.ndarray, rate: int) -> float | None:
    """Energy from 16 to 22 kHz under a Hann window; unknown for short signals or low rates."""
    if len(x) < 1024 or rate / 2 - 100 <= 16_000:
        return None
    n = len(x)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    power = np.abs(np.fft.rfft(x * window)) ** 2
    f = np.arange(len(power)) * rate / n
    return float(power[(f >= 16_000) & (f <= min(22_000, rate / 2 - 100))].sum() / n**2)


def silence(x: np.ndarray, rate: int) -> tuple[int, np.ndarray]:
    """Frames in runs of half a second or more below a hundredth of full scale, and up to thirty seconds of them."""
    quiet = np.r_[False, np.abs(x) < 0.01, False]
    edges = np.flatnonzero(quiet[1:] != quiet[:-1]).reshape(-1, 2)
    runs = [(a, b) for a, b in edges.tolist() if b - a >= rate // 2]
    held = np.concatenate([x[a:b] for a, b in runs] or [x[:0]])
    return sum(b - a for a, b in runs), held[: 30 * rate]


def silence_ratio(x: np.ndarray, rate: int) -> tuple[int, float | None]:
    """Frames of silence, and its high-band energy over that of the music, with two seconds of silence at least."""
    frames, held = silence(x, rate)
    if frames < 2 * rate:
        return frames, None
    music = high_band_energy(x[10 * rate : 40 * rate] if len(x) >= 40 * rate else x, rate)
    quiet = high_band_energy(held, rate)
    return frames, quiet / (music + 1e-12) if quiet is not None and music is not None and music > 1.2e-8 else None


def profiles(blocks: DataFrame, rates: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """One row for each track: the profile of what lies above its cutoff, attacks, clicks and silence, from the mid signal of its
    first three minutes. cutoffs: (track, cutoff); without one the band is unknown."""
    known = rates.where("status = 'analysed'").select("track", "sample_rate")
    known = known.join(cutoffs.select("track", "cutoff"), "track", "left") if cutoffs is not None else known.withColumn("cutoff", F.lit(None).cast("double"))
    rows = blocks.join(known, "track").where(F.col("start_frame") < CAP_SECONDS * F.col("sample_rate"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rate, cutoff = int(pdf["sample_rate"].iloc[0]), pdf["cutoff"].iloc[0]
        lanes = [np.concatenate(g.sort_values("start_frame")["samples"].to_list()) for _, g in pdf.groupby("channel")]
        x = np.mean(np.stack(lanes).astype(np.float32), axis=0, dtype=np.float32)[: CAP_SECONDS * rate].astype(np.float64)
        half = rate / 2
        usable = pd.notna(cutoff) and 0 < cutoff < 0.93 * half and half - 100 - (cutoff + 800) >= 400
        lag = max(25, round(50 * rate / 44_100))
        frames, ratio = silence_ratio(x, rate)
        row = {"track": pdf["track"].iloc[0], **attacks(x, rate), **band_profile(x, rate, float(cutoff) + 800 if usable else None, half - 100, lag), "silence_frames": frames, "silence_ratio": ratio}
        return pd.DataFrame([row])[[c.split()[0] for c in PROFILE.split(", ")]]

    return rows.groupBy("track").applyInPandas(run, PROFILE)


def spectrogram(blocks: DataFrame, columns: int = 1280, width: int = 1024, hop: int = 512) -> DataFrame:
    """(track, channel, column, bin, power_db): mean power of merged frames, the smallest power of two of them that leaves at most so
    many columns. Blocks carry their next width samples (column after)."""
    from resonant.operators.kernels import frame_count, magnitudes

    length = blocks.groupBy("track").agg(F.max(F.col("start_frame") + F.size("samples")).alias("frames"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for track, channel, start, x, after, total in zip(pdf["track"], pdf["channel"], pdf["start_frame"], pdf["samples"], pdf["after"], pdf["frames"], strict=True):
                count = frame_count(total, width, hop)
                merged = 1
                while -(-count // merged) > columns:
                    merged *= 2
                skip = -start % hop
                first = (start + skip) // hop
                here = max(0, (len(x) - skip + hop - 1) // hop)
                m = magnitudes(np.concatenate([np.asarray(x), np.asarray(after)])[skip:], width, hop)[:here].astype(np.float64) ** 2
                if len(m):
                    cell = (first + np.arange(len(m))) // merged
                    for c in np.unique(cell):
                        own = m[cell == c]
                        yield pd.DataFrame({"track": track, "channel": channel, "column": c, "bin": np.arange(m.shape[1]), "n": len(own), "power": own.sum(axis=0)})

    sums = blocks.join(F.broadcast(length), "track").mapInPandas(run, "track string, channel int, column long, bin long, n long, power double")
    mean = F.sum("power") / F.sum("n")
    return sums.groupBy("track", "channel", "column", "bin").agg(F.greatest(F.when(mean > 0, 10 * F.log10(mean)).otherwise(-140.0), F.lit(-140.0)).alias("power_db"))
