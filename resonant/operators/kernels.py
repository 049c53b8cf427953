"""Signal kernels that built-in functions can't express: transforms, recursive filters, lattice votes, marker scans.

They are numpy functions over arrays, called from Arrow batches. What comes after them is ordinary DataFrame work.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HOP = 4096, 2048


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window, rounded to single precision."""
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))).astype(np.float32)


def frame_count(n: int, width: int = WIDTH, hop: int = HOP) -> int:
    """Frames of n samples; one counts only if a sample follows it."""
    return (n - width - 1) // hop + 1 if n > width else 0


def magnitudes(x: np.ndarray, width: int = WIDTH, hop: int = HOP) -> np.ndarray:
    """Unnormalised magnitudes, frames x (width / 2 + 1), in single precision."""
    k = frame_count(len(x), width, hop)
    if not k:
        return np.zeros((0, width // 2 + 1), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), width)[: k * hop : hop]
    return np.abs(np.fft.rfft(frames * hann(width))).astype(np.float32)


def k_weighting(rate: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The two loudness biquads (b0, b1, b2, a1, a2) at any rate: high shelf and high pass from their analogue prototypes."""
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = math.tan(math.pi * f0 / rate)
    vh = 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)


def butterworth(rate: int, cutoff: float, high: bool) -> tuple[float, ...]:
    """A second-order section by the bilinear transform."""
    k = math.tan(math.pi * cutoff / rate)
    a0 = 1 + math.sqrt(2) * k + k * k
    b = (1.0, -2.0, 1.0) if high else (k * k, 2 * k * k, k * k)
    return (*(x / a0 for x in b), 2 * (k * k - 1) / a0, (1 - math.sqrt(2) * k + k * k) / a0)


def biquad(x: np.ndarray, c: tuple[float, ...], state: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Transposed direct form II with carried registers; tiny ones are flushed to zero."""
    b0, b1, b2, a1, a2 = c
    z1, z2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        if abs(z1) < 1e-30:
            z1 = 0.0
        if abs(z2) < 1e-30:
            z2 = 0.0
        out[i] = y
    return out, (z1, z2)


def next_fast_length(n: int) -> int:
    """The smallest length from n on with no prime factor above 11."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def brickwall(x: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    """All bins outside the band removed."""
    n = next_fast_length(max(len(x), 1))
    spec = np.fft.rfft(x, n)
    f = np.fft.rfftfreq(n, 1 / rate)
    spec[(f < low) | (f > high)] = 0
    return np.fft.irfft(spec, n)[: len(x)]


def mdct(frames: np.ndarray) -> np.ndarray:
    """Orthonormal lapped transform of windowed frames of length 2N: N coefficients each."""
    n2 = frames.shape[-1]
    n = n2 // 2
    k, i = np.arange(n)[:, None], np.arange(n2)
    return math.sqrt(2 / n) * (frames @ np.cos(np.pi / n * (i + 0.5 + n / 2) * (k + 0.5)).T)


def power_sine_window(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / n) ** 2)


def kaiser_window(n: int, alpha: float = 4.0) -> np.ndarray:
    """Kaiser-Bessel derived window of length n."""
    w = np.cumsum(np.i0(np.pi * alpha * np.sqrt(np.maximum(1 - (4 * np.arange(n // 2 + 1) / n - 1) ** 2, 0))))
    half = np.sqrt(w[:-1] / w[-1])
    return np.concatenate([half, half[::-1]])


def transform_grid(x: np.ndarray, n: int, window: np.ndarray, quiet: float = 1e-4) -> np.ndarray:
    """Per phase of a lapped transform's grid: the share of nearly zero coefficients, high where the grid is the one it was coded on."""
    out = np.zeros(n)
    for phase in range(n):
        count = (len(x) - phase - 2 * n) // n + 1
        if count > 0:
            frames = np.lib.stride_tricks.sliding_window_view(x[phase:], 2 * n)[: count * n : n]
            c = np.abs(mdct(frames * window))
            out[phase] = (c < quiet * (c.max() + 1e-30)).mean()
    return out


def lattice_vote(coefficients: np.ndarray, steps: np.ndarray, tolerance: float = 0.1) -> float:
    """The largest share of coefficients that lie near whole numbers after the power-law companding of one of the steps."""
    c = np.abs(coefficients[np.abs(coefficients) > 0])
    if not len(c):
        return 0.0
    scaled = (c[None, :] / steps[:, None]) ** 0.75
    used = scaled > 0.5
    near = (np.abs(scaled - np.round(scaled)) < tolerance) & used
    return float((near.sum(axis=1) / np.maximum(used.sum(axis=1), 1))[used.mean(axis=1) >= 0.5].max(initial=0.0))


def loudest_anchors(energy: np.ndarray, count: int, distance: int) -> list[int]:
    """Places of largest energy, each further than the distance from those before it; of equal ones the lower."""
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(energy)), -energy)):
        if len(kept) == count:
            break
        if all(abs(i - k) > distance for k in kept):
            kept.append(int(i))
    return sorted(kept)


def probe_offsets(frames: int, rate: int, most: int = 36) -> list[int]:
    """Starts of two-second probes spread evenly over the whole; none below 32 kHz."""
    if rate < 32_000:
        return []
    count = min(max(frames // (15 * rate), 9), most, frames // (2 * rate))
    return [0] if count == 1 else [(frames - 2 * rate) * i // (count - 1) for i in range(count)]


def random_probe(frames: int, rate: int, seed: int = 42) -> int:
    """One more probe at a reproducible random place."""
    return random.Random(seed).randint(0, max(0, frames - 2 * rate))


def sync_positions(left: np.ndarray, right: np.ndarray, marker: str, planes: tuple[int, ...] = (16, 17, 18)) -> list[tuple[int, int]]:
    """(plane, frame) where a marker runs through one bit plane of the two channels' difference by exclusive or."""
    want = np.array([int(b) for b in marker], np.uint8)
    found = []
    for plane in planes:
        bit = (((left ^ right) >> plane) & 1).astype(np.uint8)
        if len(bit) >= len(want):
            hit = (np.lib.stride_tricks.sliding_window_view(bit, len(want)) == want).all(axis=1)
            found += [(plane, int(i)) for i in np.flatnonzero(hit)]
    return found


def mean_spectra(blocks: DataFrame, width: int = WIDTH, hop: int = HOP) -> DataFrame:
    """(track, channel, bin, frames, power, peak): mean power of each bin over all frames.

    Every block is transformed alone: the source gave it the channel's next width samples (column after), so frames that begin
    in it are whole and no channel is gathered or sorted. Only one row a bin and block leaves the kernel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for track, channel, start, x, after in zip(pdf["track"], pdf["channel"], pdf["start_frame"], pdf["samples"], pdf["after"], strict=True):
                skip = -start % hop  # frames begin at multiples of the hop from the channel's start
                whole = np.concatenate([np.asarray(x), np.asarray(after)])[skip:]
                begin_here = max(0, (len(x) - skip + hop - 1) // hop)
                m = magnitudes(whole, width, hop)[:begin_here].astype(np.float64)
                if len(m):
                    yield pd.DataFrame({"track": track, "channel": channel, "frames": len(m), "bin": np.arange(m.shape[1]), "power": (m**2).sum(axis=0), "peak": m.max()})

    joined = blocks.select("track", "channel", "start_frame", "samples", "after")
    sums = joined.mapInPandas(run, "track string, channel int, frames long, bin long, power double, peak double")
    return sums.groupBy("track", "channel", "bin").agg(F.sum("frames").alias("frames"), (F.sum("power") / F.sum("frames")).alias("power"), F.max("peak").alias("peak"))


class Cascade:
    """Biquads in series over long blocks by matrices: the response to the input and to the registers, chunk by chunk.

    Registers at the end of a block are linear in those at its start, so blocks can be filtered in parallel and joined."""

    CHUNK = 128

    def __init__(self, sections: tuple[tuple[float, ...], ...]):
        self.sections, n = sections, self.CHUNK
        self.order = 2 * len(sections)
        zero = np.zeros(self.order)
        impulse = np.zeros(n)
        impulse[0] = 1
        h, _ = self._plain(impulse, zero)
        self.respond = np.zeros((n, n))
        for i in range(n):
            self.respond[i, i:] = h[: n - i]
        free = [self._plain(np.zeros(n), e) for e in np.eye(self.order)]
        self.ring = np.array([y for y, _ in free])
        self.power = np.array([z for _, z in free])
        # registers after the chunk, for a unit at each place of it
        self.load = np.array([self._plain(impulse[: n - i], zero)[1] for i in range(n)])

    def _plain(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, end = x, []
        for k, c in enumerate(self.sections):
            out, z = biquad(out, c, tuple(state[2 * k : 2 * k + 2]))
            end += z
        return out, np.array(end)

    def __call__(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The output and the registers after it."""
        state = np.zeros(self.order) if state is None else np.asarray(state, float)
        n = len(x) // self.CHUNK
        head = x[: n * self.CHUNK].reshape(n, self.CHUNK)
        loads = head @ self.load
        states = np.empty((n, self.order))
        for i in range(n):
            states[i] = state
            state = state @ self.power + loads[i]
        out = (head @ self.respond + states @ self.ring).ravel()
        tail, state = self._plain(x[n * self.CHUNK :], state)
        return np.concatenate([out, tail]), state

    def advance(self, n: int) -> np.ndarray:
        """The matrix that n samples of silence apply to the registers, as rows."""
        rest = np.array([self._plain(np.zeros(n % self.CHUNK), e)[1] for e in np.eye(self.order)])
        return np.linalg.matrix_power(self.power, n // self.CHUNK) @ rest


def weighted_hops(blocks: DataFrame, rates: DataFrame) -> DataFrame:
    """(track, channel, block, ms): mean squares of loudness-weighted tenths of a second.

    Blocks are filtered in parallel from empty registers; their end registers, four numbers a block, are chained per
    channel, and each block is then filtered again from its true start. No channel is gathered in one task."""
    rated = blocks.join(rates.where("status = 'analysed'").select("track", "sample_rate"), "track")
    filters: dict[int, Cascade] = {}

    def cascade(rate: int) -> Cascade:
        return filters.get(rate) or filters.setdefault(rate, Cascade(k_weighting(rate)))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, c, b, r, len(x), cascade(r)(np.asarray(x))[1].tolist()) for t, c, b, r, x in zip(pdf["track"], pdf["channel"], pdf["block"], pdf["sample_rate"], pdf["samples"], strict=True)]
            yield pd.DataFrame(rows, columns=["track", "channel", "block", "sample_rate", "n", "z"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        steps: dict[int, np.ndarray] = {}
        state, begin = np.zeros(4), []
        for rate, n, z in zip(pdf["sample_rate"], pdf["n"], pdf["z"], strict=True):
            begin.append(state.tolist())
            step = steps.get(n)
            if step is None:
                step = steps.setdefault(n, cascade(int(rate)).advance(int(n)))
            state = state @ step + np.asarray(z)
        return pd.DataFrame({"track": pdf["track"], "channel": pdf["channel"], "block": pdf["block"], "begin": begin})

    shape = "track string, channel int, block long, sample_rate int, n long, z array<double>"
    begins = rated.mapInPandas(ends, shape).groupBy("track", "channel").applyInPandas(chain, "track string, channel int, block long, begin array<double>")

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, c, r, start, x, begin in zip(pdf["track"], pdf["channel"], pdf["sample_rate"], pdf["start_frame"], pdf["samples"], pdf["begin"], strict=True):
                y, _ = cascade(r)(np.asarray(x), np.asarray(begin))
                hop = (start + np.arange(len(y))) // (r // 10)
                first = int(hop[0]) if len(hop) else 0
                n = np.bincount(hop - first)
                yield pd.DataFrame({"track": t, "channel": c, "block": first + np.arange(len(n)), "hop": r // 10, "n": n, "s": np.bincount(hop - first, weights=y * y)})

    parts = rated.join(begins, ["track", "channel", "block"]).mapInPandas(squares, "track string, channel int, block long, hop long, n long, s double")
    whole = parts.groupBy("track", "channel", "block").agg(F.sum("n").alias("n"), F.max("hop").alias("hop"), F.sum("s").alias("s"))
    return whole.where("n = hop").select("track", "channel", "block", (F.col("s") / F.col("n")).alias("ms"))


def integrated_loudness(hops: DataFrame) -> DataFrame:
    """Gated programme loudness of each track: channels summed, then the series operator's gates on ready-made hops."""
    from resonant.operators.aggregates import gated_level

    total = hops.groupBy("track", "block").agg(F.sum("ms").alias("p"))
    # a hop of one frame whose square is the hop's power
    return gated_level(total.select(F.col("track").alias("part"), F.col("block").alias("frame"), F.sqrt("p").alias("x")), hop=1).withColumnRenamed("part", "track")
